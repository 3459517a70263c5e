import numpy as np
import pytest
from conftest_llm import table
from pyspark.sql import functions as F

from modspark.llm import vector_join as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.95):
    good = {}
    for k, v in rows:
        if k is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            good[k] = np.array(v, float)
    ids = sorted({k for k, _ in rows if k is not None})
    up, links = {k: k for k in ids}, dict.fromkeys(ids, 0)

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(good)
    x = np.array([good[k] for k in keys]) if keys else np.zeros((0, 1))
    n = np.linalg.norm(x, axis=1)
    close = (x @ x.T) / np.outer(n, n) >= cosine
    for i, j in np.argwhere(np.triu(close, 1)):
        links[keys[i]] += 1
        links[keys[j]] += 1
        a, b = find(keys[i]), find(keys[j])
        up[max(a, b)] = min(a, b)
    return {k: (links[k], find(k), find(k) == k) for k in ids}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.where("vec_id is not null").collect()}


def vectors(n, groups, spread, seed, width=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    own = centres[draw.integers(0, groups, n)]
    x = own + draw.normal(size=(n, width)) * spread * np.linalg.norm(own, axis=1, keepdims=True) / np.sqrt(width)
    return (x * draw.uniform(0.1, 10, (n, 1))).tolist()


@pytest.mark.parametrize("groups, spread", [(600, 1.0), (25, 0.2), (1, 0.25)])
def test_equals_brute_force(spark, groups, spread):
    rows = [(k, v, 0) for k, v in enumerate(vectors(600, groups, spread, groups))]
    rows += [(1000 + k, rows[5][1], 1) for k in range(40)] + [(2000, [2 * x for x in rows[7][1]], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[0], r[1]) for r in rows])
    for block in (64, 4096):
        assert got(V.cosine_classes(df, block=block)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 0.0], 0), (8, [], 0), (9, [1.0], 0), (2, [2.0, 0.0], 0), (10, [-0.0, 1.0], None), (11, [0.0, 1.0], None), (None, [1.0, 0.0], 0)]
    out = V.cosine_classes(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 12
    assert got(out) == {1: (1, 1, True), 2: (1, 1, False), 10: (1, 10, True), 11: (1, 10, False)} | {k: (0, k, True) for k in range(3, 10)}
    assert [tuple(r) for r in out.where("vec_id is null").collect()] == [(None, 0, None, True)]


def test_every_length_is_joined(spark):
    rows, want = [], {}
    for n, (count, width) in enumerate([(200, 16), (120, 12), (40, 3), (1, 5)]):
        mine = [(1000 * n + k, v, 0) for k, v in enumerate(vectors(count, 10, 0.2, n, width))]
        rows += mine
        want |= brute([(r[0], r[1]) for r in mine])
    assert sum(n for k, (n, _, _) in want.items() if k >= 1000) > 0
    assert got(V.cosine_classes(spark.createDataFrame(rows, SCHEMA), block=64)) == want


def test_pairs_at_the_threshold(spark):
    c = 0.95
    rows = [(1, [1.0, 0.0], 0), (2, [c, (1 - c * c) ** 0.5], 0), (3, [0.949999, -((1 - 0.949999**2) ** 0.5)], 0)]
    assert got(V.cosine_classes(spark.createDataFrame(rows, SCHEMA))) == brute([(r[0], r[1]) for r in rows])


def test_floats_and_clashing_columns(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(200, 10, 0.2, 3))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    wide = df.withColumns({c: F.lit("theirs") for c in ("n_links", "kept", "component_id", "rep", "h", "v", "raw", "place")})
    assert table(V.cosine_classes(wide)) == table(V.cosine_classes(df))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.cosine_classes(none).count() == 0
    assert got(V.cosine_classes(spark.createDataFrame([(1, None, 0)], SCHEMA))) == {1: (0, 1, True)}
