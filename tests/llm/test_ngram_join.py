import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import documents, near, prose, table

from modspark.llm import ngram_join
from modspark.llm.components import components
from modspark.llm.text import steps, utf8

pytestmark = pytest.mark.usefixtures("spark")


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sets(rows):
    out = {}
    for doc, text in rows:
        w = words_of(text)
        out[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    return out


def brute(rows, threshold=0.8):
    s = sets(rows)
    up, links = {d: d for d in s}, Counter()

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(s[a] & s[b])
            if both and both / (len(s[a]) + len(s[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.where("doc_id is not null").collect()}


def test_equals_brute_force(docs):
    want = brute([(r[0], r[1]) for r in documents() if r[0] is not None])
    found = ngram_join.jaccard_classes(docs)
    assert got(found) == want
    assert [(r.class_id, r.n_links) for r in found.where("doc_id is null").collect()] == [(None, 0), (None, 0)]


def test_blocks_of_a_large_unit_lose_nothing(spark):
    base = prose(200, 1)
    rows = [(k, near(base, 0.02, k)) for k in range(80)] + [(100 + k, base) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for c, _ in want.values()}) < 90
    for block in (7, 1000):
        assert got(ngram_join.jaccard_classes(df, block=block)) == want


def test_clashing_columns_and_keep_one(docs, wide):
    assert table(ngram_join.jaccard_classes(wide)) == table(ngram_join.jaccard_classes(docs))
    kept = ngram_join.keep_one(wide)
    assert kept.columns == wide.columns
    classes = got(ngram_join.jaccard_classes(docs))
    rows = [r.doc_id for r in kept.collect()]
    assert {d for d in rows if d is not None} == {c for c, _ in classes.values()}
    assert rows.count(None) == 2


def test_empty(empty):
    assert ngram_join.jaccard_classes(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_prefixes_shorten_until_the_recall_is_reached():
    depth = ngram_join.prefix_length(0.8, 20, 8, 0.9995)
    assert 1 - (1 - 0.8**depth) ** 20 >= 0.9995 > 1 - (1 - 0.8 ** (depth + 1)) ** 20
    assert ngram_join.prefix_length(0.95, 20, 8, 0.9995) == 8
    assert ngram_join.prefix_length(0.8, 20, 8, 1.1) == 1


def made_pairs(n, low, high):
    """Pairs of texts whose exact similarity lies in [low, high]."""
    draw, out = random.Random(8), []
    while len(out) < n:
        words = [f"w{draw.randrange(10**9)}" for _ in range(draw.randrange(60, 160))]
        other = list(words)
        for _ in range(draw.randrange(1, 4)):
            other[draw.randrange(len(other))] = f"v{draw.randrange(10**9)}"
        a, b = sets([(0, " ".join(words)), (1, " ".join(other))]).values()
        if low <= len(a & b) / len(a | b) <= high:
            out.append((" ".join(words), " ".join(other)))
    return out


def test_recall_near_the_threshold():
    least = ngram_join.prefix_length()
    texts = [t for pair in made_pairs(4000, 0.8, 0.85) for t in pair]
    data, at = utf8(pa.array(texts))
    parts = [ngram_join.tree_labels(*ngram_join.shingles(d, a, 5), ngram_join.TREES, least, ngram_join.LONGEST)[0] for _, _, d, a in steps(data, at)]
    tops = np.concatenate(parts)
    assert (tops[::2] == tops[1::2]).any(1).mean() >= 0.999


@pytest.mark.parametrize("few", [0, 256])
def test_prefixes_are_shortened_only_where_something_is_left(spark, monkeypatch, few):
    close = prose(400, 41)
    rows = [(k, near(close, 0.002, k)) for k in range(120)]  # agree on whole labels somewhere
    rows += [(1000 + 2 * k + i, t) for k, pair in enumerate(made_pairs(120, 0.8, 0.84)) for i, t in enumerate(pair)]
    rounds, plain = [], ngram_join._round

    def watched(tries, *rest):
        rounds.append({r.rep for r in tries.select("rep").distinct().collect()})
        return plain(tries, *rest)

    monkeypatch.setattr(ngram_join, "_round", watched)
    monkeypatch.setattr(ngram_join, "FEW", few)
    assert got(ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), longest=7)) == brute(rows)
    assert len(rounds) > 1 and all(a > b for a, b in zip(rounds, rounds[1:]))
    assert len([r for r in rounds[1] if r < 1000]) < 60 and any(r >= 1000 for r in rounds[1])


def test_heavy_sets_are_dealt_into_parts(spark):
    base = prose(300, 6)
    rows = [(k, near(base, 0.01, k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.jaccard_classes(df, weight=1000)) == brute(rows)


def test_mark_misses_no_id(spark):
    from pyspark.sql import functions as F

    from modspark.llm.members import marked

    ids = spark.range(0, 3000, 7).select(F.col("id").alias("x"))
    rows = spark.range(-5, 3000).select(F.when(F.col("id") >= 0, F.col("id")).alias("id"), F.lit("z").alias("__piece_"))
    out = marked(rows, "id", ids, "may").collect()
    assert len(out) == 3005
    assert all(r.may for r in out if r.id is not None and r.id % 7 == 0)
    assert not any(r.may for r in out if r.id is None) and sum(r.may for r in out) < 0.25 * len(out)


def test_components(spark):
    import random

    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    around = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            around[a].add(b)
            around[b].add(a)
    for n in around:
        seen, todo = {n}, [n]
        while todo:
            for m in around[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert found[n] == min(seen)
    assert set(found) == set(around)
