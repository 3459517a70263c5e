"""Each query of the ten over a small folder of tables, against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest_llm import documents
from test_mixing import level
from test_packing import check as check_packs
from test_quality_rules import base
from test_secret_scan import plain
from test_vector_join import brute, vectors

from modspark.llm import queries as Q
from modspark.llm import quality_rules, toxicity
from modspark.llm.bpe import default_path, encoder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs, labels):
    to = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{to}/documents.parquet")
    labels.write.parquet(f"{to}/labels.parquet")
    rows = [(k, v) for k, v in enumerate(vectors(300, 12, 0.25, 3))]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1e200] * 16), (1005, [2e200] * 16), (1006, [1e-200] * 16), (1007, [1.0, 0.0]), (1008, [1.0, 0.01])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{to}/embeddings.parquet")
    return str(to)


def texts():
    return {r[0]: r[1] for r in documents()}


def test_op2(spark, folder):
    out = Q.op2_quality_rules(spark, folder).where("doc_id is not null").collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts()[r.doc_id])
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert len(out) == len(documents()) - 2


def test_op4(spark, folder):
    out = Q.op4_toxicity(spark, folder).collect()
    assert len(out) == len(documents())
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op5(spark, folder):
    ids = [(r[0], [*encoder(default_path()).ids(r[1] or "").tolist(), 1]) for r in documents()]
    n = check_packs(Q.op5_packing(spark, folder).collect(), ids)
    assert n <= sum(len(x) for _, x in ids) // 2048 + 2


def test_op6(spark, folder):
    for r in Q.op6_secret_scan(spark, folder).where("doc_id is not null").collect():
        found = plain(texts()[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in found) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_op7(spark, folder):
    sources = {r[0]: r[3] for r in documents()}
    out = Q.op7_mixing(spark, folder).where("doc_id is not null").collect()
    assert all(0 <= r.taken <= 2 * r.size for r in out) and len(out) == len(documents()) - 2
    held = {sources[r.doc_id]: (r.source_size, r.target) for r in out}
    order = sorted(held, key=lambda s: (s is None, s or ""))
    want = level({s: held[s][0] for s in order}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    assert all(held[s][1] == pytest.approx(want[s]) for s in order)


def test_op9(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    scaled = [(k, None if v is None else [x / 1e200 for x in v] if k in (1004, 1005) else [x * 1e200 for x in v] if k == 1006 else v) for k, v in rows]
    want = brute([(k, v) for k, v in scaled if k < 1007])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.op9_vector_join(spark, folder).collect()}
    assert {k: v for k, v in got.items() if k < 1007} == want
    assert got[1007] == (1, 1007, True) and got[1008] == (1, 1007, False)
    assert got[1005][1] == 1004 == got[1006][1]


@pytest.mark.parametrize("prior, kept_up", [(0.1, True), (0.9, False)])
def test_gradient_by_differences(prior, kept_up):
    draw, n = np.random.default_rng(2), 6

    def sets(rows):
        return toxicity.Sets.of([np.flatnonzero(r).astype(np.int32) for r in rows])

    a, b = draw.random((9, n)) < 0.6, draw.random((11, n)) < 0.3
    w = draw.normal(size=n + 1)
    w[n] = 1.0

    def risks(w):
        p, u = a @ w[:n] + w[n], b @ w[:n] + w[n]
        first = prior * np.log1p(np.exp(-p)).mean()
        second = np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()
        return first, second

    g, second = toxicity.gradient(sets(a), sets(b), w, prior, n)
    assert second == pytest.approx(risks(w)[1]) and (second >= 0) == kept_up
    goal = (lambda w: sum(risks(w))) if kept_up else (lambda w: -risks(w)[1])
    for k in range(n + 1):
        step = np.zeros(n + 1)
        step[k] = 1e-6
        assert g[k] == pytest.approx((goal(w + step) - goal(w - step)) / 2e-6, abs=1e-6)
