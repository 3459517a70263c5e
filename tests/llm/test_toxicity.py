import random
import zlib

import pytest
from conftest_llm import documents, prose, table

from modspark.llm import toxicity as X


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(4)
    rows, marks = [], []
    for k in range(1500):
        words, toxic = prose(80, k).split(" "), k % 8 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(("grumbold", "Snivelwort,", "zapfnuts", "grumboldig")))
        rows.append((k, " ".join(words)))
        if k % 3:
            marks.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    out = X.score_toxicity(docs, labels).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.doc_id % 8 == 0, r.predicted == 1, r.score) for r in out if r.held_out]
    assert sum(a == b for a, b, _ in held) / len(held) > 0.97
    assert min(s for a, _, s in held if a) > sorted(s for a, _, s in held if not a)[-3]


def test_labels_of_held_out_rows_say_nothing(spark, corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert table(X.score_toxicity(docs, turned)) == table(X.score_toxicity(docs, labels))


def test_a_huge_text_leaves_the_others_in(spark, corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    first = docs.join(labels, "doc_id").where((F.col("toxic") == 1) & ~X.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    huge = docs.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.repeat(F.lit(" la"), 7_000_000))).otherwise(F.col("text")))
    out = [r for r in X.score_toxicity(huge, labels).collect() if r.held_out]
    assert sum((r.doc_id % 8 == 0) == (r.predicted == 1) for r in out) / len(out) > 0.97


def test_odd_rows(spark, docs, wide, labels, empty):
    out = X.score_toxicity(docs, labels)
    assert out.count() == len(documents())
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert table(X.score_toxicity(wide, labels)) == table(out)
    assert X.score_toxicity(empty, labels).count() == 0
    assert {r.score < 1e-5 for r in X.score_toxicity(docs, labels.where("false")).collect()} == {True}


def test_risk_is_kept_from_going_below_zero():
    import numpy as np

    p, u = X.Sets(np.array([0, 0]), np.array([0, 1, 2])), X.Sets(np.array([0, 1, 1, 1]), np.array([0, 1, 2, 3, 4]))
    w, b = X.train(p, u, 0.25, 2, 0, 200)
    assert X.sigmoid(w[0] + b) > 2 * X.sigmoid(w[1] + b)
    assert np.isfinite(w).all() and abs(w).max() < 10
