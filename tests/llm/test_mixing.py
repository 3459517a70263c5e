import random
from collections import Counter, defaultdict

import pytest
from conftest_llm import documents, prose, table
from pyspark.sql import functions as F

from modspark.llm import mixing


def level(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing again and again what capped sources can't take."""
    most = {s: cap * n for s, n in sizes.items()}
    out, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = most[s]
            left -= most[s]
            free.discard(s)
    return out


def check(rows):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(d.words for d in r.draws)
        assert all(0 < d.words <= r.size for d in r.draws)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    cut = Counter(r.source for r in rows for d in r.draws if d.words < r.size)
    assert all(n == 1 for n in cut.values())


def test_targets_are_met_to_the_word(docs, wide):
    rows = mixing.mix(docs).collect()
    check(rows)
    assert len(rows) == len(documents())
    assert table(mixing.mix(docs.repartition(7)), "doc_id", "taken", "draws") == table(mixing.mix(docs), "doc_id", "taken", "draws")
    assert set(mixing.mix(wide).columns) == set(wide.columns)
    assert table(mixing.mix(wide), "doc_id", "source", "taken", "target") == table(mixing.mix(docs), "doc_id", "source", "taken", "target")


def test_many_sources_and_a_hot_one(spark):
    draw = random.Random(5)
    rows = [(k, prose(draw.randrange(1, 60), k), "hot" if k % 3 == 0 else f"s{draw.randrange(40):02d}") for k in range(900)]
    check(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_shards_are_even_and_whole(spark):
    rows = [(k, "word " * 10, f"s{k % 4}") for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, levels=3)
    words = {r.shard: r.n for r in mixed.select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("n")).collect()}
    assert set(words) == set(range(8)) and max(words.values()) < 1.5 * min(words.values())
    out = mixing.shard_rows(mixed, df.columns)
    assert out.columns == df.columns
    assert out.select(F.sum(mixing.word_count("text"))).first()[0] == sum(words.values())


def test_splitting_tree_keeps_quotas(spark):
    quotas = {1: 700, 2: 3, 3: 0, 4: 41, 5: 256}
    for seed in (1, 2):
        out = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "number int, quota long"), 4, seed).collect()
        by_source, by_shard = defaultdict(int), defaultdict(int)
        for r in out:
            assert r.quota >= 0
            by_source[r.number] += r.quota
            by_shard[r.shard] += r.quota
        assert by_source == quotas
        assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 4


def test_draws_follow_the_hypergeometric_law(spark):
    rows = spark.range(4000).select(F.expr(mixing._draw("30L", "12L", "10L", "((id + 0.5D) / 4000)")).alias("x"))
    found = Counter(r.x for r in rows.collect())
    from math import comb

    for x in range(11):
        want = comb(12, x) * comb(18, 10 - x) / comb(30, 10)
        assert found[x] / 4000 == pytest.approx(want, abs=0.001)


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c d",), ("a b c d",), ("a\t\tb  c d ",)], "t string")
    out = [r.x for r in df.select(mixing.first_words(F.col("t"), F.lit(2)).alias("x")).collect()]
    assert out == ["  a b\n ", "a b ", "a\t\tb  "]


def test_empty(empty, docs):
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}
