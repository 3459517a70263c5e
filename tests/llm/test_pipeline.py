import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import CLASHING, documents
from pyspark.sql import functions as F
from test_line_dedup import brute as line_brute
from test_mixing import check as check_mix
from test_ngram_join import brute as class_brute
from test_packing import check as check_packs

import corpus_pipeline
from modspark.llm import mixing, quality_rules
from modspark.llm.bpe import default_path, encoder


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs, labels):
    to = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{to}/documents.parquet")
    labels.write.parquet(f"{to}/labels.parquet")
    return str(to)


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_do_what_they_say(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
        before, after = rows(docs), rows(out) if k < 4 else None
        if name == "quality_rules":
            kept = quality_rules.apply_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept")
            assert after == rows(kept) and 0 < sum(after.values()) < sum(before.values())
        elif name == "line_dedup":
            want = line_brute([x for x, n in before.items() for _ in range(n)])
            assert sorted(repr((d, t)) for d, t in after.elements()) == sorted(repr((e[0], e[3])) for e in map(eval, want))
        elif name == "ngram_join":
            classes = class_brute([x for x in before if x[0] is not None])
            assert {d for d, _ in after if d is not None} == {c for c, _ in classes.values()}
            assert all(after[x] == before[x] for x in after)
        elif name == "mixing":
            mixed = mixing.mix(docs).collect()
            check_mix(mixed)
            words = sum(len(mixing_words(t)) * n for (_, t), n in after.items())
            assert words == sum(r.taken for r in mixed)
            whole = Counter({(r.doc_id, r.text): sum(d.words == r.size for d in r.draws) for r in mixed})
            assert all(after[x] >= n for x, n in whole.items() if n)
        else:
            ids = [(d, [*encoder(default_path()).ids(t or "").tolist(), 1]) for (d, t), n in before.items() for _ in range(n)]
            check_packs(out.collect(), ids)
        if k < 4:
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")


def mixing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_gives_whole_sequences(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.ids_crc32 for r in out} >= {zlib.crc32(np.array([1], "<u4").tobytes())} or out


def test_own_columns_keep_values_and_types(spark, folder, wide):
    odd = wide.withColumnsRenamed({"kept": "Kept", "size": "SIZE"}).withColumn("Kept", F.lit(7)).withColumn("n_lines", F.array(F.lit("x")))
    names = [c for c in odd.columns if c not in ("doc_id", "text")]
    theirs = {(r.doc_id, repr(r)) for r in odd.select("doc_id", *names).collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        rows_of = {(r.doc_id, repr(r)) for r in out.select("doc_id", *names).collect()}
        assert rows_of and rows_of <= theirs


def test_tables_of_stages_go(spark, folder):
    from modspark import session

    before = session.held()
    corpus_pipeline.run(spark, folder).collect()
    assert len(session.held() - before) <= 4 + 2 + len(corpus_pipeline.STAGES)


def test_clashing_columns_and_empty_tables(spark, folder, empty, wide):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, wide, folder).columns) == {*wide.columns, *CLASHING}
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() >= len(documents())
    nothing = wide.withColumn("text", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, nothing, folder).count()
