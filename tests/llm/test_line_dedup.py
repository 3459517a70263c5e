import hashlib
import re
from collections import defaultdict

from conftest_llm import documents, table
from pyspark.sql import functions as F

from modspark.llm import line_dedup
from modspark.llm.queries import op3_line_dedup


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), k)

    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in df.collect())


def test_equals_brute_force(docs, wide):
    want = brute([(r[0], r[1]) for r in documents()])
    assert any("SENTENCE" not in x and ", 1, " in x for x in want)
    assert rows_of(line_dedup.dedup_lines(docs)) == want
    out = line_dedup.dedup_lines(wide)
    assert rows_of(out) == want
    assert set(out.columns) == set(wide.columns)


def test_a_key_in_code_points(spark):
    line = "éé éé éé éé éé éé éé"  # 20 code points, more bytes
    df = spark.createDataFrame([(k, f"{line}\n{line[1:]}\nx{k}") for k in range(3)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [out[k].n_dropped for k in range(3)] == [1, 1, 0]
    assert out[0].text == f"{line[1:]}\nx0"


def test_repeats_of_one_document_are_one_document(spark):
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(1, line)] * 4 + [(2, f"{line}\n{line}")], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {0}
    more = df.union(spark.createDataFrame([(3, line)], df.schema))
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(more).collect()) == [(1, 1)] * 4 + [(2, 2), (3, 0)]


def test_hash_of_what_stays(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op3_line_dedup(spark, str(tmp_path))
    kept = line_dedup.dedup_lines(docs).select("doc_id", "text").collect()
    assert sorted(r.kept_sha256 for r in found.collect()) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept)


def test_empty(empty):
    out = line_dedup.dedup_lines(empty)
    assert out.count() == 0
    assert table(out.select(F.col("doc_id"))) == []
