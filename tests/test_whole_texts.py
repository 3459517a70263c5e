"""Registered queries over whole texts, against plain Python."""

import os

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from modspark.functions.sequence import reverse_complement_text

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not there")


def test_sequence_functions_take_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assert max(map(len, texts.values())) > 200
    upper = str.maketrans("acgtn", "ACGTN")
    got = {r.doc_id: (r.turned, r.upper_bases) for r in entry.queries()["sequence_functions"](spark, DIR).collect()}
    assert got == {k: (reverse_complement_text(t), t.translate(upper)) for k, t in texts.items()}
