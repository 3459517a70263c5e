import os

import pytest
from pyspark.sql import functions as F
from samples import FOUR, write

from modspark import format as text
from modspark.operators import windows as W
from modspark.operators.alignment import with_alignment
from modspark.options import Windowing
from modspark.plans import ragged
from modspark.sources import sam

DIR = "/root/testdata/sf0.001"


def refuse(*_):
    raise AssertionError("rows go through the driver")


def test_numbered_lines_are_those_of_the_file(spark, tmp_path, monkeypatch):
    reads = with_alignment(sam.read_sam(spark, write(tmp_path, FOUR)))
    mixed = reads.repartition(3).orderBy(F.desc("rec_no"))
    want = list(text.windows_tsv(W.window_table(W.decode_windows(reads, None, Windowing(2, 1)))))
    monkeypatch.setattr(type(reads), "toLocalIterator", refuse)
    for rows in (mixed, mixed.where("false")):
        lines = text.windows_lines(W.window_table(W.decode_windows(text.in_file_order(rows), None, Windowing(2, 1))))
        assert sorted(map(tuple, lines.collect())) == list(enumerate(want if rows is mixed else want[:1]))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not there")
def test_no_line_goes_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refuse)
    lines = ragged.ragged_window_lines(spark, DIR)
    assert lines.agg(F.count("*"), F.count_distinct("nth"), F.max("nth")).first() == (15617, 15617, 15616)
