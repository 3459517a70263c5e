import json
import random

import pytest
from samples import FORTY, FOUR, IMPLICIT, INDEL, QUALITIES, ZERO, line, write

from modspark import format as text
from modspark.errors import InvalidOption, InvalidSummary
from modspark.operators import peek, read_info, read_stats, read_table
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import decode
from modspark.options import ModFilter, ReadFilter, SeqDisplay
from modspark.operators.record_filters import by_sample, filter_reads
from modspark.sources import sam, tables


def load(spark, tmp_path, records):
    return sam.read_sam(spark, write(tmp_path, records))


def table(spark, tmp_path, records, **more):
    return text.sorted_lines(text.read_table_tsv(read_table.read_table(load(spark, tmp_path, records), **more)))


def test_read_table(spark, tmp_path):
    assert table(spark, tmp_path, FOUR, mods=ModFilter()) == [
        "# mod-unmod threshold is 0.5",
        "read_id\talign_length\tsequence_length_template\talignment_type\tmod_count",
        "read-a\t10\t10\tprimary_forward\tm:0",
        "read-b\t40, 0\t40\tprimary_forward, unmapped\tNA, m:2;4321:0",
        "read-c\t24\t24\tprimary_reverse\tm:2",
    ]
    assert table(spark, tmp_path, ZERO)[1:] == ["read1\t8\t0\tprimary_forward", "read2\t40\t40\tprimary_forward"]
    assert table(spark, tmp_path, ZERO, mods=ModFilter())[2:] == ["read1\t8\t0\tprimary_forward\tNA", "read2\t40\t40\tprimary_forward\tNA"]


def test_sequences(spark, tmp_path):
    def shown(records, **display):
        return [x.split("\t")[4:] for x in table(spark, tmp_path, records, display=SeqDisplay(**display))[1:]]

    assert shown(QUALITIES, full=True, show_base_qual=True) == [["ACCTGCAC", "28.0.50.15.32.53.2.42"]]
    assert shown(QUALITIES, region=("north", 22, 25), show_base_qual=True) == [["CTG", "50.15.32"]]
    assert shown(QUALITIES, region=("south", 22, 25), show_base_qual=True) == [["*", "255"]]
    assert shown(INDEL, region=("north", 0, 22)) == [["CA.TCCGAC"]]
    assert shown(INDEL, region=("north", 0, 22), show_ins_lowercase=True) == [["CA.tcCGAC"]]
    assert shown(ZERO, full=True, show_base_qual=True)[0] == ["*", "255"]
    z = [line("r", 0, "north", 1, 0, "1M1I2M", "ACCC", "*", "C+m?,0,0;", (200, 210))]
    out = table(spark, tmp_path, z, mods=ModFilter(), display=SeqDisplay(region=("north", 0, 22), show_mod_z=True, show_ins_lowercase=True, show_base_qual=True))
    assert out[-1].split("\t")[4:] == ["m:2", "AzZC", "255.255.255.255"]


def test_summary(spark, tmp_path):
    path = tmp_path / "summary"
    path.write_text("# a comment\nread_id\tsequence_length_template\tother\nread-a\t8\t0\n\nread-c\t99\t1\nread-x\t5\t2\n")
    out = read_table.read_table(load(spark, tmp_path, FOUR), None, None, tables.sequencing_summary(spark, str(path)))
    assert text.sorted_lines(text.read_table_tsv(out, "summary")) == [
        "# seq summ file: summary", "read_id\talign_length\tsequence_length_template\talignment_type", "read-a\t10\t8\tprimary_forward", "read-c\t24\t99\tprimary_reverse",
    ]
    for bad in ("", "\nread_id\tsequence_length_template\nx\t1\n", "read_id\tx\na\t1\n", "read_id\tread_id\tsequence_length_template\na\tb\t1\n", "read_id\tsequence_length_template\n", "#c\n" * 1001 + "read_id\tsequence_length_template\na\t1\n"):
        path.write_text(bad)
        with pytest.raises(InvalidSummary):
            tables.sequencing_summary(spark, str(path))
    for bad, what in (("a\tx", "length"), ("a\t", "length"), ("\t5", "read id"), ("'a'\t5", "read id"), ("a" * 51 + "\t5", "read id"), ("a\t5\na\t5", "twice"), ("a\t5\n# c", "comment"), ("a\t5\t" + "x" * 1000, "too long")):
        path.write_text(f"read_id\tsequence_length_template\n{bad}\n")
        with pytest.raises(Exception, match=what):
            tables.sequencing_summary(spark, str(path)).collect()


def test_read_ids(spark, tmp_path):
    path = tmp_path / "ids"
    path.write_text(" read-a \n# no\n\nread-b\nread-b\nnobody\n")
    assert sorted(r.read_id for r in tables.read_ids(spark, str(path)).collect()) == ["nobody", "read-a", "read-b"]
    rows = load(spark, tmp_path, FOUR)
    assert [r.read_id for r in filter_reads(rows, ReadFilter(read_id_list=str(path))).orderBy("rec_no").collect()] == ["read-a", "read-b", "read-b"]
    assert filter_reads(rows, ReadFilter(read_ids=frozenset(["read-c"]))).count() == 1
    many = frozenset([f"x{k}" for k in range(2000)] + ["read-b"])
    assert filter_reads(rows, ReadFilter(read_ids=many)).count() == 2


def test_sampling(spark):
    from pyspark.sql import functions as F

    rows = spark.range(10_000).select((F.col("id") % 5000).cast("string").alias("read_id"))
    n = rows.where(by_sample(F.col("read_id"), 0.5, None)).count()
    assert 4500 < n < 5500
    kept = rows.where(by_sample(F.col("read_id"), 0.5, 3)).groupBy("read_id").count().collect()
    assert 2250 < len(kept) < 2750 and {r["count"] for r in kept} == {2}
    assert rows.where(by_sample(F.col("read_id"), 0.0, 3)).count() == 0 and rows.where(by_sample(F.col("read_id"), 1.0, None)).count() == 10_000


def plain_stats(lengths):
    """By the book: from the longest down."""
    if not lengths:
        return 0, 0, 0, 0, 0
    down, total, run, n50 = sorted(lengths, reverse=True), sum(lengths), 0, 0
    for x in down:
        run += x
        if n50 == 0 and run > -(-total // 2):
            n50 = x
    k = -(-len(down) // 2)
    return total // len(down), down[0], down[-1], down[k] if k < len(down) else 0, n50


def test_length_statistics(spark):
    draw = random.Random(3)
    cases = [[48], [48, 33], [48, 33, 8], [5, 5, 5, 5], [1, 1], []] + [[draw.randrange(1, 30) for _ in range(draw.randrange(1, 40))] for _ in range(20)]
    rows = [(k, x) for k, c in enumerate(cases) for x in c]
    out = {r.k: tuple(r)[1:] for r in read_stats.length_stats(spark.createDataFrame(rows, "k int, length int"), ("k",)).collect()}
    for k, c in enumerate(cases):
        assert out.get(k, (0,) * 5) == plain_stats(c)


def test_read_statistics(spark, tmp_path):
    out = {r.key: r.value for r in read_stats.read_stats(load(spark, tmp_path, FOUR)).collect()}
    assert set(out) == set(read_stats.KEYS)
    assert [out[k] for k in read_stats.COUNTS] == [3, 0, 0, 1, 1]
    assert (out["align_len_mean"], out["align_len_median"], out["seq_len_median"]) == (24, 10, plain_stats([10, 40, 24, 14])[3])
    only = {r.key: r.value for r in read_stats.read_stats(load(spark, tmp_path, FOUR[3:])).collect()}
    assert only["align_len_n50"] == 0 and only["seq_len_max"] == 14
    with pytest.raises(Exception, match="length 0"):
        read_stats.read_stats(load(spark, tmp_path, ZERO)).collect()


def test_read_info(spark, tmp_path):
    rows = load(spark, tmp_path, FOUR)
    out = json.loads("\n".join(text.json_array(read_info.read_info(rows))))
    assert out[0] == {
        "read_id": "read-a", "sequence_length": 10, "mapq": 40, "contig": "north", "reference_start": 5, "reference_end": 15, "alignment_length": 10, "alignment_type": "primary_forward",
        "mod_count": "C+m:0;(probabilities >= 0.5020, PHRED base qual >= 0)",
    }
    assert out[1]["mod_count"] == "NA" and "contig" not in out[3]
    assert out[3]["mod_count"] == "C+m:2;G-4321:0;(probabilities >= 0.5020, PHRED base qual >= 0)"
    detail = read_info.read_info(rows, detail=True)
    assert detail.orderBy("rec_no").first().json == '{"alignment_type":"primary_forward","alignment":{"start":5,"end":15,"contig":"north","contig_id":0},"mod_table":[{"base":"C","is_strand_plus":true,"mod_code":"m","data":[[2,7,12],[3,8,30],[8,13,55]]}],"read_id":"read-a","mapq":40,"seq_len":10}'
    assert "".join(text.json_array(detail.where("false"))) == "[]"
    assert len("\n".join(text.json_array(detail, True)).splitlines()) > 100
    back = read_info.from_json(detail).select("read_id", "flag", "pos", "tracks")
    reads = decode(with_alignment(rows)).select("read_id", "flag", "pos", "tracks").withColumn("pos", __import__("pyspark").sql.functions.expr("if(flag = 4, null, pos)"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, reads.collect()))
    assert read_info.reads_table(decode(with_alignment(rows))).count() == 13


def test_json_checks(spark):
    good = {"alignment_type": "primary_forward", "alignment": {"start": 5, "end": 15, "contig": "c", "contig_id": 0}, "mod_table": [{"base": "C", "is_strand_plus": True, "mod_code": "m", "data": [[1, 6, 9], [3, -1, 200]]}], "read_id": "r", "seq_len": 10}
    track = good["mod_table"][0]
    bad = [
        {"alignment_type": "odd"}, {"alignment_type": "unmapped"}, {"alignment": None}, {"seq_len": 0}, {"alignment": {"start": 9, "end": 9, "contig": "c", "contig_id": 0}},
        {"mod_table": [track | {"data": [[3, 6, 9], [1, 7, 9]]}]}, {"mod_table": [track | {"data": [[10, 6, 9]]}]}, {"mod_table": [track | {"data": [[1, 15, 9]]}]},
        {"mod_table": [track | {"data": [[1, 6, 300]]}]}, {"mod_table": [track | {"data": [[1, 6]]}]}, {"mod_table": [track, track | {"base": "A"}]},
    ]
    df = spark.createDataFrame([(json.dumps(good),), *((json.dumps(good | b),) for b in bad)], "json string")
    out = read_info.from_json(df, mode="permissive").collect()
    assert out[0].problems == [] and out[0].mapq == 255 and [c.ref_pos for c in out[0].tracks[0].calls] == [6, None]
    assert all(r.problems for r in out[1:])
    for b in bad:
        with pytest.raises(Exception, match="read r"):
            read_info.from_json(spark.createDataFrame([(json.dumps(good | b),)], "json string")).collect()


def test_peek(spark, tmp_path):
    path = write(tmp_path, FOUR)
    rows = sam.read_sam(spark, path)
    lines = list(text.peek_text(peek.contig_rows(sam.contigs(spark, path)), peek.modifications(rows)))
    assert lines == ["contigs_and_lengths:", "north\t30", "south\t60", "west\t90", "", "modifications:", "C+m", "G-4321"]
    assert [r.modification for r in peek.modifications(rows, 3).collect()] == ["C+m"]
    assert list(text.peek_text(peek.contig_rows(sam.contigs(spark, path)), peek.modifications(load(spark, tmp_path, ZERO))))[-1] == "None"
    for n in (0, 100_001):
        with pytest.raises(InvalidOption):
            peek.modifications(rows, n)
    many = [line(f"r{k}", 4, "*", 0, 0, "*", "A", "*", f"A+{1000 + k}?;", ()) for k in range(101)]
    with pytest.raises(Exception, match="more than 100"):
        peek.modifications(load(spark, tmp_path, many), 200).collect()


def test_text_helpers():
    assert text.sorted_lines("#h\nb\na") == ["#h", "a", "b"]
    assert text.sorted_lines("read_id\tx\nb\na") == ["read_id\tx", "a", "b"]
    assert len(FORTY) == 40 and len(IMPLICIT) == 3
