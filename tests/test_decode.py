import random

import numpy as np
import pytest
from samples import FOUR, IMPLICIT, INDEL, QUALITIES, SHORT_QUALITY, ZERO, line, write

from modspark.errors import InvalidTag
from modspark.functions.sequence import query_over_reference, reference_positions, reverse_complement_text
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import calls, counts_per_code, decode, decode_record, limit_to_region, parse_mm, trim_to_region
from modspark.options import ModFilter, Threshold
from modspark.sources import sam


def reads(spark, tmp_path, records, zero_len=False):
    return with_alignment(sam.read_sam(spark, write(tmp_path, records)), zero_len)


def found(df):
    return {(r.rec_no, r.read_id): [(t.base, t.strand, t.mod_code, [(c.pos, c.ref_pos, c.qual) for c in t.calls]) for t in r.tracks] for r in df.collect()}


def values(df):
    return list(found(df).values())


def test_groups():
    g = parse_mm("C+m?,1,0;A-7200.;N+T,3;")
    assert [(x.base, x.strand, x.code, x.explicit, x.skipped.tolist()) for x in g] == [("C", "+", "m", True, [1, 0]), ("A", "-", "7200", False, []), ("N", "+", "T", False, [3])]
    assert parse_mm("") == []
    assert [(x.explicit, x.skipped.tolist()) for x in parse_mm("C+m,;A+a, 1 ,,+2;T+t?3;G+g.,;")] == [(False, []), (False, [1, 2]), (True, [3]), (False, [])]
    for bad in ("C+m?,1", ";", "C+mh,1;", "C+m\n;", "C+m,1 2;", "C+m,x;", "Z+m,1;", "C*m,1;", "C+,1;", "C+m,-1;", "C+55296;", "C+m;;"):
        with pytest.raises(InvalidTag):
            parse_mm(bad)


def test_forward_reverse_and_unmapped(spark, tmp_path):
    out = values(decode(reads(spark, tmp_path, FOUR)))
    assert out[0] == [("C", "+", "m", [(2, 7, 12), (3, 8, 30), (8, 13, 55)])]
    assert out[1] == []
    assert out[2] == [("C", "+", "m", [(2, 12, 140), (9, 19, 9), (15, 25, 7), (18, 28, 201)])]
    assert [(*t[:3], [(c[0], c[2]) for c in t[3]]) for t in out[3]] == [("C", "+", "m", [(4, 220), (7, 131), (13, 20)]), ("G", "-", "4321", [(0, 5), (5, 60), (9, 0)])]
    assert all(ref is None for t in out[3] for _, ref, _ in t[3])


def test_deletions_and_insertions(spark, tmp_path):
    assert values(decode(reads(spark, tmp_path, INDEL))) == [[("C", "+", "m", [(0, 3, 10), (3, None, 90), (4, 6, 77), (7, 9, 21)])]]


def test_implicit_calls_depend_on_the_threshold(spark, tmp_path):
    rows = reads(spark, tmp_path, IMPLICIT)
    assert [len(t[0][3]) for t in values(decode(rows))] == [5, 2, 5]
    above = decode(rows, ModFilter(threshold=Threshold(1)))
    assert [len(t[0][3]) for t in values(above)] == [2, 2, 2]
    reverse = values(decode(rows))[2][0]
    assert reverse[:3] == ("G", "+", "g") and [(c[0], c[2]) for c in reverse[3]] == [(1, 0), (2, 0), (5, 140), (8, 66), (9, 0)] and reverse[3][-1][1] is None


def test_conditions_on_calls(spark, tmp_path):
    q = reads(spark, tmp_path, QUALITIES)
    assert values(decode(q, ModFilter(base_qual=40))) == [[("C", "+", "m", [(5, 25, 44), (7, 27, 90)])]]
    assert values(decode(q, ModFilter(trim_read_ends=1))) == [[("C", "+", "m", [(1, 21, 8), (5, 25, 44)])]]
    assert values(decode(q, ModFilter(trim_read_ends=5))) == [[("C", "+", "m", [])]]
    assert values(decode(q, ModFilter(tag="a"))) == [[]]
    assert values(decode(q, ModFilter(mod_strand="bc_comp"))) == [[]]
    assert values(decode(q, ModFilter(threshold=Threshold(0, (40, 60))))) == [[("C", "+", "m", [(1, 21, 8), (7, 27, 90)])]]
    assert values(decode(q, wanted=lambda b, s, c: b == "G")) == [[]]
    assert values(decode(q, position=lambda x: x < 4)) == [[("C", "+", "m", [(1, 21, 8)])]]
    four = reads(spark, tmp_path, FOUR)
    none = values(decode(four, ModFilter(base_qual=1)))
    assert none[0] == [("C", "+", "m", [])]
    end = values(decode(four, ModFilter(trim_read_ends=5)))[2]
    assert [c[0] for c in end[0][3]] == [9, 15, 18]  # both ends of the strand that was read


def test_regions(spark, tmp_path):
    four = reads(spark, tmp_path, FOUR)
    part = values(decode(four, ModFilter(region=("north", 8, 14))))
    assert part[0] == [("C", "+", "m", [(3, 8, 30), (8, 13, 55)])]
    assert part[2] == [("C", "+", "m", [])] and part[3] == [("C", "+", "m", []), ("G", "-", "4321", [])]
    clip = reads(spark, tmp_path, IMPLICIT)
    whole = values(decode(clip, ModFilter(region=("north", 0, 30))))
    assert whole[1][0][3][-1] == (5, 7, 140) and len(whole[0][0][3]) == 5  # the clipped call too
    cut = values(decode(clip, ModFilter(region=("north", 0, 9))))
    assert [c[0] for c in cut[0][0][3]] == [1, 2, 5]


def test_calls_between_hits_stay():
    from modspark.operators.decode import Track

    t = Track("T", "+", "T", np.arange(6), np.array([5, -1, 7, -1, 9, -1]), np.arange(6))
    assert trim_to_region(t, 5, 8).pos.tolist() == [0, 1, 2]
    assert trim_to_region(t, 20, 30).pos.tolist() == []
    with pytest.raises(InvalidTag):
        trim_to_region(Track("T", "+", "T", np.arange(2), np.array([5, 4]), np.arange(2)), 0, 9)
    assert limit_to_region([t], ("x", 0, 99), True, "x", 5, 10)[0] is t


def test_bad_records(spark, tmp_path):
    seq = "ACCTGCAC"
    bad = {
        "more calls": ("C+m?,0,0,0,5;", (1, 2, 3, 4)),
        "few chances": ("C+m?,0,0;", (1,)),
        "many chances": ("C+m?,0;", (1, 2)),
        "twice": ("C+m?,0;G+m?,0;", (1, 2)),
        "no grammar": ("C+m?,0", (1,)),
    }
    for mm, ml in bad.values():
        with pytest.raises(InvalidTag):
            decode_record(0, "x", 0, "8M", seq, None, mm, list(ml), ModFilter())
    twice = decode_record(0, "x", 0, "8M", seq, None, "C+m?,0;G+m?,0;A+a;", [1, 2], ModFilter(tag="a"))
    assert [t.code for t in twice] == ["a"]  # unwanted groups may come twice
    with pytest.raises(Exception, match="qualities"):
        decode(reads(spark, tmp_path, SHORT_QUALITY)).collect()
    row = decode(reads(spark, tmp_path, SHORT_QUALITY), mode="permissive").first()
    assert row.tracks is None and "InvalidTag" in row.error
    both = line("x", 0, "north", 1, 0, "2M", "AC", "*", "C+m?,0;", (1,)).rstrip("\n") + "\tMm:Z:C+m?,0;\n"
    with pytest.raises(Exception, match="both"):
        sam.read_sam(spark, write(tmp_path, [both])).collect()
    with pytest.raises(Exception, match="type Z"):
        sam.read_sam(spark, write(tmp_path, [line("x", 0, "north", 1, 0, "2M", "AC").rstrip("\n") + "\tMM:i:5\n"])).collect()
    small = sam.read_sam(spark, write(tmp_path, [line("x", 0, "north", 1, 0, "2M", "AC", "*", "C+m?,0;", (1,), ("Mm", "Ml"))])).first()
    assert (small.mm, small.ml) == ("C+m?,0;", [1])


def test_zero_length(spark, tmp_path):
    with pytest.raises(Exception, match="length 0"):
        reads(spark, tmp_path, ZERO).collect()
    assert values(decode(reads(spark, tmp_path, ZERO, zero_len=True))) == [[], []]


def test_flags(spark, tmp_path):
    for flag in (1, 20, 1024, 2304, 512):
        with pytest.raises(Exception, match="read state"):
            reads(spark, tmp_path, [line("x", flag, "north", 1, 0, "2M", "AC")]).collect()
    with pytest.raises(Exception, match="covers nothing"):
        reads(spark, tmp_path, [line("x", 0, "north", 1, 0, "2S", "AC")]).collect()


def test_calls_and_counts(spark, tmp_path):
    df = decode(reads(spark, tmp_path, FOUR))
    assert calls(df).count() == 3 + 4 + 6
    n = df.select(counts_per_code("tracks").alias("n")).collect()
    assert [(c.mod_code, c.n) for c in n[3].n] == [("m", 3), ("4321", 3)]  # by code point


def spelled(seq, reverse, groups):
    """Positions of calls, one base after the other."""
    forward = reverse_complement_text(seq) if reverse else seq
    out = []
    for base, skipped in groups:
        k, wanted, at = 0, list(skipped), []
        for i, c in enumerate(forward):
            if not wanted:
                break
            if base in ("N", c):
                if k == wanted[0]:
                    at.append(i)
                    wanted.pop(0)
                    k = 0
                else:
                    k += 1
        out.append(sorted(len(seq) - 1 - i for i in at) if reverse else at)
    return out


def test_against_a_walk_over_bases():
    draw = random.Random(1)
    for _ in range(200):
        seq = "".join(draw.choice("ACGT") for _ in range(60))
        reverse = draw.random() < 0.5
        groups = [(b, [draw.randrange(3) for _ in range(draw.randrange(4))]) for b in ("C", "N")]
        mm = "".join(f"{b}+{c}?{''.join(f',{x}' for x in s)};" for (b, s), c in zip(groups, "mx"))
        ml = [draw.randrange(256) for _, s in groups for _ in s]
        tracks = decode_record(16 * reverse, "x", 5, "60M", seq, None, mm, ml, ModFilter())
        assert [t.pos.tolist() for t in tracks] == spelled(seq, reverse, groups)


def test_cigar_arithmetic():
    assert reference_positions("2S3M1I2M2D1M1S", 10, 10).tolist() == [-1, -1, 10, 11, 12, -1, 13, 14, 17, -1]
    query, aligned = query_over_reference("2S3M1I2M2D1M1S", 10, 12, 18)
    assert query.tolist() == [4, 5, 6, 7, -1, -1, 8] and aligned.tolist() == [True, False, True, True, True, True, True]
    query, _ = query_over_reference("2S3M1I2M2D1M1S", 10, 10, 13)
    assert query.tolist() == [2, 3, 4]  # the insertion at the end is cut
    assert query_over_reference("3M", 10, 20, 30) is None


def test_dense_calls(spark, tmp_path):
    from pyspark.sql import functions as F

    from modspark.operators import dense

    df = dense.with_dense_calls(decode(reads(spark, tmp_path, FOUR)))
    out = df.select("rec_no", "seq_len", "dense", dense.mod_types().alias("t"), dense.mod_calls(3).alias("three"), dense.mod_calls(F.col("seq_len")).alias("outside"), dense.modified_mask().alias("mask"), "tracks").orderBy("rec_no").collect()
    assert out[0].dense == [[0, 0, 12, 30, 0, 0, 0, 0, 55, 0]] and out[0].three == [30] and out[0].outside is None
    assert out[0].mask == [False, False, True, True, False, False, False, False, True, False]
    assert out[1].dense == [] and out[1].mask == [False] * 40
    assert [tuple(t) for t in out[3].t] == [("C", "+", "m"), ("G", "-", "4321")]
    for r in out:
        assert all(len(row) == r.seq_len for row in r.dense)
        assert [sum(x > 0 for x in row) for row in r.dense] == [sum(c.qual > 0 for c in t.calls) for t in r.tracks]


def test_calls_in_sql(spark, tmp_path):
    from modspark.operators import sql

    sql.register(spark)
    sam.read_sam(spark, write(tmp_path, FOUR)).createOrReplaceTempView("reads_of_sql")
    out = spark.sql("select rec_no, c.* from reads_of_sql, lateral mm_ml_calls(flag, contig, pos, cigar, seq, qual, mm, ml) c")
    want = calls(decode(reads(spark, tmp_path, FOUR))).select("rec_no", "track_no", "base", "mod_strand", "mod_code", "pos", "ref_pos", "qual")
    assert sorted(tuple(map(str, r)) for r in out.collect()) == sorted(tuple(map(str, r)) for r in want.collect())
