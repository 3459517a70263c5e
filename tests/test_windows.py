import math
import random

import numpy as np
import pytest
from samples import FOUR, INDEL, write

from modspark import format as text
from modspark.errors import EmptyWindow, InsufficientData, InvalidOption, LowDensity
from modspark.operators import selection as S
from modspark.operators import windows as W
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import calls, decode
from modspark.options import Windowing
from modspark.sources import sam


def windowed(spark, tmp_path, records, win, step, function=W.density):
    return W.over_tracks(decode(with_alignment(sam.read_sam(spark, write(tmp_path, records)))), Windowing(win, step), function)


def test_functions():
    assert W.density(np.array([127, 128, 255, 0])) == 0.5
    with pytest.raises(EmptyWindow):
        W.density(np.array([]))
    with pytest.raises(EmptyWindow):
        W.gradient(np.array([]))
    with pytest.raises(InsufficientData):
        W.gradient(np.array([200]))
    with pytest.raises(LowDensity):
        W.density_at_least(0.6)(np.array([200, 1]))
    draw = random.Random(1)
    for _ in range(50):
        q = np.array([draw.randrange(256) for _ in range(draw.randrange(2, 40))])
        slope = np.polyfit(np.arange(len(q)), (q >= 128).astype(float), 1)[0]
        assert W.gradient(q) == pytest.approx(slope, abs=1e-6)
        for fn in (W.density, W.gradient):
            first, values = W.window_values(q, 2, 1, fn)
            assert first.tolist() == list(range(len(q) - 1))
            assert values.tolist() == pytest.approx([float(fn(q[i : i + 2])) for i in first], abs=1e-6)


def test_text_of_windows(spark, tmp_path):
    lines = list(text.windows_tsv(W.window_table(windowed(spark, tmp_path, FOUR, 2, 1))))
    assert lines[0].startswith("#contig\tref_win_start")
    assert lines[1] == "north\t7\t9\tread-a\t0\t+\tC\t+\tm\t2\t4\t255"
    assert lines[5] == "south\t25\t29\tread-c\t0.5\t-\tC\t+\tm\t15\t19\t255"
    assert lines[6].startswith(".\t-1\t-1\tread-b\t1\t.\tC\t+\tm\t") and lines[8].startswith(".\t-1\t-1\tread-b\t0\t.\tG\t-\t4321\t")
    assert len(lines) == 1 + 2 + 3 + 2 + 2


def test_mean_quality_and_bounds(spark, tmp_path):
    lines = list(text.windows_tsv(W.window_table(windowed(spark, tmp_path, INDEL, 2, 1))))[1:]
    assert [x.split("\t")[1:3] + x.split("\t")[9:] for x in lines] == [["3", "4", "0", "4", "16"], ["6", "7", "3", "5", "28"], ["6", "10", "4", "8", "11"]]
    q = "".join(chr(33 + x) for x in (10, 20, 30, 40))
    want = round(-10 * math.log10(sum(10 ** (-x / 10) for x in (20, 30, 40)) / 3))
    assert W.mean_quality(q, np.array([1]), np.array([4])).tolist() == [want]
    assert W.mean_quality(None, np.array([1]), np.array([4])).tolist() == [255]


def test_json_of_windows(spark, tmp_path):
    import json

    out = json.loads("".join(text.windows_json(windowed(spark, tmp_path, FOUR, 2, 1))))
    assert [len(r["mod_table"]) for r in out] == [1, 0, 1, 2] and "alignment" not in out[3]
    assert out[2]["mod_table"][0]["data"][2] == [15, 19, 0.5, 255, 25, 29]
    wide = json.loads("".join(text.windows_json(windowed(spark, tmp_path, FOUR, 50, 1))))
    assert [t["data"] for r in wide for t in r["mod_table"]] == [[], [], [], []]
    assert "".join(text.windows_json(windowed(spark, tmp_path, [], 2, 1))).split() == ["[", "]"]


def test_thresholds_and_own_functions(spark, tmp_path):
    table = W.window_table(windowed(spark, tmp_path, FOUR, 2, 1, W.density_at_least(0.4)))
    assert {r.win_val for r in table.collect()} <= {0.5, 1.0} and table.count() == 4
    own = W.window_table(windowed(spark, tmp_path, FOUR, 3, 1, lambda q: q.max() / 255))
    assert max(r.win_val for r in own.collect()) == pytest.approx(220 / 255)


def test_both_forms_agree(spark, tmp_path):
    reads = decode(with_alignment(sam.read_sam(spark, write(tmp_path, FOUR))))
    for win, step, kind, fn in ((2, 1, "density", W.density), (3, 2, "gradient", W.gradient), (9, 1, "density", W.density)):
        table = W.window_table(W.over_tracks(reads, Windowing(win, step), fn))
        a = sorted((r.rec_no, r.track_no, r.win_start, r.win_end, r.win_val) for r in table.collect())
        b = sorted((r.rec_no, r.track_no, r.win_start, r.win_end, r.win_val) for r in W.over_calls(calls(reads), Windowing(win, step), kind=kind).collect())
        assert a == pytest.approx(b) if not a else [x[:4] for x in a] == [x[:4] for x in b] and [x[4] for x in a] == pytest.approx([x[4] for x in b])


def test_one_pass_is_the_same_as_two(spark, tmp_path):
    reads = with_alignment(sam.read_sam(spark, write(tmp_path, FOUR + INDEL)))
    for fn in (W.density, W.gradient, W.density_at_least(0.4)):
        two = W.window_table(W.over_tracks(decode(reads), Windowing(2, 1), fn))
        one = W.window_table(W.decode_windows(reads, None, Windowing(2, 1), fn))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert W.decode_windows(reads, None, Windowing(2, 1)).columns == ["rec_no", "read_id", "contig", "strand", "windows"]


def test_selection(spark, tmp_path):
    reads = decode(with_alignment(sam.read_sam(spark, write(tmp_path, FOUR))))

    def ids(condition, tag="m", fn=W.density, win=2):
        return [r.read_id for r in S.find_reads(reads, Windowing(win, 1), tag, condition, fn).orderBy("rec_no").collect()]

    assert ids(S.any_above(1.0)) == ["read-b"]
    assert ids(S.any_above(0.5)) == ["read-c", "read-b"]
    assert ids(S.any_below(0.0)) == ["read-a", "read-c"]
    assert ids(S.all_between(0.0, 0.4)) == ["read-a"]
    assert ids(S.any_below_and_any_above(0.0, 0.5)) == ["read-c"]
    assert ids(S.range_above(0.5)) == ["read-c", "read-b"]
    assert ids(S.any_abs_above(0.9), fn=W.gradient) == ["read-c", "read-b"]
    assert ids(S.any_below(1.0), tag="h") == [] and ids(S.any_below(1.0), win=50) == []
    assert ids(S.any_below(0.0), tag="4321") == ["read-b"]
    got = S.find_reads(reads, Windowing(2, 1), "m", predicate=lambda v: __import__("pyspark").sql.functions.size(v) == 3)
    assert [r.read_id for r in got.collect()] == ["read-c"]
    plain = with_alignment(sam.read_sam(spark, write(tmp_path, FOUR)))
    assert [r.read_id for r in S.find_reads(plain, Windowing(2, 1), "m", S.any_above(0.5)).orderBy("rec_no").collect()] == ["read-c", "read-b"]
    with pytest.raises(Exception, match="is less than"):  # selection doesn't leave windows out
        ids(S.any_above(0.5), fn=W.density_at_least(0.4))
    with pytest.raises(InvalidOption):
        ids(S.any_abs_above(0.5), fn=W.gradient, win=1)
    with pytest.raises(InvalidOption):
        S.any_above(1.5)
    with pytest.raises(InvalidOption):
        S.all_between(0.6, 0.5)


def test_windows_are_whole(spark, tmp_path):
    assert W.window_values(np.arange(10), 4, 3, W.density)[0].tolist() == [0, 3, 6]
    assert W.window_values(np.arange(3), 4, 1, W.density)[0].tolist() == []
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(InvalidOption):
            Windowing(*bad)
