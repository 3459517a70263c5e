import pytest

from modspark.errors import InvalidOption, InvalidRegion, shown
from modspark.functions import sequence, values
from modspark.options import Locator, ModFilter, ReadFilter, Region, SeqDisplay, Threshold, fraction, ordered_pair, read_states


def test_regions():
    assert Region.parse("chr1") == Region("chr1")
    assert Region.parse("chr1:5-") == Region("chr1", 5)
    assert Region.parse("a:b:5-9") == Region("a:b", 5, 9)
    assert str(Region.parse("c: 5 - 9 ")) == "c:5-9"
    for bad in ("", "chr1:", "chr1:5", "chr1:9-5", "chr1:5-5", "chr1:x-9", ":1-2", "chr1:-5-9"):
        with pytest.raises(InvalidRegion):
            Region.parse(bad)
    lengths = {"c": 100}
    assert Region("c").bind(lengths) == ("c", 0, 100)
    assert Region("c", 99).bind(lengths) == ("c", 99, 100)
    assert Region("c", 5, 100).bind(lengths) == ("c", 5, 100)
    for bad in (Region("d"), Region("c", 100), Region("c", 5, 101)):
        with pytest.raises(InvalidRegion):
            bad.bind(lengths)


def test_thresholds():
    assert Threshold.parse("") == Threshold()
    t = Threshold.parse("0.4, 0.6")
    assert t.reject == (102, 153) and t.keeps(101) and not t.keeps(102) and not t.keeps(153) and t.keeps(154)
    assert str(Threshold(100)) == "probabilities >= 0.3922"
    assert str(Threshold(0, (200, 220))) == "probabilities < 0.7843 or > 0.8627"
    assert str(Threshold(100, (200, 220))) == "probabilities >= 0.3922 and (probabilities < 0.7843 or > 0.8627)"
    assert Threshold(5, (1, 2)).promoted() == Threshold(128, (1, 2)) and Threshold(200).promoted() == Threshold(200)
    for bad in ("0.6,0.4", "a,b", "0.1", "0.1,1.2"):
        with pytest.raises(InvalidOption):
            Threshold.parse(bad)


def test_option_sets():
    for bad in (
        dict(full_region=True), dict(read_id="a", read_ids=frozenset("b")), dict(read_ids=frozenset("b"), read_id_list="f"), dict(sample_fraction=1.1), dict(mapq=256), dict(min_seq_len=-1),
    ):
        with pytest.raises(InvalidOption):
            ReadFilter(**bad)
    for bad in (dict(tag="!"), dict(mod_strand="x"), dict(base_qual=300), dict(trim_read_ends=-1)):
        with pytest.raises(InvalidOption):
            ModFilter(**bad)
    for bad in (dict(full=True, region=Region("c")), dict(show_base_qual=True), dict(full=True, show_mod_z=True)):
        with pytest.raises(InvalidOption):
            SeqDisplay(**bad)
    assert read_states("unmapped, primary_reverse") == {4, 16}
    with pytest.raises(InvalidOption):
        read_states("primary")
    assert ordered_pair(" 1 , 2", int) == (1, 2)
    with pytest.raises(InvalidOption):
        fraction(float("nan"))
    assert fraction(-0.5, -1) == -0.5


def test_locators():
    assert Locator.parse("-").kind == "stdin"
    assert Locator.parse("https://host/file.bam").kind == "url"
    assert Locator.parse("dir/a:b.bam").kind == "path"
    for bad in ("", "http://"):
        with pytest.raises(InvalidOption):
            Locator.parse(bad)


def test_codes_and_numbers():
    assert [values.mod_code(x) for x in ("m", "7200", "0076")] == ["m", "7200", "76"]
    for bad in ("", "mm", "@", "55296", "99999999", "é"):
        with pytest.raises(InvalidOption):
            values.mod_code(bad)
    assert values.code_point("T") == 84 and values.code_point("7200") == 7200
    assert [values.to_u8(x) for x in (0.0, 0.5, 1.0, 0.498)] == [0, 128, 255, 127]
    assert [values.short_float(x) for x in (0.0, 1.0, 0.1, 1 / 3, 1e-5)] == ["0", "1", "0.1", "0.33333334", "0.00001"]
    assert values.short_float(0.0, True) == "0.0" and values.short_float(-0.25, True) == "-0.25"
    assert sequence.reverse_complement_text("ACGTNryX") == "XryNACGT"
    assert shown("x" * 200) == "x" * 100 + "..."
