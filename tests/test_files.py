import gzip
import io
import json
import random

import pytest
from samples import FOUR, IMPLICIT, write

from modspark import simulate as S
from modspark.errors import InvalidOption, InvalidRecord
from modspark.model import ALIGNMENT_COLUMNS, ALIGNMENTS, CONTIGS
from modspark.operators import windows as W
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import decode
from modspark.options import Windowing
from modspark.plans import commands
from modspark.sources import bam, files, sam, sinks

SAME = [c for c in ALIGNMENT_COLUMNS if c not in ("rec_no", "tid")]


def rows(df):
    return sorted(map(repr, df.select(*SAME).collect()))


def records(reader, part):
    return [r for batch in reader.read(part) for r in zip(*batch.to_pydict().values())]


def config(**more):
    mod = {"base": "C", "mod_code": "m", "win": [10], "mod_range": [[0.7, 0.8], [0.1, 0.2]]}
    return S.SimulationConfig.parse(json.dumps({"contigs": {"number": 2, "len_range": [800, 1000]}, "reads": [{"number": 150, "mapq_range": [10, 20], "base_qual_range": [20, 40], "len_range": [0.2, 0.8], "mods": [mod]} | more], "seed": 5}))


@pytest.fixture(scope="module")
def simulated(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sim")
    S.run(spark, config(), f"{folder}/reads.bam", f"{folder}/contigs.fa")
    return f"{folder}/reads.bam", f"{folder}/contigs.fa"


def test_bam_round_trip_in_any_split(spark, simulated):
    alignments, contigs, _ = S.simulate(spark, config())
    want = rows(alignments)
    for split in (1 << 25, 70_000, 9_000):
        got = bam.read_bam(spark, simulated[0], split=split)
        assert rows(got) == want
    assert got.rdd.getNumPartitions() > 3
    assert [r.read_id for r in got.orderBy("rec_no").collect()] == [r.read_id for r in alignments.orderBy("rec_no").collect()]
    assert bam.contigs(spark, simulated[0]).collect() == contigs.collect()
    one = bam.read_bam(spark, simulated[0], "contig_00001")
    assert rows(one) == rows(alignments.where("contig = 'contig_00001'"))
    assert bam.read_bam(spark, simulated[0], "nowhere").count() == 0


def test_long_reads_over_many_splits(spark, tmp_path):
    draw = random.Random(3)
    reads = []
    for k, n in enumerate((50, 1_000_000, 60, 70, 400_000, 80)):
        seq, qual = "".join(draw.choices("ACGT", k=n)), "".join(map(chr, draw.choices(range(34, 90), k=n)))
        reads.append((k, f"r{k}", 0, 0, "c", k, 30, f"{n}M", seq, qual, None, None))
    contigs = spark.createDataFrame([(0, "c", 2_000_000)], CONTIGS)
    sinks.write_bam(spark.createDataFrame(reads, ALIGNMENTS), contigs, f"{tmp_path}/long.bam", index=False)
    for split in (70_000, 300_000, 1 << 25):
        reader = bam.BamReader(f"{tmp_path}/long.bam", split)
        got = [r[1:] for part in reader.partitions() for r in records(reader, part)]
        assert got == [r[1:] for r in reads]


def test_index_leads_to_fewer_splits(spark, simulated):
    reader = bam.BamReader(simulated[0], 1 << 25)
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("contig",), "contig_00001")])) and reader.contig == "contig_00001"
    chunks = reader.partitions()
    assert all(c.exact for c in chunks)
    seen = [r[4] for c in chunks for r in records(reader, c)]
    assert "contig_00001" in seen and len(seen) < 150


def test_sam_as_bam(spark, tmp_path):
    path = write(tmp_path, FOUR + IMPLICIT)
    alignments, contigs = sam.read_sam(spark, path), sam.contigs(spark, path)
    sinks.write_bam(alignments, contigs, f"{tmp_path}/x.bam", index=False)
    again = bam.read_bam(spark, f"{tmp_path}/x.bam")
    assert rows(again) == rows(alignments)
    with pytest.raises(InvalidRecord):
        sinks.write_bam(alignments, contigs, f"{tmp_path}/y.bam")
    order = sinks.sorted_alignments(alignments).select("read_id").collect()
    assert order[-1].read_id == "read-b"
    (tmp_path / "back.sam").write_text("\n".join(sinks.sam_lines(alignments, contigs)) + "\n")
    assert rows(sam.read_sam(spark, f"{tmp_path}/back.sam")) == rows(alignments)
    (tmp_path / "no.bam").write_bytes(gzip.compress(b"x"))
    with pytest.raises(InvalidRecord):
        bam.header(f"{tmp_path}/no.bam")


def test_order_of_lines_over_splits(spark, tmp_path):
    path = write(tmp_path, [FOUR[0].replace("read-a", f"r{k:05d}") for k in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sam.read_sam(spark, path)
        assert df.rdd.getNumPartitions() > 5
        assert [r.read_id for r in df.orderBy("rec_no").collect()] == [f"r{k:05d}" for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_staging(tmp_path):
    assert files.staged(f"{tmp_path}/x") == f"{tmp_path}/x"
    to = files.staged("-", str(tmp_path), io.BytesIO(b"abc"))
    assert open(to, "rb").read() == b"abc" and files.size(to) == 3 and files.exists(to) and not files.exists(f"{to}x")


def test_sam_by_content(spark, tmp_path):
    held = open(write(tmp_path, FOUR), "rb").read()
    to = files.staged("-", str(tmp_path), io.BytesIO(held))
    assert to.endswith(".sam") and commands.Source(spark, to).rows().count() == 4
    odd = tmp_path / "no-ending"
    odd.write_bytes(held)
    assert run(spark, "peek", str(odd))[-1] == "G-4321"


def test_letters_as_bam_has_them(spark, tmp_path):
    from samples import line

    path = write(tmp_path, [line("x", 0, "north", 1, 0, "8M", "acGUux.N")])
    assert sam.read_sam(spark, path).first().seq == "ACGTTNNN"


def test_several_files(spark, tmp_path):
    paths = []
    for k in range(3):
        path = write(tmp_path, FOUR[: k + 1], f"of{k}.sam")
        alignments, contigs = sam.read_sam(spark, path), sam.contigs(spark, path)
        paths.append(f"{tmp_path}/{k}.bam")
        sinks.write_bam(alignments, contigs, paths[-1], index=False)
    got = bam.read_bam(spark, paths).orderBy("rec_no").collect()
    assert [r.read_id[-1] for r in got] == list("aababc") and len({r.rec_no for r in got}) == 6
    folder = [write(tmp_path, [FOUR[0].replace("read-a", f"r{k}{j}") for j in range(5)], f"{k}.sam") for k in range(3)]
    got = sam.read_sam(spark, *folder).orderBy("rec_no").collect()
    assert [r.read_id for r in got] == [f"r{k}{j}" for k in range(3) for j in range(5)] and len({r.rec_no for r in got}) == 15


class Server:
    """A folder over HTTP, with ranges or without; counts the bytes that it gives out."""

    def __init__(self, folder, ranges=True):
        import http.server
        import threading

        outer = self
        outer.given = 0

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                path = folder / self.path[1:]
                if not path.exists():
                    self.send_error(404)
                    return
                held, span = path.read_bytes(), self.headers.get("Range")
                if span and ranges:
                    a, b = span.removeprefix("bytes=").split("-")
                    part = held[int(a) : int(b) + 1]
                    self.send_response(206)
                    self.send_header("Content-Range", f"bytes {a}-{int(a) + len(part) - 1}/{len(held)}")
                else:
                    part = held
                    self.send_response(200)
                self.send_header("Content-Length", str(len(part)))
                self.end_headers()
                outer.given += len(part)
                self.wfile.write(part)

            def log_message(self, *args):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.http.shutdown()


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A sorted file of some megabytes."""
    folder = tmp_path_factory.mktemp("large")
    draw = random.Random(7)
    reads = []
    for k in range(1500):
        n = 2000
        seq, qual = "".join(draw.choices("ACGT", k=n)), "".join(map(chr, draw.choices(range(34, 74), k=n)))
        reads.append((k, f"r{k}", 0, 0, "c", k * 1000, 30, f"{n}M", seq, qual, None, None))
    contigs = spark.createDataFrame([(0, "c", 2_000_000)], CONTIGS)
    sinks.write_bam(spark.createDataFrame(reads, ALIGNMENTS), contigs, f"{folder}/x.bam")
    return folder


def test_intervals_by_the_index(spark, large):
    whole = files.size(f"{large}/x.bam")
    want = {f"r{k}" for k in range(1500) if k * 1000 < 701_500 and k * 1000 + 2000 > 700_500}
    for split in (20_000, 1 << 25):
        reader = bam.BamReader(f"{large}/x.bam", split, ("c", 700_500, 701_500))
        parts = reader.partitions()
        assert sum((p.end >> 16) - (p.start >> 16) for p in parts) < whole / 10
        assert {r[1] for p in parts for r in records(reader, p)} == want
    assert {r.read_id for r in bam.read_bam(spark, f"{large}/x.bam", "c", start=700_500, end=701_500).collect()} == want
    everything = bam.BamReader(f"{large}/x.bam", 50_000, ("c", 0, None))
    got = [r[1] for p in everything.partitions() for r in records(everything, p)]
    assert len(everything.partitions()) > 5 and got == [f"r{k}" for k in range(1500)]


def test_urls(spark, large):
    want = sorted(f"r{k}" for k in range(1500) if k * 1000 < 701_500 and k * 1000 + 2000 > 700_500)
    whole = files.size(f"{large}/x.bam")
    with Server(large) as server:
        assert files.staged(f"{server.url}/x.bam") == f"{server.url}/x.bam"
        server.given = 0
        reader = bam.BamReader(f"{server.url}/x.bam", 1 << 25, ("c", 700_500, 701_500))
        got = [r[1] for p in reader.partitions() for r in records(reader, p)]
        assert got == want and server.given < max(4 * files.AHEAD, whole // 2) + files.size(f"{large}/x.bam.bai")
        table = run(spark, "read-table-hide-mods", f"{server.url}/x.bam", "--region", "c:700500-701500")
        assert sorted(x.split("\t")[0] for x in table[1:]) == want and not any("cannot find index" in x for x in table)
        assert not files.exists(f"{server.url}/none.bam")
    with Server(large, ranges=False) as server:
        to = files.staged(f"{server.url}/x.bam", str(large))
        assert to.endswith(".bam") and files.size(to) == whole


def test_fasta(spark, simulated):
    lines = [r.value for r in spark.read.text(simulated[1]).collect()]
    assert sorted(x for x in lines if x[0] == ">") == [">contig_00000", ">contig_00001"]
    assert {len(x) for x in lines if x[0] != ">"} <= set(range(800, 1001))


def test_simulation_is_determined_by_its_seed(spark):
    a, b = (S.simulate(spark, config())[0] for _ in range(2))
    assert rows(a) == rows(b)
    assert rows(a) != rows(S.simulate(spark, S.SimulationConfig(config().contigs, config().reads, 6))[0])


def test_simulated_reads_come_from_contigs(spark):
    alignments, _, sequences = S.simulate(spark, config())
    whole = {r.name: r.seq for r in sequences.collect()}
    got = alignments.collect()
    states = {r.flag for r in got}
    assert states == {0, 4, 16, 256, 272, 2048, 2064}
    for r in got:
        if r.contig:
            assert r.seq == whole[r.contig][r.pos : r.pos + len(r.seq)] and 10 <= r.mapq <= 20
            assert len(r.seq) <= 0.8 * len(whole[r.contig])
        else:
            assert (r.mapq, r.pos, r.cigar) == (255, -1, None)
        assert all(20 <= ord(c) - 33 <= 40 for c in r.qual) and r.read_id.startswith("0.")


def test_edits_and_barcodes():
    import numpy as np

    draw = np.random.default_rng(1)
    c = S.ReadConfig(barcode="CCAT", delete=(0.1, 0.2), insert_middle="TTAGA")
    seq, cigar = S.edited("ACGT" * 10, c, False, draw)
    assert cigar == "4S4M4D12M5I20M4S" and seq.startswith("CCAT") and seq.endswith("ATGG") and "TTAGA" in seq
    assert S.with_barcode("", "ACCT", False) == ("ACCT", "AGGT") and S.with_barcode("", "ACCT", True) == ("TGGA", "TCCA")
    seq, cigar = S.edited("A" * 100, S.ReadConfig(mismatch=0.3), False, draw)
    assert cigar == "100M" and seq.count("A") == 70
    with pytest.raises(InvalidOption):
        S.edited("ACGT", S.ReadConfig(delete=(0.0, 1.0)), False, draw)
    mm, ml = S.modification_tags((S.ModConfig("C", mod_code="m", win=(2, 3), mod_range=((0.0, 0.0), (1.0, 1.0))),), "CCCCCCAC", draw)
    assert mm == "C+m?,0,0,0,0,0,0,0;" and ml == [0, 0, 255, 255, 255, 0, 0]
    assert S.modification_tags((S.ModConfig("T"),), "AAA", draw) == ("", [])
    for bad in ({"reads": [{"number": 0}]}, {"reads": [{"len_range": [0.5, 0.1]}]}, {"contigs": {"repeated_seq": "AX"}}, {"reads": [{"odd": 1}]}, {"reads": [{"mods": [{"win": [0]}]}]}):
        with pytest.raises(InvalidOption):
            S.SimulationConfig.parse(json.dumps(bad))


def test_groups_are_told_apart(spark):
    common = dict(mapq_range=(30, 50), base_qual_range=(15, 35), len_range=(0.6, 0.9))
    groups = [S.ReadConfig(60, mods=({"base": "A", "mod_code": "a", "win": [3], "mod_range": [r]},), **common) for r in ((0.0, 0.1), (0.3, 0.45), (0.6, 0.95))]
    with S.temporary(spark, S.SimulationConfig(S.ContigConfig(2, (1300, 1300), "TACCGTAAC"), tuple(groups), 9)) as (path, _):
        for args in (["any-dens-above", "--high", "0.75"], ["all-dens-between", "--dens-limits", "0.8,1"]):
            lines = list(commands.run(spark, commands.parser().parse_args(["find-modified-reads", args[0], path, "--tag", "a", "--win", "40", "--step", "15", *args[1:]])))
            assert len(lines) == 60 and all(x.startswith("2.") for x in lines)
    assert not files.exists(path)


def run(spark, *args):
    return list(commands.run(spark, commands.parser().parse_args(list(args))))


def test_commands(spark, simulated, tmp_path, capsys):
    path = simulated[0]
    assert run(spark, "peek", path)[-1] == "C+m"
    assert run(spark, "read-stats", path)[0] == "key\tvalue" and len(run(spark, "read-stats", path)) == 16
    dens = run(spark, "window-dens", path, "--win", "5", "--step", "5", "--mod-region", "contig_00000:10-200")
    grad = run(spark, "window-grad", path, "--win", "5", "--step", "5", "--region", "contig_00000:10-200")
    assert dens[0] == grad[0] and not any(x.startswith("# cannot") for x in grad)
    assert len(json.loads("\n".join(run(spark, "read-info", path, "--detailed", "--read-filter", "unmapped")))) > 5
    assert run(spark, "read-info", path, "--detailed-pretty", "--min-seq-len", "100000") == ["[", "]"]
    shown = run(spark, "read-table-hide-mods", path, "--seq-region", "contig_00001:100-110", "--show-base-qual")
    assert "".join(shown[:1]).split("\t")[-2:] == ["sequence", "qualities"]
    assert "\tmod_count" in "\n".join(run(spark, "read-table-show-mods", path, "--tag", "m"))
    text = write(tmp_path, FOUR)
    assert run(spark, "window-dens", text, "--win", "2", "--step", "1", "--region", "north")[0].startswith("# cannot find index")
    (tmp_path / "c.json").write_text(json.dumps({"contigs": {"len_range": [100, 100]}, "reads": [{"number": 3, "len_range": [0.5, 1]}]}))
    assert run(spark, "simulate", f"{tmp_path}/c.json", f"{tmp_path}/s.bam", f"{tmp_path}/s.fa") == []
    assert bam.read_bam(spark, f"{tmp_path}/s.bam").count() == 3
    with pytest.raises(InvalidOption):
        run(spark, "find-modified-reads", "any-abs-grad-above", path, "--tag", "m", "--win", "1", "--step", "1", "--min-grad", "0.1")


def test_streams(spark, tmp_path):
    from modspark.streaming import live

    path = write(tmp_path, FOUR)
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, FOUR[:2], "a.sam")
    write(folder, FOUR[2:], "b.sam")
    contigs = sam.contigs(spark, path)
    stream = live.window_stream(live.sam_stream(spark, str(folder), contigs), Windowing(2, 1))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").start()
    counts = live.state_counts(live.sam_stream(spark, str(folder), contigs)).writeStream.format("memory").queryName("states").outputMode("complete").start()
    try:
        q.processAllAvailable()
        counts.processAllAvailable()
        got = spark.table("windows").drop("rec_no")
        want = W.window_table(W.over_tracks(decode(with_alignment(sam.read_sam(spark, path))), Windowing(2, 1))).drop("rec_no")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert {r.read_state: r.n for r in spark.table("states").collect()} == {"primary_forward": 2, "primary_reverse": 1, "unmapped": 1}
    finally:
        q.stop()
        counts.stop()
