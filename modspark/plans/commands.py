"""The command line: `python -m modspark COMMAND [options] FILE`."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from modspark import format as text
from modspark import session, simulate
from modspark.errors import ModsparkError
from modspark.operators import peek, read_info, read_stats, read_table, record_filters, selection, windows
from modspark.operators.alignment import with_alignment
from modspark.options import ModFilter, ReadFilter, Region, SeqDisplay, Threshold, Windowing, read_states
from modspark.sources import bam, files, sam, tables

_NO_INDEX = "# cannot find index file. region retrieval could be slower."


@dataclass
class Source:
    """An alignment file, SAM or BAM by its content: its contigs, and its rows over an interval or all."""

    spark: SparkSession
    path: str

    @cached_property
    def is_sam(self) -> bool:
        return not files.is_bam(self.path)

    def contigs(self) -> DataFrame:
        return sam.contigs(self.spark, self.path) if self.is_sam else bam.contigs(self.spark, self.path)

    def lengths(self) -> dict[str, int]:
        return {r["contig"]: r["length"] for r in self.contigs().collect()}

    def indexed(self) -> bool:
        return not self.is_sam and files.exists(f"{self.path}.bai")

    def rows(self, region: tuple[str, int, int] | None = None) -> DataFrame:
        if self.is_sam:
            return sam.read_sam(self.spark, self.path)
        contig, start, end = region or (None, 0, None)
        return bam.read_bam(self.spark, self.path, contig, start=start, end=end)


def _add_input(p: argparse.ArgumentParser) -> None:
    p.add_argument("file", help="alignments: a path, a URL, or - for standard input")
    p.add_argument("--min-seq-len", type=int, default=0)
    p.add_argument("--min-align-len", type=int)
    p.add_argument("--read-id")
    p.add_argument("--read-id-list")
    p.add_argument("--threads", type=int, default=2, help="cores of a local session")
    p.add_argument("--include-zero-len", action="store_true")
    p.add_argument("--read-filter", type=read_states)
    p.add_argument("-s", "--sample-fraction", type=float, default=1.0)
    p.add_argument("--sample-seed", type=int)
    p.add_argument("--mapq-filter", type=int, default=0)
    p.add_argument("--exclude-mapq-unavail", action="store_true")
    p.add_argument("--region", type=Region.parse)
    p.add_argument("--full-region", action="store_true")


def _add_mods(p: argparse.ArgumentParser, tag_needed: bool = False) -> None:
    p.add_argument("--tag", required=tag_needed)
    p.add_argument("--mod-strand", choices=("bc", "bc_comp"))
    p.add_argument("--mod-prob-filter", type=Threshold.parse, default=Threshold())
    p.add_argument("--trim-read-ends-mod", type=int, default=0)
    p.add_argument("--base-qual-filter-mod", type=int, default=0)
    p.add_argument("--mod-region", type=Region.parse)


def _add_windows(p: argparse.ArgumentParser) -> None:
    p.add_argument("--win", type=int, required=True)
    p.add_argument("--step", type=int, required=True)


def _add_display(p: argparse.ArgumentParser, mods: bool) -> None:
    p.add_argument("--seq-region", type=Region.parse)
    p.add_argument("--seq-full", action="store_true")
    p.add_argument("--show-base-qual", action="store_true")
    p.add_argument("--show-ins-lowercase", action="store_true")
    if mods:
        p.add_argument("--show-mod-z", action="store_true")


#: Selections: their numbers, and how a condition is made of them.
FIND = {
    "all-dens-between": (("dens-limits",), selection.all_between),
    "any-dens-above": (("high",), selection.any_above),
    "any-dens-below": (("low",), selection.any_below),
    "any-dens-below-and-any-dens-above": (("low", "high"), selection.any_below_and_any_above),
    "dens-range-above": (("min-range",), selection.range_above),
    "any-abs-grad-above": (("min-grad",), selection.any_abs_above),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="modspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, mods in (("read-table-show-mods", True), ("read-table-hide-mods", False)):
        p = sub.add_parser(name)
        _add_input(p)
        if mods:
            _add_mods(p)
        _add_display(p, mods)
        p.add_argument("summary", nargs="?", default="")
    _add_input(sub.add_parser("read-stats"))
    p = sub.add_parser("read-info")
    _add_input(p)
    _add_mods(p)
    how = p.add_mutually_exclusive_group()
    how.add_argument("--detailed", action="store_true")
    how.add_argument("--detailed-pretty", action="store_true")
    kinds = sub.add_parser("find-modified-reads").add_subparsers(dest="find", required=True)
    for name, (numbers, _) in FIND.items():
        p = kinds.add_parser(name)
        _add_input(p)
        _add_mods(p, tag_needed=True)
        _add_windows(p)
        for n in numbers:
            p.add_argument(f"--{n}", required=True)
    for name in ("window-dens", "window-grad"):
        p = sub.add_parser(name)
        _add_input(p)
        _add_mods(p)
        _add_windows(p)
    _add_input(sub.add_parser("peek"))
    p = sub.add_parser("simulate")
    p.add_argument("config")
    p.add_argument("bam")
    p.add_argument("fasta")
    return top


def _mods(a: argparse.Namespace, lengths: dict[str, int]) -> ModFilter:
    return ModFilter(a.tag, a.mod_strand, a.mod_prob_filter, a.trim_read_ends_mod, a.base_qual_filter_mod, a.mod_region).bound(lengths)


def run(spark: SparkSession, a: argparse.Namespace) -> Iterable[str]:
    """The lines that a command prints."""
    if a.command == "simulate":
        with open(a.config, encoding="utf-8") as f:
            config = simulate.SimulationConfig.parse(f.read())
        simulate.run(spark, config, a.bam, a.fasta)
        return
    folder = None if spark.sparkContext.master.startswith("local") else session.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    source = Source(spark, path := files.staged(a.file, folder))
    try:
        yield from _answer(spark, a, source)
    finally:
        if path != a.file:
            os.remove(path)


def _answer(spark: SparkSession, a: argparse.Namespace, source: Source) -> Iterable[str]:
    lengths = source.lengths()
    options = ReadFilter(
        a.min_seq_len, a.min_align_len, a.read_id, None, a.read_id_list, a.include_zero_len, a.read_filter, a.sample_fraction, a.sample_seed, a.mapq_filter, a.exclude_mapq_unavail, a.region, a.full_region
    ).bound(lengths)
    if options.region is not None and not source.indexed():
        yield _NO_INDEX
    rows = record_filters.filter_reads(source.rows(options.region), options)
    if a.command.startswith("read-table"):
        mods = _mods(a, lengths) if a.command.endswith("show-mods") else None
        display = SeqDisplay(a.seq_full, a.seq_region, a.show_base_qual, a.show_ins_lowercase, getattr(a, "show_mod_z", False)).bound(lengths)
        summary = tables.sequencing_summary(spark, a.summary) if a.summary else None
        yield from text.read_table_tsv(read_table.read_table(rows, mods, display, summary), a.summary)
    elif a.command == "read-stats":
        found = {r["key"]: r["value"] for r in read_stats.read_stats(rows).collect()}
        yield "key\tvalue"
        yield from (f"{k}\t{found[k]}" for k in read_stats.KEYS)
    elif a.command == "read-info":
        detail = a.detailed or a.detailed_pretty
        yield from text.json_array(read_info.read_info(rows, _mods(a, lengths), detail), a.detailed_pretty)
    elif a.command == "peek":
        yield from text.peek_text(peek.contig_rows(source.contigs()), peek.modifications(rows))
    else:
        reads, mods, windowing = with_alignment(rows), _mods(a, lengths), Windowing(a.win, a.step)
        slope = a.command == "window-grad" or getattr(a, "find", "") == "any-abs-grad-above"
        function = windows.gradient if slope else windows.density
        if a.command == "find-modified-reads":
            numbers, make = FIND[a.find]
            given = [float(x) for n in numbers for x in str(getattr(a, n.replace("-", "_"))).split(",")]
            found = selection.find_reads(reads, windowing, a.tag, make(*given), function, mods=mods)
            yield from (r["read_id"] for r in found.orderBy("rec_no").toLocalIterator())
        else:
            yield from text.windows_tsv(windows.window_table(windows.decode_windows(reads, mods, windowing, function)))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session.build(cpus=getattr(a, "threads", 2))
    try:
        for line in run(spark, a):
            print(line)
    except BrokenPipeError:
        sys.stderr.close()
        return 141
    except (ModsparkError, OSError) as e:
        print(f"modspark: {e}", file=sys.stderr)
        return 1
    return 0
