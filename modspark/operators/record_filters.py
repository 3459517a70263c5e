"""Conditions on alignments as one predicate, ahead of any decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions.sequence import reference_length
from modspark.model import MISSING, STATE_BITS
from modspark.options import ReadFilter

#: Ids that go into the predicate; larger sets are joined.
INLINE = 1000


def by_length(length: Column, least: int, zero_len: bool) -> Column:
    return F.when(length == 0, F.lit(zero_len)).otherwise(length >= least)


def by_align_length(flag: Column, align_len: Column, least: int) -> Column:
    """Unmapped reads fail, and reads without sequence have no exception."""
    return (flag.bitwiseAND(4) == 0) & (align_len >= least)


def by_state(flag: Column, states: frozenset[int]) -> Column:
    return flag.bitwiseAND(STATE_BITS).isin(*sorted(states))


def by_mapq(mapq: Column, least: int, exclude_unavailable: bool) -> Column:
    good = mapq >= least
    return good & (mapq != MISSING) if exclude_unavailable else good


def by_sample(read_id: Column, share: float, seed: int | None) -> Column:
    """A draw for each record, or with a seed one that all records of a read share: 60 bits of the MD5 of id, a colon and the seed."""
    if share >= 1 or share <= 0:
        return F.lit(share >= 1)
    draw = F.rand() if seed is None else F.conv(F.substring(F.md5(F.concat(read_id, F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))
    return draw < share


def by_region(flag: Column, contig: Column, pos: Column, ref_end: Column, region: tuple[str, int, int], full: bool) -> Column:
    """Mapped, on the contig, and overlapping the interval; with full, spanning it."""
    name, start, end = region
    on_contig = (flag.bitwiseAND(4) == 0) & (contig == name)
    if full:
        return on_contig & (pos <= start) & (ref_end > start) & (pos <= end) & (ref_end >= end)
    return on_contig & (pos < end) & (ref_end > start) & (pos < ref_end) & F.lit(start < end)


def predicate(options: ReadFilter, seq_len: Column | None = None, ref_span: Column | None = None) -> Column:
    """All conditions but sets of ids, over columns of alignments.

    seq_len, ref_span: where a table has these as columns already.
    """
    col = F.col
    seq_len = F.length("seq") if seq_len is None else seq_len
    span = reference_length(col("cigar")) if ref_span is None else ref_span
    found = [by_length(seq_len, options.min_seq_len, options.include_zero_len)]
    if options.min_align_len is not None:
        found.append(by_align_length(col("flag"), span, options.min_align_len))
    if options.read_id is not None:
        found.append(col("read_id") == options.read_id)
    if options.states is not None:
        found.append(by_state(col("flag"), options.states))
    if options.mapq or options.exclude_mapq_unavail:
        found.append(by_mapq(col("mapq"), options.mapq, options.exclude_mapq_unavail))
    if options.region is not None:
        found.append(by_region(col("flag"), col("contig"), col("pos"), col("pos") + span, options.region, options.full_region))
    if options.sample_fraction < 1:
        found.append(by_sample(col("read_id"), options.sample_fraction, options.sample_seed))
    return reduce(Column.__and__, found)


def by_ids(alignments: DataFrame, ids: DataFrame) -> DataFrame:
    """All alignments of the reads in rows (read_id); Spark decides from the size of these how to join."""
    return alignments.join(ids.select("read_id"), "read_id", "left_semi").select(alignments.columns)


def filter_reads(alignments: DataFrame, options: ReadFilter, ids: DataFrame | None = None) -> DataFrame:
    """The alignments that meet all conditions.

    ids: rows (read_id) of a list, if there is one. Spark decides from its size how to join it;
    all alignments of a read in it stay.
    """
    out = alignments.where(predicate(options))
    wanted = options.read_ids
    if wanted is not None and len(wanted) <= INLINE:
        out = out.where(F.col("read_id").isin(*wanted))
    elif wanted is not None:
        ids = alignments.sparkSession.createDataFrame([(x,) for x in sorted(wanted)], "read_id string")
    if options.read_id_list is not None and ids is None:
        from modspark.sources.tables import read_ids

        ids = read_ids(alignments.sparkSession, options.read_id_list)
    return out if ids is None else by_ids(out, ids)
