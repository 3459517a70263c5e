"""The read table: one row for each read id, its alignments in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.operators.alignment import with_alignment
from modspark.operators.decode import counts_per_code, decode
from modspark.operators.display import SHOWN, with_sequence
from modspark.options import ModFilter, SeqDisplay


def mod_count_text(tracks: str = "tracks"):
    """`code:count` of a read by code point, joined by semicolons; NA without tracks."""
    counts = F.transform(counts_per_code(tracks), lambda c: F.concat_ws(":", c["mod_code"], c["n"].cast("string")))
    return F.when(F.size(tracks) > 0, F.array_join(counts, ";")).otherwise(F.lit("NA"))


def listed(columns: list[str]) -> list:
    """Aggregates that list columns over the records of a read, by rec_no, joined by a comma and a space."""
    rows = F.sort_array(F.collect_list(F.struct("rec_no", *columns)))
    return [F.array_join(F.transform(rows, _picked(c)), ", ").alias(c) for c in columns]


def _picked(name: str):
    return lambda r: r[name].cast("string")


def group_reads(rows: DataFrame, columns: list[str], summary: DataFrame | None = None) -> DataFrame:
    """rows (rec_no, read_id, seq_len, columns) to one row for each id.

    The length is the largest of the read's records, or the summary's: then only reads that both
    have remain.
    """
    grouped = rows.groupBy("read_id").agg(F.max("seq_len").cast("long").alias("sequence_length_template"), *listed(columns))
    if summary is not None:
        lengths = summary.select("read_id", F.col("sequence_length_template").cast("long").alias("__length"))
        grouped = grouped.join(lengths, "read_id").withColumn("sequence_length_template", F.col("__length")).drop("__length")
    return grouped


def read_table(alignments: DataFrame, mods: ModFilter | None = None, display: SeqDisplay | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Columns read_id, align_length, sequence_length_template, alignment_type[, mod_count][, sequence][, qualities].

    mods: count modifications that are likelier than not among these; None leaves the column
    out. Reads without sequence have length 0 and no modifications (NA).
    """
    display = display or SeqDisplay()
    reads = with_alignment(alignments, zero_len=True)
    columns = {"align_length": F.coalesce("align_len", F.lit(0)), "alignment_type": F.col("read_state")}
    if mods is not None:
        wanted = ("rec_no", "read_id", "seq_len", "align_len", "read_state", *(SHOWN if display.shown else ()))
        reads = decode(reads, mods.promoted(), keep=wanted)
        columns["mod_count"] = mod_count_text()
    if display.shown:
        reads = with_sequence(reads, display)
        columns["sequence"] = F.col("shown_seq")
        if display.show_base_qual:
            columns["qualities"] = F.col("shown_qual")
    rows = reads.select("rec_no", "read_id", "seq_len", *(c.alias(k) for k, c in columns.items()))
    out = group_reads(rows, list(columns), summary)
    first, *rest = columns
    return out.select("read_id", first, "sequence_length_template", *rest)
