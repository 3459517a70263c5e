"""Reads as JSON: condensed, detailed, and with windows; and detailed reads back to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.functions import states
from modspark.functions.values import code_point_column
from modspark.model import FLAGS, TRACK
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import decode
from modspark.options import ModFilter

#: What a read's JSON and the table of its calls need besides its tracks.
DESCRIBED = ("rec_no", "read_id", "seq_len", "mapq", "read_state", "align_len", "pos", "ref_end", "contig", "tid")
READ_JSON = "alignment_type string, alignment struct<start: int, end: int, contig: string, contig_id: int>, mod_table array<struct<base: string, is_strand_plus: boolean, mod_code: string, data: array<array<int>>>>, read_id string, mapq short, seq_len int"


def _alignment() -> Column:
    place = F.struct(F.col("pos").alias("start"), F.col("ref_end").alias("end"), "contig", F.col("tid").alias("contig_id"))
    return F.when(F.col("align_len").isNotNull(), place).alias("alignment")


def _mod_table(calls) -> Column:
    return F.transform("tracks", lambda t: F.struct(t["base"].alias("base"), (t["strand"] == "+").alias("is_strand_plus"), t["mod_code"].alias("mod_code"), F.transform(t["calls"], calls).alias("data"))).alias("mod_table")


def detailed(reads: DataFrame) -> DataFrame:
    """Rows (rec_no, json) of decoded reads; a call is [pos, ref_pos or -1, probability]."""
    call = lambda c: F.array(c["pos"], F.coalesce(c["ref_pos"], F.lit(-1)), c["qual"].cast("int"))
    whole = F.struct(F.col("read_state").alias("alignment_type"), _alignment(), _mod_table(call), "read_id", "mapq", "seq_len")
    return reads.select("rec_no", F.to_json(whole).alias("json"))


def mod_section(mods: ModFilter) -> Column:
    """Calls of each track, then what they were filtered by; NA without tracks."""
    each = F.transform("tracks", lambda t: F.concat(t["base"], t["strand"], t["mod_code"], F.lit(":"), F.size(t["calls"]).cast("string"), F.lit(";")))
    rule = f"({mods.threshold}, PHRED base qual >= {mods.base_qual})"
    return F.when(F.size("tracks") > 0, F.concat(F.array_join(each, ""), F.lit(rule))).otherwise(F.lit("NA"))


def condensed(reads: DataFrame, mods: ModFilter) -> DataFrame:
    """Rows (rec_no, json): one object for each record, a field a line, with counts in place of calls."""
    text = lambda key, value: F.concat(F.lit(f'\t"{key}": "'), value, F.lit('"'))
    number = lambda key, value: F.concat(F.lit(f'\t"{key}": '), value.cast("string"))
    fields = F.concat_ws(
        ",\n",
        text("read_id", F.col("read_id")),
        number("sequence_length", F.col("seq_len")),
        number("mapq", F.col("mapq")),
        F.when(F.col("align_len").isNotNull(), F.concat_ws(",\n", text("contig", F.col("contig")), number("reference_start", F.col("pos")), number("reference_end", F.col("ref_end")), number("alignment_length", F.col("align_len")))),
        text("alignment_type", F.col("read_state")),
        text("mod_count", mod_section(mods)),
    )
    return reads.select("rec_no", F.concat(F.lit("{\n"), fields, F.lit("\n}")).alias("json"))


def read_info(alignments: DataFrame, mods: ModFilter | None = None, detail: bool = False) -> DataFrame:
    """Rows (rec_no, json), one for each record; without detail, counts are of likely modifications."""
    mods = mods or ModFilter()
    mods = mods if detail else mods.promoted()
    reads = decode(with_alignment(alignments), mods, keep=DESCRIBED)
    return detailed(reads) if detail else condensed(reads, mods)


def reads_table(reads: DataFrame) -> DataFrame:
    """One row for each call of decoded reads, with the names and types of the export; a read without calls has none."""
    tracks = reads.select("read_id", "seq_len", "mapq", "read_state", "align_len", "pos", "ref_end", "contig", "tid", F.explode("tracks").alias("t"))
    each = tracks.select("*", F.explode("t.calls").alias("c"))
    mapped = F.col("align_len").isNotNull()
    return each.select(
        "read_id",
        F.col("seq_len").cast("long").alias("seq_len"),
        F.col("mapq").cast("long").alias("mapq"),
        F.col("read_state").alias("alignment_type"),
        F.when(mapped, F.col("pos")).cast("long").alias("align_start"),
        F.when(mapped, F.col("ref_end")).cast("long").alias("align_end"),
        F.when(mapped, F.col("contig")).alias("contig"),
        F.when(mapped, F.col("tid")).cast("long").alias("contig_id"),
        F.col("t.base").alias("base"),
        (F.col("t.strand") == "+").alias("is_strand_plus"),
        F.col("t.mod_code").alias("mod_code"),
        F.col("c.pos").cast("long").alias("position"),
        F.coalesce(F.col("c.ref_pos"), F.lit(-1)).cast("long").alias("ref_position"),
        F.col("c.qual").cast("long").alias("mod_quality"),
    )


def problems() -> Column:
    """What contradicts itself in a row of from_json(): an array of texts."""
    start, end = F.col("alignment.start"), F.col("alignment.end")
    calls = F.flatten(F.transform("mod_table", lambda t: t["data"]))
    falls = lambda data: F.exists(F.sequence(F.lit(1), F.greatest(F.size(data), F.lit(1))), lambda k: F.coalesce(F.get(F.get(data, k - 1), F.lit(0)) >= F.get(F.get(data, k), F.lit(0)), F.lit(False)))
    keys = F.transform("mod_table", lambda t: F.struct(t["is_strand_plus"], t["mod_code"]))
    unmapped = F.col("alignment_type") == "unmapped"
    outside = lambda c: (F.get(c, F.lit(1)) != -1) & (unmapped | (F.get(c, F.lit(1)) < start) | (F.get(c, F.lit(1)) >= end))
    rules = {
        "not a read state": ~F.col("alignment_type").isin(*FLAGS) | F.col("alignment_type").isNull(),
        "an unmapped read with an alignment": unmapped & F.col("alignment").isNotNull(),
        "a mapped read without alignment": ~unmapped & F.col("alignment").isNull(),
        "an alignment that covers nothing": (start < 0) | (start >= end),
        "a sequence of length 0": F.coalesce(F.col("seq_len") <= 0, F.lit(True)),
        "a call that isn't three numbers": F.exists(calls, lambda c: F.size(c) != 3),
        "positions that don't rise": F.exists("mod_table", lambda t: falls(t["data"])),
        "a position outside the sequence": F.exists(calls, lambda c: (F.get(c, F.lit(0)) < 0) | (F.get(c, F.lit(0)) >= F.col("seq_len"))),
        "a reference position outside the alignment": F.exists(calls, outside),
        "a probability out of range": F.exists(calls, lambda c: ~F.get(c, F.lit(2)).between(0, 255)),
        "a modification twice on a strand": F.size(F.array_distinct(keys)) < F.size(keys),
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def from_json(json: DataFrame, column: str = "json", mode: str = "strict") -> DataFrame:
    """Decoded reads from a column of detailed JSON objects.

    Columns read_id, read_state, strand, flag, mapq, seq_len, contig, tid, pos, ref_end, align_len
    and tracks, sorted. mode "permissive" keeps reads that contradict themselves, with what is
    wrong in the column problems; "strict" stops at the first.
    """
    x = json.select(F.from_json(F.col(column), T._parse_datatype_string(READ_JSON)).alias("x")).select("x.*")
    x = x.withColumns({"mapq": F.coalesce("mapq", F.lit(255).cast("short")), "mod_table": F.coalesce("mod_table", F.array().cast("array<struct<base: string, is_strand_plus: boolean, mod_code: string, data: array<array<int>>>>"))})
    found = x.withColumn("problems", problems())
    if mode == "strict":
        stop = F.raise_error(F.concat(F.lit("read "), F.coalesce("read_id", F.lit("?")), F.lit(": "), F.array_join("problems", ", ")))
        found = found.withColumn("read_id", F.when(F.size("problems") > 0, stop.cast("string")).otherwise(F.col("read_id")))
    calls = lambda data: F.transform(data, lambda c: F.struct(F.get(c, F.lit(0)).alias("pos"), F.when(F.get(c, F.lit(1)) >= 0, F.get(c, F.lit(1))).alias("ref_pos"), F.get(c, F.lit(2)).cast("short").alias("qual")))
    track = lambda t: F.struct(t["base"].alias("base"), F.when(t["is_strand_plus"], F.lit("+")).otherwise(F.lit("-")).alias("strand"), t["mod_code"].alias("mod_code"), code_point_column(t["mod_code"]).alias("mod_cp"), calls(t["data"]).alias("calls"))
    order = lambda t: F.struct(t["base"], t["strand"] == "-", t["mod_cp"], t.alias("t"))
    tracks = F.transform(F.array_sort(F.transform(F.transform("mod_table", track), order)), lambda s: s.getField("t"))
    out = found.select(
        "read_id",
        F.col("alignment_type").alias("read_state"),
        states.strand(F.col("alignment_type")).alias("strand"),
        states.flag(F.col("alignment_type")).alias("flag"),
        "mapq",
        "seq_len",
        F.col("alignment.contig").alias("contig"),
        F.col("alignment.contig_id").alias("tid"),
        F.col("alignment.start").alias("pos"),
        F.col("alignment.end").alias("ref_end"),
        (F.col("alignment.end") - F.col("alignment.start")).alias("align_len"),
        tracks.cast(f"array<{TRACK}>").alias("tracks"),
        "problems",
    )
    return out if mode != "strict" else out.drop("problems")
