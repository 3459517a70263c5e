"""What follows from an alignment alone: state, lengths, interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions import states
from modspark.functions.sequence import reference_length


def with_alignment(alignments: DataFrame, zero_len: bool = False) -> DataFrame:
    """Adds read_state, strand, seq_len, ref_end and align_len (the last two null if unmapped).

    A read without sequence stops the query unless zero_len is set; so does a mapped read whose
    alignment covers nothing.
    """
    mapped = F.col("flag").bitwiseAND(4) == 0
    span = reference_length(F.col("cigar"))
    good = (span > 0) & (F.col("pos") >= 0)
    checked = F.when(~mapped, F.lit(None)).when(good, span).otherwise(F.raise_error(F.concat(F.lit("alignment covers nothing: "), F.col("read_id"))))
    length = F.length("seq") if zero_len else F.when(F.length("seq") > 0, F.length("seq")).otherwise(F.raise_error(F.concat(F.lit("sequence of length 0: "), F.col("read_id"))))
    out = alignments.withColumns({"read_state": states.state(F.col("flag")), "seq_len": length.cast("int"), "align_len": checked.cast("int")})
    return out.withColumns({"strand": states.strand(F.col("read_state")), "ref_end": (F.col("pos") + F.col("align_len")).cast("int")})


def interval() -> Column:
    """The stranded interval of a read; an unmapped one has an empty interval."""
    none = F.lit(None).cast("string")
    unmapped = F.col("align_len").isNull()
    return F.struct(
        F.when(unmapped, none).otherwise(F.col("contig")).alias("contig"),
        F.when(unmapped, F.lit(0)).otherwise(F.col("pos")).alias("start"),
        F.when(unmapped, F.lit(0)).otherwise(F.col("ref_end")).alias("end"),
        F.when(unmapped, F.lit(".")).otherwise(F.col("strand")).alias("strand"),
    )
