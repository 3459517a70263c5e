"""Counts of read states and statistics of lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.operators.alignment import with_alignment

#: Rows of the result, in order (fixed values).
COUNTS = ("n_primary_alignments", "n_secondary_alignments", "n_supplementary_alignments", "n_unmapped_reads", "n_reversed_reads")
LENGTHS = ("mean", "max", "min", "median", "n50")
KEYS = (*COUNTS, *(f"{of}_{k}" for of in ("align_len", "seq_len") for k in LENGTHS))


def length_stats(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, mean, max, min, median, n50) of rows (keys, length).

    Works on the number of rows of each length, which combines before the shuffle. The mean is
    rounded down. The median is the length at place ceil(n / 2), counted from 0, when lengths
    are sorted from the longest, and 0 if there is no such place. N50 is the first length, in that
    order, at which the running total is more than ceil(total / 2), or 0.
    """
    held = lengths.groupBy(*keys, "length").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    total = F.col("n") * F.col("length")
    run = held.select(*keys, "length", "n", F.sum("n").over(down).alias("seen"), F.sum(total).over(down).alias("sum"), F.sum("n").over(every).alias("rows"), F.sum(total).over(every).alias("total"))
    half = lambda c: F.expr(f"({c} + 1) div 2")
    return run.groupBy(*keys).agg(
        F.expr("max(total) div max(rows)").alias("mean"),
        F.max("length").cast("long").alias("max"),
        F.min("length").cast("long").alias("min"),
        F.coalesce(F.max(F.when(F.col("seen") > half("rows"), F.col("length"))), F.lit(0)).cast("long").alias("median"),
        F.coalesce(F.max(F.when(F.col("sum") > half("total"), F.col("length"))), F.lit(0)).cast("long").alias("n50"),
    )


def state_counts(reads: DataFrame) -> list:
    state = F.col("read_state")
    kinds = [F.startswith(state, F.lit(x)) for x in ("primary", "secondary", "supplementary", "unmapped")]
    return [F.count_if(x).alias(n) for n, x in zip(COUNTS, [*kinds, F.endswith(state, F.lit("reverse"))])]


def read_stats(alignments: DataFrame) -> DataFrame:
    """Rows (key, value), 15 of them. Alignment lengths are those of mapped records; a read without sequence is an error."""
    return stats_of(with_alignment(alignments))


def stats_of(reads: DataFrame) -> DataFrame:
    """read_stats() of rows (read_state, align_len, seq_len), align_len null for unmapped reads."""
    counts = reads.agg(*state_counts(reads))
    lengths = reads.select(F.explode(F.array(F.struct(F.lit("align_len").alias("of"), F.col("align_len").alias("length")), F.struct(F.lit("seq_len").alias("of"), F.col("seq_len").alias("length")))).alias("x")).select("x.*").where("length is not null")
    wide = length_stats(lengths, ("of",))
    found = wide.select(F.explode(F.array(*(F.struct(F.concat("of", F.lit(f"_{k}")).alias("key"), F.col(k).alias("value")) for k in LENGTHS))).alias("x")).select("x.*")
    none = [f"{of}_{k}" for of in ("align_len", "seq_len") for k in LENGTHS]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in COUNTS), *(F.struct(F.lit(k).alias("key"), F.lit(0).cast("long").alias("value")) for k in none))
    return counts.select(F.explode(pairs).alias("x")).select("x.*").unionByName(found).groupBy("key").agg(F.sum("value").alias("value"))
