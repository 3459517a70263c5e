"""Alignments as a stream: SAM text or Parquet that arrives in a folder.

Filters, decoding and windows along nested tracks look at one record only, so they run on a
stream as they are, without state. Counts of read states and lengths are kept by Spark's own
aggregation, a row for each length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.model import ALIGNMENTS
from modspark.operators import record_filters, windows
from modspark.operators.alignment import with_alignment
from modspark.options import ModFilter, ReadFilter, Windowing
from modspark.sources import sam


def sam_stream(spark: SparkSession, folder: str, contigs: DataFrame) -> DataFrame:
    """Alignments of SAM text files as they arrive; rec_no tells a split's different lines apart, not their order."""
    lines = spark.readStream.text(folder).select(F.xxhash64("_metadata.file_path", "_metadata.file_block_start", "value").alias("rec_no"), "value")
    return sam.from_lines(lines, contigs)


def parquet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Alignments in Parquet files as they arrive."""
    return spark.readStream.schema(ALIGNMENTS).parquet(folder)


def window_stream(alignments: DataFrame, windowing: Windowing, reads: ReadFilter | None = None, mods: ModFilter | None = None, function=windows.density) -> DataFrame:
    """The window table of a stream, in append mode."""
    kept = alignments.where(record_filters.predicate(reads)) if reads else alignments
    return windows.window_table(windows.decode_windows(with_alignment(kept), mods, windowing, function))


def state_counts(alignments: DataFrame) -> DataFrame:
    """Rows (read_state, n, bases), in complete or update mode."""
    return with_alignment(alignments, zero_len=True).groupBy("read_state").agg(F.count("*").alias("n"), F.sum("seq_len").alias("bases"))
