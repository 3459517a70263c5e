"""Calls as a dense matrix: one row for each track, one number for each base, 0 where nothing is called."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.operators.decode import flat_calls, offsets
from modspark.session import ship


def _filler(names: list[str]):
    at, length = names.index("tracks"), names.index("seq_len")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            if lists.null_count:
                lists = lists.fill_null(pa.scalar([], lists.type))
            counts = np.diff(np.asarray(lists.offsets))
            bases = np.asarray(batch.column(length).fill_null(0)).astype(np.int64)
            sizes = np.repeat(bases, counts)  # of the rows of the matrix, one for each track
            begin = np.concatenate(([0], np.cumsum(sizes)))
            filled = np.zeros(begin[-1], np.int16)
            _, track, pos, qual = flat_calls(lists)
            filled[begin[track] + pos] = qual
            rows = pa.ListArray.from_arrays(offsets(sizes), pa.array(filled))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.ListArray.from_arrays(offsets(counts), rows)], [*names, "dense"])

    return run


def with_dense_calls(reads: DataFrame) -> DataFrame:
    """Adds dense, array (tracks) of array (bases) of probabilities, to decoded reads. Tracks keep their order."""
    ship(reads.sparkSession)
    rows = reads.drop("dense")
    return rows.mapInArrow(_filler(rows.columns), T.StructType([*rows.schema.fields, T.StructField("dense", T.ArrayType(T.ArrayType(T.ShortType())))]))


def mod_types() -> Column:
    """The rows of dense as (base, strand, mod_code)."""
    return F.transform("tracks", lambda t: F.struct(t["base"], t["strand"], t["mod_code"]))


def mod_calls(pos: Column | int) -> Column:
    """The probabilities of all tracks at a base; null outside the read."""
    at = F.lit(pos) if isinstance(pos, int) else pos
    return F.when((at >= 0) & (at < F.col("seq_len")), F.transform("dense", lambda row: F.get(row, at)))


def modified_mask() -> Column:
    """For each base, whether any track has a call above 0."""
    none = F.array_repeat(F.lit(False), F.col("seq_len"))
    return F.aggregate("dense", none, lambda mask, row: F.zip_with(mask, row, lambda m, q: m | (q > 0)))
