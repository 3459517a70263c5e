"""Running sums whose rows are never in one task: inside buckets, plus the sums of the buckets before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a long column for each of sums: what it adds up to over the rows before, of the same keys.

    Rows are ordered by bucket and then by order, which must be unique there. bucket: a column that
    rises with the order, and parts a hot key into buckets of a bounded size; it is dropped. keys are never null; rows are read twice.
    """
    parts = rows.groupBy(*keys, bucket).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, bucket])), *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"__in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    same = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate([*keys, bucket])]
    joined = own.join(starts, same)
    return joined.withColumns({n: (F.col(f"__{n}") + F.col(f"__in_{n}")).cast("long") for n in sums}).select(*(c for c in rows.columns if c != bucket), *sums)
