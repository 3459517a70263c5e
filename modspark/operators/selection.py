"""Reads selected by conditions on the values of their windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.errors import InvalidOption
from modspark.functions.values import mod_code
from modspark.operators.windows import decode_windows, density, gradient, over_tracks
from modspark.options import ModFilter, Windowing, f32, fraction

#: A condition on the least and the largest value of a read's windows.
Condition = Callable[[Column, Column], Column]


def _single(value: float, least: float = 0.0) -> Column:
    return F.lit(f32(fraction(value, least))).cast("float")


def all_between(low: float, high: float) -> Condition:
    if not low <= high:
        raise InvalidOption("low is more than high")
    a, b = _single(low), _single(high)
    return lambda least, most: (least >= a) & (most <= b)


def any_above(high: float) -> Condition:
    b = _single(high)
    return lambda least, most: most >= b


def any_below(low: float) -> Condition:
    a = _single(low)
    return lambda least, most: least <= a


def any_below_and_any_above(low: float, high: float) -> Condition:
    below, above = any_below(low), any_above(high)
    return lambda least, most: below(least, most) & above(least, most)


def range_above(least_range: float) -> Condition:
    a = _single(least_range)
    return lambda least, most: (most - least).cast("float") >= a


def any_abs_above(least_abs: float) -> Condition:
    a = _single(least_abs)
    return lambda least, most: F.greatest(F.abs(least), F.abs(most)) >= a


def values_of(tag: str) -> Column:
    """Values of all windows of a modification, over both strands and any base."""
    tag = mod_code(tag)
    mine = F.filter("windows", lambda w: w["mod_code"] == tag)
    return F.flatten(F.transform(mine, lambda w: F.transform(w["windows"], lambda x: x["win_val"])))


def find_reads(reads: DataFrame, windowing: Windowing, tag: str, condition: Condition | None = None, function: Callable = density, predicate: Callable[[Column], Column] | None = None, mods: ModFilter | None = None) -> DataFrame:
    """Rows (rec_no, read_id) of the alignments whose window values meet the condition.

    reads: with tracks, or without them; then they are decoded in the same pass, and only tracks of the
    tag. A window on which the function fails stops the query. predicate: any other condition, on the array of the values. One row for each alignment record, so an id may come twice. Without windows no condition is
    met. A slope over windows of one call is an error, before any data is read.
    """
    if function is gradient and windowing.win < 2:
        raise InvalidOption("a slope needs windows of two calls or more")
    if "tracks" in reads.columns:
        windowed = over_tracks(reads, windowing, function, abort=True)
    else:
        windowed = decode_windows(reads, replace(mods or ModFilter(), tag=tag), windowing, function, ("rec_no", "read_id"), abort=True)
    values = windowed.select("rec_no", "read_id", values_of(tag).alias("v"))
    met = predicate(F.col("v")) if predicate else condition(F.array_min("v"), F.array_max("v"))
    return values.where((F.size("v") > 0) & met).select("rec_no", "read_id")


def find_in_windows(windows: DataFrame, condition: Condition, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """The keys whose windows, rows (keys, win_val), meet the condition: two extremes, combined before the shuffle."""
    ends = windows.groupBy(*keys).agg(F.min("win_val").alias("least"), F.max("win_val").alias("most"))
    return ends.where(condition(F.col("least"), F.col("most"))).select(*keys)
