"""Rows whose id may be in a set of ids, told by a bitmap, so that the others need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap for each id, and at most, as powers of 2: 64 MB, however many ids there are.
ROOM = 4
MOST = 29
#: Bits of a piece of a bitmap as Spark builds them (fixed value), as a power of 2.
PIECE = 15


def _slot(id: Column, power: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(1 << power)).cast("long")


def _told(rows: DataFrame, id: Column, ids: DataFrame, own: Column, mark: str) -> DataFrame:
    """rows with whether the bit at id is set in the broadcast bitmap of the bits own of ids."""
    maps = ids.groupBy(F.bitmap_bucket_number(own).alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("__bits"))
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(id) == F.col("__piece"), "left")
    place = F.bitmap_bit_position(id)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return found.withColumn(mark, F.coalesce(bit, F.lit(False))).drop("__piece", "__bits")


def exactly_marked(rows: DataFrame, id: str, ids: DataFrame, mark: str) -> DataFrame | None:
    """rows with a boolean column: whether the row's id is among ids; None where ids lie too far apart for that.

    ids: one long column, a table that is read twice. Here an id is its own place in the bitmap, of which only pieces that hold
    ids are broadcast: at most 2**MOST bits.
    """
    own = F.col(ids.columns[0])
    if ids.select(F.bitmap_bucket_number(own)).distinct().count() > 1 << (MOST - PIECE):
        return None
    return _told(rows, F.col(id).cast("long"), ids, own, mark)


def marked(rows: DataFrame, id: str, ids: DataFrame, mark: str) -> DataFrame:
    """rows with a boolean column: false only where the row's id is not among ids.

    ids: one long column, a table that is read twice. Its bitmap is broadcast: at most 2**MOST bits.
    With very many ids more rows are marked than need be, and none less.
    """
    name = ids.columns[0]
    power = min(MOST, max(PIECE, ids.count().bit_length() + ROOM))
    own, slot = _slot(F.col(name), power), _slot(F.col(id).cast("long"), power)
    return _told(rows, slot, ids, own, mark)
