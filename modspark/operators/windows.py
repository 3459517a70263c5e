"""Windows of a fixed number of calls along each track.

Three forms give the same windows. over_tracks() works on nested tracks, a row for each read:
numpy on Arrow batches, no shuffle, time linear in the calls. decode_windows() decodes and makes
windows in one such pass, so that no track crosses between the engines. over_calls() works on a table of
single calls: running sums in one window specification, one shuffle by track, so the cost of
a window doesn't depend on its width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.errors import EmptyWindow, InsufficientData, InvalidOption, LowDensity, ModsparkError
from modspark.functions.values import code_point
from modspark.model import MISSING, WINDOW_TRACK
from modspark.operators.decode import NEEDED, decode_batch, kept, offsets
from modspark.options import ModFilter, Windowing
from modspark.session import ship

#: Probability from which a base counts as modified.
LIKELY = 128
#: The error chance of each byte of a text of qualities.
CHANCE = 10.0 ** (-(np.arange(256) - 33) / 10)


def density(qual: np.ndarray) -> np.float32:
    """The share of modified bases."""
    if not len(qual):
        raise EmptyWindow("a window without calls")
    return np.float32(np.count_nonzero(np.asarray(qual) >= LIKELY) / len(qual))


def gradient(qual: np.ndarray) -> np.float32:
    """The least-squares slope of modified (1) or not (0) against 1, 2, 3, ..."""
    n = len(qual)
    if not n:
        raise EmptyWindow("a window without calls")
    if n == 1:
        raise InsufficientData("a slope needs two calls")
    y = np.asarray(qual) >= LIKELY
    x = np.arange(1, n + 1) - (n + 1) / 2
    return np.float32(x[y].sum() / (n * (n * n - 1) / 12))


def density_at_least(least: float) -> Callable[[np.ndarray], np.float32]:
    """The density, in windows where it is `least` or more."""
    bound = np.float32(least)

    def value(qual: np.ndarray) -> np.float32:
        found = density(qual)
        if found < bound:
            raise LowDensity(f"{found} is less than {bound}")
        return found

    return value


def window_values(qual: np.ndarray, win: int, step: int, function, abort: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First calls of the windows and their values; windows on which the function fails are left out, unless that is to stop everything."""
    first, _, values = _values_of_tracks(np.asarray(qual), np.array([0, len(qual)]), win, step, function, abort)
    return first, values


def _values_of_tracks(qual: np.ndarray, edges: np.ndarray, win: int, step: int, function, abort: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First calls of the windows of many tracks, counted over all of them, windows for each track, and values; track t is qual[edges[t]:edges[t + 1]]."""
    counts = np.maximum((np.diff(edges) - win) // step + 1, 0)
    if function is gradient and win == 1:
        counts[:] = 0
    track = np.repeat(np.arange(len(counts)), counts)
    local = (np.arange(len(track)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    first = edges[track] + local
    if function is density:
        total = np.concatenate(([0], np.cumsum(qual >= LIKELY)))
        return first, counts, ((total[first + win] - total[first]) / win).astype(np.float32)
    if function is gradient:
        y = (qual >= LIKELY).astype(np.int64)
        place = np.arange(1, len(y) + 1) - np.repeat(edges[:-1], np.diff(edges))
        total, weighted = (np.concatenate(([0], np.cumsum(x))) for x in (y, y * place))
        n = total[first + win] - total[first]
        slope = (weighted[first + win] - weighted[first] - local * n - n * (win + 1) / 2) / (win * (win * win - 1) / 12)
        return first, counts, slope.astype(np.float32)
    kept, values = [], []
    for k, i in enumerate(first):
        try:
            values.append(function(qual[i : i + win]))
            kept.append(k)
        except ModsparkError:
            if abort:
                raise
    kept = np.array(kept, np.int64)
    return first[kept], np.bincount(track[kept], minlength=len(counts)), np.array(values, np.float32)


def mean_quality(qual: str | None, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mean error chance of bases [start, end) as a quality; 255 where there are none."""
    return mean_qualities([qual], np.zeros(len(start), np.int64), start, end)


def mean_qualities(quals: list[str | None], owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mean error chance of bases [start, end) of the qualities numbered owner, as a quality; 255 where those are missing."""
    texts = [b"" if q is None else q.encode() for q in quals]
    at = np.cumsum([0, *map(len, texts)])[owner]
    some = ~np.array([q is None for q in quals], bool)[owner]
    out = np.full(len(start), MISSING, np.int16)
    if some.any():
        chance = np.append(CHANCE[np.frombuffer(b"".join(texts), np.uint8)], 0.0)
        low, high = (at + start)[some], (at + end)[some]
        total = np.add.reduceat(chance, np.stack((low, high), 1).ravel())[::2]
        out[some] = np.floor(-10 * np.log10(total / (high - low)) + 0.5)
    return out


class _Found:
    """Windows of many tracks as flat columns, made for all tracks at once."""

    KINDS = (pa.int32(), pa.int32(), pa.float32(), pa.int16(), pa.int32(), pa.int32())
    NAMES = ("win_start", "win_end", "win_val", "basecall_qual", "ref_win_start", "ref_win_end")

    def __init__(self, windowing: Windowing, function, abort: bool) -> None:
        self.windowing, self.function, self.abort = windowing, function, abort

    def array(self, edges: np.ndarray, pos: np.ndarray, ref: np.ndarray, prob: np.ndarray, quals: list[str | None], owner: np.ndarray) -> pa.Array:
        """A list of windows for each track.

        Track t has the calls [edges[t], edges[t + 1]) of pos, ref (-1 where there is none, or rising) and prob, and the
        qualities numbered owner[t].
        """
        win = self.windowing.win
        first, counts, values = _values_of_tracks(prob, edges, win, self.windowing.step, self.function, self.abort)
        last = first + win - 1
        start, end = pos[first], pos[last] + 1
        known = np.flatnonzero(ref >= 0)
        i, j = np.searchsorted(known, first), np.searchsorted(known, last, "right") - 1
        some = i <= j
        low, high = np.full(len(first), -1), np.full(len(first), -1)
        low[some], high[some] = ref[known[i[some]]], ref[known[j[some]]] + 1
        flat = (start, end, values, mean_qualities(quals, np.repeat(owner, counts), start, end), low, high)
        columns = [pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, kind in zip(flat, self.KINDS)]
        return pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays(columns, self.NAMES))


_TRACK = ("base", "strand", "mod_code", "mod_cp")


def _windower(names: list[str], windowing: Windowing, function, abort: bool):
    at, with_qual = names.index("tracks"), names.index("qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quals = batch.column(with_qual).to_pylist()
            lists = batch.column(at)
            if lists.null_count:
                lists = lists.fill_null(pa.scalar([], lists.type))
            tracks = lists.flatten()
            owner = np.repeat(np.arange(len(quals)), np.diff(np.asarray(lists.offsets)))
            calls = tracks.field("calls")
            edges = np.asarray(calls.offsets) - calls.offsets[0].as_py()
            flat = calls.flatten()
            pos, prob = (np.asarray(flat.field(k)).astype(np.int64) for k in ("pos", "qual"))
            ref = np.asarray(flat.field("ref_pos").fill_null(-1)).astype(np.int64)
            found = _Found(windowing, function, abort).array(edges.astype(np.int64), pos, ref, prob, quals, owner)
            track = pa.StructArray.from_arrays([*(tracks.field(k) for k in _TRACK), found], [*_TRACK, "windows"])
            out = pa.ListArray.from_arrays(offsets(np.diff(np.asarray(lists.offsets))), track)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), out], [*names, "windows"])

    return run


def over_tracks(reads: DataFrame, windowing: Windowing, function: Callable = density, abort: bool = False) -> DataFrame:
    """Adds windows to reads with tracks: for each track its windows, also where there are none.

    function: density, gradient, density_at_least(x), or any callable from an array of
    probabilities to a number; a window on which it raises one of this package's errors is
    skipped, or with abort stops the query.
    """
    ship(reads.sparkSession)
    rows = reads.drop("windows")
    schema = T.StructType([*rows.schema.fields, T.StructField("windows", T._parse_datatype_string(f"array<{WINDOW_TRACK}>"))])
    return rows.mapInArrow(_windower(rows.columns, windowing, function, abort), schema)


def _both(names: list[str], keep: list[int], mods: ModFilter, windowing: Windowing, function, abort: bool, wanted, position):
    need, ml, with_qual = [names.index(x) for x in NEEDED], names.index("ml"), names.index("qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = decode_batch(batch, need, ml, mods, True, wanted, position)
            quals = batch.column(with_qual).to_pylist()
            flat, each = [t for r in rows for t in r], [len(r) for r in rows]
            none = np.zeros(0, np.int64)
            pos, ref, prob = (np.concatenate([none, *(getattr(t, k) for t in flat)]) for k in ("pos", "ref", "qual"))
            edges = np.cumsum([0, *(len(t.pos) for t in flat)])
            found = _Found(windowing, function, abort).array(edges, pos, ref, prob, quals, np.repeat(np.arange(len(rows)), each))
            points = pa.array([code_point(t.code) for t in flat], pa.int32())
            names_of = [pa.array([getattr(t, k) for t in flat], pa.string()) for k in ("base", "strand", "code")]
            track = pa.StructArray.from_arrays([*names_of, points, found], [*_TRACK, "windows"])
            out = pa.ListArray.from_arrays(offsets(each), track)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), out], [*(names[k] for k in keep), "windows"])

    return run


def decode_windows(reads: DataFrame, mods: ModFilter | None, windowing: Windowing, function: Callable = density, keep: tuple[str, ...] | None = ("rec_no", "read_id", "contig", "strand"), abort: bool = False, wanted=None, position=None) -> DataFrame:
    """over_tracks(decode(reads, mods)) in one pass, without the tracks; keep: the columns of reads that are still wanted, or None for all."""
    ship(reads.sparkSession)
    rows, out = kept(reads.drop("tracks", "windows"), keep, (*NEEDED, "ml"))
    schema = T.StructType([*(rows.schema.fields[k] for k in out), T.StructField("windows", T._parse_datatype_string(f"array<{WINDOW_TRACK}>"))])
    return rows.mapInArrow(_both(rows.columns, out, mods or ModFilter(), windowing, function, abort, wanted, position), schema)


def window_table(windowed: DataFrame) -> DataFrame:
    """One row for each window, with the names and types of the window table."""
    tracks = windowed.select("rec_no", "read_id", "contig", "strand", F.posexplode("windows").alias("track_no", "t"))
    each = tracks.select("*", F.posexplode("t.windows").alias("idx", "w"))
    return each.select(
        F.coalesce("contig", F.lit(".")).alias("contig"),
        F.col("w.ref_win_start").cast("long").alias("ref_win_start"),
        F.col("w.ref_win_end").cast("long").alias("ref_win_end"),
        "read_id",
        F.col("w.win_val").alias("win_val"),
        "strand",
        F.col("t.base").alias("base"),
        F.col("t.strand").alias("mod_strand"),
        F.col("t.mod_code").alias("mod_type"),
        F.col("w.win_start").cast("long").alias("win_start"),
        F.col("w.win_end").cast("long").alias("win_end"),
        F.col("w.basecall_qual").cast("long").alias("basecall_qual"),
        "rec_no",
        "track_no",
        "idx",
    )


def over_calls(calls: DataFrame, windowing: Windowing, keys: tuple[str, ...] = ("rec_no", "track_no"), kind: str = "density", single: bool = True, order: str = "idx") -> DataFrame:
    """Rows (keys, idx, win_start, win_end, win_val) from rows (keys, idx, pos, qual) of calls.

    order: a column with the same order as idx, by which rows may be sorted already. single: values as single precision, as over_tracks() gives them, or else as double.
    """
    win, step = windowing.win, windowing.step
    if kind == "gradient" and win < 2:
        raise InvalidOption("a slope needs windows of two calls or more")
    along = Window.partitionBy(*keys).orderBy(order)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = (F.col("qual") >= LIKELY).cast("long")
    summed = calls.select(*dict.fromkeys((*keys, "idx", "pos", order)), y.alias("y"), F.sum(y).over(running).alias("s"), F.sum(y * (F.col("idx") + 1)).over(running).alias("t"))
    last = lambda c: F.lead(c, win - 1).over(along)
    n = last("s") - F.col("s") + F.col("y")
    if kind == "density":
        value = n / F.lit(float(win))
    else:
        weighted = last("t") - F.col("t") + F.col("y") * (F.col("idx") + 1) - F.col("idx") * n
        value = (weighted - F.lit((win + 1) / 2) * n) / F.lit(win * (win * win - 1) / 12)
    ends = summed.select(*keys, "idx", F.col("pos").alias("win_start"), (last("pos") + 1).alias("win_end"), value.cast("float" if single else "double").alias("win_val"))
    return ends.where(F.col("win_end").isNotNull() & (F.col("idx") % step == 0))
