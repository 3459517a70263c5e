"""Embedding near-dedup: an epsilon grid order join.

Cosine >= c means that the unit vectors are at most sqrt(2 - 2c) = epsilon apart. Vectors are
turned to principal axes, which are fitted to at most `SAMPLE` vectors of a length (the join is exact with
any axes), and sorted by their cells of width epsilon along the leading ones. The sequence is
cut into blocks that carry the box of their leading coordinates. A pair of blocks whose boxes
are more than epsilon apart is skipped: blocks meet by the cells that they cover along as many
of the leading axes as keep the table of cells in proportion to that of blocks, in one cell of
those that they share, and only if their boxes are close. Inside a task the two intervals are halved and
joined recursively, with the same test, down to leaves that are compared by one product of
matrices in double precision.

Equal vectors make one representative. A task gives out, for each vector, the number of its
links and one vector that it can reach, so what leaves it follows the number of vectors and
not that of pairs; classes are the connected components.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components
link with nothing; finite ones whose squares leave the range of doubles are first divided by a power of 2; vectors of different lengths don't link, and those of each length are joined by
themselves, with axes of their own; rows that repeat a vec_id are
one row of the result, with the vector that has the least digest; rows with a null vec_id
have null class and no links and are kept; an empty table gives an empty result; labels and
other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.links import Forest, classes
from modspark.llm.totals import running
from modspark.session import materialise, ship

COSINE = 0.95
#: Most vectors, by the hash of their ids, that the axes and their number of components come from.
SAMPLE = 8192
#: Leading axes that have cells and boxes.
LEADING = 8
#: Vectors in a block, of which a task holds two, and in a leaf of the recursion.
BLOCK = 4096
LEAF = 128
#: Vectors of a run, most of them; blocks are made of whole runs.
RUN = 1024
#: Rows of the table of cells for each block, on average and at most, unless one axis has more.
CELLS = 64
#: Components are taken as they are if the largest lies between this and its inverse.
RANGE = 1e-100
#: Slack for rounding in distances, far above it and far below epsilon.
SLACK = 1e-9


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of finite components and a length other than zero, as bytes of doubles with a digest."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        at = np.asarray(column.offsets)
        flat = column.values.cast(pa.float64())
        valid = np.asarray(column.is_valid())
        values = flat.to_numpy(zero_copy_only=False)  # nulls are NaN
        keep, raws, h, g = [], [], [], []
        for i in np.flatnonzero(valid):
            v = values[at[i] : at[i + 1]]
            top = np.abs(v).max() if len(v) else 0.0
            if np.isfinite(top) and top > 0:
                if not RANGE <= top <= 1 / RANGE:
                    v = np.ldexp(v, -np.frexp(top)[1])
                raws.append((v + 0.0).tobytes())  # -0.0 is 0.0
                two = np.frombuffer(xxhash.xxh3_128_digest(raws[-1]), "<i8")
                keep.append(i)
                h.append(int(two[0]))
                g.append(int(two[1]))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(raws, pa.binary()), pa.array(h, pa.int64()), pa.array(g, pa.int64())], ["vec_id", "raw", "h", "g"])


def axes(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A centre of vectors of one length, and their leading principal axes as columns."""
    x = np.array([np.frombuffer(v) for v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    _, turned = np.linalg.eigh((x - centre).T @ (x - centre))
    return centre, turned[:, ::-1][:, :LEADING]


def _project(centre: np.ndarray, turned: np.ndarray, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, len(centre))
            place = (x / np.linalg.norm(x, axis=1, keepdims=True) - centre) @ turned
            cells = np.floor(place / epsilon).astype(np.int32)
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists(cells), lists(place)], ["rep", "copies", "raw", "cells", "place"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rep, copies, raw, cells, place) to runs with their boxes."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            rows = batch.slice(at, RUN)
            place = rows.column(4).flatten().to_numpy().reshape(rows.num_rows, -1)
            values = [rows.column(0).to_numpy().astype("<i8").tobytes(), rows.column(1).to_numpy().astype("<i8").tobytes(), b"".join(rows.column(2).to_pylist()), place.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows]), pa.array([place.min(0).tolist()]), pa.array([place.max(0).tolist()]), *(pa.array([v], pa.binary()) for v in values)], ["n", "low", "high", "reps", "copies", "raw", "place"])


def _merge(keys: tuple, runs: pa.Table) -> pa.Table:
    """The runs of a block, in order, as one row."""
    runs = runs.sort_by("run")
    low, high = np.array(runs.column("low").to_pylist()).min(0), np.array(runs.column("high").to_pylist()).max(0)
    joined = {c: pa.array([b"".join(runs.column(c).to_pylist())], pa.binary()) for c in ("reps", "copies", "raw", "place")}
    return pa.table({"block": pa.array([keys[0].as_py()], pa.int64()), "low": pa.array([low.tolist()]), "high": pa.array([high.tolist()]), **joined})


def _blocks(placed: DataFrame, axes: int, size: int) -> DataFrame:
    """Blocks of about `size` vectors along the sequence of cells, however it is dealt into partitions."""
    order = [F.col("cells")[k] for k in range(axes)] + [F.col("rep")]
    count = placed.agg(F.count("*").alias("n")).first()["n"]
    cut = placed.repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
    runs = materialise(cut.mapInArrow(_runs, "n long, low array<double>, high array<double>, reps binary, copies binary, raw binary, place binary").withColumn("run", F.monotonically_increasing_id()))
    # Runs of a partition follow each other, and partitions by their numbers, which ids begin with.
    placed = running(runs.select("run", "n", F.shiftright("run", 33).alias("part")), [], "part", ["run"], {"before": F.col("n")})
    numbered = placed.select("run", F.floor(F.col("before") / size).alias("block"))  # a row for RUN vectors, without them
    return materialise(runs.join(numbered, "run").groupBy("block").applyInArrow(_merge, "block long, low array<double>, high array<double>, reps binary, copies binary, raw binary, place binary"))


class _Side:
    def __init__(self, reps: bytes, copies: bytes, raw: bytes, place: bytes) -> None:
        self.reps, self.copies = np.frombuffer(reps, "<i8"), np.frombuffer(copies, "<i8")
        n = len(self.reps)
        self.raw = np.frombuffer(raw).reshape(n, -1)
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.unit = self.raw / self.norm[:, None]
        self.place = np.frombuffer(place, "<f8").reshape(n, -1)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.place[a:b].min(0), self.place[a:b].max(0)
        return self.boxes[a, b]


class _Task:
    """The recursive join of two blocks, or of one with itself."""

    def __init__(self, x: _Side, y: _Side | None, cosine: float, epsilon: float) -> None:
        self.x, self.y, self.one = x, y or x, y is None
        self.cosine, self.reach = cosine, (epsilon + SLACK) ** 2
        self.shift = 0 if self.one else len(x.reps)
        self.links = np.zeros(self.shift + len(self.y.reps), np.int64)
        self.forest = Forest(len(self.links))

    def far(self, a: int, b: int, c: int, d: int) -> bool:
        (low, high), (least, most) = self.x.box(a, b), self.y.box(c, d)
        gap = np.maximum(0, np.maximum(least - high, low - most))
        return gap @ gap > self.reach

    def join(self, a: int, b: int, c: int, d: int) -> None:
        if self.far(a, b, c, d):
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.leaf(a, b, c, d)
            return
        same, m, n = self.one and (a, b) == (c, d), (a + b) // 2, (c + d) // 2
        for p, q in ((a, m), (m, b)) if b - a > LEAF else ((a, b),):
            for r, s in ((c, n), (n, d)) if d - c > LEAF else ((c, d),):
                if not (same and p > r):
                    self.join(p, q, r, s)

    def leaf(self, a: int, b: int, c: int, d: int) -> None:
        close = self.x.unit[a:b] @ self.y.unit[c:d].T
        hit = close >= self.cosine
        for i, j in np.argwhere(np.abs(close - self.cosine) < 1e-12):  # decided by the plain formula
            u, v = self.x.raw[a + i], self.y.raw[c + j]
            hit[i, j] = u @ v / (self.x.norm[a + i] * self.y.norm[c + j]) >= self.cosine
        if self.one and a == c:
            hit = np.triu(hit, 1)
        rows, columns = hit.any(1), hit.any(0)
        if not rows.any():
            return
        self.links[a:b] += hit @ self.y.copies[c:d]
        self.links[self.shift + c : self.shift + d] += self.x.copies[a:b] @ hit
        columns = np.flatnonzero(columns)
        for i in np.flatnonzero(rows):
            self.forest.join(int(a + i), self.shift + c + columns[hit[i, columns]])


def _join(cosine: float, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (_Side(row[f"reps{k}"], row[f"copies{k}"], row[f"raw{k}"], row[f"place{k}"]) if row[f"reps{k}"] is not None else None for k in (1, 2))
                task = _Task(x, y, cosine, epsilon)
                task.join(0, len(x.reps), 0, len(task.y.reps))
                reps = x.reps if y is None else np.concatenate((x.reps, y.reps))
                order = np.argsort(reps)  # a root is to be the least id
                some = np.flatnonzero(task.links)
                least: dict[int, int] = {}
                roots = task.forest.roots()
                for k in order:
                    least.setdefault(int(roots[k]), int(reps[k]))
                yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(task.links[some]), pa.array([least[int(r)] for r in roots[some]], pa.int64())], ["rep", "links", "root"])

    return run


def _pairs(blocks: DataFrame, axes: int, epsilon: float) -> DataFrame:
    """Rows (x, y), x <= y, of blocks whose boxes are within epsilon of each other."""
    first = [F.floor(F.col("low")[k] / epsilon) for k in range(axes)]
    last = [F.floor(F.col("high")[k] / epsilon) + 1 for k in range(axes)]  # and the next one: what is close may begin there
    wide = blocks.select("block", "low", "high", *(c.alias(f"first{k}") for k, c in enumerate(first)), *(c.alias(f"last{k}") for k, c in enumerate(last)))
    cells = [reduce(lambda a, b: a * b, (F.col(f"last{i}") - F.col(f"first{i}") + 1 for i in range(k + 1)), F.lit(1.0)) for k in range(axes)]
    totals = wide.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"t{k}") for k, c in enumerate(cells))).first()
    keys = max([1, *(k + 1 for k in range(axes) if totals["n"] and totals[f"t{k}"] <= CELLS * totals["n"])])

    def side(mark: str) -> DataFrame:
        out = wide.select(F.col("block").alias(mark), F.col("low").alias(f"low_{mark}"), F.col("high").alias(f"high_{mark}"), *(F.col(f"first{k}").alias(f"first{k}_{mark}") for k in range(keys)), *(F.col(f"last{k}").alias(f"last{k}") for k in range(keys)))
        for k in range(keys):
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(F.col(f"first{k}_{mark}"), F.col(f"last{k}")))).drop(f"last{k}")
        return out

    names = [f"cell{k}" for k in range(keys)]
    gap = F.expr("aggregate(zip_with(zip_with(low_y, high_x, (a, b) -> a - b), zip_with(low_x, high_y, (a, b) -> a - b), (a, b) -> greatest(0.0D, a, b)), 0.0D, (s, g) -> s + g * g)")
    once = reduce(lambda a, b: a & b, (F.col(f"cell{k}") == F.greatest(f"first{k}_x", f"first{k}_y") for k in range(keys)))  # of the cells that two share, the least
    return side("x").join(side("y"), names).where((F.col("x") <= F.col("y")) & once & (gap <= (epsilon + SLACK) ** 2)).select("x", "y")


def _links(groups: DataFrame, cosine: float, epsilon: float, block: int) -> DataFrame:
    """Rows (rep, links, root) of the join of vectors of one length."""
    centre, turned = axes([bytes(r["raw"]) for r in groups.orderBy(F.xxhash64("rep"), "rep").select("raw").limit(SAMPLE).collect()])
    placed = groups.select("rep", "copies", "raw").mapInArrow(_project(centre, turned, epsilon), "rep long, copies long, raw binary, cells array<int>, place array<double>")
    blocks = _blocks(placed, turned.shape[1], block)
    pairs = materialise(_pairs(blocks, turned.shape[1], epsilon))
    side = lambda k, key: blocks.select(F.col("block").alias(key), *(F.col(c).alias(f"{c}{k}") for c in ("reps", "copies", "raw", "place")))
    both = pairs.where("x < y").join(side(1, "x"), "x").join(side(2, "y"), "y")
    alone = pairs.where("x = y").join(side(1, "x"), "x").select("*", *(F.lit(None).cast("binary").alias(f"{c}2") for c in ("reps", "copies", "raw", "place")))
    return materialise(both.unionByName(alone).mapInArrow(_join(cosine, epsilon), "rep long, links long, root long"))


def cosine_classes(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each id."""
    spark = vectors.sparkSession
    ship(spark)
    epsilon = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    some = rows.where(F.col("vec_id").isNotNull())
    clean = some.mapInArrow(_clean, "vec_id long, raw binary, h long, g long").groupBy("vec_id").agg(F.min(F.struct("h", "g", "raw")).alias("s")).select("vec_id", "s.*")
    groups = materialise(clean.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    known = groups.select("h", "g", "rep", "copies")
    widths = groups.groupBy(F.length("raw").alias("width")).agg(F.count("*").alias("n")).where("n > 1").orderBy("width").collect()
    if widths:
        found = reduce(DataFrame.unionByName, (_links(groups.where(F.length("raw") == w["width"]), cosine, epsilon, block) for w in widths))
        known = classes(known, found)
    else:
        known = known.select("*", F.col("rep").alias("class"), (F.col("copies") - 1).alias("links"))
    linked = clean.select("vec_id", "h", "g").join(known.select("h", "g", "class", "links"), ["h", "g"]).select(F.col("vec_id").alias("__id"), "class", "links")
    ids = some.select("vec_id").distinct()
    out = ids.join(linked, F.col("vec_id") == F.col("__id"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "vec_id").alias("component_id"))
    nulls = rows.where(F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
