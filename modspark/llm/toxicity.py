"""Toxicity: non-negative positive-unlabelled learning of linear classifiers.

Confirmed toxic documents (P) and documents taken without their labels (U) are all that is
learned from. The risk is the class-prior-corrected one, prior * R_P(+) + R_U(-) - prior *
R_P(-), whose second part can't be less than 0: a batch in which it is steps the other way.
The prior is the toxic share of all labelled training rows.

Features are hashed words, without regard to case and punctuation, and their first 4, 5 and 6
bytes, as present or not. Those that are surely more frequent in P than in U are kept.
`MODELS` classifiers start from different shuffles and their scores are averaged. Where an
average counts as toxic is chosen by the same risk with the 0-1 loss, and scores are shifted so
that this place is 0.5.

Limits: P has at most `POSITIVE` documents and U at most `UNLABELLED`, taken in the order of the hash
of their ids, with their whole texts, however long. Executors make the texts' feature sets and count
them; to the driver come at most `SELECTED` features of each document. Scores cover all rows, and
see nothing but the text.

Defined cases: a null or empty text has no features and gets the score of the bias; rows that
repeat are scored each; a very long text is worked through in pieces; a null doc_id is never learned from and isn't held out; without any
positive label every score is the prior, or 0 without labels; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.llm.text import LOWER, PARTS, hashes, mix, place_of, sorted_sets, steps, utf8, words
from modspark.session import materialise, ship

POSITIVE = 4000
UNLABELLED = 8000
SELECTED = 4096
LIFT = 3.0
MODELS = 3
PREFIXES = (4, 5, 6)
BITS = 22
FOLDS = 5
EPOCHS = 40
BATCHES = 8
RATE = 0.1
DECAY = 1e-3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashed features, ascending, and where they begin (one more)."""
    low = LOWER[data]
    start, end, first = words(low, at, PARTS)
    kinds = [hashes(low, start, end)]
    for n in PREFIXES:
        cut = np.minimum(start + n, end)
        kinds.append(mix(hashes(low, start, cut) ^ np.uint64(n)))
    every = np.stack(kinds, 1).ravel() >> np.uint64(64 - BITS)
    return sorted_sets(every, first * len(kinds))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Sets:
    """Feature sets of many texts, with numbered features."""

    def __init__(self, flat: np.ndarray, at: np.ndarray) -> None:
        self.flat, self.at = flat, at

    @classmethod
    def of(cls, numbers: list[np.ndarray]) -> Sets:
        return cls(np.concatenate([np.zeros(0, np.int32), *numbers]), np.cumsum([0, *map(len, numbers)]))

    def only(self, chosen: np.ndarray) -> Sets:
        """With numbers in place of the chosen features, the others left out."""
        k = np.minimum(np.searchsorted(chosen, self.flat), max(len(chosen) - 1, 0))
        have = chosen[k] == self.flat if len(chosen) else np.zeros(len(self.flat), bool)
        before = np.concatenate(([0], np.cumsum(have)))
        return Sets(k[have], before[self.at])

    def rows(self, order: np.ndarray) -> Sets:
        sizes = np.diff(self.at)[order]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return Sets(self.flat[np.repeat(self.at[order] - at[:-1], sizes) + np.arange(at[-1])], at)

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.flat])))
        return total[self.at[1:]] - total[self.at[:-1]]

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(g, np.diff(self.at)), n)

    def __len__(self) -> int:
        return len(self.at) - 1


def select(features: np.ndarray, n: np.ndarray, m: np.ndarray, p: int, u: int, most: int = SELECTED) -> np.ndarray:
    """The features that are surely more frequent in P than in U, at most `most`, ascending.

    n, m: in how many of the p documents of P and the u of U each feature is. Sure: the lower
    95 % bound of the ratio of frequencies is `LIFT` or more. Those with the largest bounds are taken.
    """
    m = m + 0.5
    least = np.log(n / p) - np.log(m / u) - 1.645 * np.sqrt(1 / n + 1 / m)
    sure = np.flatnonzero(least >= np.log(LIFT))
    return np.sort(features[sure[np.argsort(-least[sure], kind="stable")[:most]]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradient(x: Sets, y: Sets, w: np.ndarray, prior: float, n: int) -> tuple[np.ndarray, float]:
    """Of the non-negative risk of positive sets x and unlabelled sets y at weights w[:n] and bias w[n]; and its second part.

    Where the second part is below 0 it is the gradient that leads away from that.
    """
    sp, su = sigmoid(x.times(w) + w[n]), sigmoid(y.times(w) + w[n])
    risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
    if risk >= 0:
        gp, gu = -prior * (1 - sp) / len(sp) - prior * sp / len(sp), su / len(su)
    else:  # unlabelled rows are fitted too well
        gp, gu = prior * sp / len(sp), -su / len(su)
    return np.append(x.back(gp, n) + y.back(gu, n), gp.sum() + gu.sum()), float(risk)


def train(p: Sets, u: Sets, prior: float, n: int, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam."""
    draw = np.random.default_rng(seed)
    w, m, v, step = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    w[n] = np.log(prior / (1 - prior))
    for _ in range(epochs):
        for some_p, some_u in zip(np.array_split(draw.permutation(len(p)), BATCHES), np.array_split(draw.permutation(len(u)), BATCHES)):
            if not len(some_p) or not len(some_u):
                continue
            g, _ = gradient(p.rows(some_p), u.rows(some_u), w, prior, n)
            g[:n] += DECAY * w[:n]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The place among scores of P and U at which the non-negative risk of errors is least, the highest such place."""
    places = np.unique(np.concatenate((p, u)))
    missed = np.searchsorted(np.sort(p), places) / len(p)
    above = 1 - np.searchsorted(np.sort(u), places) / len(u)
    risk = prior * missed + np.maximum(0, above - prior * (1 - missed))
    k = int(np.flatnonzero(risk <= risk.min() + 1e-12)[-1])
    return float(np.clip((places[k] + places[max(k - 1, 0)]) / 2, 1e-6, 1 - 1e-6))


def averaged(sets: Sets, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    return np.mean([sigmoid(sets.times(w) + b) for w, b in zip(weights, biases)], axis=0)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature set of each text as int32."""
    for batch in batches:
        data, at = utf8(batch.column(2))
        for i, j, d, a in steps(data, at):
            flat, first = features(d, a)
            flat = flat.astype("<i4")
            raws = [flat[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(raws, pa.binary())], ["positive", "doc_id", "raw"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of P and of U in each batch have a feature."""
    for batch in batches:
        positive = np.asarray(batch.column(0).to_pylist(), bool)
        raws = batch.column(2).to_pylist()
        p, u = (np.frombuffer(b"".join(r for r, x in zip(raws, positive) if x == want), "<i4") for want in (True, False))
        found = np.unique(np.concatenate((p, u)))
        n, m = (np.bincount(np.searchsorted(found, x), minlength=len(found)) for x in (p, u))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], ["feature", "n", "m"])


def _only(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [Sets(np.frombuffer(r, "<i4"), np.array([0, len(r) // 4])).only(chosen).flat.astype("<i4").tobytes() for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary())], ["positive", "doc_id", "raw"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The chosen features, a row of weights for each model, their biases, and where to cut."""
    ids = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    by_hash = lambda rows, n: rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(known.where("toxic = 1"), POSITIVE).withColumn("positive", F.lit(True)).unionByName(by_hash(ids, UNLABELLED).withColumn("positive", F.lit(False)))
    kind = "positive boolean, doc_id long, raw binary"
    sets = materialise(ids.join(F.broadcast(chosen), "doc_id").select("positive", "doc_id", "text").mapInArrow(_sets, kind))
    bias = np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6)))
    sizes = {r["positive"]: r["n"] for r in sets.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or not 0 < rate < 1:
        return np.zeros(0, np.int64), np.zeros((1, 0)), np.array([bias]), 0.5
    counts = sets.mapInArrow(_counted, "feature int, n long, m long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n >= 3")
    counts = counts.toArrow().sort_by("feature")
    chosen_features = select(*(counts.column(c).to_numpy() for c in ("feature", "n", "m")), sizes[True], sizes[False])
    few = sets.mapInArrow(_only(chosen_features), kind)
    p, u = (Sets.of([np.frombuffer(r["raw"], "<i4") for r in few.where(F.col("positive") == x).orderBy("doc_id", "raw").select("raw").toLocalIterator()]) for x in (True, False))
    models = [train(p, u, rate, len(chosen_features), seed) for seed in range(MODELS)]
    weights, biases = np.array([w for w, _ in models]), np.array([b for _, b in models])
    return chosen_features, weights, biases, cut(averaged(p, weights, biases), averaged(u, weights, biases), rate)


def _score(names: list[str], text: str, chosen: np.ndarray, weights: np.ndarray, biases: np.ndarray, place: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place_of(names, text)))
            scores = np.zeros(len(at) - 1)
            for i, j, d, a in steps(data, at):
                flat, first = features(d, a)
                own = Sets(flat.astype(np.int64), first).only(chosen)
                mean = averaged(own, weights, biases)
                scores[i:j] = mean * (1 - place) / (mean * (1 - place) + (1 - mean) * place)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of docs, by models that fit() trains on docs and labels."""
    ship(docs.sparkSession)
    model = fit(docs, labels, id, text)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_score(rows.columns, "text", *model), "doc_id long, held_out boolean, text string, score double, predicted int").drop("text")
