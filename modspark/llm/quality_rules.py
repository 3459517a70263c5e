"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed 4-grams of bytes are counted: one over the trusted target
(all documents labelled good, however many), one over the whole raw corpus. A document's score is the sum over its n-grams of
log p_target - log p_raw, divided by their number; it is kept if the score reaches a fixed
threshold, so every document has one verdict that needs no draw.

The tables have a fixed size (2**16 counts), which is all that is gathered; broadcast are they and
a bitmap of the target's ids (64 MB at most). Texts aren't shuffled, unless the ids lie too far apart
for an exact bitmap: then those that a hashed one lets through meet the ids in a join of Spark's choice.

Defined cases: a null or empty text has no words and fails the base rules; a text without
n-grams scores 0; rows that repeat a doc_id are scored each by its own text; rows with a
null doc_id are scored, but are never part of the target; with no target every score is 0;
empty tables give an empty result; other columns pass through, and columns named like the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.llm.members import exactly_marked, marked
from modspark.llm.text import PIECE, SPACE, grams, hashes, mix, place_of, reduced, steps, utf8, words
from modspark.session import materialise, ship

BITS = 16
GRAM = 4
#: Mean log-likelihood ratio per n-gram from which a document is kept.
THRESHOLD = -0.6
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "llr": "double", "base_failed": "boolean", "kept": "boolean"}


def ngram_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of bytes that lies inside a text, and each text's first one (one more)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h |= data[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    bucket = (mix(h.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int32)
    sizes = np.diff(at)
    counts = np.maximum(sizes - GRAM + 1, 0)
    inside = np.ones(n + GRAM, bool)
    for k in range(1, GRAM):
        inside[at[1:][sizes >= k] - k] = False
    first = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=first[1:])
    return bucket[inside[:n]], first


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A step as it is, or one long text in pieces that hold each of its n-grams once."""
    if len(data) <= PIECE:
        yield data, at
        return
    for p in range(0, len(data) - GRAM + 1, PIECE):
        part = data[p : p + PIECE + GRAM - 1]
        yield part, np.array([0, len(part)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False))
        data, at = utf8(batch.column(0))
        for i, j, d, a in steps(data, at):
            for part, places in _pieces(d, a):
                bucket, first = ngram_buckets(part, places)
                raw += np.bincount(bucket, minlength=1 << BITS)
                if good[i:j].any():
                    target += np.bincount(bucket[np.repeat(good[i:j], np.diff(first))], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def repeated_words(word: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more; word: hashes of one text's words."""
    if len(word) <= WINDOW:
        return 0
    window, _ = grams(word, np.array([0, len(word)]), WINDOW)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(window), np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    cover = np.zeros(len(word) + 1, np.int64)
    cover[: len(window)] += twice
    cover[WINDOW : WINDOW + len(window)] -= twice
    return int(np.count_nonzero(np.cumsum(cover)[: len(word)]))


def _duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _score(names: list[str], text: str, ratio: np.ndarray, threshold: float):
    symbol = np.zeros(256, np.uint8)
    symbol[list(SYMBOLS)] = 1
    letter = (((np.arange(256) & 0xC0) != 0x80) & ~SPACE).astype(np.uint8)  # bytes that begin a code point of a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place_of(names, text)))
            n = len(at) - 1
            out = {k: np.zeros(n, np.int64) for k in list(FIELDS)[:5]}
            llr = np.zeros(n)
            for i, j, d, a in steps(data, at):
                start, end, first = words(d, a)
                out["n_words"][i:j] = np.diff(first)
                out["word_chars"][i:j] = reduced(np.add, letter[d], a, 0, np.int64)
                out["n_symbols"][i:j] = reduced(np.add, symbol[d], a, 0, np.int64)
                word = hashes(d, start, end)
                total, grams_of = np.zeros(j - i), np.zeros(j - i, np.int64)
                for part, places in _pieces(d, a):
                    bucket, at_gram = ngram_buckets(part, places)
                    total += reduced(np.add, ratio[bucket], at_gram, 0.0)
                    grams_of += np.diff(at_gram)
                llr[i:j] = total / np.maximum(grams_of, 1)
                for t in range(j - i):
                    out["n_repeat_words"][i + t] = repeated_words(word[first[t] : first[t + 1]])
                    out["n_dup_lines"][i + t] = _duplicate_lines(d[a[t] : a[t + 1]].tobytes())
            failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
            columns = [*(batch.column(k) for k in range(len(names))), *map(pa.array, out.values()), pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *FIELDS])

    return run


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the trusted target: all that are labelled quality 1 and never 0."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id")


def fit(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log p_target - log p_raw for each bucket; counts of all of docs, one added to each.

    target: ids without repeats, as many as there are. Which texts are theirs a bitmap tells; where ids lie too far apart for
    an exact one, those that a hashed one lets through are joined with the ids.
    """
    ship(docs.sparkSession)
    ids = materialise(target.select(F.col("doc_id").cast("long").alias("__good")))
    texts = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    known = exactly_marked(texts, "__id", ids, "__mark")
    if known is None:
        told = marked(texts, "__id", ids, "__mark")
        may = told.where("__mark").join(ids, F.col("__id") == F.col("__good"), "left").select("__text", F.col("__good").isNotNull().alias("__mark"))
        known = may.unionByName(told.where("not __mark").select("__text", "__mark"))
    rows = known.select("__text", "__mark").mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    size = 1 << BITS
    raw, good = np.zeros(size), np.zeros(size)
    for b, r, g in rows:
        raw[b], good[b] = r, g
    if not good.any():
        return np.zeros(size)
    return np.log((good + 1) / (good.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs with the columns of FIELDS: base counts, the score, base_failed and kept."""
    ship(docs.sparkSession)
    rows = docs.drop(*FIELDS)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in FIELDS.items())).fields])
    return rows.mapInArrow(_score(rows.columns, text, ratio, threshold), schema)


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """score() of docs with the ratios that fit() finds in docs itself and its labelled good documents."""
    return score(docs, fit(docs, trusted(labels)), threshold)
