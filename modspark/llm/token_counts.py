"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves hold runs of up to `LEAF`
pre-tokens (their code points and their tokens), inner nodes the sums of both. An edit is
found by descending along the code points. Encoding starts again at the last pre-token
boundary that no look-ahead could carry into the edit, and ends at the first boundary behind
the edit that was one before: from there on text and pre-tokens are as they were. Only the
sums on the paths from the touched leaves to the root are renewed. A leaf that an insertion has
made longer than `GROWN` is split, for which leaves are dealt anew, without encoding anything.

A stored tree holds its sums, so reading one adds up nothing; what an edit costs besides its own
region is the copy of the row's bytes that any new row is. edited_counts() builds and edits in one
pass, where trees needn't be stored.

Counts are those of byte-level BPE with strings of special tokens read as ordinary text.

Defined cases: a null text is an empty one, with 0 tokens; null or no edits change nothing; an
edit's place and length are cut to the text, nulls in it are 0 or the empty string; rows that
repeat are handled each; empty tables give empty results; other columns pass through, and
columns named like the results are replaced. A very long text is one row of a worker, which
holds it and about 16 bytes for each of its pre-tokens; a very long pre-token, white space too,
is merged without matching a pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.llm.bpe import PATTERN, Encoder, default_path, encoder
from modspark.llm.text import place_of
from modspark.session import ship

#: Pre-tokens in a leaf when a tree is built.
LEAF = 64
#: Pre-tokens at which a leaf is split.
GROWN = 1024
#: Code points behind its end that the pre-token pattern may look at ('re, and space before text).
CONTEXT = 4
#: Different pre-tokens whose counts a worker remembers at most.
REMEMBERED = 300_000
#: Code points of a pre-token whose count may be remembered.
SHORT = 64
#: Rows whose trees are held at once.
SLICE = 64

_PATTERN = regex.compile(PATTERN)
COUNTS = ("n_tokens", "n_tokens_after", "n_reencoded")
EDIT = "array<struct<at: long, removed: long, inserted: string>>"


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, encode: Encoder) -> None:
        self.encode, self.known = encode.piece, {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.encode(piece)
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(encoder(path))


def _summed(leaves: np.ndarray) -> np.ndarray:
    """The tree over columns of sums of leaves: root at 1, leaves from the width on."""
    width = 1 << max(0, leaves.shape[1] - 1).bit_length()
    sums = np.zeros((2, 2 * width), np.int64)
    sums[:, width : width + leaves.shape[1]] = leaves
    while width > 1:
        width //= 2
        sums[:, width : 2 * width] = sums[:, 2 * width : 4 * width : 2] + sums[:, 2 * width + 1 : 4 * width : 2]
    return sums


class TokenTree:
    """Code points and tokens of pre-tokens in leaves, and the tree of their sums, with its root at 1."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.deal(pairs)

    def deal(self, pairs: np.ndarray) -> None:
        """Leaves of `LEAF` pre-tokens from an array of shape (2, n)."""
        self.flat, n = pairs, pairs.shape[1]
        self.at = np.append(np.arange(0, max(n, 1), LEAF), n)
        total = np.zeros((2, n + 1), np.int64)
        np.cumsum(pairs, axis=1, out=total[:, 1:])
        self.sums = _summed(np.diff(total[:, self.at], axis=1))
        self.changed: dict[int, np.ndarray] = {}

    @property
    def count(self) -> int:
        return len(self.at) - 1

    @property
    def width(self) -> int:
        return self.sums.shape[1] // 2

    def leaf(self, k: int) -> np.ndarray:
        held = self.changed.get(k)
        return self.flat[:, self.at[k] : self.at[k + 1]] if held is None else held

    @property
    def leaves(self) -> list[np.ndarray]:
        return [self.leaf(k) for k in range(self.count)]

    @classmethod
    def of(cls, text: str, count: Counter) -> TokenTree:
        pieces = _PATTERN.findall(text)
        return cls(np.array([[len(p) for p in pieces], [count(p) for p in pieces]], np.int64).reshape(2, -1))

    @classmethod
    def read(cls, raw: bytes) -> TokenTree:
        """The tree of bytes(): numbers of leaves and pre-tokens, where leaves begin, sums, pre-tokens."""
        leaves, n = np.frombuffer(raw, "<i8", 2)
        width = 1 << max(0, int(leaves) - 1).bit_length()
        self, place = cls.__new__(cls), 16
        self.at = np.frombuffer(raw, "<i8", leaves + 1, place)
        place += 8 * len(self.at)
        self.sums = np.frombuffer(raw, "<i8", 4 * width, place).reshape(2, -1).copy()
        self.flat = np.frombuffer(raw, "<u4", 2 * n, place + 32 * width).reshape(2, -1)
        self.changed = {}
        return self

    def bytes(self) -> bytes:
        flat, at = self.flat, self.at
        if self.changed:
            sizes = np.diff(at)
            parts, done = [], 0
            for k in sorted(self.changed):
                parts += [flat[:, done : at[k]], self.changed[k]]
                done, sizes[k] = at[k + 1], self.changed[k].shape[1]
            flat, at = np.concatenate([*parts, flat[:, done:]], axis=1), np.append(0, np.cumsum(sizes))
        return b"".join((np.array([self.count, flat.shape[1]], "<i8").tobytes(), at.astype("<i8").tobytes(), self.sums.astype("<i8").tobytes(), flat.astype("<u4").tobytes()))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def points(self) -> int:
        return int(self.sums[0, 1])

    def locate(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the code points before that leaf."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if place - before >= self.sums[0, k] and self.sums[0, k + 1]:
                before += int(self.sums[0, k])
                k += 1
        return k - self.width, before

    def renew(self, k: int) -> None:
        k += self.width
        self.sums[:, k] = self.leaf(k - self.width).sum(1)
        while k > 1:
            k //= 2
            self.sums[:, k] = self.sums[:, 2 * k] + self.sums[:, 2 * k + 1]

    def edit(self, text: str, at: int, removed: int, inserted: str, count: Counter) -> tuple[str, int]:
        """Apply one edit; the new text, and how many code points were encoded again."""
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + inserted + text[at + removed :]
        moved, behind = len(inserted) - removed, at + len(inserted)

        first, before = self.locate(max(at - CONTEXT, 0))
        ends = before + np.cumsum(self.leaf(first)[0], dtype=np.int64)
        kept = int(np.searchsorted(ends, at - CONTEXT, "right"))
        start = int(ends[kept - 1]) if kept else before

        last, held, used, old = first, self.leaf(first), kept, start  # old: the next boundary of the old text, `used` pre-tokens into leaf `last`
        found, place = [], start
        while place < len(new):
            m = _PATTERN.match(new, place)
            found.append((m.end() - place, count(m[0])))
            place = m.end()
            if place < behind:
                continue
            while old + moved < place and (last < self.count - 1 or used < held.shape[1]):
                if used == held.shape[1]:
                    last, used = last + 1, 0
                    held = self.leaf(last)
                elif not used and last < self.count - 1 and old + (whole := int(self.sums[0, self.width + last])) + moved <= place:
                    old, used = old + whole, held.shape[1]
                else:
                    old += int(held[0, used])
                    used += 1
            if old + moved == place and old >= at + removed:
                break
        else:  # encoded to the end: nothing of the old tree is left behind the start
            last, used = self.count - 1, self.leaf(self.count - 1).shape[1]
        fresh = np.array(found, np.int64).reshape(-1, 2).T
        grown = np.concatenate((self.leaf(first)[:, :kept], fresh, self.leaf(last)[:, used:]), axis=1)
        for k in range(first + 1, last + 1):
            self.changed[k] = np.zeros((2, 0), np.int64)
        self.changed[first] = grown
        if grown.shape[1] > GROWN:
            self.deal(np.concatenate(self.leaves, axis=1).astype(np.int64))
        else:
            for k in range(first, last + 1):
                self.renew(k)
        return new, place - start


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: trees are larger than their texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _with(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *new.values()], [*names, *new])


def _build(names: list[str], text: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in _slices(batches):
            trees = [TokenTree.of(t or "", count) for t in batch.column(place_of(names, text)).to_pylist()]
            yield _with(batch, names, {"token_tree": pa.array([t.bytes() for t in trees], pa.binary()), "n_tokens": pa.array([t.tokens for t in trees], pa.int64())})

    return run


def _apply(names: list[str], text: str, edits: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in _slices(batches):
            texts, trees, tokens, again = batch.column(place_of(names, text)).to_pylist(), batch.column(place_of(names, "token_tree")).to_pylist(), [], []
            for i, wanted in enumerate(batch.column(place_of(names, edits)).to_pylist()):
                tree, encoded = TokenTree.read(trees[i]), 0
                for e in wanted or ():
                    if e is not None:
                        texts[i], n = tree.edit(texts[i] or "", e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                        encoded += n
                if wanted:
                    trees[i] = tree.bytes()
                tokens.append(tree.tokens)
                again.append(encoded)
            new = {place_of(names, text): pa.array(texts, pa.string()), place_of(names, "token_tree"): pa.array(trees, pa.binary()), place_of(names, "n_tokens"): pa.array(tokens, pa.int64())}
            columns = [new.get(k, batch.column(k)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.int64())], [*names, "n_reencoded"])

    return run


def _both(keep: list[int], at_text: int, at_edits: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts, edits, before, after, again = batch.column(at_text), batch.column(at_edits), [], [], []
            for i in range(batch.num_rows):
                text, encoded = texts[i].as_py() or "", 0
                tree = TokenTree.of(text, count)
                before.append(tree.tokens)
                for e in edits[i].as_py() or ():
                    if e is not None:
                        text, n = tree.edit(text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                        encoded += n
                after.append(tree.tokens)
                again.append(encoded)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in (before, after, again))], [*(batch.schema.names[k] for k in keep), *COUNTS])

    return run


def build_trees(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """The rows of docs with token_tree (binary) and n_tokens (long)."""
    ship(docs.sparkSession)
    rows = docs.drop("token_tree", "n_tokens")
    schema = T.StructType([*rows.schema.fields, T.StructField("token_tree", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_build(rows.columns, text, tokenizer or default_path()), schema)


def apply_edits(trees: DataFrame, edits: str = "edits", tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """The rows with text, token_tree and n_tokens after their edits, and n_reencoded (code points).

    edits: the column of a row's edits, in order, each of the text that the one before left:
    array of (at, removed, inserted), places and lengths in code points.
    """
    ship(trees.sparkSession)
    rows = trees.drop("n_reencoded").withColumn(edits, F.col(edits).cast(EDIT))
    return rows.mapInArrow(_apply(rows.columns, text, edits, tokenizer or default_path()), T.StructType([*rows.schema.fields, T.StructField("n_reencoded", T.LongType())]))


def edited_counts(docs: DataFrame, edits: str = "edits", tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """The rows of docs without text and edits, with n_tokens, n_tokens_after and n_reencoded (code points).

    The same numbers as of build_trees() and apply_edits(), in one pass and without a stored tree.
    """
    ship(docs.sparkSession)
    rows = docs.drop(*COUNTS).withColumn(edits, F.col(edits).cast(EDIT))
    out = [k for k, c in enumerate(rows.columns) if k not in (place_of(rows.columns, text), place_of(rows.columns, edits))]
    schema = T.StructType([*(rows.schema.fields[k] for k in out), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return rows.mapInArrow(_both(out, place_of(rows.columns, text), place_of(rows.columns, edits), tokenizer or default_path()), schema)


def with_edits(trees: DataFrame, edits: DataFrame, id: str = "doc_id") -> DataFrame:
    """Trees with a table of edits (id, nth, at, removed, inserted) as the column edits, by nth."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "at", "removed", "inserted"))), lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted")))
    grouped = edits.groupBy(F.col(id).alias("__id")).agg(ordered.cast(EDIT).alias("edits"))
    return trees.drop("edits").join(grouped, F.col(id) == F.col("__id"), "left").drop("__id")
