"""Packing: sequences of tokens with little padding, by minimum bin slack.

Each document is cut at multiples of the window, so one piece at most is shorter. What the
driver plans from is the number of pieces of each length, never more than `window` counts.
For each sequence it takes the longest length left and lets a subset-sum over bitsets find
the multiset of other lengths that comes closest to the capacity; counts are backtracked,
and the pattern is repeated as often as the counts allow. So the plan's size depends on the
window and not on the corpus.

A piece that fills a window is a sequence of its own, and takes no part in the plan. Any other
piece finds its place by its rank among the pieces of its length: a row number inside hashed
shards of each length plus the sizes of the shards before. There are as many shards as keep
each at about `ROWS` pieces, so that no length, however common, meets in one task.
Numbers of sequences are unique and leave gaps.

Defined cases: a null or empty text is the end id alone; rows that repeat a document are
packed each; a null doc_id is packed like any other; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.bpe import default_path, encoder
from modspark.llm.totals import running
from modspark.session import materialise, ship

WINDOW = 2048
END = 1
#: Pieces of a shard, about.
ROWS = 1 << 16


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the largest up to capacity."""
    mask, reach, used = (1 << (capacity + 1)) - 1, [1], []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        now, left, k = reach[-1], min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            now |= (now << (k * length)) & mask
            left -= k
            k *= 2
        reach.append(now)
        used.append(length)
        if now >> capacity & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, {}
    for length, before in zip(reversed(used), reversed(reach[:-1])):
        while not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces of that length in a sequence, offset of the first, sequences)."""
    left, rank, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    for longest in sorted(counts, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = fill(left, window - longest)
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times, offset = min(left[x] // n for x, n in chosen.items()), 0
            for length, n in sorted(chosen.items(), reverse=True):
                rows.append((length, rank[length], sequence, n, offset, times))
                rank[length] += n * times
                left[length] -= n * times
                offset += n * length
            sequence += times
    return rows


def _pieces(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            texts, owner, start, length, crc, total = batch.column(1), [], [], [], [], []
            for i in range(len(texts)):
                raw = np.append(encode(texts[i].as_py() or ""), np.uint32(end)).astype("<u4").tobytes()
                n = len(raw) // 4
                for a in range(0, n, window):
                    owner.append(i)
                    start.append(a)
                    length.append(min(window, n - a))
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + window)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _place(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (2, 5))
            _, first, sequence, n, offset, _ = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            slot = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence + slot // n), pa.array(offset + slot % n * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    tokenizer: the path of a byte-level BPE file in JSON, the same on all machines. Offsets in a
    sequence leave no gap, and each id of a document lies in one piece.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialise(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer or default_path(), window, end), schema))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    partial, full = (pieces.where(F.col("length") < window), pieces.where(F.col("length") == window))
    counts.pop(window, None)
    rows = plan(counts, window)
    planned = max((sequence + times for _, _, sequence, _, _, times in rows), default=0)

    shards = 1 << max(0, -(-max(counts.values(), default=0) // ROWS) - 1).bit_length()
    sharded = partial.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int"))
    ranked = running(sharded, ["length"], "shard", ["doc_id", "start", "ids_crc32"], {"rank": F.lit(1)})
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = ranked.mapInArrow(_place(rows), f"{schema}, sequence_id long, offset long")
    alone = full.select("*", (F.monotonically_increasing_id() + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)
