"""Line dedup: lines that many documents share stay in one document only.

Explode normalised lines, hash, count documents per hash, drop the lines over the
threshold, reassemble each text by position.

* A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z in lower case.
* Keys are held as 128-bit hashes. A first pass counts rows per key, which is a sum that
  combines before the shuffle; only keys with `min_docs` rows or more go on, so what a
  hot line sends is a number per task. The second pass counts distinct documents.
* Nothing is collected: the dropped keys of a document meet its text in a join by id, which
  documents that lose no line, told by a bitmap of bounded size, take no part in.

Defined cases: a null or empty text is one empty line (null stays null); rows that repeat
a doc_id are one document; rows with a null doc_id count for nothing and stay whole; an
empty table gives an empty result; other columns pass through, and columns named like the
two counts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.llm.members import marked
from modspark.llm.text import place_of, utf8
from modspark.session import materialise, ship

_ENDS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_ENDS).lower()  # bytes.lower changes A-Z alone


def _counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = utf8(batch.column(1))
            raw, digests, owners = data.tobytes(), [], []
            for i, doc in enumerate(ids):
                if doc is None:
                    continue
                keys = {k for line in raw[at[i] : at[i + 1]].split(b"\n") if len(line) >= min_chars and _counted(k := line_key(line), min_chars)}
                digests += [xxhash.xxh3_128_digest(k) for k in keys]
                owners += [doc] * len(keys)
            two = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(owners, pa.int64())], ["h", "g", "doc"])

    return run


def _rewrite(names: list[str], text: str, counts: tuple[str, str], min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = place_of(names, text)
            column, drops = batch.column(at_text), batch.column(len(names))
            data, at = utf8(column)
            lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), at)) + 1
            dropped = np.zeros(len(lines), np.int64)
            some = np.flatnonzero(np.asarray(drops.is_valid()))
            out = column
            if len(some):
                parts, done, sizes = [], 0, np.diff(at)
                for i in some:
                    gone = {(x["h"], x["g"]) for x in drops[int(i)].as_py()}
                    kept = []
                    for line in data[at[i] : at[i + 1]].tobytes().split(b"\n"):
                        if len(line) >= min_chars and _counted(k := line_key(line), min_chars):
                            if tuple(np.frombuffer(xxhash.xxh3_128_digest(k), ">i8").tolist()) in gone:
                                dropped[i] += 1
                                continue
                        kept.append(line)
                    parts += [data[done : at[i]].tobytes(), b"\n".join(kept)]
                    done, sizes[i] = at[i + 1], len(parts[-1])
                parts.append(data[done:].tobytes())
                ends = np.concatenate(([0], np.cumsum(sizes)))
                whole = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(b"".join(parts))])
                out = pc.if_else(column.is_valid(), whole, pa.scalar(None, pa.large_string())).cast(column.type)
            columns = [out if k == at_text else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(dropped)], [*names, *counts])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of docs with their texts rewritten, and two long columns: lines before, lines dropped.

    A key of at least `min_chars` code points in at least `min_docs` documents loses all its
    lines except those of the document with the largest id among its holders.
    """
    ship(docs.sparkSession)
    lines = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(_keys(min_chars), "h long, g long, doc long")
    often = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h", "g")
    # Tables on both sides of a join let Spark split the partition of a hot line.
    held = materialise(lines.join(materialise(often), ["h", "g"])).distinct()
    hot = materialise(held.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs))
    drops = materialise(held.join(hot, ["h", "g"]).where("doc <> keeper").groupBy("doc").agg(F.collect_list(F.struct("h", "g")).alias("__drops")))
    rows = docs.drop(*counts)
    told = marked(rows, id, drops.select("doc"), "__may")  # texts that lose nothing aren't shuffled
    with_drops = told.where("__may").drop("__may").join(drops.withColumnRenamed("doc", "__doc"), F.col(id) == F.col("__doc"), "left").drop("__doc")
    with_drops = with_drops.unionByName(told.where("not __may").drop("__may").withColumn("__drops", F.lit(None).cast(drops.schema["__drops"].dataType)))
    schema = T.StructType([*rows.schema.fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())])
    return with_drops.mapInArrow(_rewrite(rows.columns, text, counts, min_chars), schema)
