"""Results as the text that commands print. Frames are streamed to the driver, partition by partition, but for numbered lines, which stay where they are."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.functions.values import short_float
from modspark.session import materialise, ship

WINDOW_HEADER = "#contig ref_win_start ref_win_end read_id win_val strand base mod_strand mod_type win_start win_end basecall_qual".split()


def tsv(df: DataFrame, columns: list[str] | None = None, header: str | None = None) -> Iterator[str]:
    columns = columns or df.columns
    yield header if header is not None else "\t".join(columns)
    for row in df.select(*columns).toLocalIterator():
        yield "\t".join(short_float(x) if isinstance(x, float) else str(x) for x in row)


def windows_tsv(table: DataFrame) -> Iterator[str]:
    """The window table in file order."""
    names = [c.lstrip("#") for c in WINDOW_HEADER]
    yield from tsv(table.orderBy("rec_no", "track_no", "idx"), names, "\t".join(WINDOW_HEADER))


def in_file_order(reads: DataFrame) -> DataFrame:
    """Reads by rec_no, over the partitions and within each; what is made of them row by row keeps that order."""
    spark = reads.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reads.repartitionByRange(parts, "rec_no").sortWithinPartitions("rec_no")


def _short_floats(values: pa.Array) -> pa.Array:
    each = values.dictionary_encode()
    texts = [str(x) if x is None else short_float(x) for x in each.dictionary.to_pylist()]
    places = each.indices.fill_null(len(texts))
    return pa.array([*texts, "None"], pa.string()).take(places)


def windows_lines(table: DataFrame) -> DataFrame:
    """The lines of windows_tsv() as rows (nth, line), the header being line 0.

    table: windows of reads that in_file_order() has sorted. No line passes through the driver: each
    partition numbers its own, and of each its number of lines is summed up.
    """
    spark = table.sparkSession
    ship(spark)
    value = F.arrow_udf(_short_floats, "string")
    names = [c.lstrip("#") for c in WINDOW_HEADER]
    own = materialise(table.select(*names).withColumn("win_val", value("win_val")).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # by definition of these ids: the partition, and 33 bits for the place in it
    sizes = sorted(own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    first = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__part long, __before long")
    nth = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in names))
    rows = own.join(F.broadcast(first), part == F.col("__part")).select(nth.alias("nth"), line.alias("line"))
    return spark.range(1).select(F.lit(0).cast("long").alias("nth"), F.lit("\t".join(WINDOW_HEADER)).alias("line")).unionByName(rows)


def read_table_tsv(table: DataFrame, summary: str | None = None) -> Iterator[str]:
    """The read table under its comments; the order of reads is open."""
    head = [f"# seq summ file: {summary}"] if summary else []
    head += ["# mod-unmod threshold is 0.5"] if "mod_count" in table.columns else []
    yield from tsv(table, header="\n".join([*head, "\t".join(table.columns)]))


def json_array(df: DataFrame, pretty: bool = False) -> Iterator[str]:
    """Rows (rec_no, json) as one JSON array, in file order."""
    yield "["
    last = None
    for row in df.orderBy("rec_no").toLocalIterator():
        if last is not None:
            yield last + ","
        last = json.dumps(json.loads(row["json"]), indent=2, ensure_ascii=False) if pretty else row["json"]
    if last is not None:
        yield last
    yield "]"


def windows_json(windowed: DataFrame) -> Iterator[str]:
    """Pieces of one pretty JSON array of reads with their windows, in file order, also those without windows."""
    fields = ["rec_no", "read_id", "read_state", "align_len", "pos", "ref_end", "contig", "tid", "seq_len", "windows"]
    number = lambda x: _Raw(short_float(x, point=True))
    between = "[\n"
    for r in windowed.select(*fields).orderBy("rec_no").toLocalIterator():
        out: dict = {"alignment_type": r["read_state"]}
        if r["align_len"] is not None:
            out["alignment"] = {"start": r["pos"], "end": r["ref_end"], "contig": r["contig"], "contig_id": r["tid"]}
        out["mod_table"] = [
            {"base": t["base"], "is_strand_plus": t["strand"] == "+", "mod_code": t["mod_code"], "data": [[w["win_start"], w["win_end"], number(w["win_val"]), w["basecall_qual"], w["ref_win_start"], w["ref_win_end"]] for w in t["windows"]]}
            for t in r["windows"]
        ]
        yield between + _dump(out | {"read_id": r["read_id"], "seq_len": r["seq_len"]})
        between = ",\n"
    yield "\n]" if between == ",\n" else "[\n\n]"


class _Raw(float):
    """A number that is written as the text it was made of."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out

    def __repr__(self) -> str:
        return self.text


def _dump(x, depth: int = 0) -> str:
    """Pretty JSON with two spaces, numbers as _Raw has them."""
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(x, dict) and x:
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k)}: {_dump(v, depth + 1)}" for k, v in x.items()) + f"\n{end}}}"
    if isinstance(x, list) and x:
        return "[\n" + ",\n".join(pad + _dump(v, depth + 1) for v in x) + f"\n{end}]"
    return x.text if isinstance(x, _Raw) else json.dumps(x, ensure_ascii=False)


def peek_text(contigs: DataFrame, mods: DataFrame) -> Iterator[str]:
    yield "contigs_and_lengths:"
    for r in contigs.toLocalIterator():
        yield f"{r['contig']}\t{r['length']}"
    yield ""
    yield "modifications:"
    names = [r["modification"] for r in mods.collect()]
    yield from names or ["None"]


def sorted_lines(lines: Iterable[str] | str) -> list[str]:
    """For comparing tables: header lines first, the others sorted."""
    every = lines.splitlines() if isinstance(lines, str) else [x for text in lines for x in text.split("\n")]
    head = [k for k, x in enumerate(every) if x.startswith("#")]
    n = max(head, default=-1) + 1
    rest = every[n:]
    if rest and rest[0].startswith("read_id\t"):
        n += 1
    return every[:n] + sorted(every[n:])
