"""Side inputs: sequencing summaries and lists of read ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.errors import InvalidSummary

#: Limits of a sequencing summary (fixed values).
COMMENTS = 1000
LINE = 1000
ID = 50
NEEDED = ("read_id", "sequence_length_template")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    from modspark.sources.sam import _lines

    return _lines(spark, [path])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (read_id), distinct: lines without space at their ends, blank ones and those that begin with # left out."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.read.text(path).select(line.alias("read_id")).where((F.col("read_id") != "") & ~F.startswith("read_id", F.lit("#"))).distinct()


def sequencing_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows (read_id, sequence_length_template) of a summary in tab-separated text.

    Comments (#) stand before the header only, at most COMMENTS of them; a blank line there is an
    error, later ones are skipped. Exactly one column has each needed name. Long lines, ids that
    are empty, too long or quoted, lengths that are no numbers, repeated ids and a summary
    without rows are errors: the first three kinds when the header is read, the others when rows are.
    """
    lines = _numbered(spark, path)
    head = [r["value"] for r in lines.orderBy("rec_no").limit(COMMENTS + 2).collect()]
    comments = next((k for k, x in enumerate(head) if not x.startswith("#")), len(head))
    if comments > COMMENTS:
        raise InvalidSummary(f"more than {COMMENTS} comments before the header")
    if comments == len(head) or not head[comments].strip():
        raise InvalidSummary("no header")
    names = head[comments].rstrip("\r").split("\t")
    for n in NEEDED:
        if names.count(n) != 1:
            raise InvalidSummary(f"one column {n} is needed, there are {names.count(n)}")
    first = lines.orderBy("rec_no").limit(comments + 1).agg(F.max("rec_no")).first()[0]
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.substring("value", 1, 100)))
    id, number = (F.get(f, F.lit(names.index(n))) for n in NEEDED)
    number = F.when(F.rlike(F.trim(number), F.lit(r"^\d+$")), F.trim(number).cast("long"))
    checked = (
        F.when(F.octet_length("value") > LINE, fail("a line is too long"))
        .when(F.startswith("value", F.lit("#")), fail("a comment after the header"))
        .when(F.coalesce(F.length(id) == 0, F.lit(True)) | (F.octet_length(id) > ID) | F.rlike(id, F.lit("[\"']")), fail("not a read id"))
        .when(number.isNull(), fail("not a length"))
        .otherwise(id)
    )
    rows = lines.where((F.col("rec_no") > first) & (F.trim("value") != "")).select(checked.alias("read_id"), number.alias("length"))
    if rows.isEmpty():
        raise InvalidSummary("no rows")
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("a read id comes twice: "), F.col("read_id")))).otherwise(F.max("length"))
    return rows.groupBy("read_id").agg(once.cast("long").alias("sequence_length_template"))
