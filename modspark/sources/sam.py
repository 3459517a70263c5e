"""SAM text as alignments, parsed by Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.errors import TooLarge
from modspark.model import ALIGNMENT_COLUMNS, CONTIGS

#: Bits of rec_no for a place in a file, and the files that the others can tell apart.
PLACE = 42
MOST_FILES = 1 << 21
FEW = 200_000


def _small(names: DataFrame) -> DataFrame:
    """A table of names for a join: broadcast up to FEW rows, and beyond that joined as Spark chooses."""
    return F.broadcast(names) if names.count() <= FEW else names


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (rec_no, value): lines with numbers that rise along each file and from file to file.

    A line's number is made of its file's, of the byte where its split begins and of its count in
    the partition, so splits may be read in any order and by any task: lines are no fewer bytes than
    their number, so counts stay below where the file's next split begins.
    """
    text = spark.read.text(paths)
    found = sorted(re.sub("^file:/+", "file:/", x) for x in text.inputFiles())  # written in two ways
    if len(found) > MOST_FILES:
        raise TooLarge(f"more than {MOST_FILES} files")
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = text.select(place.alias("rec_no"), "value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__file"))
    if len(found) == 1:
        return rows.drop("__file")
    numbers = spark.createDataFrame(list(enumerate(found)), "number long, __file string")
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("an unknown file: "), "__file")))
    return rows.join(_small(numbers), "__file", "left").select((F.shiftleft(number, PLACE) + F.col("rec_no")).alias("rec_no"), "value")


def contigs(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (tid, contig, length) of the header of the first file, in its order."""
    head = _lines(spark, [paths[0]]).where(F.startswith("value", F.lit("@SQ\t")))
    tags = F.transform(F.split("value", "\t"), lambda x: x)
    tag = lambda key: F.substring(F.element_at(F.filter(tags, lambda x: F.startswith(x, F.lit(f"{key}:"))), 1), 4, 1 << 30)
    rows = head.select("rec_no", tag("SN").alias("contig"), tag("LN").cast("long").alias("length")).orderBy("rec_no").collect()  # a header
    return spark.createDataFrame([(k, r["contig"], r["length"]) for k, r in enumerate(rows)], CONTIGS)


def _tag(fields: Column, name: str) -> Column:
    """The type and value of a tag, null without it."""
    found = F.filter(F.slice(fields, F.lit(12), F.greatest(F.size(fields) - 11, F.lit(0))), lambda x: F.startswith(x, F.lit(f"{name}:")))
    return F.when(F.size(found) > 0, F.substring(F.element_at(found, 1), 4, 1 << 30))


def _letters(seq: Column) -> Column:
    """A sequence in the letters that BAM has: U is T, and what is none of them is N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^=ACMGRSVTWYHKDBN]", "N")


def _one_of(a: Column, b: Column, names: str) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit(f"a record has both {names}"))).otherwise(F.coalesce(a, b))


def from_lines(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments from rows (rec_no, value) of SAM lines; also for streams, which bring lines of their own."""
    f = F.split("value", "\t")
    data = ~F.startswith("value", F.lit("@")) & (F.col("value") != "")
    at = lambda k: F.get(f, F.lit(k))
    number = lambda k, kind: F.when(data, at(k).cast(kind))  # noqa: E731  conditions may be tried on header lines too
    star = lambda c: F.when(c != "*", c)
    mm = _one_of(_tag(f, "MM"), _tag(f, "Mm"), "MM and Mm")
    ml = _one_of(_tag(f, "ML"), _tag(f, "Ml"), "ML and Ml")
    mm_text = F.when(mm.isNull() | F.startswith(mm, F.lit("Z:")), F.substring(mm, 3, 1 << 30)).otherwise(F.raise_error(F.lit("an MM tag isn't of type Z")))
    numbers = F.filter(F.split(F.substring(ml, 4, 1 << 30), ","), lambda x: x != "")
    rows = lines.where(data).select(
        "rec_no",
        at(0).alias("read_id"),
        number(1, "int").alias("flag"),
        star(at(2)).alias("contig"),
        (number(3, "int") - 1).alias("pos"),
        number(4, "short").alias("mapq"),
        star(at(5)).alias("cigar"),
        F.coalesce(_letters(star(at(9))), F.lit("")).alias("seq"),
        F.when((at(10) != "*") | (at(9) == "*"), at(10)).alias("qual"),
        mm_text.alias("mm"),
        F.when(F.startswith(ml, F.lit("B:C")), numbers.cast("array<short>")).when(ml.isNotNull(), F.array().cast("array<short>")).alias("ml"),
    )
    rows = rows.withColumn("qual", F.when(F.col("seq") != "", F.col("qual")))
    return rows.join(_small(contigs.select("tid", "contig")), "contig", "left").select(*ALIGNMENT_COLUMNS)


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignments of SAM files, with rec_no in file order."""
    return from_lines(_lines(spark, list(paths)), contigs(spark, *paths))
