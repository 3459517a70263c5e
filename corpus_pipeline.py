"""A training corpus from raw documents, in stages that each use one operator.

Every stage but the last returns the columns of `documents`, and works on all that the one
before has kept; run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark import session
from modspark.llm import line_dedup, mixing, ngram_join, packing, quality_rules


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all but the used columns under names of no operator, and what gives a result their names back."""
    own = {c: next((u for u in used if u == c.lower()), f"__own{k}") for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in own.items()))
    return renamed, lambda out: out.select(*(F.col(n).alias(c) for c, n in own.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have too few words and go; rows that repeat are judged each, alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows, back = apart(docs, "doc_id", "text")
    return back(quality_rules.apply_rules(rows, labels).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them.

    Null texts stay null; rows that repeat an id count as one document and are rewritten each; no row goes.
    """
    rows, back = apart(docs, "doc_id", "text")
    return back(line_dedup.dedup_lines(rows))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id.

    Texts without words are copies of nothing; rows that repeat an id, and rows without one, stay together.
    """
    rows, back = apart(docs, "doc_id", "text")
    return back(ngram_join.keep_one(rows))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to its shards; of one in each source, its first words.

    Texts without words are taken 0 times; a null source is one of its own; rows that repeat count each.
    """
    rows, back = apart(docs, "doc_id", "text", "source")
    return back(mixing.shard_rows(mixing.mix(rows), rows.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences.

    A null or empty text is its end id alone; rows that repeat, and a null id, are packed each; a long
    text is as many pieces as it needs.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("mixing", mix), ("packing", pack)]
#: Hashes that DuckDB doesn't have decide the verdicts, the mix and the places: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage has written for itself goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = session.held()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            within = session.held() - before
            docs = session.materialise(docs)
            session.release(within)
    return docs
