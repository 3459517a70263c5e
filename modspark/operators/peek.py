"""A first look at a file: its contigs and the modifications of its first records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.errors import InvalidOption

#: Records that are looked at, and the most that may be asked for (fixed values).
RECORDS = 100
MOST_RECORDS = 100_000
MOST_CONTIGS = 1_000_000
MOST_MODS = 100


def modifications(alignments: DataFrame, records: int = RECORDS) -> DataFrame:
    """Rows (modification), base, strand and code, in order of text, of the first records in file order.

    Records without sequence count as looked at and add nothing. More than MOST_MODS different
    ones stop the query.
    """
    if not 0 < records <= MOST_RECORDS:
        raise InvalidOption(f"from 1 to {MOST_RECORDS} records")
    first = alignments.select("rec_no", "seq", "mm").orderBy("rec_no").limit(records).where(F.length("seq") > 0)
    groups = F.filter(F.split(F.coalesce("mm", F.lit("")), ";"), lambda g: g != "")
    named = first.select(F.explode(groups).alias("g")).select(F.regexp_extract("g", r"^([ACGTUN][+-])([A-Za-z]|\d+)", 1).alias("a"), F.regexp_extract("g", r"^([ACGTUN][+-])([A-Za-z]|\d+)", 2).alias("b"))
    code = F.when(F.rlike("b", F.lit("^[0-9]+$")), F.regexp_replace("b", "^0+(?=[0-9])", "")).otherwise(F.col("b"))
    found = named.select(F.concat("a", code).alias("modification")).distinct()
    count = F.when(F.size(all_ := F.collect_list("modification")) > MOST_MODS, F.raise_error(F.lit(f"more than {MOST_MODS} modifications"))).otherwise(F.sort_array(all_))
    return found.agg(count.alias("all")).select(F.explode("all").alias("modification"))


def contig_rows(contigs: DataFrame) -> DataFrame:
    """Rows (tid, contig, length) in the order of the header; too many stop the query."""
    n = contigs.limit(MOST_CONTIGS + 1).count()
    if n > MOST_CONTIGS:
        raise InvalidOption(f"more than {MOST_CONTIGS} contigs")
    return contigs.orderBy("tid")
