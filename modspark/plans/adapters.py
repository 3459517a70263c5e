"""Generic tables as alignments and calls, so that every operator can be run against SQL.

Each adapter has the same content in SQL beside it: names in capitals are the text of common
table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.model import ALIGNMENT_COLUMNS
from modspark.operators.alignment import with_alignment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: a user is a read, an event type a modification, the order of events the position."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("read_id"), F.col("event_type").alias("mod_code"), F.col("event_id").alias("pos"), (F.floor(F.col("value") * 4).cast("int") % 256).alias("qual")
    )
    place = F.row_number().over(Window.partitionBy("read_id", "mod_code").orderBy("pos")) - 1
    return e.withColumn("idx", place).withColumn("ref_pos", F.when(F.col("pos") % 5 != 0, F.col("pos") * 2))


CALLS = """
calls as (select user_id as read_id, event_type as mod_code, event_id as pos, cast(floor(value * 4) as int) % 256 as qual,
  row_number() over (partition by user_id, event_type order by event_id) - 1 as idx,
  case when event_id % 5 <> 0 then event_id * 2 end as ref_pos from events)"""


def flat_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alignments without sequences: lengths are columns."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    flags = F.array(*(F.lit(x) for x in (0, 4, 16, 256, 272, 2048, 2064)))
    length = (F.floor("o_totalprice").cast("int") % 5000).cast("int")
    flag = F.element_at(flags, (key % 7 + 1).cast("int"))
    return o.select(
        key.alias("rec_no"),
        F.col("o_custkey").cast("string").alias("read_id"),
        flag.alias("flag"),
        F.when(flag != 4, F.concat(F.lit("contig"), (F.col("o_custkey") % 3).cast("string"))).alias("contig"),
        F.when(flag != 4, (key * 37 % 10000).cast("int")).alias("pos"),
        (key % 256).cast("short").alias("mapq"),
        length.alias("seq_len"),
        F.when(flag != 4, length).alias("align_len"),
    )


ALIGNMENTS = """
alignments as (select o_orderkey as rec_no, cast(o_custkey as varchar) as read_id,
  [0, 4, 16, 256, 272, 2048, 2064][cast(o_orderkey % 7 + 1 as int)] as flag,
  case when o_orderkey % 7 <> 1 then 'contig' || (o_custkey % 3) end as contig,
  case when o_orderkey % 7 <> 1 then cast(o_orderkey * 37 % 10000 as int) end as pos,
  cast(o_orderkey % 256 as int) as mapq, cast(floor(o_totalprice) as int) % 5000 as seq_len,
  case when o_orderkey % 7 <> 1 then cast(floor(o_totalprice) as int) % 5000 end as align_len from orders)"""


def tagged_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alignments with sequences and tags.

    A read is ACGT repeated 4 to 35 times, mapped base by base. The first group is on T of the
    sequenced strand (A of the record if it is reversed), explicit, every (key mod 3 + 1)th of
    them called; the second is on C (G) with a numeric code, every second one called. The
    probability of call k is (31 k + key) mod 256.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("read_id"))
    o = o.repartition(spark.sparkContext.defaultParallelism)  # two narrow columns of a small file become long reads
    o = o.select("*", (F.col("key") % 32 + 4).cast("int").alias("n"), (F.col("key") % 3).cast("int").alias("d"))
    o = o.withColumn("first", F.expr("(n + d) div (d + 1)").cast("int")).withColumn("second", F.expr("(n + 1) div 2").cast("int"))
    flags = F.array(*(F.lit(x) for x in (0, 16, 4, 256, 2064)))
    o = o.withColumn("flag", F.element_at(flags, (F.col("key") % 5 + 1).cast("int")))
    mapped = F.col("flag") != 4
    ones = F.array_repeat(F.lit(",1"), F.col("second") - 1)
    mm = F.concat(F.lit("T+T?,0"), F.array_join(F.transform(F.array_repeat(F.col("d"), F.col("first") - 1), lambda d: F.concat(F.lit(","), d.cast("string"))), ""), F.lit(";C+76792?,0"), F.array_join(ones, ""), F.lit(";"))
    ml = F.transform(F.sequence(F.lit(0), F.col("first") + F.col("second") - 1), lambda k: ((k * 31 + F.col("key")) % 256).cast("short"))
    contig = F.when(mapped, F.concat(F.lit("contig"), (F.col("key") % 3).cast("string")))
    return o.select(
        F.col("key").alias("rec_no"), "read_id", "flag", F.when(mapped, F.col("key") % 3).cast("int").alias("tid"), contig.alias("contig"),
        F.when(mapped, F.col("key") * 37 % 10000).otherwise(-1).cast("int").alias("pos"), (F.col("key") % 61).cast("short").alias("mapq"),
        F.when(mapped, F.concat((F.col("n") * 4).cast("string"), F.lit("M"))).alias("cigar"), F.repeat(F.lit("ACGT"), F.col("n")).alias("seq"),
        F.expr("repeat(chr(cast(33 + key % 60 as int)), n * 4)").alias("qual"), mm.alias("mm"), ml.alias("ml"),
    ).select(*ALIGNMENT_COLUMNS)


def tagged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_alignment(tagged_alignments(spark, sf_dir))


#: The same alignments, and the calls that their tags spell out. On the strand that was
#: sequenced (ACGT is its own reverse complement) T number j is base 4 j + 3, C is 4 j + 1.
TAGGED = """
tagged as (select *, case when flag = 4 then null else flag end is not null as mapped from (
  select o_orderkey as key, cast(o_custkey as varchar) as read_id, cast(o_orderkey % 32 + 4 as int) as n, cast(o_orderkey % 3 as int) as d,
    [0, 16, 4, 256, 2064][cast(o_orderkey % 5 + 1 as int)] as flag from orders)),
spelled as (
  select *, 'T' as base, 'T' as mod_code, 84 as mod_cp, k * (d + 1) * 4 + 3 as fwd, (k * 31 + key) % 256 as qual
    from (select *, unnest(range((n + d) // (d + 1))) as k from tagged)
  union all
  select *, 'C', '76792', 76792, k * 8 + 1, ((k + (n + d) // (d + 1)) * 31 + key) % 256
    from (select *, unnest(range((n + 1) // 2)) as k from tagged)),
called as (select key as rec_no, read_id, flag, mapped, n, base, mod_code, mod_cp, fwd, cast(qual as int) as qual,
  case when flag & 16 > 0 then 4 * n - 1 - fwd else fwd end as pos,
  case when mapped then key * 37 % 10000 + case when flag & 16 > 0 then 4 * n - 1 - fwd else fwd end end as ref_pos,
  'contig' || (key % 3) as contig, key * 37 % 10000 as start, key * 37 % 10000 + 4 * n as stop from spelled)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sequencing summary."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("read_id"), (F.col("c_custkey") % 900 + 100).alias("sequence_length_template"))


def wanted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment as a list of read ids."""
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("read_id")).distinct()
