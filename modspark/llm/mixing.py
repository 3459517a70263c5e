"""Mixing sources to target weights, with DataFrame operations only.

Targets: sources by code point, null last, take their weights in turn; together they get
`share` times all words. A source stops at `cap` times its own words, and what it can't take
goes to the others by weight until none is above: the level that does this is found by one
window over the sources, ordered by cap over weight.

Draw: a hash deals each source's documents into blocks, one for `ROWS` rows of the table and
`BLOCKS` at least, and another puts the blocks in a permuted order. A source takes whole passes
over its blocks, then blocks in that order up to its target; the last one is taken in part,
document by document, and so is one document. Thus every source meets its target to the word, and no document goes over the cap.

Shards: the blocks that each source gives are an exact quota. A splitting tree halves the
shards again and again, and at each node draws from a multivariate hypergeometric law how
many blocks of each source go left, so that the quotas of all shards add up. The blocks go to
shards in permuted order, disjoint ones, and a hash orders the rows inside a shard. All draws
are functions of hashes and a seed: reruns agree.

There is a shard for `SHARD` words of the mix. A hot source is spread over its blocks; windows
run inside a block, inside a bucket of about `BUCKET` blocks or shards of a source, over the buckets
of a source, or over the sources, never over the documents or all the blocks of a source.

Sources are few: a node of the tree holds a number for each of them in one row.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own; rows that repeat count each; null ids are dealt by their texts; an empty
table gives an empty result; other columns pass through, and columns named like the results
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.totals import running
from modspark.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 256
ROWS = 1024
SHARD = 8_000_000
#: Blocks, or shards, of a source over which one window runs, as a power of 2.
BUCKET = 10
#: What is known of a row's source, what the mix takes of the row, and where each taking goes.
FIELDS = ("size", "source_size", "target", "taken", "draws")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes: rows (key, source_size), one for each source, with keys in the order of sources."""
    number = F.row_number().over(Window.orderBy("key"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(number - 1, F.lit(len(weights))) + 1).cast("int"))
    known = sizes.select("key", "source_size", number.alias("number"), weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "number")
    every = Window.partitionBy()
    full_before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - full_before) / weight_left
    tried = known.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))
    found = tried.withColumn("level", F.coalesce(F.min_by("level", fits).over(every), F.lit(float("inf"))))
    return found.select("key", "source_size", "number", F.least("most", F.col("level") * F.col("weight")).alias("target"))


#: One draw from the hypergeometric law with population `all`, marked `good` and sample `n`, by
#: inversion of its distribution within ten deviations of the mode.
_DRAW = """
  case when {good} = 0 or {n} = 0 then 0L when {good} = {all} then {n} when {n} = {all} then {good} else
  aggregate(
    sequence({low}, {high}),
    named_struct('k', cast({low} as bigint), 'p', 1.0D, 'sum', 0.0D, 'all', aggregate(
        sequence({low}, {high}), named_struct('p', 1.0D, 'sum', 0.0D),
        (s, k) -> named_struct('p', s.p * {ratio}, 'sum', s.sum + s.p), s -> s.sum)),
    (s, k) -> named_struct('k', if(s.sum < {u} * s.all, k, s.k), 'p', s.p * {ratio}, 'sum', s.sum + s.p, 'all', s.all),
    s -> s.k) end
"""


def _draw(all: str, good: str, n: str, u: str) -> str:
    mode = f"cast(floor(({n} + 1.0D) * ({good} + 1.0D) / ({all} + 2.0D)) as bigint)"
    reach = f"cast(ceil(10 * sqrt({n} * 1.0D * {good} / {all} * ({all} - {good}) / {all} * ({all} - {n}) / greatest({all} - 1, 1))) as bigint) + 2"
    low = f"greatest(0L, {n} + {good} - {all}, {mode} - {reach})"
    high = f"least({n}, {good}, {mode} + {reach})"
    ratio = f"(({good} - k) * 1.0D * ({n} - k) / ((k + 1.0D) * ({all} - {good} - {n} + k + 1)))"
    return _DRAW.format(all=all, good=good, n=n, u=u, low=low, high=high, ratio=ratio)


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: rows (number, quota). Rows (number, shard, quota) for 2**levels shards of equal size, to a block."""
    order = F.sort_array(F.collect_list(F.struct("number", "quota")))
    nodes = quotas.agg(order.alias("q")).select(F.lit(0).alias("shard"), F.expr("transform(q, x -> x.quota)").alias("counts"), F.expr("transform(q, x -> x.number)").alias("numbers"))
    total = "aggregate(counts, 0L, (s, x) -> s + x)"
    step = _draw("acc.all", "x.c", "acc.n", "x.u")
    for level in range(levels):
        drawn = f"""aggregate(
            transform(counts, (c, i) -> named_struct('c', c, 'u', shiftrightunsigned(xxhash64({seed}, {level}, shard, i), 11) / 9007199254740992.0D)),
            named_struct('all', {total}, 'n', ({total} + 1 - pmod(shard, 2)) div 2, 'got', cast(array() as array<bigint>)),
            (acc, x) -> element_at(transform(array({step}), d -> named_struct('all', acc.all - x.c, 'n', acc.n - d, 'got', concat(acc.got, array(d)))), 1),
            acc -> acc.got)"""
        nodes = nodes.select("shard", "counts", "numbers", F.expr(drawn).alias("left"))
        right = F.expr("transform(counts, (c, i) -> c - left[i])")
        if level == 7:  # as many nodes as tasks are worth while
            nodes = nodes.repartition("shard")
        nodes = nodes.select("numbers", F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("counts")))).alias("s")).select("s.shard", "s.counts", "numbers")
    return nodes.select("shard", F.explode(F.arrays_zip("numbers", "counts")).alias("z")).select(F.col("z.numbers").alias("number"), "shard", F.col("z.counts").alias("quota"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, levels: int | None = None, seed: int = 7, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs with size, source_size, target, taken (words, repeats counted) and draws.

    draws: array of (shard, place, words), one for each time that the mix takes the row: the
    output shard of 2**levels, the order inside it, and how many of its words, which is all of
    them but for one document of each source. levels: by default as many as the mix needs.
    """
    rows = docs.drop(*FIELDS)
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))
    count = max(BLOCKS, 1 << max(0, docs.count() // ROWS - 1).bit_length())
    sized = rows.withColumns({"size": word_count(text), "__key": key})
    sized = sized.withColumns({"__block": F.pmod(F.xxhash64(F.col(id), F.col(text), F.lit(seed)), F.lit(count)).cast("long"), "__place": F.xxhash64(F.col(id), F.col(text), F.lit(seed + 1))})

    blocks = materialise(sized.groupBy(F.col("__key").alias("key"), F.col("__block").alias("block")).agg(F.sum("size").alias("words")))
    if levels is None:
        total = blocks.agg(F.sum("words")).first()[0] or 0
        levels = max(1, math.ceil(math.log2(max(1.0, share * total / SHARD))))
    goals = targets(blocks.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("passes", passes).withColumn("rest", goal - F.col("passes") * F.col("source_size"))
    # Buckets are runs of the permuted order: its leading bits, behind whether a block has words.
    bits = max(0, count.bit_length() - 1 - BUCKET)
    order = F.xxhash64("key", "block", F.lit(seed + 2))
    bucket = (F.col("words") == 0).cast("long") * (1 << bits) + (F.shiftright(order, 64 - bits) + (1 << bits >> 1) if bits else F.lit(0))
    blocks = running(blocks.withColumns({"__bucket": bucket, "__order": order}), ["key"], "__bucket", ["__order", "block"], {"before": F.col("words"), "earlier": F.lit(1)})
    numbers = blocks.groupBy("key").agg(F.count("*").alias("blocks"))
    before = F.col("before")
    blocks = blocks.join(goals, "key").join(numbers, "key").withColumn("nth", F.col("earlier") + 1)
    blocks = blocks.withColumn("extra", F.least("words", F.greatest(F.lit(0), F.col("rest") - before)).cast("long"))

    # Every taking of a block has an ordinal in its source; shards get runs of ordinals by their quotas.
    last = F.when(F.col("extra") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    takings = blocks.where(last >= 0).select("number", "key", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pass"), "blocks", "nth")
    takings = takings.select("number", "key", "block", "pass", (F.col("pass") * F.col("blocks") + F.col("nth") - 1).alias("ordinal"))
    quotas = blocks.groupBy("number").agg(F.sum(F.col("passes") + (F.col("extra") > 0).cast("long")).alias("quota"))
    tree = materialise(splitting_tree(quotas, levels, seed)).withColumn("__bucket", F.shiftright("shard", BUCKET))
    runs = running(tree, ["number"], "__bucket", ["shard"], {"begin": F.col("quota")}).where("quota > 0")
    placed = runs.select("number", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("quota") - 1)).alias("ordinal"))
    takes = takings.join(placed, ["number", "ordinal"]).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("__takes"))
    dealt = blocks.join(takes, ["key", "block"], "left").select(F.col("key").alias("__key"), F.col("block").alias("__block"), "source_size", "target", F.col("passes").alias("__passes"), F.col("extra").alias("__extra"), "__takes")

    inside = Window.partitionBy("__key", "__block").orderBy("__place", id, "size")
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sized.withColumn("__earlier", earlier).join(dealt, ["__key", "__block"])
    part = F.least("size", F.greatest(F.lit(0), F.col("__extra") - F.col("__earlier"))).cast("long")
    draw = f"transform(__takes, t -> named_struct('shard', t.shard, 'place', xxhash64(__place, t.pass, {seed}), 'words', if(t.pass < __passes, size, __part)))"
    draws = F.expr(f"coalesce(filter({draw}, d -> d.words > 0), cast(array() as array<struct<shard: int, place: bigint, words: bigint>>))")
    found = found.withColumn("__part", part)
    return found.select(*rows.columns, "size", "source_size", "target", (F.col("__passes") * F.col("size") + F.col("__part")).alias("taken"), draws.alias("draws"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to and with its nth word and the white space after that."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.rlike(F.element_at(pieces, 1), F.lit(r"^[\x20\x09-\x0D]*$")).cast("int")
    return F.array_join(F.slice(pieces, F.lit(1), (n + blank).cast("int")), "")


def shard_rows(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mixed corpus: one row for each draw, whole shards in a partition, in random order inside each."""
    each = mixed.select(*columns, "size", F.explode("draws").alias("d"))
    cut = F.when(F.col("d.words") < F.col("size"), first_words(F.col(text), F.col("d.words"))).otherwise(F.col(text))
    placed = each.withColumn(text, cut).withColumns({"__shard": F.col("d.shard"), "__order": F.col("d.place")})
    return placed.repartition("__shard").sortWithinPartitions("__shard", "__order").select(columns)
