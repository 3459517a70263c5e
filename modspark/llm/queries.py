"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.llm import chat_format, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, token_counts, toxicity, vector_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    return quality_rules.apply_rules(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"].isin(*secret_scan.BASE))
    counts = [F.size(F.expr(f"filter(secrets, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(extra.columns).union(extra)
    out = chat_format.format_chats(rows)
    turns, loss = chat_format.read_turns(F.col("formatted")), chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
    line = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.cosine_classes(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document before and after three edits: inside, near the first quarter, at the start."""
    place = lambda share: F.floor(F.coalesce(F.length("text"), F.lit(0)) * share)
    edit = lambda at, removed, inserted: F.struct(at.alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(place(0.5), 0, " (as amended) "), edit(place(0.25), 12, ""), edit(place(0.0), 0, "Note: "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    out = token_counts.edited_counts(docs.withColumn("n_edits", F.size("edits").cast("long")))
    return out.select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_reencoded")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: the base counts, and whether they fail."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: how many spans of the base kinds."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: sizes and targets."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


_WORD = r"[^\x20\x09-\x0D]+"
BASE_SQL = rf"""
with w as (select row_number() over () as row, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
runs as (select row, i, array_to_string(w[i:i + 7], ' ') as g from (select row, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
again as (select row, i from (select row, i, count(*) over (partition by row, g) as n from runs) where n > 1),
covered as (select row, count(distinct p) as n from (select row, unnest(range(i, i + 8)) as p from again) group by row),
lines as (select row, l from (select row, unnest(string_split(t, chr(10))) as l from w) where regexp_matches(l, '{_WORD}')),
copies as (select row, count(*) - count(distinct l) as n from lines group by row)
select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(copies.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words, len(w) < 20 or 100 * coalesce(covered.n, 0) > 30 * len(w) as base_failed
from w left join copies using (row) left join covered using (row)
"""

_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS_SQL = rf"""
select doc_id, len(list_filter(regexp_extract_all(t, '(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8))::bigint as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::bigint as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))::bigint as n_hex
from (select doc_id, coalesce(text, '') as t from documents)
"""

MIX_SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents),
s as (select source, sum(size)::bigint as n, [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)]::double as weight from d group by source),
all_of as (select 1.5 * sum(n)::double as total from s),
edges as (select 2.0 * n / weight as edge from s union select 0.0),
filled as (select edge, sum(least(2.0 * n, edge * weight)) as got, coalesce(sum(weight) filter (where 2.0 * n / weight > edge), 0) as free from edges, s group by edge),
level as (select arg_max(edge + case when free > 0 then (total - got) / free else 0 end, edge) as reached from filled, all_of where got <= total)
select doc_id, size, n as source_size, round(least(2.0 * n, reached * weight), 3) as target from d join s on d.source is not distinct from s.source, level
"""

_REACH = """
reach as (select id as node, id as least from nodes union select l.b, r.least from reach r join links l on l.a = r.node),
classes as (select node, min(least) as class from reach group by node),
counted as (select a as node, count(*) as n from links group by a)"""

OP1_SQL = f"""
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as run from words),
sizes as (select doc_id, count(*) as n from runs group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n from runs x join runs y on x.run = y.run and x.doc_id <> y.doc_id group by all),
links as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c.n::double / (x.n + y.n - c.n) >= 0.8),
nodes as (select distinct doc_id as id from documents),{_REACH}
select node as doc_id, class as class_id, coalesce(n, 0)::bigint as n_links from classes left join counted using (node)
"""

OP9_SQL = f"""
with recursive vectors as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
good as (select * from vectors where len(v) > 0 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_inner_product(v, v) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id where list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
nodes as (select distinct vec_id as id from embeddings),{_REACH}
select node as vec_id, coalesce(n, 0)::bigint as n_links, class as component_id, node = class as kept from classes left join counted using (node)
"""

OP8_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
escaped as (select *, replace(replace(role, '&', '&amp;'), '<', '&lt;') as r, replace(replace(text, '&', '&amp;'), '<', '&lt;') as t from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(replace(r, '|', '&bar;')) + length(t) + 10)::bigint as formatted_chars
from escaped group by conv_id
"""

OP3_SQL = r"""
with doc as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select row, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from doc),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
hot as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
kept as (select k.row, k.doc_id, k.line, k.pos, h.key is not null and k.doc_id <> h.keeper as gone from keyed k left join hot h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from kept group by row, doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_quality_rules, op3_line_dedup, op4_toxicity, op5_packing, op6_secret_scan, op7_mixing, op8_chat_format, op9_vector_join, op10_token_counts, base_counts, base_secrets, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op9_vector_join": OP9_SQL, "op3_line_dedup": OP3_SQL, "op8_chat_format": OP8_SQL, "base_counts": BASE_SQL, "base_secrets": SECRETS_SQL, "mix_targets": MIX_SQL}
