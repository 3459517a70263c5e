"""Every operator as a query over the generic tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions import sequence, states, values
from modspark.functions.values import threshold_column
from modspark.operators import dense, display, peek, read_info, read_stats, read_table, record_filters, selection, windows
from modspark.operators.alignment import interval
from modspark.operators.decode import calls as call_rows
from modspark.operators.decode import decode
from modspark.options import ModFilter, ReadFilter, SeqDisplay, Threshold, Windowing, f32
from modspark.plans import adapters as A
from modspark.plans import ragged  # noqa: F401  registers its queries
from modspark.plans.registry import QUERIES, SQL, query  # noqa: F401

KEYS = ("read_id", "mod_code")


# Windows over calls.

_WINDOWED = f"""with {A.CALLS.strip()},
w as (select read_id, mod_code, idx, pos as win_start, max(pos) over f + 1 as win_end, count(*) over f as n,
  sum(case when qual >= 128 then 1 else 0 end) over f as hit, sum(case when qual >= 128 then idx else 0 end) over f as placed,
  min(ref_pos) over f as low, max(ref_pos) over f as high
  from calls window f as (partition by read_id, mod_code order by idx rows between current row and {{last}} following))"""


def _windows(win: int, step: int, select: str, where: str = "") -> str:
    return _WINDOWED.format(last=win - 1) + f" select {select} from w where n = {win} and idx % {step} = 0 {where}"


_SLOPE = "(placed - idx * hit + hit - 3.0 * hit) / 10.0"


@query(_windows(5, 2, "read_id, mod_code, idx::int as idx, win_start, win_end, hit / 5.0::double as win_val"))
def window_density(spark, sf_dir):
    return windows.over_calls(A.calls(spark, sf_dir), Windowing(5, 2), KEYS, "density", False, "pos")


@query(_windows(5, 1, f"read_id, mod_code, idx::int as idx, win_start, win_end, ({_SLOPE})::double as win_val"))
def window_gradient(spark, sf_dir):
    return windows.over_calls(A.calls(spark, sf_dir), Windowing(5, 1), KEYS, "gradient", False, "pos")


@query(_windows(10, 10, "read_id, mod_code, idx::int as idx, win_start, win_end, hit / 10.0::double as win_val", "and hit / 10.0 >= 0.4"))
def window_density_at_least(spark, sf_dir):
    return windows.over_calls(A.calls(spark, sf_dir), Windowing(10, 10), KEYS, "density", False, "pos").where(F.col("win_val") >= 0.4)


def _selection(condition: str, slope: bool = False) -> str:
    value = f"cast({_SLOPE} as float)" if slope else "cast(hit / 5.0::double as float)"
    return _WINDOWED.format(last=4) + f", v as (select read_id, {value} as v from w where n = 5) select read_id from v group by read_id having {condition}"


def _find(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = {
        "all_dens_between": lambda: selection.all_between(0.2, 0.9),
        "any_dens_above": lambda: selection.any_above(0.8),
        "any_dens_below": lambda: selection.any_below(0.2),
        "any_dens_below_and_any_dens_above": lambda: selection.any_below_and_any_above(0.2, 0.8),
        "dens_range_above": lambda: selection.range_above(0.7),
        "any_abs_grad_above": lambda: selection.any_abs_above(0.25),
    }[kind]()
    found = windows.over_calls(A.calls(spark, sf_dir), Windowing(5, 1), KEYS, "gradient" if "grad" in kind else "density", order="pos")
    return selection.find_in_windows(found, condition)


for _kind, _having in {
    "all_dens_between": "min(v) >= cast(0.2 as float) and max(v) <= cast(0.9 as float)",
    "any_dens_above": "max(v) >= cast(0.8 as float)",
    "any_dens_below": "min(v) <= cast(0.2 as float)",
    "any_dens_below_and_any_dens_above": "min(v) <= cast(0.2 as float) and max(v) >= cast(0.8 as float)",
    "dens_range_above": "cast(max(v) - min(v) as float) >= cast(0.7 as float)",
    "any_abs_grad_above": "max(abs(v)) >= cast(0.25 as float)",
}.items():
    query(_selection(_having, "grad" in _kind), f"find_{_kind}")(partial(_find, _kind))


# Conditions on alignments.


def _filtered(options: Callable[[], ReadFilter], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.flat_alignments(spark, sf_dir)
    return rows.where(record_filters.predicate(options(), F.col("seq_len"), F.coalesce("align_len", F.lit(0)))).select("rec_no", "read_id")


_SELECT = f"with {A.ALIGNMENTS.strip()} select rec_no, read_id from alignments where "
_ON_CONTIG = "flag <> 4 and contig = 'contig1' and "
for _name, (_options, _where) in {
    "filter_seq_len": (lambda: ReadFilter(min_seq_len=2500), "seq_len >= 2500"),
    "filter_zero_len": (lambda: ReadFilter(min_seq_len=4900, include_zero_len=True), "seq_len = 0 or seq_len >= 4900"),
    "filter_align_len": (lambda: ReadFilter(include_zero_len=True, min_align_len=3000), "flag <> 4 and align_len >= 3000"),
    "filter_read_id": (lambda: ReadFilter(include_zero_len=True, read_id="7"), "read_id = '7'"),
    "filter_states": (lambda: ReadFilter(include_zero_len=True, states=frozenset({16, 272, 2064})), "flag & 2324 in (16, 272, 2064)"),
    "filter_mapq": (lambda: ReadFilter(include_zero_len=True, mapq=200), "mapq >= 200"),
    "filter_mapq_available": (lambda: ReadFilter(include_zero_len=True, mapq=200, exclude_mapq_unavail=True), "mapq >= 200 and mapq <> 255"),
    "filter_region": (lambda: ReadFilter(include_zero_len=True, region=("contig1", 4000, 4200)), _ON_CONTIG + "pos < 4200 and pos + align_len > 4000 and align_len > 0"),
    "filter_full_region": (lambda: ReadFilter(include_zero_len=True, region=("contig1", 4000, 4200), full_region=True), _ON_CONTIG + "pos <= 4000 and pos + align_len > 4000 and pos + align_len >= 4200"),
    "filter_all": (
        lambda: ReadFilter(min_seq_len=100, min_align_len=500, mapq=20, states=frozenset({0, 16}), region=("contig1", 1000, 8000)),
        "seq_len >= 100 and flag in (0, 16) and align_len >= 500 and mapq >= 20 and contig = 'contig1' and pos < 8000 and pos + align_len > 1000",
    ),
}.items():
    query(_SELECT + _where, _name)(partial(_filtered, _options))


@query(_SELECT + "seq_len > 0 and read_id in (select cast(c_custkey as varchar) from customer where c_mktsegment = 'BUILDING')")
def filter_read_id_list(spark, sf_dir):
    rows = A.flat_alignments(spark, sf_dir)
    kept = rows.where(record_filters.predicate(ReadFilter(), F.col("seq_len")))
    return record_filters.by_ids(kept, A.wanted_ids(spark, sf_dir)).select("rec_no", "read_id")


@query(_SELECT + "('0x' || substr(md5(read_id || ':11'), 1, 15))::ubigint::double / 1152921504606846976 < 0.5")
def filter_sample(spark, sf_dir):
    rows = A.flat_alignments(spark, sf_dir)
    return rows.where(record_filters.by_sample(F.col("read_id"), 0.5, 11)).select("rec_no", "read_id")


# Projections.


@query(
    f"""with {A.ALIGNMENTS.strip()}, s as (select rec_no, flag, case flag when 0 then 'primary_forward' when 4 then 'unmapped' when 16 then 'primary_reverse'
  when 256 then 'secondary_forward' when 272 then 'secondary_reverse' when 2048 then 'supplementary_forward' else 'supplementary_reverse' end as read_state from alignments)
select rec_no, read_state, case when flag = 4 then '.' when read_state like '%reverse' then '-' else '+' end as strand, flag from s"""
)
def read_states(spark, sf_dir):
    rows = A.flat_alignments(spark, sf_dir).select("rec_no", states.state(F.col("flag")).alias("read_state"))
    return rows.select("*", states.strand(F.col("read_state")).alias("strand"), states.flag(F.col("read_state")).alias("flag"))


@query(
    "select doc_id, reverse(translate(text, 'AGCTYRWSKMDVHBNagctyrwskmdvhbn', 'TCGARYWSMKHBDVNtcgarywsmkhbdvn')) as turned,"
    " translate(text, 'acgtn', 'ACGTN') as upper_bases from documents"
)
def sequence_functions(spark, sf_dir):
    text = F.col("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", sequence.reverse_complement(text).alias("turned"), sequence.upper_bases(text).alias("upper_bases"))


_CIGAR = "(o_orderkey % 9 + 1) || 'S' || (o_orderkey % 50 + 1) || 'M' || (o_orderkey % 7 + 1) || 'D' || (o_orderkey % 11 + 1) || 'I' || (o_orderkey % 13 + 1) || '='"


@query("select o_orderkey as rec_no, (o_orderkey % 50 + o_orderkey % 7 + o_orderkey % 13 + 3)::int as ref_length, (o_orderkey % 9 + o_orderkey % 50 + o_orderkey % 11 + o_orderkey % 13 + 4)::int as query_length from orders")
def cigar_lengths(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_no"), F.expr(_CIGAR).alias("cigar"))
    return rows.select("rec_no", sequence.reference_length(F.col("cigar")).alias("ref_length"), sequence.query_length(F.col("cigar")).alias("query_length"))


@query(f"with {A.CALLS.strip()} select read_id, pos, cast(qual / 255.0 as float)::double as chance from calls where qual >= 30 and not (qual between 102 and 153)")
def call_threshold(spark, sf_dir):
    t = Threshold.parse("0.4,0.6")
    rows = A.calls(spark, sf_dir).where(threshold_column(F.col("qual"), 30, t.reject))
    return rows.select("read_id", "pos", values.to_fraction(F.col("qual")).cast("double").alias("chance"))


@query(f"with {A.ALIGNMENTS.strip()} select rec_no, case when flag <> 4 then contig end as contig, case when flag <> 4 then pos else 0 end as start, case when flag <> 4 then pos + align_len else 0 end as stop, case when flag = 4 then '.' when flag & 16 > 0 then '-' else '+' end as strand from alignments")
def read_intervals(spark, sf_dir):
    rows = A.flat_alignments(spark, sf_dir).withColumns({"strand": states.strand(states.state(F.col("flag"))), "ref_end": F.col("pos") + F.col("align_len")})
    return rows.select("rec_no", interval().alias("i")).select("rec_no", "i.contig", "i.start", F.col("i.end").alias("stop"), "i.strand")


# Decoding.

_CALLED = f"with {A.TAGGED.strip()} select rec_no, read_id, base, '+' as mod_strand, mod_code, pos, ref_pos, qual from called"


def _decoded(mods: ModFilter, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = call_rows(decode(A.tagged_reads(spark, sf_dir), mods, keep=("rec_no", "read_id")))
    return rows.select("rec_no", "read_id", "base", "mod_strand", "mod_code", F.col("pos").cast("long"), F.col("ref_pos").cast("long"), F.col("qual").cast("int"))


for _name, (_mods, _where) in {
    "decode_calls": (ModFilter(), ""),
    "decode_threshold": (ModFilter(threshold=Threshold(0, (50, 200))), " where qual < 50 or qual > 200"),
    "decode_tag": (ModFilter(tag="76792", mod_strand="bc"), " where mod_code = '76792'"),
    "decode_trim": (ModFilter(trim_read_ends=9), " where fwd >= 9 and fwd < 4 * n - 9"),
    "decode_base_qual": (ModFilter(base_qual=30), " where rec_no % 60 >= 30"),
    "decode_region": (ModFilter(region=("contig2", 3000, 6005)), " where mapped and contig = 'contig2' and ref_pos >= 3000 and ref_pos < 6005"),
}.items():
    query(_CALLED + _where, _name)(partial(_decoded, _mods))


@query(f"with {A.TAGGED.strip()} select rec_no, count(*) filter (where mod_code = 'T' and qual >= 128)::bigint as t, count(*) filter (where mod_code = '76792' and qual >= 128)::bigint as c from called group by rec_no")
def mod_counts(spark, sf_dir):
    reads = decode(A.tagged_reads(spark, sf_dir), ModFilter().promoted(), keep=("rec_no",))
    from modspark.operators.decode import counts_per_code

    counts = reads.select("rec_no", counts_per_code("tracks").alias("n"))
    return counts.select("rec_no", F.col("n")[0]["n"].alias("t"), F.col("n")[1]["n"].alias("c"))


@query(f"with {A.TAGGED.strip()} select distinct rec_no, pos from called where qual > 0")
def modified_positions(spark, sf_dir):
    """Where any track of a read has a call above 0."""
    rows = dense.with_dense_calls(decode(A.tagged_reads(spark, sf_dir), keep=("rec_no", "seq_len")))
    return rows.select("rec_no", F.posexplode(dense.modified_mask()).alias("pos", "m")).where("m").select("rec_no", F.col("pos").cast("long"))


@query(
    f"""with {A.TAGGED.strip()} select read_id, (4 * n)::bigint as seq_len, rec_no % 61 as mapq, case flag when 0 then 'primary_forward' when 4 then 'unmapped' when 16 then 'primary_reverse' when 256 then 'secondary_forward' else 'supplementary_reverse' end as alignment_type,
  case when mapped then start end as align_start, case when mapped then stop end as align_end, case when mapped then contig end as contig, case when mapped then rec_no % 3 end as contig_id,
  base, true as is_strand_plus, mod_code, pos as position, coalesce(ref_pos, -1) as ref_position, qual::bigint as mod_quality from called"""
)
def reads_export(spark, sf_dir):
    return read_info.reads_table(decode(A.tagged_reads(spark, sf_dir), keep=read_info.DESCRIBED))


_TRACKS = f"""with {A.TAGGED.strip()}, ordered as (select *, row_number() over (partition by rec_no, mod_code order by pos) - 1 as idx from called),
w as (select *, count(*) over f as k, sum(case when qual >= 128 then 1 else 0 end) over f as hit, max(pos) over f + 1 as win_end, min(ref_pos) over f as low, max(ref_pos) over f + 1 as high
  from ordered window f as (partition by rec_no, mod_code order by idx rows between current row and 3 following))
select case when mapped then contig else '.' end as contig, coalesce(low, -1) as ref_win_start, coalesce(high, -1) as ref_win_end, read_id, cast(hit / 4.0 as double) as win_val,
  case when flag = 4 then '.' when flag & 16 > 0 then '-' else '+' end as strand, base, '+' as mod_strand, mod_code as mod_type, pos as win_start, win_end, rec_no % 60 as basecall_qual, rec_no
from w where k = 4 and idx % 2 = 0"""


@query(f"select * exclude (rec_no) from ({_TRACKS})")
def window_table(spark, sf_dir):
    """Windows along nested tracks, with intervals on read and reference and the mean base quality."""
    out = windows.window_table(windows.decode_windows(A.tagged_reads(spark, sf_dir), None, Windowing(4, 2)))
    return out.withColumn("win_val", F.col("win_val").cast("double")).drop("rec_no", "track_no", "idx")


@query(f"with t as ({_TRACKS}) select rec_no, read_id from t where mod_type = 'T' group by rec_no, read_id having max(win_val) >= 0.75")
def find_modified_reads(spark, sf_dir):
    return selection.find_reads(A.tagged_reads(spark, sf_dir), Windowing(4, 2), "T", selection.any_above(f32(0.75)))


@query(f"with {A.TAGGED.strip()} select rec_no, base, mod_code, any_value(4 * n)::bigint as n_bases, sum(qual)::bigint as total, count(*) filter (where qual > 0)::bigint as n_modified from called group by rec_no, base, mod_code")
def dense_calls(spark, sf_dir):
    """The dense matrix of a read, summed along its rows."""
    reads = dense.with_dense_calls(decode(A.tagged_reads(spark, sf_dir), keep=("rec_no", "seq_len")))
    rows = reads.select("rec_no", F.explode(F.arrays_zip(dense.mod_types().alias("t"), F.col("dense").alias("q"))).alias("z"))
    total = F.aggregate("z.q", F.lit(0).cast("long"), lambda s, q: s + q)
    return rows.select("rec_no", "z.t.base", "z.t.mod_code", F.size("z.q").cast("long").alias("n_bases"), total.alias("total"), F.size(F.filter("z.q", lambda q: q > 0)).cast("long").alias("n_modified"))


@query(
    """with a as (select o_orderkey as rec_no, o_orderkey % 5 <> 2 and o_orderkey % 3 = 2 as near, (o_orderkey % 32 + 4) * 4 as n, o_orderkey * 37 % 10000 as start from orders),
b as (select *, greatest(start, 3000) as low, least(start + n, 3060) as high from a)
select rec_no, case when near and low < high then substr(repeat('ACGT', 40), low - start + 1, high - low) else '*' end as shown_seq,
  case when near and low < high then array_to_string(list_transform(range(high - low), lambda i: rec_no % 60), '.') else '255' end as shown_qual from b"""
)
def region_sequences(spark, sf_dir):
    """Sequence and qualities over an interval of the reference."""
    reads = display.with_sequence(A.tagged_reads(spark, sf_dir), SeqDisplay(region=("contig2", 3000, 3060), show_base_qual=True))
    return reads.select("rec_no", "shown_seq", "shown_qual")


# Tables.

_STATES = "case when flag = 4 then 'unmapped' when flag in (0, 16) then 'primary' when flag in (256, 272) then 'secondary' else 'supplementary' end"
_LENGTH_STATS = """select '{of}_mean' as key, coalesce(sum(l) // count(*), 0)::bigint as value from {of} union all select '{of}_max', coalesce(max(l), 0) from {of} union all select '{of}_min', coalesce(min(l), 0) from {of}
union all select '{of}_median', coalesce(max(l) filter (where r - 1 = (n + 1) // 2), 0) from {of}
union all select '{of}_n50', coalesce(max(l) filter (where run > (total + 1) // 2), 0) from {of}"""
_LENGTHS = "{of} as (select {of} as l, row_number() over (order by {of} desc) as r, count(*) over () as n, sum({of}) over (order by {of} desc rows unbounded preceding) as run, sum({of}) over () as total from {source} where {where})"


@query(
    f"""with {A.ALIGNMENTS.strip()}, {_LENGTHS.format(of="align_len", source="alignments", where="flag <> 4")}, {_LENGTHS.format(of="seq_len", source="alignments", where="true")},
kinds as (select {_STATES} as kind, flag from alignments)
select 'n_primary_alignments' as key, count(*) filter (where kind = 'primary') as value from kinds union all select 'n_secondary_alignments', count(*) filter (where kind = 'secondary') from kinds
union all select 'n_supplementary_alignments', count(*) filter (where kind = 'supplementary') from kinds union all select 'n_unmapped_reads', count(*) filter (where kind = 'unmapped') from kinds
union all select 'n_reversed_reads', count(*) filter (where flag in (16, 272, 2064)) from kinds
union all {_LENGTH_STATS.format(of="align_len")} union all {_LENGTH_STATS.format(of="seq_len")}"""
)
def read_statistics(spark, sf_dir):
    return read_stats.stats_of(A.flat_alignments(spark, sf_dir).withColumn("read_state", states.state(F.col("flag"))))


_KINDS = "case flag when 0 then 'primary_forward' when 4 then 'unmapped' when 16 then 'primary_reverse' when 256 then 'secondary_forward' when 272 then 'secondary_reverse' when 2048 then 'supplementary_forward' else 'supplementary_reverse' end"
_GROUPED = f"string_agg(coalesce(align_len, 0)::varchar, ', ' order by rec_no) as align_length, string_agg({_KINDS}, ', ' order by rec_no) as alignment_type"


def _grouped(summary: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.flat_alignments(spark, sf_dir)
    rows = rows.select("rec_no", "read_id", "seq_len", F.coalesce("align_len", F.lit(0)).alias("align_length"), states.state(F.col("flag")).alias("alignment_type"))
    return read_table.group_reads(rows, ["align_length", "alignment_type"], A.summary(spark, sf_dir) if summary else None)


query(f"with {A.ALIGNMENTS.strip()} select read_id, max(seq_len)::bigint as sequence_length_template, {_GROUPED} from alignments group by read_id", "read_table_hide_mods")(partial(_grouped, False))
query(
    f"with {A.ALIGNMENTS.strip()}, g as (select read_id, {_GROUPED} from alignments group by read_id) select g.*, c_custkey % 900 + 100 as sequence_length_template from g join customer on read_id = cast(c_custkey as varchar)",
    "read_table_summary",
)(partial(_grouped, True))


@query(
    f"""with {A.TAGGED.strip()}, one as (select rec_no, any_value(read_id) as read_id, any_value(flag) as flag, any_value(n) as n, any_value(mapped) as mapped,
  'T:' || count(*) filter (where mod_code = 'T' and qual >= 128) || ';76792:' || count(*) filter (where mod_code <> 'T' and qual >= 128) as c from called group by rec_no)
select read_id, string_agg(case when mapped then 4 * n else 0 end::varchar, ', ' order by rec_no) as align_length, (4 * max(n))::bigint as sequence_length_template,
  string_agg({_KINDS}, ', ' order by rec_no) as alignment_type, string_agg(c, ', ' order by rec_no) as mod_count from one group by read_id"""
)
def read_table_show_mods(spark, sf_dir):
    return read_table.read_table(A.tagged_alignments(spark, sf_dir), ModFilter())


@query(
    f"""with {A.TAGGED.strip()}, one as (select rec_no, any_value(read_id) as read_id, any_value(flag) as flag, any_value(n) as n, any_value(mapped) as mapped, any_value(contig) as contig, any_value(start) as start, any_value(stop) as stop,
  count(*) filter (where mod_code = 'T' and qual >= 128) as t, count(*) filter (where mod_code <> 'T' and qual >= 128) as c from called group by rec_no)
select rec_no, '{{' || chr(10) || chr(9) || '"read_id": "' || read_id || '",' || chr(10) || chr(9) || '"sequence_length": ' || (4 * n) || ',' || chr(10) || chr(9) || '"mapq": ' || (rec_no % 61) || ',' || chr(10) ||
  case when mapped then chr(9) || '"contig": "' || contig || '",' || chr(10) || chr(9) || '"reference_start": ' || start || ',' || chr(10) || chr(9) || '"reference_end": ' || stop || ',' || chr(10) || chr(9) || '"alignment_length": ' || (4 * n) || ',' || chr(10) else '' end ||
  chr(9) || '"alignment_type": "' || {_KINDS} || '",' || chr(10) || chr(9) || '"mod_count": "C+76792:' || c || ';T+T:' || t || ';(probabilities >= 0.5020, PHRED base qual >= 0)"' || chr(10) || '}}' as json from one"""
)
def read_info_condensed(spark, sf_dir):
    return read_info.read_info(A.tagged_alignments(spark, sf_dir))


@query(
    f"""with {A.TAGGED.strip()}, one as (select rec_no, base, mod_code, any_value(read_id) as read_id, any_value(flag) as flag, any_value(n) as n, any_value(mapped) as mapped, any_value(contig) as contig, any_value(start) as start, any_value(stop) as stop,
  string_agg('[' || pos || ',' || coalesce(ref_pos, -1) || ',' || qual || ']', ',' order by pos) as data from called group by rec_no, base, mod_code)
select rec_no, '{{"alignment_type":"' || {_KINDS.replace("flag", "any_value(flag)")} || '",' || case when any_value(mapped) then '"alignment":{{"start":' || any_value(start) || ',"end":' || any_value(stop) || ',"contig":"' || any_value(contig) || '","contig_id":' || (rec_no % 3) || '}},' else '' end ||
  '"mod_table":[' || string_agg('{{"base":"' || base || '","is_strand_plus":true,"mod_code":"' || mod_code || '","data":[' || data || ']}}', ',' order by base) || '],"read_id":"' || any_value(read_id) || '","mapq":' || (rec_no % 61) || ',"seq_len":' || (4 * any_value(n)) || '}}' as json from one group by rec_no"""
)
def read_info_detailed(spark, sf_dir):
    return read_info.read_info(A.tagged_alignments(spark, sf_dir), detail=True)


@query(f"with {A.TAGGED.strip()} select rec_no, base, mod_code, count(*)::bigint as n, sum(pos)::bigint as places from called group by all")
def read_json_round_trip(spark, sf_dir):
    """Detailed JSON read back, its checks included."""
    json = read_info.read_info(A.tagged_alignments(spark, sf_dir), detail=True)
    reads = read_info.from_json(json.select(F.concat(F.lit('{"read_id":"'), F.col("rec_no").cast("string"), F.lit('"'), F.regexp_replace(F.regexp_replace(F.substring("json", 2, 1 << 30), '"read_id":"[^"]*",', ""), "^", ",")).alias("json")))
    tracks = reads.select(F.col("read_id").cast("long").alias("rec_no"), F.explode("tracks").alias("t"))
    return tracks.select("rec_no", "t.base", "t.mod_code", F.size("t.calls").cast("long").alias("n"), F.aggregate("t.calls", F.lit(0).cast("long"), lambda s, c: s + c["pos"]).alias("places"))


@query(f"with {A.TAGGED.strip()} select distinct base || '+' || mod_code as modification from called where rec_no in (select key from tagged order by key limit 100)")
def peek_modifications(spark, sf_dir):
    return peek.modifications(A.tagged_alignments(spark, sf_dir))
