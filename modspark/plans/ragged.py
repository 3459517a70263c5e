"""Queries over alignments that are hard to decode, each with SQL that walks the bases one by one.

A read has a sequence without pattern, qualities of its own for each base, or none, and a CIGAR
with clips, an insertion, a deletion and a skip. Its tags have three groups, not in their final
order: an implicit one on the other strand, one on any base with a numeric code, and one on C
whose mode and numbers differ from read to read. SQL spells out bases, candidates, calls and
places on the reference by ranks and sums, and shares nothing with the kernels.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modspark import format as text
from modspark import simulate
from modspark.functions import states, values
from modspark.functions.sequence import reverse_complement
from modspark.model import ALIGNMENT_COLUMNS, CONTIGS
from modspark.operators import dense, display, read_info, read_table, record_filters, selection, sql, windows
from modspark.operators.alignment import with_alignment
from modspark.operators.decode import calls as call_rows
from modspark.operators.decode import decode
from modspark.options import ModFilter, ReadFilter, Region, SeqDisplay, Threshold, Windowing
from modspark.plans import adapters as A
from modspark.plans.registry import query
from modspark.session import scratch
from modspark.sources import bam, sam, sinks, tables

HEX, LETTERS, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGT", "!#%,/2589<?BDFHJ"
CONTIG = ("contig1", 4000, 4300)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    o = o.repartition(spark.sparkContext.defaultParallelism)
    o = o.selectExpr("key", "cast(40 + key % 17 as int) as n", "element_at(array(0, 16, 4, 256, 2064), cast(key % 5 + 1 as int)) as flag", "key % 4 as s1", "key % 3 as i1", "key % 5 as d1", "if(key % 2 = 1, 11, 0) as n1", "if(key % 6 = 0, 3, 0) as s2")
    text = lambda a, b, to: f"substr(translate(concat(md5(concat('{a}', key)), md5(concat('{b}', key))), '{HEX}', '{to}'), 1, n)"
    o = o.selectExpr("*", "flag <> 4 as mapped", f"{text('s', 't', LETTERS)} as seq", f"if(key % 11 <> 0, {text('q', 'r', QUALITIES)}, null) as qual")
    o = o.selectExpr("*", "if(flag & 16 > 0, reverse(translate(seq, 'ACGT', 'TGCA')), seq) as fwd")
    o = o.selectExpr("*", "(length(fwd) - length(replace(fwd, 'C', ''))) div 2 as kc", "least(1, length(fwd) - length(replace(fwd, 'T', ''))) as kt")
    run = lambda n, op: f"if({n} > 0, concat({n}, '{op}'), '')"
    cigar = f"concat({run('s1', 'S')}, '9M', {run('i1', 'I')}, '7M', {run('d1', 'D')}, '6=', {run('n1', 'N')}, '4X', n - s1 - i1 - s2 - 26, 'M', {run('s2', 'S')})"
    skips = "if(kc > 0, array_join(transform(sequence(1, kc), j -> concat(',', (j - 1) % 2)), ''), '')"
    mm = f"concat('T-a.', if(kt > 0, ',0', ''), ';N+21839?,3,', key % 5, ',7;C+m', element_at(array('', '.', '?'), cast(key % 3 + 1 as int)), {skips}, ';')"
    return o.selectExpr(
        "key as rec_no", "concat('r', key) as read_id", "flag", "if(mapped, cast(key % 3 as int), null) as tid", "if(mapped, concat('contig', key % 3), null) as contig",
        "if(mapped, cast(key * 37 % 10000 as int), -1) as pos", "cast(key % 61 as short) as mapq", f"if(mapped, {cigar}, null) as cigar", "seq", "qual", f"{mm} as mm",
        "transform(sequence(0, cast(kt + 2 + kc as int)), j -> cast((j * 31 + key) % 256 as short)) as ml",
    ).select(*ALIGNMENT_COLUMNS)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_alignment(alignments(spark, sf_dir))


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f"contig{k}", 20_000) for k in range(3)], CONTIGS)


_STATE = "case flag when 0 then 'primary_forward' when 4 then 'unmapped' when 16 then 'primary_reverse' when 256 then 'secondary_forward' else 'supplementary_reverse' end"
#: r: the reads. c: their calls, pos in the record's orientation, f in that of sequencing.
READS = f"""r0 as (select o_orderkey as key, cast(40 + o_orderkey % 17 as int) as n, [0, 16, 4, 256, 2064][cast(o_orderkey % 5 + 1 as int)] as flag,
  o_orderkey % 4 as s1, o_orderkey % 3 as i1, o_orderkey % 5 as d1, case when o_orderkey % 2 = 1 then 11 else 0 end as n1, case when o_orderkey % 6 = 0 then 3 else 0 end as s2 from orders),
r1 as (select *, flag <> 4 as mapped, n - s1 - i1 - s2 - 26 as rest, case when flag <> 4 then key * 37 % 10000 end as start, 'contig' || (key % 3) as on_contig,
  substr(translate(md5('s' || key) || md5('t' || key), '{HEX}', '{LETTERS}'), 1, n) as seq, case when key % 11 <> 0 then substr(translate(md5('q' || key) || md5('r' || key), '{HEX}', '{QUALITIES}'), 1, n) end as quals from r0),
r2 as (select *, case when flag & 16 > 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as fwd, start + 26 + d1 + n1 + rest as stop from r1),
r as (select *, (length(fwd) - length(replace(fwd, 'C', ''))) // 2 as kc, least(1, length(fwd) - length(replace(fwd, 'T', ''))) as kt from r2)"""
#: The place on the reference of base p of a read, null where there is none.
PLACE = """case when not mapped or p < s1 then null when p < s1 + 9 then start + p - s1 when p < s1 + 9 + i1 then null when p < s1 + 16 + i1 then start + p - s1 - i1
  when p < s1 + 22 + i1 then start + p - s1 - i1 + d1 when p < n - s2 then start + p - s1 - i1 + d1 + n1 end"""
CALLS = f"""{READS},
b as (select key, f, substr(fwd, f + 1, 1) as letter from (select key, fwd, unnest(range(n)) as f from r)),
g as (select key, 2 as track, 'T' as base, '-' as strand, 'a' as code, true as implicit, case when kt > 0 then [0] else [] end as skipped, 0 as used from r
  union all select key, 1, 'N', '+', '21839', false, [3, key % 5, 7], kt from r
  union all select key, 0, 'C', '+', 'm', key % 3 <> 2, list_transform(range(kc), lambda j: j % 2), kt + 3 from r),
candidate as (select g.key, track, f, row_number() over (partition by g.key, track order by f) - 1 as rank from g join b on g.key = b.key and (g.base = 'N' or g.base = b.letter)),
given as (select key, track, coalesce(list_sum(skipped[1:j + 1]), 0) + j as rank, (31 * (used + j) + key) % 256 as value from (select *, unnest(range(len(skipped))) as j from g)),
c as (select key as rec_no, 'r' || key as read_id, track, base, strand as mod_strand, code as mod_code, f, p as pos, cast({PLACE} as bigint) as ref_pos, cast(coalesce(value, 0) as int) as qual,
    case when quals is null then 255 else ascii(substr(quals, p + 1, 1)) - 33 end as base_qual, n, flag, mapped, on_contig, start, stop, quals
  from (select *, case when flag & 16 > 0 then n - 1 - f else f end as p from candidate join g using (key, track) join r using (key) left join given using (key, track, rank)) where value is not null or implicit)"""
_CALL = "rec_no, read_id, track, base, mod_strand, mod_code, pos, ref_pos, qual"


def _calls(decoded: DataFrame) -> DataFrame:
    rows = call_rows(decoded)
    return rows.select("rec_no", "read_id", F.col("track_no").alias("track"), "base", "mod_strand", "mod_code", F.col("pos").cast("long"), F.col("ref_pos").cast("long"), F.col("qual").cast("int"))


def _decoded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _calls(decode(reads(spark, sf_dir), keep=("rec_no", "read_id"), **options))


@query(f"with {CALLS} select {_CALL} from c")
def ragged_calls(spark, sf_dir):
    """Implicit and explicit groups, clips, insertions and skips, both orientations, tracks in order."""
    return _decoded(spark, sf_dir)


@query(f"with {CALLS} select {_CALL} from c where qual >= 1 and qual not between 100 and 150")
def ragged_threshold(spark, sf_dir):
    """Implicit calls aren't there where 0 doesn't pass."""
    return _decoded(spark, sf_dir, mods=ModFilter(threshold=Threshold(1, (100, 150))))


@query(f"with {CALLS} select {_CALL} from c where base_qual >= 20 and base_qual <> 255")
def ragged_base_qual(spark, sf_dir):
    return _decoded(spark, sf_dir, mods=ModFilter(base_qual=20))


@query(f"with {CALLS} select {_CALL} from c where base in ('C', 'N') and f % 3 <> 1 and f >= 5 and f < n - 5")
def ragged_closures(spark, sf_dir):
    """Conditions of the caller's own on groups and on positions, and trimmed ends."""
    return _decoded(spark, sf_dir, mods=ModFilter(trim_read_ends=5), wanted=lambda base, strand, code: base in "CN", position=lambda i: i % 3 != 1)


@query(f"""with {CALLS}, o as (select *, start >= {CONTIG[1]} and stop <= {CONTIG[2]} as whole, ref_pos >= {CONTIG[1]} and ref_pos < {CONTIG[2]} as inside from c
  where mapped and on_contig = '{CONTIG[0]}' and start < {CONTIG[2]} and stop > {CONTIG[1]}),
e as (select *, min(pos) filter (where inside) over w as low, max(pos) filter (where inside) over w as high from o window w as (partition by rec_no, track))
select {_CALL} from e where whole or pos between low and high""")
def ragged_region(spark, sf_dir):
    """Calls without a place on the reference stay between those inside."""
    return _decoded(spark, sf_dir, mods=ModFilter(region=CONTIG))


@query(f"""with {CALLS}, k as (select * from c where mod_code = 'm' and mod_strand = '+' and qual >= 1 and qual not between 100 and 150 and base_qual >= 11 and base_qual <> 255 and f >= 3 and f < n - 3 and mapped and on_contig = '{CONTIG[0]}' and start < 9000 and stop > 2000),
e as (select *, min(pos) filter (where ref_pos >= 2000 and ref_pos < 9000) over w as low, max(pos) filter (where ref_pos >= 2000 and ref_pos < 9000) over w as high from k window w as (partition by rec_no))
select {_CALL.replace('track', '0 as track')} from e where (start >= 2000 and stop <= 9000) or pos between low and high""")
def ragged_combined(spark, sf_dir):
    """All conditions on calls at once."""
    rows = _decoded(spark, sf_dir, mods=ModFilter("m", "bc", Threshold(1, (100, 150)), 3, 11, (CONTIG[0], 2000, 9000)))
    return rows.withColumn("track", F.lit(0))


_FAULTS = "case key % 7 when 0 then 'InvalidModProbs' when 1 then 'InvalidModProbs' when 2 then 'InvalidModCoords' when 3 then 'InvalidModType' when 4 then 'DuplicateMods' when 5 then 'InvalidBase' end"


@query(f"with {READS} select key as rec_no, {_FAULTS} as kind, case when key % 7 = 6 then 3 end::int as n_tracks from r")
def ragged_faults(spark, sf_dir):
    """Tags that contradict themselves, told apart; good ones among them."""
    change = "case rec_no % 7 when 3 then rtrim(';', mm) when 4 then concat(mm, 'A+m?;') when 5 then concat(mm, 'Z+m;') when 2 then concat(mm, 'T+t?,900;') else mm end"
    chances = "case rec_no % 7 when 0 then slice(ml, 1, size(ml) - 1) when 1 then concat(ml, array(cast(7 as short))) else ml end"
    rows = with_alignment(alignments(spark, sf_dir).withColumns({"mm": F.expr(change), "ml": F.expr(chances)}))
    out = decode(rows, mode="permissive", keep=("rec_no",))
    return out.select("rec_no", F.substring_index("error", ":", 1).alias("kind"), F.when(F.col("tracks").isNotNull(), F.size("tracks")).alias("n_tracks"))


@query(f"with {CALLS} select {_CALL} from c")
def ragged_sql_calls(spark, sf_dir):
    """The table function for SQL."""
    sql.register(spark)
    rows = alignments(spark, sf_dir)
    out = spark.sql("select rec_no, read_id, x.* from {rows}, lateral mm_ml_calls(flag, contig, pos, cigar, seq, qual, mm, ml) x", rows=rows)
    return out.select("rec_no", "read_id", F.col("track_no").alias("track"), "base", "mod_strand", "mod_code", F.col("call_pos").cast("long").alias("pos"), F.col("ref_pos").cast("long"), F.col("probability").alias("qual"))


_ERRORS = "chance as (select key, p, sum(pow(10, -q / 10.0)) over (partition by key order by p) as total from (select key, p, ascii(substr(quals, p + 1, 1)) - 33 as q from (select key, quals, unnest(range(n)) as p from r where quals is not null)))"
_WINDOWS = f"""with {CALLS}, {_ERRORS},
i as (select *, row_number() over (partition by rec_no, track order by pos) - 1 as idx from c),
w as (select *, count(*) over f as k, sum(case when qual >= 128 then 1 else 0 end) over f as hit, max(pos) over f + 1 as win_end, min(ref_pos) over f as low, max(ref_pos) over f + 1 as high
  from i window f as (partition by rec_no, track order by idx rows between current row and 2 following)),
t as (select case when mapped then on_contig else '.' end as contig, coalesce(low, -1) as ref_win_start, coalesce(high, -1) as ref_win_end, read_id, cast(cast(hit / 3.0 as float) as double) as win_val,
  case when flag = 4 then '.' when flag & 16 > 0 then '-' else '+' end as strand, base, mod_strand, mod_code as mod_type, pos as win_start, win_end,
  case when quals is null then 255 else cast(floor(-10 * log10((b.total - coalesce(a.total, 0)) / (win_end - pos)) + 0.5) as bigint) end as basecall_qual, rec_no, k, idx
  from w left join chance a on a.key = rec_no and a.p = pos - 1 left join chance b on b.key = rec_no and b.p = win_end - 1)
select contig, ref_win_start, ref_win_end, read_id, win_val, strand, base, mod_strand, mod_type, win_start, win_end, basecall_qual from t where k = 3 and idx % 2 = 0"""


def _windows(spark: SparkSession, sf_dir: str, function) -> DataFrame:
    out = windows.window_table(windows.decode_windows(reads(spark, sf_dir), None, Windowing(3, 2), function))
    return out.withColumn("win_val", F.col("win_val").cast("double")).drop("rec_no", "track_no", "idx")


@query(_WINDOWS)
def ragged_windows(spark, sf_dir):
    """Places on the reference across gaps, and mean qualities of bases that differ."""
    return _windows(spark, sf_dir, windows.density)


@query(_WINDOWS + " and win_val >= 0.5")
def ragged_density_at_least(spark, sf_dir):
    """The function that leaves windows out."""
    return _windows(spark, sf_dir, windows.density_at_least(0.5))


_LINES = _WINDOWS.replace("select contig, ref_win_start, ref_win_end, read_id, win_val, strand, base, mod_strand, mod_type, win_start, win_end, basecall_qual from t where k = 3 and idx % 2 = 0", "")


@query(f"""{_LINES}
select row_number() over (order by rec_no, mod_strand = '-', mod_type <> 'm', idx) as nth, concat_ws(chr(9), contig, ref_win_start, ref_win_end, read_id, case round(3 * win_val) when 0 then '0' when 1 then '0.33333334' when 2 then '0.6666667' else '1' end, strand, base, mod_strand, mod_type, win_start, win_end, basecall_qual) as line
from t where k = 3 and idx % 2 = 0
union all select 0, concat_ws(chr(9), '#contig', 'ref_win_start', 'ref_win_end', 'read_id', 'win_val', 'strand', 'base', 'mod_strand', 'mod_type', 'win_start', 'win_end', 'basecall_qual')""")
def ragged_window_lines(spark, sf_dir):
    """The window table as text, in file order."""
    return text.windows_lines(windows.window_table(windows.decode_windows(text.in_file_order(reads(spark, sf_dir)), None, Windowing(3, 2))))


@query(f"with {CALLS}, w as (select rec_no, read_id, max(qual) over f as top, count(*) over f as k from c where mod_code = 'm' window f as (partition by rec_no order by pos rows between current row and 1 following)) select distinct rec_no, read_id from w where k = 2 and top >= 230")
def ragged_find_custom(spark, sf_dir):
    """A window function and a condition on values of the caller's own."""
    return selection.find_reads(reads(spark, sf_dir), Windowing(2, 1), "m", function=lambda q: np.float32(q.max() / 255), predicate=lambda v: F.exists(v, lambda x: x >= 0.9))


@query(f"with {CALLS} select rec_no, any_value(n)::bigint as n_bases, count(distinct pos) filter (where qual > 0)::bigint as n_modified, coalesce(sum(distinct pos) filter (where qual > 0), 0)::bigint as places from c group by rec_no")
def ragged_mask(spark, sf_dir):
    """The mask over all tracks."""
    rows = dense.with_dense_calls(decode(reads(spark, sf_dir), keep=("rec_no", "seq_len"))).select("rec_no", dense.modified_mask().alias("m"))
    where = F.filter(F.transform("m", lambda x, k: F.when(x, k)), lambda k: k.isNotNull())
    return rows.select("rec_no", F.size("m").cast("long").alias("n_bases"), F.size(where).cast("long").alias("n_modified"), F.aggregate(where, F.lit(0).cast("long"), lambda s, k: s + k).alias("places"))


@query(f"""with {CALLS}, modified as (select distinct rec_no as key, pos as p from c where qual > 0),
columns as (select *, unnest(range(n + d1 + n1)) as k from r where mapped and on_contig = '{CONTIG[0]}' and start < {CONTIG[2]} and stop > {CONTIG[1]}),
walked as (select *, case when k < s1 + 16 + i1 then k when k < s1 + 16 + i1 + d1 then null when k < s1 + 22 + i1 + d1 then k - d1 when k < s1 + 22 + i1 + d1 + n1 then null else k - d1 - n1 end as p from columns),
placed as (select *, case when p is null then start + k - s1 - i1 else {PLACE} end as ref from walked),
ends as (select *, min(k) filter (where ref >= {CONTIG[1]} and ref < {CONTIG[2]}) over w as low, max(k) filter (where ref >= {CONTIG[1]} and ref < {CONTIG[2]}) over w as high from placed window w as (partition by key)),
shown as (select e.key, k, case when e.p is null then '.' when m.p is not null and ref is null then 'z' when m.p is not null then 'Z' when ref is null then lower(substr(seq, e.p + 1, 1)) else substr(seq, e.p + 1, 1) end as base,
  case when e.p is null or quals is null then 255 else ascii(substr(quals, e.p + 1, 1)) - 33 end as q from ends e left join modified m on m.key = e.key and m.p = e.p where k between low and high),
joined as (select key, string_agg(base, '' order by k) as s, string_agg(q::varchar, '.' order by k) as q from shown group by key)
select r.key as rec_no, coalesce(s, '*') as shown_seq, coalesce(q, '255') as shown_qual from r left join joined using (key)""")
def ragged_sequences(spark, sf_dir):
    """Insertions in lower case, gaps as dots, modified bases as Z, over an interval."""
    rows = decode(reads(spark, sf_dir), keep=("rec_no", *display.SHOWN))
    return display.with_sequence(rows, SeqDisplay(region=CONTIG, show_base_qual=True, show_ins_lowercase=True, show_mod_z=True)).select("rec_no", "shown_seq", "shown_qual")


_COUNTED = "count(*) filter (where mod_code = '{0}' and qual >= 128)"


@query(f"""with {CALLS}, one as (select rec_no, 'a:' || {_COUNTED.format('a')} || ';m:' || {_COUNTED.format('m')} || ';21839:' || {_COUNTED.format('21839')} as counts from c group by rec_no)
select 'r' || key as read_id, cast(case when mapped then stop - start else 0 end as varchar) as align_length, case when key % 7 = 0 then 0 else n end::bigint as sequence_length_template, {_STATE} as alignment_type,
  case when key % 7 = 0 then 'NA' else counts end as mod_count from r join one on rec_no = key""")
def ragged_read_table(spark, sf_dir):
    """Reads without sequence among the others, and codes by code point."""
    rows = alignments(spark, sf_dir).withColumns({"seq": F.when(F.col("rec_no") % 7 != 0, F.col("seq")).otherwise(""), "qual": F.when(F.col("rec_no") % 7 != 0, F.col("qual"))})
    return read_table.read_table(rows, ModFilter())


@query(f"""with {CALLS} select read_id, n::bigint as seq_len, rec_no % 61 as mapq, {_STATE} as alignment_type, case when mapped then start end as align_start, case when mapped then stop end as align_end, case when mapped then on_contig end as contig,
  case when mapped then rec_no % 3 end as contig_id, base, mod_strand = '+' as is_strand_plus, mod_code, pos as position, coalesce(ref_pos, -1) as ref_position, qual::bigint as mod_quality from c""")
def ragged_export(spark, sf_dir):
    return read_info.reads_table(decode(reads(spark, sf_dir), keep=read_info.DESCRIBED))


# Files. They are written to the shared folder and read back.

_RUN = "case when {0} > 0 then {0} || '{1}' else '' end"
_CIGAR = "case when mapped then " + " || ".join([_RUN.format("s1", "S"), "'9M'", _RUN.format("i1", "I"), "'7M'", _RUN.format("d1", "D"), "'6='", _RUN.format("n1", "N"), "'4X'", "rest || 'M'", _RUN.format("s2", "S")]) + " end"
_MM = "'T-a.' || case when kt > 0 then ',0' else '' end || ';N+21839?,3,' || (key % 5) || ',7;C+m' || ['', '.', '?'][cast(key % 3 + 1 as int)] || array_to_string(list_transform(range(kc), lambda j: ',' || (j % 2)), '') || ';'"
_ML = "array_to_string(list_transform(range(kt + 3 + kc), lambda j: (j * 31 + key) % 256), ',')"
_SCANNED = f"with {READS} select 'r' || key as read_id, flag, case when mapped then key % 3 end::int as tid, case when mapped then on_contig end as contig, coalesce(start, -1)::int as pos, (key % 61)::int as mapq, {_CIGAR} as cigar, seq, quals as qual, {_MM} as mm, {_ML} as ml from r"
SPLIT = 100_000


def _path(spark: SparkSession, name: str) -> str:
    """Where the driver writes a file of its own."""
    path = scratch(spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select("read_id", "flag", "tid", "contig", "pos", F.col("mapq").cast("int"), "cigar", "seq", "qual", "mm", F.array_join(F.transform("ml", lambda x: x.cast("string")), ",").alias("ml"))


@query(_SCANNED)
def scan_bam(spark, sf_dir):
    """A BAM file without index, in many splits."""
    path = _path(spark, "reads.bam")
    sinks.write_bam(alignments(spark, sf_dir), contigs(spark), path, index=False)
    return _scanned(bam.read_bam(spark, path, split=SPLIT))


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    """A sorted BAM file with an index; records are numbered in its order by the writer's own sort."""
    path = _path(spark, "sorted.bam")
    rows = sinks.sorted_alignments(alignments(spark, sf_dir)).withColumn("rec_no", F.monotonically_increasing_id())
    sinks.write_bam(rows, contigs(spark), path)
    return path


@query(_SCANNED + f" where mapped and on_contig = '{CONTIG[0]}' and start < {CONTIG[2]} and stop > {CONTIG[1]}")
def scan_bam_region(spark, sf_dir):
    """An interval, by the index."""
    return _scanned(bam.read_bam(spark, _indexed(spark, sf_dir), CONTIG[0], SPLIT, CONTIG[1], CONTIG[2]))


@query(_SCANNED + f" where mapped and on_contig = '{CONTIG[0]}' and start < {CONTIG[2]} and stop > {CONTIG[1]}")
def scan_bam_region_unindexed(spark, sf_dir):
    """The same without an index: all of the file is read."""
    path = _path(spark, "plain.bam")
    sinks.write_bam(alignments(spark, sf_dir), contigs(spark), path, index=False)
    return _scanned(bam.read_bam(spark, path, CONTIG[0], SPLIT, CONTIG[1], CONTIG[2]))


@query("select unnest([0, 1, 2])::int as tid, unnest(['contig0', 'contig1', 'contig2']) as contig, 20000::bigint as length")
def header_contigs(spark, sf_dir):
    return bam.contigs(spark, _indexed(spark, sf_dir))


@query(f"with {READS} select 'r' || key as read_id, on_contig as contig, row_number() over (partition by on_contig order by start, flag & 16 > 0, key) as nth from r where mapped")
def sorted_places(spark, sf_dir):
    """The order that an index needs, as a file has it on each contig."""
    rows = bam.read_bam(spark, _indexed(spark, sf_dir)).where("flag <> 4")
    return rows.select("read_id", "contig", F.row_number().over(Window.partitionBy("contig").orderBy("rec_no")).cast("long").alias("nth"))


@query(_SCANNED + " where mapped and on_contig = 'contig2'")
def scan_bam_contig(spark, sf_dir):
    return _scanned(bam.read_bam(spark, _indexed(spark, sf_dir), "contig2", SPLIT))


@query(_SCANNED)
def scan_sam(spark, sf_dir):
    path = _path(spark, "reads.sam")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{x}\n" for x in sinks.sam_lines(alignments(spark, sf_dir), contigs(spark)))
    return _scanned(sam.read_sam(spark, path))


@query(f"""with {READS} select 'r' || key as read_id, {_MM} as mm, case when key % 3 = 2 then '' else {_ML} end as ml from r""")
def scan_sam_tags(spark, sf_dir):
    """Both spellings of the tags, and numbers that aren't bytes, which count as none."""
    path = _path(spark, "tags.sam")
    name = lambda a, b: F.when(F.col("rec_no") % 3 == 0, F.lit(a)).otherwise(F.lit(b))
    numbers = F.array_join(F.transform("ml", lambda x: x.cast("string")), ",")
    kind = F.when(F.col("rec_no") % 3 == 2, F.lit("B:S,")).otherwise(F.lit("B:C,"))
    fields = ["read_id", F.col("flag").cast("string"), F.coalesce("contig", F.lit("*")), (F.col("pos") + 1).cast("string"), F.lit("9"), F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")]
    lines = alignments(spark, sf_dir).select(F.concat_ws("\t", *fields, F.concat(name("Mm", "MM"), F.lit(":Z:"), "mm"), F.lit("NM:i:3"), F.concat(name("Ml", "ML"), F.lit(":"), kind, numbers)).alias("value"))
    head = spark.createDataFrame([(f"@SQ\tSN:contig{k}\tLN:20000",) for k in range(3)], "value string")
    head.coalesce(1).write.text(f"{path}/a")
    lines.write.text(f"{path}/b")
    rows = sam.from_lines(spark.read.text(f"{path}/b").select(F.monotonically_increasing_id().alias("rec_no"), "value"), sam.contigs(spark, f"{path}/a"))
    return rows.select("read_id", "mm", F.array_join(F.transform("ml", lambda x: x.cast("string")), ",").alias("ml"))


@query("select unnest([0, 1])::int as part, unnest([300, 200])::bigint as n, unnest([300, 200])::bigint as n_in_contig, unnest([300, 200])::bigint as n_quality, unnest([300, 200])::bigint as n_called, true as sorted")
def simulated_reads(spark, sf_dir):
    """What must hold of simulated reads, whatever is drawn: two groups, sequences out of their contig, calls on every candidate, and their order."""
    mods = ({"base": "C", "mod_code": "m", "win": [3, 2], "mod_range": [[0.5, 0.6], [0.0, 0.1]]},)
    groups = tuple(simulate.ReadConfig(n, mapq_range=(5, 9), base_qual_range=(11, 19), len_range=(0.3, 0.7), mods=mods) for n in (300, 200))
    rows, _, sequences = simulate.simulate(spark, simulate.SimulationConfig(simulate.ContigConfig(3, (700, 700), "ACCGTTAGC"), groups, 21))
    whole = sequences.select(F.col("name").alias("contig"), F.col("seq").alias("whole")) if "name" in sequences.columns else sequences
    calls = call_rows(decode(with_alignment(rows), keep=("rec_no", "read_id"))).groupBy("rec_no").agg(F.count("*").alias("called"), F.sum(F.col("qual").between(127, 153).cast("int")).alias("high"))
    forward = F.when(F.col("flag").bitwiseAND(16) > 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    wanted = F.length(forward) - F.length(F.replace(forward, F.lit("C"), F.lit("")))
    high = F.floor(wanted / 5) * 3 + F.least(F.lit(3), wanted % 5)
    place = F.when(F.col("contig").isNull(), F.lit(True)).otherwise(F.expr("substr(whole, pos + 1, length(seq))") == F.col("seq"))
    good = F.forall(F.split("qual", ""), lambda q: (q == "") | (F.ascii(q) - 33).between(11, 19))
    before = F.lag(F.struct(F.col("flag") == 4, "tid", "pos", F.col("flag").bitwiseAND(16) != 0)).over(Window.partitionBy("contig").orderBy("rec_no"))
    order = F.coalesce(before <= F.struct(F.col("flag") == 4, "tid", "pos", F.col("flag").bitwiseAND(16) != 0), F.lit(True))
    checked = rows.join(whole, "contig", "left").join(calls, "rec_no", "left").withColumn("order", order)
    return checked.groupBy(F.substring_index("read_id", ".", 1).cast("int").alias("part")).agg(
        F.count("*").alias("n"), F.sum(place.cast("long")).alias("n_in_contig"), F.sum(good.cast("long")).alias("n_quality"),
        F.sum(((F.coalesce("called", F.lit(0)) == wanted) & (F.coalesce("high", F.lit(0)) == high)).cast("long")).alias("n_called"), F.bool_and("order").alias("sorted"),
    )


@query("select unnest(['>' || c_name, c_mktsegment]) as line from customer")
def fasta_lines(spark, sf_dir):
    path = _path(spark, "contigs.fa")
    sinks.fasta(A.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seq")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select distinct cast(c_custkey as varchar) as read_id from customer where c_mktsegment = 'BUILDING'")
def read_id_file(spark, sf_dir):
    """A list of ids with comments, blank lines and repeats."""
    path = _path(spark, "ids.txt")
    ids = A.wanted_ids(spark, sf_dir).select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.col("read_id"), F.concat(F.lit(" "), "read_id"))).alias("value"))
    ids.write.text(path)
    return tables.read_ids(spark, path)


@query("select cast(c_custkey as varchar) as read_id, (c_custkey % 900 + 100)::bigint as sequence_length_template from customer")
def summary_file(spark, sf_dir):
    """A sequencing summary with comments and other columns."""
    path = _path(spark, "summary.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# made for a test\n# second comment\nrun\tsequence_length_template\tread_id\n")
        for r in A.summary(spark, sf_dir).orderBy("read_id").toLocalIterator():
            f.write(f"x\t{r['sequence_length_template']}\t{r['read_id']}\n")
    return tables.sequencing_summary(spark, path)


# Options and values.


@query(f"with {A.ALIGNMENTS.strip()} select rec_no, read_id from alignments where flag <> 4 and contig = 'contig1' and pos < 12000 and pos + align_len > 6000 and align_len > 0")
def filter_region_text(spark, sf_dir):
    """A region with an open end, bound to its contig."""
    region = Region.parse("contig1:6000-").bind({"contig0": 9_000, "contig1": 12_000})
    rows = A.flat_alignments(spark, sf_dir)
    return rows.where(record_filters.predicate(ReadFilter(include_zero_len=True, region=region), F.col("seq_len"), F.coalesce("align_len", F.lit(0)))).select("rec_no", "read_id")


@query("select distinct event_id % 4096 as flag, case event_id % 4096 when 0 then 'primary_forward' when 4 then 'unmapped' when 16 then 'primary_reverse' when 256 then 'secondary_forward' when 272 then 'secondary_reverse' when 2048 then 'supplementary_forward' when 2064 then 'supplementary_reverse' end as read_state from events")
def flag_states(spark, sf_dir):
    """Every flag of twelve bits: those of pairs, copies and failed reads, and impossible ones, have no state."""
    rows = A.table(spark, sf_dir, "events").select((F.col("event_id") % 4096).alias("flag")).distinct()
    return rows.select("flag", states.state_or_null(F.col("flag")).alias("read_state"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', cast(instr('0123456789abcdef', substr(h, 17, 1)) - 1 as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"with d as (select event_id, md5(event_id::varchar) as h from events) select event_id, {_UUID} as made, regexp_full_match(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') as known, true as good from d")
def uuids(spark, sf_dir):
    """UUIDs made from bytes, and texts of which few are ones of version 4."""
    rows = A.table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"))
    plain = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    made = values.uuid_of(F.col("h"))
    return rows.select("event_id", made.alias("made"), values.is_uuid(F.upper(plain)).alias("known"), values.is_uuid(made).alias("good"))
