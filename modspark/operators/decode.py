"""Modification tags to calls: one pass over alignments, no shuffle.

The tag grammar is a loop over sequence positions that no built-in operator expresses, so it
runs as a numpy kernel on Arrow batches; what comes out are nested columns, and all that
follows is native again. Filters on records belong before it, filters on calls are its
arguments, because what counts as a call depends on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.errors import DuplicateMods, InvalidBase, InvalidModCoords, InvalidModProbs, InvalidModType, InvalidTag, ModsparkError, shown
from modspark.functions.sequence import reference_positions, reverse_complement_text
from modspark.functions.values import code_point, mod_code
from modspark.model import MISSING, TRACK
from modspark.options import ModFilter
from modspark.session import ship

#: A code is followed by its mode, by the first comma, or by nothing.
_GROUP = re.compile(r"([ACGTUN])([+-])([A-Za-z]|[0-9]+)(?:([.?])|(?=,)|\Z)(.*)", re.DOTALL)
_NUMBER = re.compile(r"\+?[0-9]{1,18}")


@dataclass(frozen=True)
class Group:
    """One group of an MM tag: skipped counts numbers of unmodified candidates before each call."""

    base: str
    strand: str
    code: str
    explicit: bool
    skipped: np.ndarray


def parse_mm(text: str) -> list[Group]:
    """Groups of an MM tag, each ended by a semicolon; an empty text has none.

    Numbers may have white space around them, and entries between commas may be empty.
    """
    if not text:
        return []
    if not text.endswith(";"):
        raise InvalidModType(f"a group without an end: {shown(text)}")
    found = []
    for part in text[:-1].split(";"):
        m = _GROUP.fullmatch(part)
        if m is None:
            raise (InvalidBase if part and part[0] not in "ACGTUN" else InvalidModType)(f"not a group: {shown(part)}")
        base, strand, code, mode, numbers = m.groups()
        try:
            code = mod_code(code)
        except ModsparkError as e:
            raise InvalidModType(str(e)) from e
        entries = [x for x in map(str.strip, numbers.split(",")) if x]
        if not all(map(_NUMBER.fullmatch, entries)):
            raise InvalidModCoords(f"not a list of numbers: {shown(part)}")
        found.append(Group(base, strand, code, mode == "?", np.array(entries, np.int64)))
    return found


@dataclass
class Track:
    """The calls of one group that stay: positions in the record's orientation, ascending."""

    base: str
    strand: str
    code: str
    pos: np.ndarray
    ref: np.ndarray  # -1 where there is none
    qual: np.ndarray

    @property
    def order(self) -> tuple:
        return ord(self.base), self.strand == "-", code_point(self.code)

    def take(self, which) -> Track:
        return Track(self.base, self.strand, self.code, self.pos[which], self.ref[which], self.qual[which])


def trim_to_region(track: Track, low: int, high: int) -> Track:
    """From the first to the last call inside [low, high); calls without a reference position between them stay."""
    known = track.ref[track.ref >= 0]
    if (np.diff(known) <= 0).any():
        raise InvalidTag("reference positions of calls don't increase")
    inside = np.flatnonzero((track.ref >= low) & (track.ref < high))
    return track.take(slice(inside[0], inside[-1] + 1) if len(inside) else slice(0, 0))


def decode_record(
    flag: int,
    contig: str | None,
    pos: int,
    cigar: str | None,
    seq: str,
    qual: str | None,
    mm: str | None,
    ml: np.ndarray | list[int] | None,
    mods: ModFilter,
    wanted: Callable[[str, str, str], bool] | None = None,
    position: Callable[[np.ndarray], np.ndarray] | None = None,
) -> list[Track]:
    """The tracks of one record.

    wanted: a further condition on (base, strand, code); position: one on positions in the
    orientation of sequencing, as an array to booleans.
    """
    n, reverse = len(seq), bool(flag & 16)
    if qual is not None and len(qual) != n:
        raise InvalidTag("as many qualities as bases are needed")
    groups = parse_mm(mm or "")
    given, used = np.asarray([] if ml is None else ml, np.int64), 0
    if not groups and not len(given):
        return []
    forward = np.frombuffer((reverse_complement_text(seq) if reverse else seq).upper().encode(), np.uint8)
    good = np.ones(n, bool)
    if mods.base_qual:
        q = np.full(n, MISSING) if qual is None else np.frombuffer(qual.encode(), np.uint8).astype(np.int64) - 33
        q = q[::-1] if reverse else q
        good &= (q >= mods.base_qual) & (q != MISSING)
    if mods.trim_read_ends:
        good[: mods.trim_read_ends] = False
        good[max(0, n - mods.trim_read_ends) :] = False
    if position is not None:
        good &= position(np.arange(n))
    refs, tracks = None, []
    for g in groups:
        candidates = np.arange(n) if g.base == "N" else np.flatnonzero(forward == ord(g.base))
        ranks = np.cumsum(g.skipped) + np.arange(len(g.skipped))
        if len(ranks) and ranks[-1] >= len(candidates):
            raise InvalidModCoords(f"more calls than bases {g.base}")
        if used + len(ranks) > len(given):
            raise InvalidModProbs("fewer probabilities than calls")
        q, used = given[used : used + len(ranks)], used + len(ranks)
        at = candidates[ranks]
        keep = mods.threshold.keeps(q)
        if not g.explicit and mods.threshold.keeps(0):
            stays, every = np.ones(len(candidates), bool), np.zeros(len(candidates), np.int64)
            stays[ranks], every[ranks] = keep, q
            at, q = candidates[stays], every[stays]
        else:
            at, q = at[keep], q[keep]
        at, q = at[good[at]], q[good[at]]
        if (mods.tag is not None and g.code != mods.tag) or (mods.mod_strand is not None and g.strand != mods.mod_strand) or (wanted is not None and not wanted(g.base, g.strand, g.code)):
            continue  # only now: its probabilities had to be passed over
        if reverse:
            at, q = n - 1 - at[::-1], q[::-1]
        if refs is None:
            refs = np.full(n, -1, np.int64) if flag & 4 or not cigar else reference_positions(cigar, pos, n)
        tracks.append(Track(g.base, g.strand, g.code, at, refs[at], q))
    if used != len(given):
        raise InvalidModProbs("more probabilities than calls")
    if len({(t.strand, t.code) for t in tracks}) < len(tracks):
        raise DuplicateMods("a modification is given twice for a strand")
    tracks.sort(key=lambda t: t.order)
    return tracks


def limit_to_region(tracks: list[Track], region: tuple[str, int, int] | None, mapped: bool, contig: str | None, pos: int, ref_end: int | None) -> list[Track]:
    """Calls over a region of the reference; all of them if it covers the alignment, none if they don't meet."""
    if region is None:
        return tracks
    name, start, end = region
    if not mapped or contig != name or start >= ref_end or end <= pos:
        return [t.take(slice(0, 0)) for t in tracks]
    if start <= pos and end >= ref_end:
        return tracks
    return [trim_to_region(t, max(start, pos), min(end, ref_end)) for t in tracks]


def offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))).astype(np.int32))


def tracks_array(rows: list[list[Track] | None]) -> pa.Array:
    """Rows of tracks as nested Arrow arrays, built from flat columns."""
    flat = [t for r in rows for t in r or ()]
    none = np.zeros(0, np.int64)
    pos, ref, qual = (np.concatenate([none, *(getattr(t, k) for t in flat)]) for k in ("pos", "ref", "qual"))
    call = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(ref, pa.int32(), mask=ref < 0), pa.array(qual, pa.int16())], ["pos", "ref_pos", "qual"])
    calls = pa.ListArray.from_arrays(offsets([len(t.pos) for t in flat]), call)
    names = [pa.array([getattr(t, k) for t in flat], pa.string()) for k in ("base", "strand", "code")]
    points = pa.array([code_point(t.code) for t in flat], pa.int32())
    track = pa.StructArray.from_arrays([*names, points, calls], ["base", "strand", "mod_code", "mod_cp", "calls"])
    missing = np.array([r is None for r in rows], bool)
    return pa.ListArray.from_arrays(offsets([len(r or ()) for r in rows]), track, mask=pa.array(missing) if missing.any() else None)


def decode_batch(batch: pa.RecordBatch, need: list[int], ml: int, mods: ModFilter, strict: bool, wanted, position) -> tuple[list[list[Track] | None], list[str | None]]:
    """The tracks of a batch's records, and what is wrong with those that have none for that."""
    rows, errors = [], []
    chances = batch.column(ml)
    if chances.null_count:
        chances = chances.fill_null(pa.scalar([], chances.type))
    edges, flat = np.asarray(chances.offsets), np.asarray(chances.values)
    for i, (flag, contig, pos, cigar, seq, qual, mm, ref_end) in enumerate(zip(*(batch.column(k).to_pylist() for k in need))):
        try:
            found = decode_record(flag, contig, pos, cigar, seq or "", qual, mm, flat[edges[i] : edges[i + 1]], mods, wanted, position) if seq else []
            rows.append(limit_to_region(found, mods.region, not flag & 4, contig, pos, ref_end))
            errors.append(None)
        except ModsparkError as e:
            if strict:
                raise
            rows.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return rows, errors


NEEDED = ("flag", "contig", "pos", "cigar", "seq", "qual", "mm", "ref_end")


def _decoder(names: list[str], keep: list[int], mods: ModFilter, strict: bool, wanted, position):
    need = [names.index(x) for x in NEEDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = decode_batch(batch, need, names.index("ml"), mods, strict, wanted, position)
            more = [tracks_array(rows)] + ([] if strict else [pa.array(errors, pa.string())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more], [*(names[k] for k in keep), "tracks"] + ([] if strict else ["error"]))

    return run


def kept(rows: DataFrame, keep: tuple[str, ...] | None, inputs: tuple[str, ...]) -> tuple[DataFrame, list[int]]:
    """rows with the columns that a kernel takes in, and which of them it gives out again: all, or those named."""
    if keep is None:
        return rows, list(range(len(rows.columns)))
    rows = rows.select([c for c in rows.columns if c in keep or c in inputs])
    return rows, [k for k, c in enumerate(rows.columns) if c in keep]


def decode(reads: DataFrame, mods: ModFilter | None = None, mode: str = "strict", wanted=None, position=None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds tracks to reads (alignments that with_alignment() has completed).

    A read without tags has no tracks; a track all of whose calls are filtered away stays, with
    none. mode "strict" stops at the first bad record; "permissive" gives it null tracks and a
    text in the column error. Reads without sequence have no tracks. keep: the columns of reads
    that are still wanted; what goes through a kernel can't be pruned later.
    """
    ship(reads.sparkSession)
    rows, out = kept(reads.drop("tracks", "error"), keep, (*NEEDED, "ml"))
    fields = [*(rows.schema.fields[k] for k in out), T.StructField("tracks", T._parse_datatype_string(f"array<{TRACK}>"))]
    if mode != "strict":
        fields.append(T.StructField("error", T.StringType()))
    return rows.mapInArrow(_decoder(rows.columns, out, mods or ModFilter(), mode == "strict", wanted, position), T.StructType(fields))


def flat_calls(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of tracks as flat arrays: of each call its row, its track, its position and its probability."""
    if lists.null_count:
        lists = lists.fill_null(pa.scalar([], lists.type))
    inner = lists.flatten().field("calls")
    calls = inner.flatten()
    sizes = np.diff(np.asarray(inner.offsets))
    track = np.repeat(np.arange(len(inner)), sizes)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))[track]
    return row, track, np.asarray(calls.field("pos")).astype(np.int64), np.asarray(calls.field("qual")).astype(np.int64)


def calls(reads: DataFrame) -> DataFrame:
    """One row for each call: rec_no, read_id, track_no, base, strand of the call, code, idx, pos, ref_pos, qual."""
    tracks = reads.select("rec_no", "read_id", F.posexplode("tracks").alias("track_no", "t"))
    each = tracks.select("rec_no", "read_id", "track_no", F.col("t.base").alias("base"), F.col("t.strand").alias("mod_strand"), F.col("t.mod_code").alias("mod_code"), F.col("t.mod_cp").alias("mod_cp"), F.posexplode("t.calls").alias("idx", "c"))
    return each.select("*", "c.pos", "c.ref_pos", "c.qual").drop("c")


def counts_per_code(tracks: str) -> Column:
    """Array of (mod_cp, mod_code, n) of a read, by code point: calls of a code over all bases and strands."""
    return F.expr(f"""transform(array_sort(array_distinct(transform({tracks}, t -> named_struct('mod_cp', t.mod_cp, 'mod_code', t.mod_code)))),
        c -> named_struct('mod_cp', c.mod_cp, 'mod_code', c.mod_code, 'n',
            aggregate(filter({tracks}, t -> t.mod_code = c.mod_code), 0L, (s, t) -> s + size(t.calls))))""")
