"""Sequences: letters, complements and CIGAR arithmetic."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC bases and their complements (fixed values).
BASES = "AGCTYRWSKMDVHBN"
COMPLEMENTS = "TCGARYWSMKHBDVN"
_FROM, _TO = BASES + BASES.lower(), COMPLEMENTS + COMPLEMENTS.lower()
_TABLE = str.maketrans(_FROM, _TO)
#: Longest sequence that is turned round.
LONGEST = 3 << 30
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def complement(seq: Column) -> Column:
    """Case stays, and so do letters that are no base."""
    return F.translate(seq, _FROM, _TO)


def reverse_complement(seq: Column) -> Column:
    return F.when(F.length(seq) > LONGEST, F.lit("")).otherwise(F.reverse(complement(seq)))


def reverse_complement_text(seq: str) -> str:
    return "" if len(seq) > LONGEST else seq.translate(_TABLE)[::-1]


def upper_bases(seq: Column) -> Column:
    """Upper case for a, c, g, t and n alone."""
    return F.translate(seq, "acgtn", "ACGTN")


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR covers."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda total, n: total + n.cast("int")), F.lit(0))


def query_length(cigar: Column) -> Column:
    """Bases of the read that a CIGAR covers, soft clips included."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIS=X]"), F.lit(1))
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda total, n: total + n.cast("int")), F.lit(0))


def cigar_runs(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _CIGAR.findall(cigar)]


def reference_positions(cigar: str, start: int, length: int) -> np.ndarray:
    """The reference position of each base of a read, -1 for insertions and clips."""
    out = np.full(length, -1, np.int64)
    query, ref = 0, start
    for n, op in cigar_runs(cigar):
        if op in "M=X":
            out[query : query + n] = np.arange(ref, ref + n)[: max(0, length - query)]
        if op in "MIS=X":
            query += n
        if op in "MDN=X":
            ref += n
    return out


def aligned_pairs(cigar: str, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and reference position along an alignment, -1 where there is none."""
    query, ref, q, r = [], [], 0, start
    for n, op in cigar_runs(cigar):
        on_query, on_ref = op in "MIS=X", op in "MDN=X"
        if on_query or on_ref:
            query.append(np.arange(q, q + n) if on_query else np.full(n, -1))
            ref.append(np.arange(r, r + n) if on_ref else np.full(n, -1))
        q, r = q + n * on_query, r + n * on_ref
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *query]), np.concatenate([none, *ref])


def query_over_reference(cigar: str, start: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Query positions over [low, high) of the reference, and which of them are aligned.

    Begins at the first base of the reference inside and ends before the first one outside.
    Insertions between are kept, deletions are -1, insertions and clips at the end are cut.
    None if there is no overlap.
    """
    query, ref = aligned_pairs(cigar, start)
    on_ref = ref >= 0
    inside = on_ref & (ref >= low) & (ref < high)
    if not inside.any():
        return None
    first = int(inside.argmax())
    out = np.flatnonzero(on_ref[first:] & ~inside[first:])
    last = first + int(out[0]) if len(out) else len(ref)
    last = first + int(np.flatnonzero(on_ref[first:last])[-1]) + 1
    return query[first:last], on_ref[first:last]
