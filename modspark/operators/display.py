"""Sequences and qualities of reads, whole or over an interval of the reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from modspark.functions.sequence import query_over_reference
from modspark.model import MISSING
from modspark.operators.decode import flat_calls
from modspark.options import SeqDisplay
from modspark.session import ship


def qualities(qual: str | None, n: int) -> np.ndarray:
    return np.full(n, MISSING) if qual is None else np.frombuffer(qual.encode(), np.uint8).astype(np.int64) - 33


def over_region(flag: int, contig: str | None, pos: int, cigar: str | None, ref_end: int | None, region: tuple[str, int, int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Query positions over a region (-1 for deletions) and whether they are aligned; None without overlap."""
    name, start, end = region
    if flag & 4 or contig != name or not cigar or start >= ref_end or end <= pos:
        return None
    return query_over_reference(cigar, pos, max(start, pos), min(end, ref_end))


def shown_sequence(flag, contig, pos, cigar, ref_end, seq: str, qual: str | None, modified: np.ndarray, display: SeqDisplay) -> tuple[str, str]:
    """The sequence and the qualities, joined by dots, that a read table shows."""
    if display.full:
        return seq or "*", ".".join(map(str, qualities(qual, len(seq)))) or str(MISSING)
    found = over_region(flag, contig, pos, cigar, ref_end, display.region)
    if found is None or not len(found[0]) or not seq:
        return "*", str(MISSING)
    query, aligned = found
    bases, mask, q = np.frombuffer(seq.encode(), np.uint8), np.zeros(len(seq), bool), qualities(qual, len(seq))
    mask[modified] = True
    out = np.where(query >= 0, bases[query], ord("."))
    if display.show_mod_z:
        out = np.where((query >= 0) & mask[query], ord("Z"), out)
    if display.show_ins_lowercase:
        inserted = (query >= 0) & ~aligned & (out >= ord("A")) & (out <= ord("Z"))
        out = np.where(inserted, out + 32, out)
    return out.astype(np.uint8).tobytes().decode(), ".".join(map(str, np.where(query >= 0, q[query], MISSING)))


#: What a sequence is shown from.
SHOWN = ("flag", "contig", "pos", "cigar", "ref_end", "seq", "qual")


def _shower(names: list[str], display: SeqDisplay):
    need = [names.index(x) for x in SHOWN]
    tracks = names.index("tracks") if "tracks" in names and display.show_mod_z else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tracks is None:
                places, edges = np.zeros(0, np.int64), np.zeros(batch.num_rows + 1, np.int64)
            else:
                owner, _, pos, qual = flat_calls(batch.column(tracks))
                places = pos[qual > 0]
                edges = np.searchsorted(owner[qual > 0], np.arange(batch.num_rows + 1))
            shown = []
            for i, (*fields, seq, qual) in enumerate(zip(*(batch.column(k).to_pylist() for k in need))):
                shown.append(shown_sequence(*fields, seq or "", qual, places[edges[i] : edges[i + 1]], display))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array([s[k] for s in shown], pa.string()) for k in (0, 1))], [*names, "shown_seq", "shown_qual"])

    return run


def with_sequence(reads: DataFrame, display: SeqDisplay) -> DataFrame:
    """Adds shown_seq and shown_qual to reads with alignment columns, and tracks if modified bases are marked."""
    ship(reads.sparkSession)
    rows = reads.drop("shown_seq", "shown_qual")
    schema = T.StructType([*rows.schema.fields, T.StructField("shown_seq", T.StringType()), T.StructField("shown_qual", T.StringType())])
    return rows.mapInArrow(_shower(rows.columns, display), schema)
