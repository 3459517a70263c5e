"""Schemas of alignments, reads, tracks and calls, and the seven read states."""

from __future__ import annotations

#: Alignments as sources give them; rec_no orders them as in the file, pos counts from 0.
ALIGNMENTS = (
    "rec_no long, read_id string, flag int, tid int, contig string, pos int, mapq short, cigar string, seq string, qual string, mm string, ml array<short>"
)
CONTIGS = "tid int, contig string, length long"
ALIGNMENT_COLUMNS = [x.split(" ")[0] for x in ALIGNMENTS.split(", ")]
CALL = "struct<pos: int, ref_pos: int, qual: short>"
TRACK = f"struct<base: string, strand: string, mod_code: string, mod_cp: int, calls: array<{CALL}>>"
WINDOW = "struct<win_start: int, win_end: int, win_val: float, basecall_qual: short, ref_win_start: int, ref_win_end: int>"
WINDOW_TRACK = f"struct<base: string, strand: string, mod_code: string, mod_cp: int, windows: array<{WINDOW}>>"
#: What decoding adds to an alignment; columns are null where a read has no such thing.
READS = "read_state string, strand string, seq_len int, ref_end int, align_len int"

#: Flags that alignments may have, and what they are called (fixed values).
STATES = {
    0: "primary_forward",
    4: "unmapped",
    16: "primary_reverse",
    256: "secondary_forward",
    272: "secondary_reverse",
    2048: "supplementary_forward",
    2064: "supplementary_reverse",
}
FLAGS = {name: flag for flag, name in STATES.items()}
#: Flag bits that make a state; all others are for paired or failed reads, which aren't handled.
STATE_BITS = 0x4 | 0x10 | 0x100 | 0x800
MISSING = 255


def strand_of(state: str) -> str:
    return "." if state == "unmapped" else "-" if state.endswith("reverse") else "+"
