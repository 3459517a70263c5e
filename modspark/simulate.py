"""Simulated alignments with modification tags, for tests and benchmarks.

Every read is made from a generator seeded by (seed, group, number of the read), so the same
configuration gives the same reads, however the work is divided.
"""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modspark.errors import InvalidOption, TooLarge, shown
from modspark.functions.sequence import reverse_complement_text
from modspark.functions.values import mod_code, to_u8
from modspark.model import ALIGNMENT_COLUMNS, ALIGNMENTS, CONTIGS, STATES
from modspark.options import fraction
from modspark.session import materialise, ship


#: Bases of all contigs, which every worker holds.
MOST_BASES = 1 << 28


def _bases(text: str | None) -> str | None:
    """A sequence in upper case of A, C, G and T, or nothing."""
    if not text:
        return None
    if set(text.upper()) - set("ACGT"):
        raise InvalidOption(f"not bases: {shown(text)}")
    return text.upper()


def _pair(x, check=lambda v: v) -> tuple:
    low, high = (check(v) for v in x)
    if low > high:
        raise InvalidOption(f"the first number is the larger one: {x}")
    return low, high


def _positive(n: int) -> int:
    if int(n) < 1:
        raise InvalidOption(f"1 or more is needed: {n}")
    return int(n)


@dataclass(frozen=True)
class ModConfig:
    base: str = "C"
    is_strand_plus: bool = True
    mod_code: str = "m"
    win: tuple[int, ...] = (1,)
    mod_range: tuple[tuple[float, float], ...] = ((0.0, 1.0),)

    def __post_init__(self) -> None:
        if self.base not in ("A", "C", "G", "T", "N"):
            raise InvalidOption(f"not a base: {shown(self.base)}")
        object.__setattr__(self, "mod_code", mod_code(self.mod_code))
        object.__setattr__(self, "win", tuple(_positive(w) for w in self.win))
        object.__setattr__(self, "mod_range", tuple(_pair(r, fraction) for r in self.mod_range))


@dataclass(frozen=True)
class ReadConfig:
    number: int = 1
    mapq_range: tuple[int, int] = (0, 0)
    base_qual_range: tuple[int, int] = (0, 0)
    len_range: tuple[float, float] = (0.0, 0.0)
    barcode: str | None = None
    delete: tuple[float, float] | None = None
    insert_middle: str | None = None
    mismatch: float | None = None
    mods: tuple[ModConfig, ...] = ()

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "number", _positive(self.number))
        for name in ("mapq_range", "base_qual_range"):
            put(self, name, _pair(getattr(self, name), int))
        put(self, "len_range", _pair(self.len_range, fraction))
        put(self, "delete", None if self.delete is None else _pair(self.delete, fraction))
        put(self, "barcode", _bases(self.barcode))
        put(self, "insert_middle", _bases(self.insert_middle))
        put(self, "mismatch", None if self.mismatch is None else fraction(self.mismatch))
        put(self, "mods", tuple(m if isinstance(m, ModConfig) else ModConfig(**m) for m in self.mods))


@dataclass(frozen=True)
class ContigConfig:
    number: int = 1
    len_range: tuple[int, int] = (1, 1)
    repeated_seq: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "number", _positive(self.number))
        object.__setattr__(self, "len_range", _pair(self.len_range, _positive))
        object.__setattr__(self, "repeated_seq", _bases(self.repeated_seq))


@dataclass(frozen=True)
class SimulationConfig:
    contigs: ContigConfig = field(default_factory=ContigConfig)
    reads: tuple[ReadConfig, ...] = ()
    seed: int | None = None

    @classmethod
    def parse(cls, text: str) -> SimulationConfig:
        held = json.loads(text)
        try:
            return cls(ContigConfig(**held.get("contigs", {})), tuple(ReadConfig(**r) for r in held.get("reads", [])), held.get("seed"))
        except TypeError as e:
            raise InvalidOption(str(e)) from e


def contig_sequences(config: ContigConfig, seed: int) -> list[tuple[str, str]]:
    """Names and sequences, random or repeated to a random length."""
    out = []
    for k in range(config.number):
        draw = np.random.default_rng((seed, 0, k))
        n = int(draw.integers(config.len_range[0], config.len_range[1] + 1))
        unit = config.repeated_seq
        seq = (unit * (n // len(unit) + 1))[:n] if unit else "".join(np.array(list("ACGT"))[draw.integers(0, 4, n)])
        out.append((f"contig_{k:05d}", seq))
    return out


def with_barcode(seq: str, barcode: str, reverse: bool) -> tuple[str, str]:
    """What stands before and behind a read: of a reversed one, the record shows the other strand."""
    turned = reverse_complement_text(barcode)
    return (turned[::-1], barcode[::-1]) if reverse else (barcode, turned)


def edited(seq: str, config: ReadConfig, reverse: bool, draw: np.random.Generator) -> tuple[str, str]:
    """A piece of a contig with mismatches, a deletion, an insertion and barcodes, and its CIGAR."""
    n = len(seq)
    bases, half = np.array(list(seq)), lambda x: int(np.floor(x + 0.5))
    if config.mismatch:
        at = draw.choice(n, min(n, half(n * config.mismatch)), replace=False)
        shift = draw.integers(1, 4, len(at))
        letters = np.array(list("ACGT"))
        known = np.isin(bases[at], letters)
        bases[at[known]] = letters[(np.searchsorted(letters, bases[at[known]]) + shift[known]) % 4]
    ops = np.full(n, "M")
    if config.delete:
        ops[half(n * config.delete[0]) : min(n, half(n * config.delete[1]))] = "D"
    if config.insert_middle:
        new, middle = list(config.insert_middle), n // 2
        bases = np.concatenate((bases[:middle], new, bases[middle:]))
        ops = np.concatenate((ops[:middle], ["I"] * len(new), ops[middle:]))
    if config.barcode:
        before, behind = with_barcode(seq, config.barcode, reverse)
        bases = np.concatenate((list(before), bases, list(behind)))
        ops = np.concatenate((["S"] * len(before), ops, ["S"] * len(behind)))
    cuts = np.flatnonzero(np.concatenate(([True], ops[1:] != ops[:-1]))) if len(ops) else np.zeros(0, int)
    runs = [(int(n), ops[c]) for n, c in zip(np.diff([*cuts, len(ops)]), cuts)]
    inner = [op for _, op in runs if op != "S"]
    if not inner or inner[0] != "M" or inner[-1] != "M":
        raise InvalidOption("too few bases, or an insertion or deletion at an end")
    return "".join(bases[ops != "D"]), "".join(f"{n}{op}" for n, op in runs)


def modification_tags(mods: tuple[ModConfig, ...], seq: str, draw: np.random.Generator) -> tuple[str, list[int]]:
    """MM and ML for a sequence as read: every candidate base is called, windows and ranges in turn."""
    mm, ml = "", []
    for m in mods:
        count = len(seq) if m.base == "N" else seq.count(m.base)
        if not count:
            continue
        low, high, k = [], [], 0
        while len(low) < count:
            a, b = m.mod_range[k % len(m.mod_range)]
            n = m.win[k % len(m.win)]
            low += [to_u8(a)] * n
            high += [to_u8(b)] * n
            k += 1
        ml += draw.integers(np.array(low[:count]), np.array(high[:count]) + 1).tolist()
        mm += f"{m.base}{'+' if m.is_strand_plus else '-'}{m.mod_code}?{',0' * count};"
    return mm, ml


def one_read(config: ReadConfig, group: int, number: int, contigs: list[tuple[str, str]], seed: int) -> dict:
    draw = np.random.default_rng((seed, 1 + group, number))
    tid = int(draw.integers(len(contigs)))
    whole = contigs[tid][1]
    low, high = config.len_range
    n = min(len(whole), int((low + (high - low) * draw.random()) * len(whole)))
    start = int(draw.integers(0, len(whole) - n + 1))
    flag = int(draw.choice(list(STATES)))
    seq, cigar = edited(whole[start : start + n], config, bool(flag & 16), draw)
    qual = draw.integers(config.base_qual_range[0], config.base_qual_range[1] + 1, len(seq))
    mm, ml = modification_tags(config.mods, reverse_complement_text(seq) if flag & 16 else seq, draw)
    name = f"{group}.{uuid.UUID(bytes=draw.bytes(16), version=4)}"
    mapq = int(draw.integers(config.mapq_range[0], config.mapq_range[1] + 1))
    mapped = flag != 4
    return {
        "rec_no": number, "read_id": name, "flag": flag, "tid": tid if mapped else None, "contig": contigs[tid][0] if mapped else None, "pos": start if mapped else -1,
        "mapq": mapq if mapped else 255, "cigar": cigar if mapped else None, "seq": seq,
        "qual": None if len(qual) and qual[0] == 255 else (np.minimum(qual, 93) + 33).astype(np.uint8).tobytes().decode(), "mm": mm or None, "ml": ml if mm else None,
    }


def _maker(config: ReadConfig, group: int, contigs: list[tuple[str, str]], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"rec_no": pa.int64(), "flag": pa.int32(), "tid": pa.int32(), "pos": pa.int32(), "mapq": pa.int16(), "ml": pa.list_(pa.int16())}
        for batch in batches:
            rows = [one_read(config, group, n, contigs, seed) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in ALIGNMENT_COLUMNS], ALIGNMENT_COLUMNS)

    return run


def simulate(spark: SparkSession, config: SimulationConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alignments, contigs, and sequences (name, seq) of the contigs.

    Alignments are sorted by (unmapped, contig, place, strand), and rec_no counts in that order:
    inside the ranges that the sort makes, and on from the ranges before. They are a table in the shared folder.
    Without a seed each call gives other reads; with one always the same.
    """
    ship(spark)
    if config.contigs.number * config.contigs.len_range[1] > MOST_BASES:
        raise TooLarge(f"contigs of more than {MOST_BASES} bases")
    seed = int(np.random.SeedSequence().entropy % (1 << 63)) if config.seed is None else config.seed
    sequences = contig_sequences(config.contigs, seed)
    parts = [spark.range(r.number).mapInArrow(_maker(r, g, sequences, seed), ALIGNMENTS) for g, r in enumerate(config.reads)]
    rows = parts[0] if parts else spark.createDataFrame([], ALIGNMENTS)
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = (F.col("flag") == 4, "tid", "pos", F.col("flag").bitwiseAND(16) != 0, "read_id")
    placed = materialise(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))  # a row for each range
    rows = placed.withColumn("__part", part).join(starts, "__part").withColumn("rec_no", F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1))
    contigs = spark.createDataFrame([(k, n, len(s)) for k, (n, s) in enumerate(sequences)], CONTIGS)
    return rows.select(*ALIGNMENT_COLUMNS), contigs, spark.createDataFrame(sequences, "name string, seq string")


def run(spark: SparkSession, config: SimulationConfig, bam: str, fasta: str) -> None:
    """A BAM file with its index, and a FASTA folder of the contigs."""
    from modspark.sources import sinks

    rows, contigs, sequences = simulate(spark, config)
    sinks.write_bam(rows, contigs, bam)
    sinks.fasta(sequences, fasta)


@contextmanager
def temporary(spark: SparkSession, config: SimulationConfig) -> Iterator[tuple[str, str]]:
    """run() into a folder that goes when the block ends."""
    folder = tempfile.mkdtemp(prefix="modspark-sim-")
    try:
        run(spark, config, f"{folder}/reads.bam", f"{folder}/contigs.fa")
        yield f"{folder}/reads.bam", f"{folder}/contigs.fa"
    finally:
        shutil.rmtree(folder, ignore_errors=True)
