"""BAM files as a Spark data source, split at BGZF blocks, with or without an index.

Records carry rec_no, their virtual offset in the file, so that order is known although splits
are read apart; with several files, their number comes first. Where an index (.bai) lies beside a
file, a condition on the contig, or an interval of it, restricts what is read to the index's chunks
that may overlap it, cut into splits again. Without one, and inside a chunk, a split begins at the
first place where several records in a row are plausible.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from modspark.errors import BadHeader, BadIndex, InvalidRecord, TooLarge
from modspark.model import ALIGNMENTS, CONTIGS
from modspark.sources import files

SPLIT = 32 << 20
#: Largest record that is read: what the format's own length field may say.
LARGEST = (1 << 31) - 1
#: Records of an Arrow batch, and bytes of them, about.
ROWS, BYTES = 1024, 4 << 20
#: Bytes between chunks that are read over rather than sought.
NEAR = 1 << 16
#: Bits of rec_no that a place in a file has when there are several.
PLACE = 56
_FIXED = struct.Struct("<iiBBHHHi")
_SEQ = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_PAIRS = [a + b for a in _SEQ for b in _SEQ]


class Blocks:
    """Uncompressed bytes of a BGZF file from a block on."""

    def __init__(self, file, start: int) -> None:
        self.file, self.next = file, start
        self.at: list[tuple[int, int]] = []  # (place in buffer, start of the block in the file)
        self.buffer, self.place = bytearray(), 0

    def more(self) -> bool:
        """Append one block; False at the end of the file."""
        self.file.seek(self.next)
        head = self.file.read(12)
        if len(head) < 12:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise InvalidRecord("not a BGZF block")
        extra = self.file.read(struct.unpack("<H", head[10:12])[0])
        whole = block_size(extra)
        body = self.file.read(whole - 12 - len(extra))
        self.at.append((len(self.buffer), self.next))
        self.buffer += zlib.decompress(body[:-8], -15)
        self.next += whole
        return True

    def take(self, n: int) -> bytes | None:
        while len(self.buffer) - self.place < n:
            if not self.more():
                return None
        out = bytes(self.buffer[self.place : self.place + n])
        self.place += n
        return out

    def offset(self) -> int:
        """The virtual offset of the next byte."""
        while self.place >= len(self.buffer) and self.more():
            pass
        for start, block in reversed(self.at):
            if start <= self.place and (start < len(self.buffer) or start == self.place):
                return block << 16 | (self.place - start)
        return self.next << 16

    def trim(self) -> None:
        """Forget what has been read."""
        if self.place > 1 << 20:
            keep = max((k for k, (start, _) in enumerate(self.at) if start <= self.place), default=0)
            cut = self.at[keep][0]
            del self.buffer[:cut]
            self.place -= cut
            self.at = [(start - cut, block) for start, block in self.at[keep:]]


def block_size(extra: bytes) -> int:
    k = 0
    while k + 4 <= len(extra):
        n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
        if extra[k : k + 2] == b"BC" and n == 2:
            return struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
        k += 4 + n
    raise InvalidRecord("a BGZF block without its size")


def first_block(file, start: int, end: int) -> int | None:
    """The first BGZF block that begins in [start, end): its header must lead to another block, or the end."""
    file.seek(start)
    held = file.read(end - start + (1 << 16))
    k = held.find(b"\x1f\x8b\x08\x04")
    while 0 <= k < end - start:
        try:
            n = block_size(held[k + 12 : k + 12 + struct.unpack("<H", held[k + 10 : k + 12])[0]])
            if k + n + 4 > len(held) or held[k + n : k + n + 4] == b"\x1f\x8b\x08\x04" or k + n == len(held):
                return start + k
        except (InvalidRecord, struct.error):
            pass
        k = held.find(b"\x1f\x8b\x08\x04", k + 1)
    return None


def header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of contigs, and the virtual offset of the first record."""
    with files.opened(path) as f:
        b = Blocks(f, 0)
        if b.take(4) != b"BAM\x01":
            raise BadHeader("not a BAM file")
        b.take(struct.unpack("<i", b.take(4))[0])
        found = []
        for _ in range(struct.unpack("<i", b.take(4))[0]):
            name = b.take(struct.unpack("<i", b.take(4))[0])[:-1].decode()
            found.append((name, struct.unpack("<i", b.take(4))[0]))
        return found, b.offset()


def plausible(buffer: bytes, place: int, contigs: int, last: bool = False, need: int = 4) -> bool | None:
    """Whether `need` records, or all up to the end of the file, begin here; None if the buffer ends before that is known.

    last: the buffer's end is that of the file.
    """
    for k in range(need):
        if k and last and place == len(buffer):
            return True
        if place + 36 > len(buffer):
            return None
        n, tid, pos, name, _, _, cigar, flag, bases, mate, _, _ = struct.unpack_from("<iiiBBHHHiiii", buffer, place)
        fixed = 32 + name + 4 * cigar + (bases + 1) // 2 + bases
        if not (32 < n < LARGEST and -1 <= tid < contigs and -1 <= pos and -1 <= mate < contigs and name > 0 and bases >= 0 and fixed <= n and flag < 1 << 12):
            return False
        text = buffer[place + 36 : place + 36 + name]
        if len(text) < name:
            return None
        if text[-1] or not all(32 < c < 127 for c in text[:-1]):
            return False
        place += 4 + n
    return True


def seek_record(b: Blocks, end: int, contigs: int) -> bool:
    """Go to the first record that begins in a block before `end`; False if none does.

    Blocks are read until that is known, as a record from before may cover any number of them.
    """
    place, limit, grown, cut = 0, 0, -1, None
    while True:
        if len(b.buffer) != grown:
            grown = len(b.buffer)
            limit = next((start for start, block in b.at if block >= end), grown)
        if place >= limit:
            if b.next >= end or not b.more():
                break
            continue
        found = plausible(b.buffer, place, contigs)
        while found is None and b.more():
            found = plausible(b.buffer, place, contigs)
        if found is None:
            found = plausible(b.buffer, place, contigs, last=True)
            if found is None and cut is None and place + 36 <= len(b.buffer):
                cut = place
        if found:
            b.place = place
            return True
        place += 1
    if cut is None or b.at[-1][0] == len(b.buffer):  # a whole file ends in an empty block
        return False
    b.place = cut
    return True


def _aux(raw: bytes) -> tuple[str | None, list[int] | None]:
    """The modification tags: text of MM or Mm, numbers of ML or Ml."""
    width = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    mm, ml, k = {}, {}, 0
    while k + 3 <= len(raw):
        tag, kind = raw[k : k + 2].decode("latin-1"), chr(raw[k + 2])
        k += 3
        if kind in "ZH":
            end = raw.index(0, k)
            if tag in ("MM", "Mm"):
                if kind != "Z":
                    raise InvalidRecord("an MM tag isn't of type Z")
                mm[tag] = raw[k:end].decode()
            k = end + 1
            continue
        if tag in ("MM", "Mm"):
            raise InvalidRecord("an MM tag isn't of type Z")
        if kind == "B":
            inner, n = chr(raw[k]), struct.unpack_from("<i", raw, k + 1)[0]
            if tag in ("ML", "Ml"):
                ml[tag] = list(raw[k + 5 : k + 5 + n]) if inner == "C" else []
            k += 5 + n * width[inner]
        else:
            if tag in ("ML", "Ml"):
                ml[tag] = []
            k += width[kind]
    if len(mm) > 1 or len(ml) > 1:
        raise InvalidRecord("a record has both spellings of a tag")
    return next(iter(mm.values()), None), next(iter(ml.values()), None)


def record(raw: bytes, offset: int, contigs: list[str]) -> tuple:
    """A row of the alignment schema from the bytes behind a record's length."""
    tid, pos, name, mapq, _, n_cigar, flag, n = struct.unpack_from("<iiBBHHHi", raw, 0)
    k = 32 + name
    runs = struct.unpack_from(f"<{n_cigar}I", raw, k)
    k += 4 * n_cigar
    seq = "".join(_PAIRS[b] for b in raw[k : k + (n + 1) // 2])[:n]
    k += (n + 1) // 2
    q = raw[k : k + n]
    qual = None if not n or q[0] == 255 else bytes(x + 33 for x in q).decode("latin-1")
    mm, ml = _aux(raw[k + n :])
    cigar = "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in runs) or None
    contig = contigs[tid] if tid >= 0 else None
    return offset, raw[32 : 31 + name].decode(), flag, tid if tid >= 0 else None, contig, pos, mapq, cigar, seq, qual, mm, ml


@dataclass
class Split(InputPartition):
    """Records that begin in blocks from start on, before end; exact: start is a virtual offset of a record."""

    start: int
    end: int
    exact: bool


def bins_over(start: int, end: int) -> set[int]:
    """The bins of the binning index that an interval's records may be in."""
    found = {0}
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        found.update(range(first + (start >> shift), first + (min(end, 1 << 29) - 1 >> shift) + 1))
    return found


def index_chunks(path: str, tid: int, start: int = 0, end: int = 1 << 29) -> list[tuple[int, int]]:
    """The index's chunks (virtual offsets) of an interval of a contig, merged where they are near each other."""
    with files.opened(path) as f:
        raw = f.read()
    if raw[:4] != b"BAI\x01":
        raise BadIndex("not an index")
    k, found, least = 8, [], 0
    over = bins_over(start, end) if end - start < 1 << 28 else None
    for ref in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = struct.unpack_from("<i", raw, k)[0]
        k += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, k)
            k += 8
            if ref == tid and number != 37450 and (over is None or number in over):
                found += [struct.unpack_from("<QQ", raw, k + 16 * c) for c in range(chunks)]
            k += 16 * chunks
        windows = struct.unpack_from("<i", raw, k)[0]
        if ref == tid and windows:
            at = start >> 14
            least = struct.unpack_from("<Q", raw, k + 4 + 8 * at)[0] if at < windows else 0
        k += 4 + 8 * windows
    merged: list[tuple[int, int]] = []
    for a, b in sorted((max(a, least), b) for a, b in found if b > least):
        if merged and a >> 16 <= (merged[-1][1] >> 16) + NEAR:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


@dataclass
class Split(InputPartition):
    """Records of a file from start on, before end.

    exact: start is a virtual offset of a record, or else of a block; ordered: they are sorted by place.
    """

    file: int
    start: int
    end: int
    exact: bool
    ordered: bool = False


class BamReader(DataSourceReader):
    def __init__(self, paths: str | list[str], split: int, interval: tuple[str, int, int | None] | None = None) -> None:
        paths = [paths] if isinstance(paths, str) else paths
        if len(paths) > 1 << 63 - PLACE:
            raise TooLarge("too many files")
        self.paths, self.split = paths, split
        self.interval, self.contig = interval, interval[0] if interval else None
        self.contigs, self.first = header(paths[0])
        self.firsts = [self.first] + [f for c, f in map(header, paths[1:]) if c == self.contigs]
        if len(self.firsts) < len(paths):
            raise BadHeader("files with other contigs")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                self.contig = f.value
            yield f  # Spark checks all of them again

    def bounds(self) -> tuple[int, int]:
        _, start, end = self.interval or (None, 0, None)
        return start, 1 << 31 if end is None else end

    def partitions(self) -> list[Split]:
        names = [c for c, _ in self.contigs]
        none = [Split(0, 0, 0, True)]
        if (self.contig is not None and self.contig not in names) or (self.interval and self.contig != self.interval[0]):
            return none
        found = []
        for k, path in enumerate(self.paths):
            if self.contig is not None and files.exists(f"{path}.bai"):
                for a, b in index_chunks(f"{path}.bai", names.index(self.contig), *self.bounds()):
                    found += self.cut(k, a, b, True)
            else:
                found += self.cut(k, self.firsts[k], files.size(path) << 16)
        return found or none

    def cut(self, file: int, start: int, end: int, ordered: bool = False) -> list[Split]:
        """Splits of a run of records, whose first place is a record's."""
        cuts = [start, *(x << 16 for x in range((start >> 16) + self.split, end >> 16, self.split)), end]
        return [Split(file, a, b, a == start, ordered) for a, b in zip(cuts, cuts[1:])]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.start >= split.end:
            return
        names, tid = [c for c, _ in self.contigs], None
        start, end = self.bounds()
        if self.interval:
            tid = names.index(self.interval[0])
        held, size, number = [], 0, split.file << PLACE
        with files.opened(self.paths[split.file]) as f:
            if split.exact:
                b = Blocks(f, split.start >> 16)
                b.more()
                b.place = split.start & 0xFFFF
            else:
                last = -(-split.end >> 16)  # past the last block that may hold one
                at = first_block(f, split.start >> 16, last)
                if at is None:
                    return
                b = Blocks(f, at)
                if not seek_record(b, last, len(names)):
                    return
            while True:
                at = b.offset()
                if at >= split.end:
                    break
                length = b.take(4)
                if length is None:
                    break
                raw = b.take(struct.unpack("<i", length)[0])
                if raw is None:
                    raise InvalidRecord("a record is cut off")
                b.trim()
                if tid is not None and not overlaps(raw, tid, start, end):
                    if split.ordered and _FIXED.unpack_from(raw, 0)[:2] >= (tid, end):
                        break
                    continue
                held.append(record(raw, number | at, names))
                size += len(raw)
                if len(held) >= ROWS or size >= BYTES:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)


def overlaps(raw: bytes, tid: int, start: int, end: int) -> bool:
    """Whether a record lies over an interval of a contig; one that covers nothing counts as a base long."""
    own, pos, name, _, _, runs, _, _ = _FIXED.unpack_from(raw, 0)
    if own != tid or pos >= end:
        return False
    span = sum(x >> 4 for x in struct.unpack_from(f"<{runs}I", raw, 32 + name) if x & 15 in (0, 2, 3, 7, 8))
    return pos + max(span, 1) > start


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "short": pa.int16(), "array<short>": pa.list_(pa.int16())}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in ALIGNMENTS.split(", "))])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


class ModBam(DataSource):
    """format("modbam"): option path, one or more by line; split for the bytes of a partition; contig, start and end for an interval."""

    @classmethod
    def name(cls) -> str:
        return "modbam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        o = self.options
        interval = (o["contig"], int(o.get("start", 0)), int(o["end"]) if "end" in o else None) if "contig" in o else None
        return BamReader(o["path"].split("\n"), int(o.get("split", SPLIT)), interval)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(k, n, m) for k, (n, m) in enumerate(header(path)[0])], CONTIGS)


def read_bam(spark: SparkSession, path: str | list[str], contig: str | None = None, split: int = SPLIT, start: int = 0, end: int | None = None) -> DataFrame:
    """Alignments of BAM files with the same contigs; contig, start, end: only those over that interval, by the index if there is one."""
    from modspark.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModBam)
    options = {"split": split} | ({} if contig is None else {"contig": contig, "start": start}) | ({} if end is None else {"end": end})
    rows = spark.read.format("modbam").options(**options).load(path if isinstance(path, str) else "\n".join(path))
    return rows if contig is None else rows.where(rows["contig"] == contig)
