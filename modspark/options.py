"""Options of all operators, with the checks that they need before any data is read."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

from modspark.errors import InvalidOption, InvalidRegion, shown
from modspark.functions.values import mod_code, to_u8
from modspark.model import FLAGS


def ordered_pair(text: str, kind=float) -> tuple:
    """`low,high` with low <= high."""
    parts = [p.strip() for p in str(text).split(",")]
    if len(parts) != 2:
        raise InvalidOption(f"two numbers are needed: {shown(text)}")
    try:
        low, high = map(kind, parts)
    except ValueError as e:
        raise InvalidOption(f"not numbers: {shown(text)}") from e
    if not low <= high:
        raise InvalidOption(f"the first number is the larger one: {shown(text)}")
    return low, high


def fraction(value: float, least: float = 0.0) -> float:
    """A number from `least` (0, or -1 for gradients) to 1."""
    value = float(value)
    if not least <= value <= 1:  # also not-a-number
        raise InvalidOption(f"not between {least:g} and 1: {value}")
    return value


@dataclass(frozen=True)
class Locator:
    """Where alignments come from: `-` for standard input, a URL, or a path."""

    kind: str  # "stdin", "url" or "path"
    value: str

    @classmethod
    def parse(cls, text: str) -> Locator:
        if not text:
            raise InvalidOption("an empty path")
        if text == "-":
            return cls("stdin", text)
        parts = urlsplit(text)
        if parts.scheme.lower() in ("http", "https", "ftp"):
            if not parts.netloc:
                raise InvalidOption(f"not a URL: {shown(text)}")
            return cls("url", text)
        return cls("path", text)


@dataclass(frozen=True)
class Region:
    """`contig`, `contig:start-` or `contig:start-end`: counted from 0, the end exclusive."""

    contig: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """The last colon splits, so names of contigs may hold colons."""
        name, colon, span = text.rpartition(":")
        if not colon:
            if not text:
                raise InvalidRegion("an empty region")
            return cls(text)
        start, dash, end = span.partition("-")
        if not name or not dash:
            raise InvalidRegion(f"not a region: {shown(text)}")
        try:
            low = int(start.strip())
            high = int(end.strip()) if end.strip() else None
        except ValueError as e:
            raise InvalidRegion(f"not an interval: {shown(text)}") from e
        if low < 0 or (high is not None and low >= high):
            raise InvalidRegion(f"start must be less than end: {shown(text)}")
        return cls(name, low, high)

    def bind(self, lengths: dict[str, int]) -> tuple[str, int, int]:
        """The interval on a contig of known length; an open end is the contig's."""
        if self.contig not in lengths:
            raise InvalidRegion(f"no contig {shown(self.contig)}")
        length = lengths[self.contig]
        start, end = self.start or 0, length if self.end is None else self.end
        if start >= length or end > length:
            raise InvalidRegion(f"{self} goes beyond the end of its contig, {length}")
        return self.contig, start, end

    def __str__(self) -> str:
        return self.contig if self.start is None else f"{self.contig}:{self.start}-{'' if self.end is None else self.end}"


def read_states(text: str) -> frozenset[int]:
    """Flags of a comma-separated list of read states."""
    names = [x.strip() for x in text.split(",")]
    if unknown := [x for x in names if x not in FLAGS]:
        raise InvalidOption(f"unknown read state: {shown(unknown[0])}")
    return frozenset(FLAGS[x] for x in names)


@dataclass(frozen=True)
class ReadFilter:
    """Conditions on alignments; all must hold.

    Length 0 is decided by include_zero_len alone. Mapping quality 255 (unavailable) passes any
    minimum, unless it is excluded. A region, once bound, is (contig, start, end).
    """

    min_seq_len: int = 0
    min_align_len: int | None = None
    read_id: str | None = None
    read_ids: frozenset[str] | None = None
    read_id_list: str | None = None
    include_zero_len: bool = False
    states: frozenset[int] | None = None
    sample_fraction: float = 1.0
    sample_seed: int | None = None
    mapq: int = 0
    exclude_mapq_unavail: bool = False
    region: Region | tuple[str, int, int] | None = None
    full_region: bool = False

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.read_id, self.read_ids, self.read_id_list)) > 1:
            raise InvalidOption("one of read_id, read_ids and read_id_list at most")
        if self.full_region and self.region is None:
            raise InvalidOption("full_region needs a region")
        fraction(self.sample_fraction)
        if not 0 <= self.mapq <= 255 or self.min_seq_len < 0 or (self.min_align_len or 0) < 0:
            raise InvalidOption("a minimum is out of range")

    def bound(self, lengths: dict[str, int]) -> ReadFilter:
        return replace(self, region=self.region.bind(lengths)) if isinstance(self.region, Region) else self


@dataclass(frozen=True)
class Threshold:
    """Which probabilities (0 to 255) stay: at least `least`, and not in low..high."""

    least: int = 0
    reject: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.least <= 255 or (self.reject and not 0 <= self.reject[0] <= self.reject[1] <= 255):
            raise InvalidOption("probabilities go from 0 to 255")

    @classmethod
    def parse(cls, text: str | None) -> Threshold:
        """`low,high` as fractions: what lies between, ends included, is rejected."""
        if text is None or not text.strip():
            return cls()
        low, high = ordered_pair(text)
        return cls(0, (to_u8(fraction(low)), to_u8(fraction(high))))

    def keeps(self, q):
        """For a number or a numpy array."""
        good = q >= self.least
        return good if self.reject is None else good & ((q < self.reject[0]) | (q > self.reject[1]))

    def promoted(self) -> Threshold:
        """Counts of modifications take those that are likelier than not."""
        return replace(self, least=max(self.least, 128))

    def __str__(self) -> str:
        above = f"probabilities >= {self.least / 255:.4f}"
        if self.reject is None:
            return above
        outside = f"probabilities < {self.reject[0] / 255:.4f} or > {self.reject[1] / 255:.4f}"
        return f"{above} and ({outside})" if self.least else outside


@dataclass(frozen=True)
class ModFilter:
    """Conditions on modification calls."""

    tag: str | None = None
    mod_strand: str | None = None  # "+" for the basecalled strand, "-" for its complement
    threshold: Threshold = field(default_factory=Threshold)
    trim_read_ends: int = 0
    base_qual: int = 0
    region: Region | tuple[str, int, int] | None = None

    def __post_init__(self) -> None:
        if self.tag is not None:
            object.__setattr__(self, "tag", mod_code(self.tag))
        known = {"bc": "+", "bc_comp": "-", "+": "+", "-": "-", None: None}
        if self.mod_strand not in known:
            raise InvalidOption(f"unknown strand: {shown(self.mod_strand)}")
        object.__setattr__(self, "mod_strand", known[self.mod_strand])
        if self.trim_read_ends < 0 or not 0 <= self.base_qual <= 255:
            raise InvalidOption("a minimum is out of range")

    def bound(self, lengths: dict[str, int]) -> ModFilter:
        return replace(self, region=self.region.bind(lengths)) if isinstance(self.region, Region) else self

    def promoted(self) -> ModFilter:
        return replace(self, threshold=self.threshold.promoted())


@dataclass(frozen=True)
class Windowing:
    """Windows of `win` calls that begin every `step` calls."""

    win: int
    step: int

    def __post_init__(self) -> None:
        if self.win < 1 or self.step < 1:
            raise InvalidOption("win and step are 1 or more")


@dataclass(frozen=True)
class SeqDisplay:
    """Which sequence a read table shows: none, all of it, or that over a region."""

    full: bool = False
    region: Region | tuple[str, int, int] | None = None
    show_base_qual: bool = False
    show_ins_lowercase: bool = False
    show_mod_z: bool = False

    def __post_init__(self) -> None:
        if self.full and self.region is not None:
            raise InvalidOption("the full sequence or that of a region")
        if not self.full and self.region is None and self.show_base_qual:
            raise InvalidOption("qualities are shown with a sequence")
        if self.region is None and (self.show_ins_lowercase or self.show_mod_z):
            raise InvalidOption("insertions and modifications are marked over a region")

    @property
    def shown(self) -> bool:
        return self.full or self.region is not None

    def bound(self, lengths: dict[str, int]) -> SeqDisplay:
        return replace(self, region=self.region.bind(lengths)) if isinstance(self.region, Region) else self


def f32(value: float) -> float:
    """A number as single precision has it, for comparisons with window values."""
    import numpy as np

    if not math.isfinite(value):
        raise InvalidOption(f"not a number: {value}")
    return float(np.float32(value))
