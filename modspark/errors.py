"""What can be wrong with input, options and records."""

from __future__ import annotations

#: Longest piece of input text that a message repeats.
SHOWN = 100


def shown(text: object) -> str:
    """Input for a message, cut where it is long."""
    text = str(text)
    return text if len(text) <= SHOWN else text[:SHOWN] + "..."


class ModsparkError(ValueError):
    """The base of all errors that this package raises itself."""


class InvalidOption(ModsparkError):
    """Options that exclude each other, or values out of range."""


class InvalidRegion(ModsparkError):
    """A region that can't be read or that lies outside its contig."""


class InvalidRecord(ModsparkError):
    """An alignment record that breaks a rule of the format or of this package."""


class InvalidFlag(InvalidRecord):
    """A flag that is not one of the seven read states."""


class ZeroLength(InvalidRecord):
    """A record without sequence where one is needed."""


class InvalidTag(InvalidRecord):
    """Modification tags that contradict the grammar, the sequence or each other."""


class InvalidBase(InvalidTag):
    """A group of an MM tag on a letter that is no base."""


class InvalidModType(InvalidTag):
    """A group of an MM tag that breaks the grammar, or has no end."""


class InvalidModCoords(InvalidTag):
    """Numbers of skipped bases that can't be read, or that don't fit the sequence."""


class InvalidModProbs(InvalidTag):
    """More or fewer probabilities than calls."""


class DuplicateMods(InvalidTag):
    """A modification that is given twice for a strand."""


class BadHeader(InvalidRecord):
    """A file that isn't of its format, or files with different contigs."""


class BadIndex(InvalidRecord):
    """An index that can't be read."""


class Unsorted(InvalidRecord):
    """Records that aren't in the order that an index needs."""


class TooLarge(InvalidOption):
    """More than a documented limit."""


class InvalidSummary(ModsparkError):
    """A sequencing summary that breaks its rules."""


class InvalidRead(ModsparkError):
    """A read in JSON form that contradicts itself."""


class EmptyWindow(ModsparkError):
    """A window function was given no calls."""


class InsufficientData(ModsparkError):
    """A window function was given too few calls."""


class LowDensity(ModsparkError):
    """A window's density is below the asked minimum."""
