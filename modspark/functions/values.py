"""Probabilities, modification codes and how numbers are written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from modspark.errors import InvalidOption, shown


def to_u8(value: float) -> int:
    """A fraction as a probability from 0 to 255, halves away from 0."""
    return int(np.floor(float(np.float32(value)) * 255 + 0.5))


def to_fraction(value: Column) -> Column:
    """A probability from 0 to 255 as a fraction."""
    return (value / F.lit(255.0)).cast("float")


def mod_code(text: str) -> str:
    """The written form of a modification code: a letter, or a number."""
    if len(text) == 1 and text.isascii() and text.isalpha():
        return text
    if text.isascii() and text.isdigit() and code_point(str(int(text))) is not None:
        return str(int(text))
    raise InvalidOption(f"not a modification code: {shown(text)}")


def code_point(code: str) -> int | None:
    """What codes are ordered by: the letter's code point, or the number; None if that is no code point."""
    if code.isdigit():
        n = int(code)
        return n if n < 0xD800 or 0xE000 <= n <= 0x10FFFF else None
    return ord(code)


def code_point_column(code: Column) -> Column:
    return F.when(F.rlike(code, F.lit("^[0-9]+$")), F.try_to_number(code, F.lit("9999999"))).otherwise(F.ascii(code)).cast("int")


def threshold_column(q: Column, least: int, reject: tuple[int, int] | None) -> Column:
    """Whether a probability stays."""
    good = q >= least
    return good if reject is None else good & ~q.between(*reject)


def short_float(value: float, point: bool = False) -> str:
    """The shortest digits that give back a single-precision number, never with an exponent."""
    text = np.format_float_positional(np.float32(value), unique=True, trim="-")
    return f"{text}.0" if point and "." not in text else text


def is_uuid(text: Column) -> Column:
    """Whether a text is a random UUID (version 4), in either case."""
    return F.rlike(text, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")) & (F.length(text) == 36)


def uuid_of(digits: Column) -> Column:
    """The version-4 UUID of 16 bytes, given as 32 hexadecimal digits: version and variant bits are set."""
    part = lambda a, n: F.substring(digits, a, n)
    variant = F.substring(F.lit("89ab"), (F.pmod(F.conv(part(17, 1), 16, 10).cast("int"), F.lit(4)) + 1), F.lit(1))
    return F.lower(F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)))


def random_uuid() -> Column:
    return F.expr("uuid()")
