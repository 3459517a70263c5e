"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass over a text with A-Z in lower case finds the keywords; each kind's
expression is then tried only where one of its keywords begins. Runs of hex digits have no
keyword: their prefilter looks at every 16th byte, one of which any run of 32 must cover,
twice in a row.

Kinds, the base ones first:

* assign, access, hex: as written in KINDS; matches are leftmost and non-overlapping, and
  those that are too short are dropped after they have taken their characters.
* github, npm: tokens whose last six characters are the CRC-32 of the rest in base 62.
* card: 13 to 19 digits near a word such as `card`, that the Luhn sum accepts.
* iban: after the keyword `iban`, an account number whose remainder modulo 97 is 1.

Defined cases: a null text is an empty one and has no spans; rows that repeat are scanned
each; empty tables give empty results; other columns pass through, and columns named like
the result are replaced. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from modspark.llm.text import place_of, utf8
from modspark.session import ship

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "card", "iban")

# Expressions and keywords.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[opusr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_CARD = re.compile(rb"(?i:card|visa|mastercard|amex)[a-z ]{0,16}[:=#]?\x20{0,3}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
_IBAN = re.compile(rb"(?i:iban)[:=]?\x20{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "gho_": "github", "ghp_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card",
    "iban": "iban",
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def crc_ok(body: bytes) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    n = zlib.crc32(body[:-6])
    digits = bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(_BASE62[d])
    return bytes(reversed(digits)) == body[-6:]


def luhn_ok(number: bytes) -> bool:
    digits = [c - 48 for c in number if 48 <= c <= 57]
    doubled = [2 * d - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(doubled) % 10 == 0


def iban_ok(number: bytes) -> bool:
    x = number.replace(b" ", b"").decode()
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _assign(m: re.Match) -> tuple[int, int] | None:
    return m.span() if len(m[1]) >= 8 else None


def _access(m: re.Match) -> tuple[int, int] | None:
    return m.span() if len(m[0]) >= 16 else None


def _token(m: re.Match) -> tuple[int, int] | None:
    return m.span() if crc_ok(m[1]) else None


def _card(m: re.Match) -> tuple[int, int] | None:
    """The longest part of what was matched, by whole groups from its end, that checks out."""
    body = m[1]
    while body:
        if luhn_ok(body):
            return m.start(1), m.start(1) + len(body)
        body = body[: max(body.rfind(b" "), body.rfind(b"-"), 0)]
    return None


def _iban(m: re.Match) -> tuple[int, int] | None:
    """The longest part of what was matched, by whole groups from its end, that checks out."""
    body = m[1]
    while len(body) >= 15:
        if iban_ok(body):
            return m.start(1), m.start(1) + len(body)
        body = body.rpartition(b" ")[0]
    return None


_RULES = {"assign": (_ASSIGN, _assign), "access": (_ACCESS, _access), "github": (_GITHUB, _token), "npm": (_NPM, _token), "card": (_CARD, _card), "iban": (_IBAN, _iban)}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _hex_spans(raw: bytes, data: np.ndarray) -> list[tuple[int, int]]:
    """Runs of 32 or more hex digits; a run covers two of the bytes 15, 31, 47, ... in a row."""
    probe = _IS_HEX[data[15::16]]
    spans, end = [], -1
    for k in np.flatnonzero(probe[:-1] & probe[1:]):
        at = 15 + 16 * int(k)
        if at < end:
            continue
        start = at
        while start and _IS_HEX[raw[start - 1]]:
            start -= 1
        end = _HEX.match(raw, start).end()
        if end - start >= 32:
            spans.append((start, end))
    return spans


def scan(raw: bytes) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text given as UTF-8, in code points, by start and then kind."""
    data = np.frombuffer(raw, np.uint8)
    found = [(a, BASE.index("hex"), b) for a, b in _hex_spans(raw, data)]
    low = raw.lower()  # of bytes: A-Z only
    last = dict.fromkeys(_RULES, 0)
    hits = ((at - n + 1, kind) for at, (n, kind) in _automaton().iter(low.decode("latin-1")))
    for at, kind in sorted(set(hits)):
        if at < last[kind]:
            continue
        pattern, accept = _RULES[kind]
        m = pattern.match(raw, at)
        if m is None:
            continue
        span = accept(m)
        if kind in BASE or span:
            last[kind] = m.end()
        if span:
            found.append((span[0], KINDS.index(kind), span[1]))
    found.sort()
    if raw.isascii() or not found:
        return [(KINDS[k], a, b) for a, k, b in found]
    ends = sorted({x for a, _, b in found for x in (a, b)})
    point, total, before = {}, 0, 0
    for x in ends:  # one pass over the text, whatever the number of spans
        total += int(np.count_nonzero((data[before:x] & 0xC0) != 0x80))
        point[x], before = total, x
    return [(KINDS[k], point[a], point[b]) for a, k, b in found]


def _run(names: list[str], text: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, at = utf8(batch.column(place_of(names, text)))
            raw = data.tobytes()
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in scan(raw[at[i] : at[i + 1]])] for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(spans, kind)], [*names, to])

    return run


def find_secrets(docs: DataFrame, text: str = "text", to: str = "secrets") -> DataFrame:
    """The rows of docs with an array of spans (kind, start, end), by start, then kind as in KINDS."""
    ship(docs.sparkSession)
    rows = docs.drop(to)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(_run(rows.columns, text, to), T.StructType([*rows.schema.fields, T.StructField(to, T.ArrayType(span))]))
