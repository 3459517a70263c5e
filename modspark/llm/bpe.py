"""Byte-level BPE ids from a tokenizers JSON file, by the faster of two public libraries."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from modspark.errors import InvalidOption, shown

#: The pre-token pattern of byte-level BPE files that use the library's own regex (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space so long that a backtracking engine may give up on it goes to the other library.
_LONG_SPACE = re.compile(r"\s{2000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others, in order, from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(held: dict) -> bool:
    """Whether a file is byte-level BPE with the library's own regex, and ranks its merges by its ids.

    Only then do both libraries give the same ids: the faster one merges by the order of ids.
    """
    before, model = held.get("pre_tokenizer") or {}, held["model"]
    if held.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    special = {x["content"] for x in held["added_tokens"]}
    return all(a < b for a, b in zip([-1, *merged], merged)) and len(merged) + 256 == len(model["vocab"].keys() - special)


class Encoder:
    """Ids as `tokenizers` gives them with add_special_tokens=False, special tokens in texts included."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if not plain(held):
            raise InvalidOption(f"not a plain byte-level BPE file: {shown(path)}")
        self.special = [x["content"] for x in held["added_tokens"]]
        symbol = _byte_of_symbol()
        ranks = {bytes(symbol[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.full = path, None

    def _slow(self, text: str) -> list[int]:
        if self.full is None:
            self.full = Tokenizer.from_file(self.path)
        return self.full.encode(text, add_special_tokens=False).ids

    def piece(self, text: str) -> int:
        """How many ids one pre-token has, however long it is: no pattern is matched."""
        return len(self.fast._core_bpe.encode_single_piece(text.encode()))

    def odd(self, text: str) -> bool:
        return any(x in text for x in self.special) or bool(_LONG_SPACE.search(text))

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._slow(text) if self.odd(text) else self.fast.encode_ordinary(text), "<u4")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
