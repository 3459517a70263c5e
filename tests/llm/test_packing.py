import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import documents, table
from tokenizers import Tokenizer

from modspark.llm import packing as P
from modspark.llm.bpe import default_path, encoder


def test_fill_is_the_best_sum():
    draw = random.Random(1)
    for _ in range(200):
        counts = {draw.randrange(1, 30): draw.randrange(0, 4) for _ in range(4)}
        capacity = draw.randrange(0, 60)
        chosen = P.fill(counts, capacity)
        assert all(n <= counts[x] for x, n in chosen.items())
        best = max(s for take in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(take, counts))) <= capacity)
        assert sum(x * n for x, n in chosen.items()) == best


def test_plan_uses_every_piece_once():
    draw = random.Random(2)
    counts = {draw.randrange(1, 2049): draw.randrange(1, 50) for _ in range(300)}
    rows, seen = P.plan(counts), defaultdict(int)
    fill = defaultdict(int)
    for length, rank, sequence, n, _, times in rows:
        assert rank == seen[length]
        seen[length] += n * times
        for t in range(times):
            fill[sequence + t] += n * length
    assert seen == counts
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.03 * sum(a * b for a, b in counts.items()) / 2048


@pytest.fixture(scope="module")
def expected():
    full = Tokenizer.from_file(default_path())
    return [(r[0], full.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in documents()]


def check(rows, expected):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for doc, ids in expected:
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[doc].append((a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items()}
    return len(sequences)


def test_exact_round_trip(docs, wide, expected):
    n = check(P.pack(docs).collect(), expected)
    assert n <= sum(len(ids) for _, ids in expected) // 2048 + 2
    assert table(P.pack(wide), "doc_id", "start", "length", "ids_crc32", "doc_tokens") == table(P.pack(docs), "doc_id", "start", "length", "ids_crc32", "doc_tokens")


def test_many_pieces_of_one_length(spark):
    df = spark.createDataFrame([(k, "the same text") for k in range(3000)], "doc_id long, text string")
    full = Tokenizer.from_file(default_path()).encode("the same text", add_special_tokens=False).ids + [1]
    assert check(P.pack(df).collect(), [(k, full) for k in range(3000)]) == -(-3000 * len(full) // 2048)


def test_empty(empty):
    assert P.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", " " * 5000 + "x", "\n\n  é \U0001f600 'll don't", "x" * 3000, "1234567 ½ ²", "\x00\x01", "á ​"])
def test_both_libraries_agree(text):
    assert encoder(default_path()).ids(text).tolist() == Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids
