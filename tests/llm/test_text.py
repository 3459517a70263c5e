"""Long texts are worked through in pieces, with the same results."""

import numpy as np
import pyarrow as pa
from conftest_llm import prose

from modspark.llm import quality_rules, text


def words_of(data):
    at = np.array([0, len(data)])
    return text.words(data, at)


def test_hashes_in_pieces(monkeypatch):
    data = np.frombuffer(("x" * 700 + " " + prose(500, 1) + " é" + "y" * 130 + "\U0001f600").encode(), np.uint8)
    start, end, first = words_of(data)
    whole = text.hashes(data, start, end)
    runs, _ = text.grams(whole, first, 5)
    cut = text.hashes(data, start, np.minimum(start + 4, end))
    for piece in (7, 64, 301):
        monkeypatch.setattr(text, "PIECE", piece)
        assert np.array_equal(text.hashes(data, start, end), whole)
        assert np.array_equal(text.hashes(data, start, np.minimum(start + 4, end)), cut)
        assert np.array_equal(text.grams(whole, first, 5)[0], runs)
    assert len(text.hashes(data, start[:0], end[:0])) == 0


def test_scores_in_pieces(monkeypatch):
    ratio = np.random.default_rng(1).normal(size=1 << quality_rules.BITS)
    batch = pa.RecordBatch.from_arrays([pa.array([prose(300, 2), "abc", "", None, prose(80, 3) * 30])], ["TEXT"])

    def scored():
        out = next(quality_rules._score(["TEXT"], "text", ratio, -0.5)(iter([batch])))
        return [out.column(k).to_pylist() for k in range(1, out.num_columns)]

    whole = scored()
    monkeypatch.setattr(text, "STEP", 100)
    monkeypatch.setattr(quality_rules, "PIECE", 1000)
    for a, b in zip(scored(), whole):
        assert np.allclose(np.array(a, float), np.array(b, float))


def test_columns_are_found_as_spark_finds_them():
    assert text.place_of(["id", "Text", "text"], "text") == 2 and text.place_of(["id", "TEXT"], "text") == 1
