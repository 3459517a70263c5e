import re
from collections import Counter

import numpy as np
from conftest_llm import documents, table

from modspark.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def test_base_counts(docs, labels, wide):
    out = Q.apply_rules(docs, labels)
    rows = out.collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert r.kept == (not r.base_failed and r.llr >= Q.THRESHOLD)
    assert len(rows) == len(documents())
    assert any(r.n_repeat_words for r in rows)
    names = ["doc_id", "lang", *Q.FIELDS]
    assert table(Q.apply_rules(wide, labels), *names) == table(out, *names)


def test_scores_equal_brute_force(docs, labels):
    good = {r.doc_id for r in Q.trusted(labels).collect()}
    assert 3 not in good and None not in good and 5 in good
    ratio = Q.fit(docs, Q.trusted(labels))

    def buckets(text):
        raw = (text or "").encode()
        out = []
        for k in range(len(raw) - 3):
            b, _ = Q.ngram_buckets(np.frombuffer(raw[k : k + 4], np.uint8), np.array([0, 4]))
            out += b.tolist()
        return out

    raw, target = np.zeros(1 << Q.BITS), np.zeros(1 << Q.BITS)
    texts = [(r[0], r[1]) for r in documents() if r[1] is None or len(r[1]) < 20_000]
    long = [(r[0], r[1]) for r in documents() if r[1] is not None and len(r[1]) >= 20_000]
    for doc, text in texts + long:
        data = np.frombuffer((text or "").encode(), np.uint8)
        b = np.array(buckets(text) if len(data) < 2000 else Q.ngram_buckets(data, np.array([0, len(data)]))[0], np.int64)
        raw += np.bincount(b, minlength=1 << Q.BITS)
        target += np.bincount(b, minlength=1 << Q.BITS) * (doc in good)
    want = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert np.allclose(ratio, want)
    for r in Q.score(docs, ratio).collect():
        if r.text is None or len(r.text) < 500:
            b = buckets(r.text)
            assert np.isclose(r.llr, want[b].mean() if b else 0.0)


def test_junk_goes_and_clean_stays(spark):
    from conftest_llm import prose

    clean = [(k, prose(120, k)) for k in range(200)]
    junk = [(1000 + k, " ".join(f"{w}$$&&%%{k}" for w in prose(120, 900 + k).split())) for k in range(50)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(100)] + [(1000, 0)], "doc_id long, quality int")
    kept = {r.doc_id for r in Q.apply_rules(df, labels).where("kept").collect()}
    assert kept == set(range(200))


def test_no_labels_and_no_rows(spark, docs, empty, labels):
    none = labels.where("false")
    assert {r.llr for r in Q.apply_rules(docs, none).collect()} == {0.0}
    assert Q.apply_rules(empty, labels).count() == 0
