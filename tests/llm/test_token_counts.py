import random

from conftest_llm import documents, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modspark.llm import token_counts as K
from modspark.llm.bpe import default_path, encoder

PARTS = ["'re", "'", "r", "e", " ", "  ", "\n", "\n\n", "a", "bc", "12", "!!", " don't", "é", "\U0001f600", "\t", "x" * 30, " \n ", "'s"]


def full(text):
    return len(encoder(default_path()).fast.encode_ordinary(text))


def check(text, edits):
    count = K.counter(default_path())
    tree = K.TokenTree.of(text, count)
    assert tree.tokens == full(text)
    for at, removed, inserted in edits:
        text, _ = tree.edit(text, at, removed, inserted, count)
        assert tree.tokens == full(text)
        assert tree.points == len(text)
        whole = K.TokenTree.of(text, count)
        assert K.np.array_equal(K.np.concatenate(tree.leaves, 1), K.np.concatenate(whole.leaves, 1))
        assert K.TokenTree.read(tree.bytes()).tokens == tree.tokens


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 12), st.lists(st.sampled_from(PARTS), max_size=4).map("".join)), max_size=4))
def test_counts_follow_edits(text, edits):
    check(text, edits)


def test_long_texts_with_many_leaves():
    draw = random.Random(2)
    text = prose(4000, 1)
    check(text, [(draw.randrange(len(text)), draw.choice((0, 1, 5, 900)), draw.choice(("", "x", " new words here", "\n\n"))) for _ in range(40)])
    check(text, [(0, len(text), ""), (0, 0, text), (len(text), 0, "'re"), (10**9, 5, "end")])


def test_only_what_an_edit_touches_is_encoded():
    count, text = K.counter(default_path()), prose(20_000, 3)
    tree = K.TokenTree.of(text, count)
    _, again = tree.edit(text, len(text) // 2, 3, "new", count)
    assert again < 100


def test_very_long_pretokens():
    count = K.counter(default_path())
    for text in ("a" + " " * 1_000_000 + "x", "=" * 50_000 + "\n", "x" * 300_000):
        tree, n = K.TokenTree.of(text, count), len(encoder(default_path()).ids(text))
        assert tree.tokens == n
        new, _ = tree.edit(text, 20_000, 5, " in between ", count)
        assert tree.tokens == len(encoder(default_path()).ids(new)) and tree.points == len(new)


def test_work_of_an_edit_does_not_grow_with_the_text():
    count = K.counter(default_path())

    def touched(n):
        text = "some words here " * n
        tree = K.TokenTree.read(K.TokenTree.of(text, count).bytes())
        sums = tree.sums.copy()
        _, again = tree.edit(text, len(text) // 2, 4, "new", count)
        return again, len(tree.changed), int((tree.sums != sums).any(0).sum())

    (a, x, p), (b, y, q) = touched(1000), touched(64_000)
    assert a == b < 50 and max(x, y) <= 2 and p <= 16 and q <= p + 16


def test_leaves_that_grow_are_split():
    count, text = K.counter(default_path()), prose(5000, 4)
    tree = K.TokenTree.of(text, count)
    check(text, [(700, 0, prose(9000, 5)), (20, 4, "x"), (3000, 20_000, "")])
    tree.edit(text, 700, 0, prose(9000, 5), count)
    assert max(leaf.shape[1] for leaf in tree.leaves) <= K.LEAF


def test_files_that_are_not_plain_byte_level_bpe_are_refused(tmp_path):
    import json

    import pytest

    from modspark.llm.bpe import Encoder

    with open(default_path(), encoding="utf-8") as f:
        held = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": held["model"] | {"merges": held["model"]["merges"][::-1]}}):
        (tmp_path / "t.json").write_text(json.dumps(held | change))
        with pytest.raises(ValueError, match="byte-level"):
            Encoder(str(tmp_path / "t.json"))


def test_query_against_full_encoding(spark, docs, tmp_path):
    from modspark.llm.queries import op10_token_counts

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_tokens_after, r.n_edits) for r in op10_token_counts(spark, str(tmp_path)).collect())
    want = []
    for doc, t, *_ in documents():
        t = t or ""
        n, half, quarter = full(t), len(t) // 2, len(t) // 4
        new = t[:half] + " (as amended) " + t[half:]
        new = new[:quarter] + new[quarter + 12 :]
        want.append((repr(doc), n, full("Note: " + new), 3))
    assert got == sorted(want)


def test_one_pass_is_the_same_as_two(docs, wide):
    edits = F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("removed"), F.lit("new ").alias("inserted")))
    two = K.apply_edits(K.build_trees(docs).withColumn("was", F.col("n_tokens")).withColumn("edits", edits))
    one = K.edited_counts(wide.withColumnRenamed("text", "Text").withColumn("edits", edits))
    assert table(one, "doc_id", "n_tokens", "n_tokens_after", "n_reencoded") == sorted(repr(r).replace("was=", "n_tokens=").replace("after_=", "n_tokens_after=") for r in two.select("doc_id", "was", F.col("n_tokens").alias("after_"), "n_reencoded").collect())
    assert "text" not in map(str.lower, one.columns)


def test_rows(docs, wide, empty, spark):
    trees = K.build_trees(docs)
    assert {r.n_tokens == full(r.text or "") for r in trees.collect()} == {True}
    edits = F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("removed"), F.lit("new ").alias("inserted")), F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("removed"), F.lit(None).cast("string").alias("inserted")))
    after = K.apply_edits(trees.withColumn("edits", edits)).collect()
    assert len(after) == len(documents())
    assert all(r.n_tokens == full(r.text) for r in after)
    none = K.apply_edits(trees.withColumn("edits", F.lit(None).cast(K.EDIT)))
    assert table(none, "doc_id", "n_tokens") == table(trees, "doc_id", "n_tokens")
    assert table(K.build_trees(wide), "doc_id", "n_tokens") == table(trees, "doc_id", "n_tokens")
    assert K.apply_edits(K.build_trees(empty).withColumn("edits", edits)).count() == 0
    rows = spark.createDataFrame([(20, 2, 0, 0, "B"), (20, 1, 0, 0, "A"), (777, 1, 0, 0, "x")], "doc_id long, nth int, at long, removed long, inserted string")
    out = K.apply_edits(K.with_edits(trees, rows)).where("doc_id = 20").collect()
    assert all(r.text.startswith("BA") and r.n_tokens == full(r.text) for r in out)
