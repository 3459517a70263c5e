"""Small documents with all kinds of odd ones among them."""

import random

#: Names that operators use for results or inside, as columns that documents may bring along.
CLASHING = "n_words kept llr n_lines n_dropped score predicted held_out secrets size source_size target taken draws token_tree n_tokens n_reencoded class_id n_links doc h g key block rep units shard toxic quality bucket".split()


def near(text: str, share: float, seed: int) -> str:
    """A text with a share of its words changed."""
    draw = random.Random(seed)
    return " ".join(f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split(" "))


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choice(("an", "the", "or", "ti", "is", "ed", "sh", "ou")) for _ in range(draw.randrange(1, 4))) for _ in range(n)]
    return "".join(w + draw.choice((" ", " ", " ", ".\n")) for w in words).strip()


SHARED = "A sentence that stands in very many of the documents here."


def documents() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with all kinds of odd ones among them."""
    texts = [None, "", " \n\t\n ", "one", "one two three four", "\x00\x0b éé \U0001f600 x", "a " * 3000, SHARED]
    texts += [prose(60 + 7 * k, k) for k in range(12)]
    long = prose(30_000, 99)
    texts += [long, near(long, 0.01, 3)]
    base = prose(300, 5)
    texts += [base, base, base] + [near(base, 0.005 * k, k) for k in range(1, 9)]
    texts += [f"{prose(50, 200 + k)}\n  {SHARED.upper() if k % 2 else SHARED}\t\n{prose(50, 300 + k)}" for k in range(6)]
    rows = [(k, t, "en", None if k % 5 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[20], rows[9], (None, "a row without an id " * 8, None, None, None), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(df, *columns):
    """Rows as sorted texts, to compare with repeats."""
    return sorted(map(repr, df.select(*(columns or sorted(df.columns))).collect()))
