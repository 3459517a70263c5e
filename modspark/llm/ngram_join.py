"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of hashed runs of five words. Sets that are equal make one representative.
A forest has `TREES` tries; a representative's label in a trie is a run of `LONGEST` minima, and
labels that share a branch of a trie are kept sorted. Matching begins at whole labels: pairs
that agree on one are verified. Then prefixes get shorter, one minimum at a time, but only those
of representatives whose recall is not reached: not all who share a shortest branch with them
have been compared with them. That is known by counting. A shortest branch is the prefix at
which a pair at the threshold agrees in some trie with chance `RECALL` (prefix_length()); a
representative has as many meetings as there are others on its shortest branches, and each
compared pair accounts for as many of them as there are tries in which it shares one. When
all are accounted for, no shorter prefix can bring anyone new, and it takes no further part.
Where the representatives left miss `FEW` meetings each at most, they go to the shortest branches at once.

Nodes with one member end there. Nodes of a round with the same members are one unit, looked at in
the first trie. A pair is verified at the longest prefix on which it agrees, in the first trie
of that round where it does, so once. A unit of more than `BLOCK` members, or of sets too large together, is
dealt into parts, and each pair of parts is a group of its own: no task holds more than two, and
no pair leaves a task. What leaves is, for each member, how many documents it links to, how
many meetings were settled and one document it can reach; classes are then the connected components.

Texts are read again only for documents that share a branch with another; the others are told by
a bitmap and aren't shuffled.

Defined cases: a text of fewer than five words is one run of all its words; a text without
words links with nothing; rows that repeat a doc_id are one document, that with the least
digest; rows with a null doc_id have a null class and no links; an empty table gives an empty
result; a very long text is held by one worker as its words' hashes and runs, and its set by
each group it is in; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.links import Forest, classes
from modspark.llm.members import marked
from modspark.llm.text import binaries, grams, hashes, mix, reduced, signed, sorted_sets, steps, utf8, words
from modspark.session import materialise, ship

WORDS = 5
THRESHOLD = 0.8
TREES = 24
LONGEST = 8
RECALL = 0.9999
#: Members of a part of a unit, and runs of words in their sets together.
BLOCK = 512
WEIGHT = 1 << 21
#: Meetings that representatives may miss on average for the last prefixes to be taken at once.
FEW = 256
#: Bits that a minimum below the shortest branch has in a stored label.
BITS = 16


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """Where shortening ends: the longest prefix at which a pair at the threshold is found with the wanted chance."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashed runs of words, ascending, and where it begins (one more)."""
    start, end, first = words(data, at)
    return sorted_sets(*grams(hashes(data, start, end), first, size))


def digests(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return tuple(signed(reduced(np.add, mix(flat ^ np.uint64(salt)), at, 0)) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344))


def step_bits(levels: int) -> int:
    """Bits for each minimum in what a label has beyond its shortest branch."""
    return min(BITS, 62 // max(levels, 1))


def tree_labels(flat: np.ndarray, at: np.ndarray, trees: int, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's label in each tree: the hash of its first `least` minima, and some bits of each further one."""
    x = (flat >> np.uint64(32)).astype(np.uint32)
    seed = mix(np.arange(2 * trees * longest, dtype=np.uint64) + np.uint64(0xA5A5))
    bits = np.uint64(step_bits(longest - least))
    tops, rests = (np.zeros((len(at) - 1, trees), np.uint64) for _ in range(2))
    for t in range(trees):
        for k in range(longest):
            a, b = (np.uint32(int(seed[2 * (t * longest + k) + i]) & 0xFFFFFFFF) for i in (0, 1))
            minimum = reduced(np.minimum, x * (a | np.uint32(1)) + b, at, 0xFFFFFFFF).astype(np.uint64)
            if k < least:
                tops[:, t] = mix(tops[:, t] ^ minimum + np.uint64(0x9E3779B97F4A7C15))
            else:
                rests[:, t] = rests[:, t] << bits | mix(minimum) >> np.uint64(64) - bits
    return tops.view(np.int64), rests.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def _sign(size: int, trees: int, least: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j, d, a in steps(data, at):
                flat, first = shingles(d, a, size)
                h, g = digests(flat, first)
                labels = map(_lists, tree_labels(flat, first, trees, least, longest))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(h), pa.array(g), *labels], ["doc_id", "size", "h", "g", "tops", "rests"])

    return run


def _sets(size: int):
    """Texts to sets, for ids of representatives and others; rows whose set has digests of its own follow their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j, d, a in steps(data, at):
                flat, first = shingles(d, a, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, digests(flat, first)), binaries(flat, first)], ["rep", "h", "g", "set"])

    return run


def _verify(threshold: float, shift: int, done: int | None):
    """Members of a group (tree, top, prefix, low, high) to rows (rep, links, root, seen).

    shift: bits of a label's rest that the prefix leaves out; done: those of the round before, whose pairs are settled.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tree, low, high = (key[k].as_py() for k in (0, 3, 4))
        group = group.sort_by("rep")
        rep = group.column("rep").to_numpy()
        keep = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1])))
        group, rep = group.take(pa.array(keep)), rep[keep]
        copies, part = group.column("copies").to_numpy(), group.column("part").to_numpy()
        tops, rests = (group.column(c).combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("tops", "rests"))
        here, longer = rests >> shift, rests >> (done or 0)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("set")]
        size = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(int(flat.max()) + 1, bool)
        links, seen, forest = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64), Forest(len(rep))
        for i in range(len(rep) - 1):
            same = tops[i + 1 :] == tops[i]
            now = same & (here[i + 1 :] == here[i])
            first = now.argmax(1)
            mine = now[np.arange(len(first)), first] & (first == tree)
            if done is not None:
                mine &= ~(same & (longer[i + 1 :] == longer[i])).any(1)
            if low != high:
                mine &= part[i + 1 :] != part[i]
            met = same.sum(1) * mine
            seen[i] += met.sum()
            seen[i + 1 :] += met
            js = np.flatnonzero(mine & (np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i]))) + i + 1
            if not len(js):
                continue
            mine = flat[at[i] : at[i + 1]]
            mark[mine] = True
            ends = np.cumsum(size[js])
            places = np.arange(ends[-1]) + np.repeat(at[js] - ends + size[js], size[js])
            both = np.add.reduceat(mark[flat[places]], ends - size[js], dtype=np.int64)
            mark[mine] = False
            js = js[both / (size[i] + size[js] - both) >= threshold]
            if len(js):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                forest.join(i, js)
        some = np.flatnonzero(seen)
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[forest.roots()[some]], "seen": seen[some]})

    return run


def _round(tries: DataFrame, sets: DataFrame, threshold: float, shift: int, done: int | None, block: int, weight: int) -> DataFrame:
    """Rows (rep, links, root, seen) of the pairs that agree on a prefix without `shift` bits, and on none without `done`; tries: labels that still take part."""
    cut = tries.withColumn("prefix", F.shiftright("rest", shift))
    nodes = cut.groupBy("tree", "top", "prefix").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum("size").alias("weight")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("weight") / weight)).cast("int")
    units = nodes.groupBy("n", "a", "b", "x").agg(F.min(F.struct("tree", "top", "prefix")).alias("u"), F.max(parts).alias("parts")).select("u.*", "parts")
    of_rep = cut.join(units, ["tree", "top", "prefix"]).groupBy("rep").agg(F.collect_list(F.struct("tree", "top", "prefix", "parts")).alias("units"))  # one for each tree at most
    members = sets.join(of_rep, "rep").select("*", F.explode("units").alias("u")).drop("units")
    part = F.pmod(F.xxhash64("rep"), F.col("u.parts")).cast("int")
    dealt = members.select("u.tree", "u.top", "u.prefix", part.alias("part"), "rep", "copies", "tops", "rests", "set", F.explode(F.sequence(F.lit(0), F.col("u.parts") - 1)).alias("other"))
    dealt = dealt.select("*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).drop("other")
    groups = dealt.groupBy("tree", "top", "prefix", "low", "high")
    return groups.applyInArrow(_verify(threshold, shift, done), "rep long, links long, root long, seen long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, block: int = BLOCK, weight: int = WEIGHT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each id.

    class_id: the smallest id that links can reach, the document's own included. n_links: other
    documents whose sets have at least the threshold's Jaccard similarity, copies counted.
    """
    ship(docs.sparkSession)
    least = prefix_length(threshold, trees, longest, recall)
    step = step_bits(longest - least)
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = texts.where(F.col("doc_id").isNotNull())
    signed_rows = some.mapInArrow(_sign(size, trees, least, longest), "doc_id long, size long, h long, g long, tops array<long>, rests array<long>")
    signs = materialise(signed_rows.groupBy("doc_id").agg(F.min(F.struct("h", "g", "size", "tops", "rests")).alias("s")).select("doc_id", "s.*"))
    groups = materialise(signs.where("size > 0").groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("size", "tops", "rests")).alias("s")).select("h", "g", "rep", "copies", "s.*"))

    labels = groups.select("rep", "size", F.posexplode(F.arrays_zip("tops", "rests")).alias("tree", "l")).select("rep", "size", "tree", F.col("l.tops").alias("top"), F.col("l.rests").alias("rest"))
    branches = labels.groupBy("tree", "top").agg(F.count("*").alias("n")).where("n > 1")
    tries = materialise(labels.join(branches, ["tree", "top"]).sortWithinPartitions("tree", "top", "rest", "rep"))
    meetings = materialise(tries.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("all")))

    again = marked(some, "doc_id", meetings.select("rep"), "__may").where("__may").select("doc_id", "text").mapInArrow(_sets(size), "rep long, h long, g long, set binary")
    sets = materialise(again.join(groups.join(meetings.select("rep"), "rep", "left_semi").select("rep", "h", "g", "copies", "tops", "rests"), ["rep", "h", "g"]).select("rep", "copies", "tops", "rests", "set"))

    found, left, depth, done, everyone = [], tries, longest, None, meetings.count()
    while True:
        found.append(materialise(_round(left, sets, threshold, step * (longest - depth), done, block, weight)))
        if depth == least:
            break
        seen = reduce(DataFrame.unionByName, found).groupBy("rep").agg(F.sum("seen").alias("seen"))
        missing = F.col("all") - F.coalesce("seen", F.lit(0))
        open = materialise(meetings.join(seen, "rep", "left").select("rep", missing.alias("missing")).where("missing > 0"))
        rest = open.agg(F.count("*").alias("n"), F.sum("missing").alias("missing")).first()
        if not rest["n"]:
            break
        done = step * (longest - depth)
        depth = least if rest["missing"] <= FEW * rest["n"] else depth - 1
        if 2 * rest["n"] < everyone:  # a join that leaves out few isn't worth its while: what is settled is passed over anyway
            left = materialise(tries.join(open.select("rep"), "rep", "left_semi"))

    known = classes(groups.select("h", "g", "rep", "copies"), reduce(DataFrame.unionByName, found).where("links > 0")).select("h", "g", "class", "links")
    out = signs.select("doc_id", "h", "g").join(known, ["h", "g"], "left")
    out = out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(texts.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay when one document of each class does: that with the smallest id.

    Rows that repeat an id, and rows with a null id, all stay or go with it, and stay.
    """
    found = jaccard_classes(docs, id=id, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(found, F.col(id) == F.col("__gone"), "left_anti").select(docs.columns)
