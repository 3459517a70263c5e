"""Chat formatting by schema fingerprints, with DataFrame operations only.

A fingerprint is the hash of a layout's nested field paths, sorted: for each declared mapping of
those paths that it knows, so unrelated fields don't change it. The first mapping that has the
fingerprint among its own says how the layout becomes canonical turns: an array of (role,
text). Frames are matched by their schema, when the plan is made; JSON texts row by row.

The template writes a turn as `<|role|>`, a line feed, the text, `</s>` and a line feed. In
texts and roles `&` and `<` are written `&amp;` and `&lt;` (in roles `|` too, as `&bar;`), so
that no control string can occur in them, and reading back is exact. The loss mask is given as
spans of code points of the formatted text that hold the assistant's texts, and nothing else.

Defined cases: a null text or role is an empty one; turns with the same number are ordered by
role and text; null turn numbers come first; rows of single turns keep their roles as they are,
names of roles inside other layouts become those of ROLES; rows with a null conversation id belong to no
conversation and give none; a layout that no mapping knows gives null turns; no turns give an
empty formatted text; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
END = "</s>\n"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its paths, the ones that may be missing, and how its turns are made.

    turns: pairs of a fixed role and the paths whose texts, those that aren't empty, are joined
    by an empty line; or one pair of the paths of role and text inside an array, or in rows.
    """

    name: str
    kind: str  # "fields", "array" or "rows"
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        named = [p for role, texts in self.turns for p in texts] + [role for role, _ in self.turns if self.kind != "fields"]
        return sorted({*named, *(("turn",) if self.kind == "rows" else ())})


MAPPINGS = (
    Mapping("turn_rows", "rows", (("role", ("text",)),)),
    Mapping("messages", "array", (("messages[].role", ("messages[].content",)),)),
    Mapping("shares", "array", (("conversations[].from", ("conversations[].value",)),)),
    Mapping("instruction", "fields", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Mapping("prompt_response", "fields", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Mapping("prompt_completion", "fields", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", "fields", (("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted({*paths})).encode()).hexdigest()


#: The fingerprints of each mapping, one for each choice of its optional paths, and the paths that it then has.
LAYOUTS: dict[tuple[str, str], tuple[Mapping, frozenset[str]]] = {
    (m.name, fingerprint(have := [p for p in m.paths() if p not in gone])): (m, frozenset(have)) for m in MAPPINGS for n in range(len(m.optional) + 1) for gone in combinations(m.optional, n)
}


def layout_of(paths: list[str]) -> tuple[Mapping, frozenset[str]] | None:
    marks = ((m.name, fingerprint([p for p in paths if p in m.paths()])) for m in MAPPINGS)
    return next((LAYOUTS[x] for x in marks if x in LAYOUTS), None)


def schema_paths(kind: T.DataType, top: str = "") -> list[str]:
    """The nested field paths of a type; `[]` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{top}.{f.name}" if top else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{top}[]")
    return [top]


def _role(raw: Column) -> Column:
    low = F.coalesce(raw.cast("string"), F.lit(""))
    return reduce(lambda c, x: F.when(low == x[0], F.lit(x[1])).otherwise(c), ROLES.items(), low)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns_of(mapping: Mapping, have: frozenset[str], at) -> Column:
    """The turns of a row whose fields at() gives by path."""
    if mapping.kind == "array":
        (role, (text,)) = mapping.turns[0]
        array, role = role.split("[].")
        text = text.split("[].")[1]
        return F.coalesce(F.transform(at(array), lambda x: _turn(_role(x[role]), x[text])).cast(TURNS), F.array().cast(TURNS))
    found = []
    for role, texts in mapping.turns:
        parts = [F.when(at(p).cast("string") != "", at(p).cast("string")) for p in texts if p in have]
        if parts:
            found.append(F.when(F.lit(role != "system") | F.coalesce(*parts).isNotNull(), _turn(F.lit(role), F.concat_ws("\n\n", *parts))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def canonical(df: DataFrame, id: str = "conv_id") -> DataFrame:
    """Rows (id, layout, turns) of a frame in any layout that MAPPINGS declares, chosen by its schema."""
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        return df.select(F.col(id), F.lit(None).cast("string").alias("layout"), F.lit(None).cast(TURNS).alias("turns"))
    mapping, have = layout
    name = F.lit(mapping.name).alias("layout")
    if mapping.kind != "rows":
        return df.select(F.col(id), name, _turns_of(mapping, have, F.col).cast(TURNS).alias("turns"))
    rows = df.where(F.col(id).isNotNull()).select(id, F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(id).agg(turns.alias("turns")).select(id, name, F.col("turns").cast(TURNS).alias("turns"))


def canonical_json(df: DataFrame, json: str, id: str = "conv_id") -> DataFrame:
    """Rows (id, layout, turns) of JSON objects in mixed layouts; each row's own paths, those of all elements of an array, choose its mapping."""
    arrays = sorted({m.turns[0][0].split("[].")[0] for m in MAPPINGS if m.kind == "array"})
    none = F.array().cast("array<string>")
    keys = lambda x: F.coalesce(F.json_object_keys(x), none)
    top = F.filter(keys(F.col(json)), lambda k: ~k.isin(*arrays))
    elements = {a: F.from_json(F.get_json_object(F.col(json), f"$.{a}"), "array<string>") for a in arrays}
    below = lambda a: lambda k: F.concat(F.lit(f"{a}[]."), k)
    nested = [F.transform(F.flatten(F.transform(F.coalesce(x, none), keys)), below(a)) for a, x in elements.items()]
    rows = df.select(F.col(id), F.col(json), F.array_sort(F.array_distinct(F.concat(top, *nested))).alias("__paths"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in reversed([m for m in MAPPINGS if m.kind == "array"]):  # where nothing else is known, an empty array has no turns
        empty = F.size(elements[mapping.turns[0][0].split("[].")[0]]) == 0
        layout = F.when(empty, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(empty, F.array().cast(TURNS)).otherwise(turns)
    for (_, key), (mapping, have) in reversed(LAYOUTS.items()):
        if mapping.kind == "rows":
            continue
        mark = F.sha2(F.array_join(F.filter("__paths", _among(mapping.paths())), "\n"), 256)
        tops = sorted({p.split("[].")[0] for p in have})
        inner = ", ".join(f"{p.split('[].')[1]}: string" for p in sorted(have) if "[]." in p)
        parsed = F.from_json(F.col(json), ", ".join(f"{t} array<struct<{inner}>>" if mapping.kind == "array" else f"{t} string" for t in tops))
        layout = F.when(mark == key, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(mark == key, _turns_of(mapping, have, lambda p, x=parsed: x[p]).cast(TURNS)).otherwise(turns)
    return rows.select(id, layout.alias("layout"), turns.alias("turns"))


def _among(names: list[str]):
    return lambda p: p.isin(*names)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def render(turns: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans (array of start, end) to rows with turns."""
    head = lambda role: F.concat(F.lit("<|"), F.replace(escaped(role), F.lit("|"), F.lit("&bar;")), F.lit("|>\n"))
    heads = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    text = F.array_join(F.expr("transform(__parts, p -> concat(p.head, p.body, '</s>\\n'))"), "")
    spans = F.expr("""aggregate(__parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, end: bigint>>)),
        (s, p) -> named_struct('at', s.at + length(p.head) + length(p.body) + 5, 'spans',
            if(p.loss, concat(s.spans, array(named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body)))), s.spans)),
        s -> s.spans)""")
    return turns.withColumn("__parts", heads).withColumn("formatted", text).withColumn("loss_spans", spans).drop("__parts")


def format_chats(df: DataFrame, id: str = "conv_id", json: str | None = None) -> DataFrame:
    """Rows (id, layout, turns, formatted, loss_spans); json: the column of JSON texts, if that is what df holds."""
    return render(canonical_json(df, json, id) if json else canonical(df, id))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: the inverse of render()."""
    parts = F.split(formatted, "</s>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    head = lambda p: F.substring_index(p, "|>\n", 1)
    role = lambda p: unescaped(F.replace(F.substring(head(p), 3, 1 << 30), F.lit("&bar;"), F.lit("|")))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescaped(F.substr(p, F.length(head(p)) + 4)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
