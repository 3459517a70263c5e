import hashlib
import json

from conftest_llm import table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modspark.llm import chat_format as C
from modspark.llm.queries import op8_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<|user|>\n", "&lt;", "&amp;lt;", "a</s>\n<|assistant|>\nb", "", None, "\n", "&", "<", "é\U0001f600", "&bar;|>"]


def back(df):
    out = C.format_chats(df)
    rows = out.select("conv_id", "turns", C.read_turns(F.col("formatted")).alias("read"), C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans")
    return {r.conv_id: r for r in rows.collect()}


def test_round_trip_of_odd_texts(spark):
    rows = [(k, t, "assistant" if t % 2 else "user", ODD[(k + t) % len(ODD)]) for k in range(12) for t in range(k % 5 + 1)]
    rows += [(90, 0, "a|>\n<b&", "x"), (91, None, None, None), (91, 1, "assistant", "y"), (None, 0, "user", "z"), (92, 3, "assistant", "second"), (92, 3, "assistant", "first")]
    found = back(spark.createDataFrame(rows, SCHEMA))
    assert set(found) == {r[0] for r in rows} - {None}
    for k, r in found.items():
        mine = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == k)
        assert [(x.role, x.text) for x in r.read] == [(role, text) for _, role, text in mine] == [(x.role, x.text) for x in r.turns]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        spans = [(s.start, s.end) for s in r.loss_spans]
        assert all(a <= b for a, b in spans) and spans == sorted(spans)
        inside = "".join(r.formatted[a:b] for a, b in spans)
        assert "</s>" not in inside and "<|" not in inside


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="&<>|s/alt;gmp[]INST \n", max_size=12), min_size=1, max_size=30))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<" not in r.e


def test_layouts_by_schema(spark):
    frames = {
        "messages": spark.createDataFrame([(1, [("system", "s"), ("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role: string, content: string>>"),
        "shares": spark.createDataFrame([(1, [("system", "s"), ("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`: string, value: string>>"),
        "prompt_response": spark.createDataFrame([(1, "s", "q", "a")], "conv_id long, system string, prompt string, response string"),
        "instruction": spark.createDataFrame([(1, "s", "q", "", "a", 5)], "conv_id long, system string, instruction string, input string, output string, extra long"),
    }
    for name, df in frames.items():
        r = C.canonical(df).first()
        assert r.layout == name
        assert [tuple(t) for t in r.turns] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    pair = C.canonical(spark.createDataFrame([(1, "q", "a")], "conv_id long, question string, answer string")).first()
    assert [tuple(t) for t in pair.turns] == [("user", "q"), ("assistant", "a")]
    assert C.canonical(spark.createDataFrame([(1, 2)], "conv_id long, other long")).first().turns is None


def test_layouts_by_row(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "more", "output": "a"},
        {"instruction": "q", "output": "a"},
        {"prompt": "q", "completion": "a", "source": {"x": 1}},
        {"prompt": "q", "response": "a", "system": "s"},
        {"something": "else"},
        None,
    ]
    df = spark.createDataFrame([(k, None if r is None else json.dumps(r)) for k, r in enumerate(rows)] + [(50, "not json")], "conv_id long, j string")
    out = {r.conv_id: r for r in C.format_chats(df, json="j").collect()}
    assert [out[k].layout for k in range(8)] == ["messages", "shares", "instruction", "instruction", "prompt_completion", "prompt_response", None, None]
    pair = [("user", "q"), ("assistant", "a")]
    assert [[tuple(t) for t in out[k].turns] for k in (0, 1, 3, 4)] == [pair] * 4
    assert [tuple(t) for t in out[2].turns] == [("user", "q\n\nmore"), ("assistant", "a")]
    assert [tuple(t) for t in out[5].turns] == [("system", "s"), *pair]
    assert out[50].turns is None and out[6].turns is None
    assert out[0].formatted == "<|user|>\nq</s>\n<|assistant|>\na</s>\n"


def test_arrays_whose_first_element_says_too_little(spark):
    rows = [
        {"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt"}]},
        {"messages": []},
        {"conversations": [], "id": 3},
        {"messages": [], "prompt": "q", "response": "a"},
        {"messages": [], "conversations": [{"from": "human", "value": "q"}]},
        {"messages": "none"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "conv_id long, j string")
    out = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns], r.formatted) for r in C.format_chats(df, json="j").collect()}
    assert out[0][:2] == ("messages", [("system", ""), ("user", "q"), ("assistant", "a")])
    assert out[1][:2] == ("shares", [("user", "q"), ("assistant", "")])
    assert out[2] == ("messages", [], "") and out[3] == ("shares", [], "")
    assert out[4][:2] == ("prompt_response", [("user", "q"), ("assistant", "a")])
    assert out[5][:2] == ("shares", [("user", "q")])
    assert out[6][:2] == (None, None)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hé"), (1, 1, "assistant", "<ok>")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {1, -7}
    assert out[1].turns_sha256 == hashlib.sha256("user\nhé\nassistant\n<ok>\n".encode()).hexdigest()
    assert (out[1].loss_chars, out[1].loss_sha256) == (4, hashlib.sha256(b"<ok>").hexdigest())
    assert out[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.format_chats(none).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    wide = df.withColumns({c: F.lit("theirs") for c in ("turns", "layout", "formatted", "loss_spans", "t")})
    assert table(C.format_chats(wide)) == table(C.format_chats(df))
