import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tillroll.llm import chat, queries

NASTY = st.text(alphabet="\\#<:>/ turn\nas", max_size=30) | st.sampled_from(["</turn>", "### ", "\\", "\\\\", "### assistant: x</turn>\n", ": ", "\\</turn>", "a\\", queries.CONFLICT])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "", "###", "\\"]) | NASTY, NASTY), max_size=5))
def test_round_trip(turns):
    text = chat.render(turns)
    assert chat.parse(text) == turns
    spans = chat.loss_spans(text)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_plain_text_stays_plain():
    assert chat.render([("user", "Hello \\o/ #1: x < y")]) == "### user: Hello \\o/ #1: x < y</turn>\n"


def test_control_strings_are_escaped():
    text = chat.render([("user", queries.CONFLICT)])
    assert text.count("</turn>") - text.count("\\</turn>") == 1


@pytest.mark.parametrize("text", ["x", "### user", "### user: a", "### user: a</turn>", "### user: a ### b</turn>\n"])
def test_wrong_grammar(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def digests(conv, turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (conv, len(turns), digest(said), len(loss), digest(loss), len(chat.render(turns)))


def test_query(spark, small):
    convs = {-7: [("user", queries.CONFLICT), ("assistant", queries.CONFLICT)]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = sorted(tuple(r) for r in queries.op10_chat(spark, small).collect())
    assert got == sorted(digests(c, t) for c, t in convs.items())


def test_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, None, None, None), (1, 2, "user", "b"), (1, 1, "assistant", "x" * 300_000), (None, 0, "user", "no id"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss_spans")
    got = {r[0]: tuple(r) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1] == digests(1, [("", ""), ("assistant", "x" * 300_000), ("user", "b"), ("user", "b")])
    assert got[None] == digests(None, [("user", "no id")])
    assert got[2] == digests(2, [("assistant", "")])
    assert chat.format_conversations(df.where("1 = 0")).count() == 0
