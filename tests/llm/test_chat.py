import hashlib

from hypothesis import given, settings, strategies as st

from gridspark.llm.chat import escape, format_conversations, locate, locate_long, parse_tagged, tagged_template, unescape
from gridspark.llm.queries import op1_chat_formatting

TEXT = st.text(alphabet=st.sampled_from("\\<>/turn\nlé #:\ue000\U0001f600"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_round_trip_and_spans(turns):
    out, spans, texts, bad = locate(tagged_template, turns)
    assert parse_tagged(out) == turns and bad is None and out == tagged_template(turns)
    assert [unescape(out[a:b]) for a, b in texts] == [t for _, t in turns]
    assert "".join(out[a:b] for a, b in spans) == out
    assert all("<" not in escape(t) for _, t in turns)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=30), st.integers(1, 5))
def test_blocks_give_what_whole_prefixes_give(turns, block):
    assert locate_long(tagged_template, turns, block) == locate(tagged_template, turns)


def numbered(turns):
    return "BOS" + "".join(f"[{i}|{r}]{t}[/]" for i, (r, t) in enumerate(turns))


def hides_thoughts(turns):
    """Shows the text of the last turn only in full, as templates do that drop reasoning."""
    return "".join(f"<{r}>{t if i == len(turns) - 1 else t[:1]}</>" for i, (r, t) in enumerate(turns))


def with_summary(turns):
    return f"{len(turns)} turns\n" + "".join(t for _, t in turns)


def test_templates_with_memory_are_rendered_in_full():
    turns = [("user", f"text {i}") for i in range(20)]
    out, spans, texts, bad = locate_long(numbered, turns, 4)
    assert bad is None and out == numbered(turns) and [out[a:b] for a, b in texts] == [t for _, t in turns]


def test_rewriting_templates_are_detected():
    turns = [("user", "a"), ("assistant", "long thought"), ("user", "b"), ("assistant", "c")]
    assert locate(hides_thoughts, turns)[3] == 2   # the third prefix shortens the second turn
    assert locate(with_summary, turns)[3] == 0
    out, spans, texts, bad = locate_long(hides_thoughts, turns, 2)
    assert bad == 2 and set(spans) == set(texts) == {(-1, -1)} and out == hides_thoughts(turns)


def test_spark_rows(spark):
    rows = [(1, 2, "assistant", "yes <turn>"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "yes <turn>"),
            (None, 0, "assistant", "no id"), (3, 0, "assistant", "x" * 200_000), (4, 0, "user", "")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, roles string")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert parse_tagged(got[1].formatted) == [("", "first"), ("user", ""), ("assistant", "yes <turn>"), ("assistant", "yes <turn>")]
    assert [unescape(got[1].formatted[m.start:m.end]) for m in got[1].loss_mask] == ["yes <turn>"] * 2
    assert parse_tagged(got[None].formatted) == [("assistant", "no id")] and got[3].loss_mask[0].end > 200_000
    assert got[4].loss_mask == [] and all(r.rewritten_at is None for r in got.values())
    assert format_conversations(df.limit(0)).count() == 0
    hidden = format_conversations(df, template=hides_thoughts).where("conv_id = 1").first()
    assert hidden.rewritten_at is not None and hidden.loss_mask == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r, x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest(), len(tagged_template([(r, x) for _, r, x in turns])))
    assert {r.conv_id: tuple(r)[1:] for r in op1_chat_formatting(spark, d).collect()} == want
