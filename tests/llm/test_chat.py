import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import chat as op
from sparquill.llm.common import read

TURNS = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_whole_table(spark, sf_dir):
    turns = [tuple(r) for r in read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", op.PROBE), (-1, 1, "assistant", op.PROBE)]
    by = {}
    for c, t, r, x in sorted(turns, key=lambda v: (v[0], v[1])):
        by.setdefault(c, []).append((r or "", x or ""))
    found = {r.conv_id: r for r in op.op7_chat_formatting(spark, sf_dir).collect()}
    assert set(found) == set(by)
    for c, ts in by.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))


def test_conflicting_content_is_escaped_and_read_back(spark):
    odd = ["</s>", "<s>[user]\nx</s>", "\\", "\\l\\b", "a</s", "]", "\\\n", "", "é</s>\U0001f600", "</s></s>", "<\\s>"]
    rows = [(k, t, role, text) for k, text in enumerate(odd) for t, role in enumerate(["user", "assistant", "a]b", "</s>", None])]
    for r in op.format_chats(spark.createDataFrame(rows, TURNS)).collect():
        assert r.identical and [x.text for x in r.parsed] == [odd[r.conv_id]] * 5
        assert [x.role for x in r.parsed] == ["user", "assistant", "a]b", "</s>", ""]
        (span,) = r.loss_spans
        assert r.formatted[span.start : span.start + span.length] == r.parsed[1].body


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("<s>/[]\\\nbl a", max_size=6), st.text("<s>/[]\\\nbl a", max_size=12)), min_size=1, max_size=12))
def test_round_trip_of_any_text(spark, turns):
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    (r,) = op.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert r.identical and [(x.role, x.text) for x in r.parsed] == turns


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "system", None), (2, 5, "assistant", "x" * 200000)]
    found = {r.conv_id: [(t.role, t.text) for t in r.parsed] for r in op.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert found[None] == [("system", ""), ("user", "a"), ("user", "b")]
    assert op.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    assert op.parse.__doc__ and spark.range(1).select(op.parse(op.F.lit("not of the grammar")).alias("p")).first().p is None


def test_clashing_columns_are_left_out(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 3), (1, 1, "assistant", "ho", "y", 4)], "conv_id long, turn long, role string, text string, formatted string, nr int")
    row = op.format_chats(turns).first()
    assert row.identical and [t.text for t in row.parsed] == ["hi", "ho"]
