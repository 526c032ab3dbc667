import hashlib

import oracle
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
text = st.text(st.sampled_from("\\#<:/>turn \nA"), max_size=12)


def test_conversations_as_in_sql(spark):
    oracle.assert_equal(spark, "op8_chat_format")


@given(st.lists(st.tuples(text, text), max_size=5))
@settings(max_examples=200, deadline=None)
def test_turns_come_back(turns):
    whole, of_turn, of_text, rewrites = chat.spans(turns, chat.marked_turns)
    assert chat.read_turns(whole) == turns and not rewrites
    assert [chat.unescaped(whole[a:b]) for a, b in of_text] == [t for _, t in turns]
    assert [a for a, _ in of_turn] + [len(whole)] == [0] + [b for _, b in of_turn]


def plain(turns):
    return "".join(f"[{r}] {t}\n" for r, t in turns)


def only_last(turns):
    """Drops what was said before the last turn of the user."""
    at = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=0)
    return "".join(f"[{r}] {t if i >= at else '...'}\n" for i, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    whole, of_turn, of_text, rewrites = chat.spans(turns, only_last)
    assert rewrites and of_text[1] is None and whole[slice(*of_text[3])] == "d"
    whole, of_turn, of_text, rewrites = chat.spans(turns, plain)
    assert not rewrites and [whole[slice(*s)] for s in of_text] == ["a", "b", "c", "d"]


def test_order_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, None, None),
            (None, 1, "assistant", "x"), (2, 1, "user", "long " * 100_000), (2, 2, "assistant", "é" * 10)]
    got = chat.formatted(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    assert {r.conv_id: (r.n_turns, r.rewrites) for r in got.collect()} == {1: (4, False), None: (1, False), 2: (2, False)}
    read = {r.conv_id: r for r in chat.read_back(got).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert read[1].turns_sha256 == sha("\n\nuser\na\nassistant\nb\nassistant\nb\n")
    assert (read[1].loss_chars, read[1].loss_sha256) == (2, sha("bb"))
    assert (read[2].loss_chars, read[2].loss_sha256) == (10, sha("é" * 10))


def test_no_conversations(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
