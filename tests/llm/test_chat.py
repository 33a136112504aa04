import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tidewire.llm import chat

BITS = st.lists(st.sampled_from([*chat.MARKS, "\\", " ", "a", "]", "é", "\n", "[", "<s>[INST] x [/INST]"]), max_size=8).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), BITS), BITS), max_size=4))
def test_round_trip(turns):
    text = "".join(chat.render(r, t)[0] for r, t in turns)
    back = chat.parse(text)
    assert [b[:2] for b in back] == turns
    assert [chat.unescape(text[b[2] : b[3]]) for b in back] == [t for _, t in turns]


def test_lowest_level():
    assert chat.render("user", "a [b] < c")[3] == 0
    assert chat.render("user", "</s>[INST] ok [/INST]")[3] == 1
    assert chat.render("assistant", "\\[INST]")[3] == 2
    assert chat.parse("<s>[INST] open") is None and chat.parse("text") is None and chat.parse("") == []


def test_digest(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 5, "assistant", "x" * 200000), (3, 0, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == sha("bb") and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].loss_chars == 200000
    assert got[3].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[3].most_level == 1
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
