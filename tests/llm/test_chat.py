import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import chat

from .brute import sha


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "a", "\n", "</", "é"]), max_size=12).map("".join))
def test_round_trip(text):
    formatted, start, end, _ = chat.format_turn(text, [chat.Part("text", text)])
    assert chat.read_turn(formatted) == (text, [text] if text else [])
    assert chat.unescape(formatted[start:end]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_parts():
    parts = [chat.Part("text", "see <|image|>"), chat.Part("image", uri="a.png", units=2), chat.Part("audio", uri="b.wav", units=3), chat.Part("text", "\\"), chat.Part("document", uri="c.pdf")]
    formatted, start, end, seen = chat.format_turn("user", parts)
    assert [a["uri"] for a in seen.attachments] == ["a.png", "b.wav", "c.pdf"]
    assert seen.expanded_tokens == 2 * 256 + 3 * 25 + 512
    assert all(formatted[start + a["at"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in seen.attachments)
    assert chat.read_turn(formatted) == ("user", ["see <|image|>", "<|image|>", "<|audio|>", "\\", "<|document|>"])
    with pytest.raises(ValueError):
        chat.format_turn("user", [chat.Part("video")])


@given(st.lists(st.sampled_from(["<|e", "nd|>", "<|", "turn|>", "\\", "<", "/s>", "[INST", "]", None]), max_size=8))
def test_adjacent_texts(pieces):
    """None is an image; texts next to each other read back as one."""
    parts = [chat.Part("image") if x is None else chat.Part("text", x) for x in pieces]
    formatted, *_ = chat.format_turn("user", parts)
    want, run = [], ""
    for x in [*pieces, None]:
        if x is None:
            want += ([run] if run else []) + ["<|image|>"]
            run = ""
        else:
            run += x
    assert chat.read_turn(formatted) == ("user", want[:-1])


def test_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi </s>", "a\\b <|end|>", "x" * 5000])) for c in [*range(30), None] for t in range(rng.randint(1, 6))]
    rows += [(2, 0, "user", "tie"), (2, 0, "user", "tie"), (5, None, "user", "no turn")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as turn_no", "2 as formatted", "3 as loss_start")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(chat.with_probe(df))).collect()}
    probe = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    key = lambda x: (x is not None, x)
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: [key(x) for x in r[1:]])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    assert got == want
    assert chat.read_back(chat.format_conversations(df.filter("false"))).count() == 0


def test_typed_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", None, [("text", "look", None, None), ("image", None, "i.png", 4)])], "conv_id long, turn long, role string, text string, content array<struct<kind:string,text:string,uri:string,units:int>>")
    row = chat.format_conversations(df, "content").first()
    assert row["attachments"][0]["uri"] == "i.png" and row["expanded_tokens"] == 1024 and row["formatted"].count("<|image|>") == 1
