"""Formatting reads back exactly."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from textmatch.llm import chat

from .cases import with_clashes

PARTS = st.sampled_from(
    ["<", ">", "/", "s", "s>", "<s>", "</s>", "[", "]", "\\", "\\\\", "INST", "/INST", "[INST]", "[/INST]", "[TURN user]", "[/TURN]",
     "[MASK]", "[/MASK]", "<<SYS>>", "<|", "|", " ", "\n", "é", "x", "[\\TURN", "[\\\\/TURN]"]
)
TEXTS = st.lists(PARTS, max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "a b", "[x]", "é%", "user\n"])


@given(st.lists(st.tuples(ROLES, TEXTS), max_size=5))
@settings(max_examples=600, deadline=None)
def test_round_trip(turns):
    text = chat.render(turns)
    assert chat.parse(text) == [(r, t, r == "assistant") for r, t in turns]
    assert chat.parse(text) == chat.parse(text)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_only_conflicts_are_escaped(text):
    rendered = chat.render_turn("user", text)
    plain = f"[TURN user]{text}[/TURN]"
    clash = any(c in text for c in ("<s>", "</s>", "[INST", "[/INST", "[TURN", "[/TURN", "[MASK", "[/MASK", "<<", "<|", "\\"))
    assert rendered == plain or clash


def test_what_is_no_conversation_fails():
    for bad in ("", "<s>", "<s>x</s>", "<s>[TURN user]a</s>", "<s>[TURN user]<s>[/TURN]</s>", "[TURN user]a[/TURN]"):
        with pytest.raises(chat.FormatError):
            chat.parse(bad)


def test_tables(spark):
    draw = random.Random(1)
    rows = [(c, t, ("user", "assistant")[t % 2], draw.choice(("</s>[INST] ok [/INST]", "hi\\", "", None, "[\\/TURN] é"))) for c in range(9) for t in range(c)]
    rows += [(20, i, "assistant" if i % 3 else "user", f"turn {i}") for i in range(3000)]  # one that is long
    rows += [(None, 0, "user", "a"), (None, 1, None, None), (30, None, "user", "b"), (30, 1, "tool", "c"), (31, 0, "user", "x" * 200_000), (32, 0, "assistant", "z"), (32, 0, "assistant", "z")]
    table = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.round_trip(table).collect()}
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        groups.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.render(turns))
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(chat.format_turns(table)).collect()}
    assert chat.parse(whole[5]) == [(r, t, r == "assistant") for r, t in groups[5]]


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.round_trip(empty).count() == 0
