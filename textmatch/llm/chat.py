"""Chat formatting that reads back exactly.

A turn is rendered as ``[TURN role]text[/TURN]``, an assistant's turn inside
``[INST]``-style marks of its own, and a conversation as the turns end to end between
``<s>`` and ``</s>``. A deterministic parser reads the marks back. Where a text holds
something that the parser would take for a mark, the rendered turn does not read back as
it was; the text is then escaped step by step until it does:

1. as it is;
2. a backslash is put inside each control string (``[/INST]`` becomes ``[\\/INST]``);
3. control strings that already hold backslashes get one more.

The parser takes one backslash out of each control string that holds some, so step 3 is
the inverse of the parser for any text, and the loop ends. Texts without control strings
stay as they are.

Turns are rendered and checked row by row, without a shuffle; what is stored is one row
per turn, so a conversation of any length is never one value. Reading back sorts the
turns of a conversation and passes them through running digests, so memory does not grow
with a conversation either.

Defined results: null texts and roles are empty; turns go by turn number (null first),
then by their rendered text; rows that agree in all are turns of their own; rows with a null
``conv_id`` form one conversation; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

BEGIN, END = "<s>", "</s>"
ASSISTANT = "assistant"
# What makes a control string, seen from its first character: <s>, </s>, <<,
# <|, [INST, [TURN, [SYS, [MASK and their closing forms, with any backslashes put inside.
_CONTROL = re.compile(r"<\\*(?=/?s>|<|\|)|\[\\*(?=/?(?:INST|TURN|SYS|MASK))")
_TURN = re.compile(r"\[TURN ([^\]]*)\](\[MASK\])?", re.DOTALL)
_CLOSE = {True: "[/MASK][/TURN]", False: "[/TURN]"}


class FormatError(ValueError):
    """The text is not a formatted conversation."""


def _groups(match: re.Match) -> tuple[str, str]:
    """The first character and the backslashes after it."""
    return match.group(0)[0], match.group(0)[1:]


def escape(text: str, level: int) -> str:
    """Escape control strings: none, those without backslashes, or all."""
    if level == 0:
        return text

    def put(match: re.Match) -> str:
        head, slashes = _groups(match)
        return match.group(0) if slashes and level == 1 else head + "\\" + slashes

    return _CONTROL.sub(put, text)


def unescape(text: str) -> str:
    """Take one backslash out of each control string that holds some."""

    def take(match: re.Match) -> str:
        head, slashes = _groups(match)
        return head + slashes[1:]

    return _CONTROL.sub(take, text)


def escape_role(role: str) -> str:
    """A role as one word without brackets or line ends."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else f"%{ord(c):x}." for c in role)


def unescape_role(role: str) -> str:
    return re.sub(r"%([0-9a-f]+)\.", lambda m: chr(int(m.group(1), 16)), role)


def parse_turn(text: str) -> tuple[str, str, bool]:
    """(role, text, is under the loss mask) of one rendered turn; fails on anything else."""
    opened = _TURN.match(text)
    if not opened:
        raise FormatError("no turn begins here")
    masked = opened.group(2) is not None
    close = _CLOSE[masked]
    body = text[opened.end() :]
    if not body.endswith(close):
        raise FormatError("the turn does not end")
    body = body[: len(body) - len(close)]
    # A control string without a backslash is a mark, and marks end a text.
    if any(not _groups(m)[1] for m in _CONTROL.finditer(body)):
        raise FormatError("a mark inside a text")
    if not masked and body.startswith("[MASK]"):
        raise FormatError("a mark inside a text")
    return unescape_role(opened.group(1)), unescape(body), masked


def render_turn(role: str, text: str) -> str:
    """Render a turn, escaping no more than it takes to read back identically."""
    masked = role == ASSISTANT
    opening = f"[TURN {escape_role(role)}]" + ("[MASK]" if masked else "")
    for level in (0, 1, 2):
        whole = opening + escape(text, level) + _CLOSE[masked]
        try:
            if parse_turn(whole) == (role, text, masked):
                return whole
        except FormatError:
            continue
    raise FormatError("a text that does not read back")  # cannot happen: level 2 is exact


def render(turns: list[tuple[str, str]]) -> str:
    """A whole conversation as text; for reading by eye and for tests."""
    return BEGIN + "".join(render_turn(r, t) for r, t in turns) + END


def parse(text: str) -> list[tuple[str, str, bool]]:
    """Turns of a whole conversation."""
    if not (text.startswith(BEGIN) and text.endswith(END) and len(text) >= len(BEGIN) + len(END)):
        raise FormatError("not a conversation")
    body, out = text[len(BEGIN) : len(text) - len(END)], []
    # Inside texts every control string holds a backslash, so a plain one ends a turn.
    while body:
        end = body.find("[/TURN]")
        if end < 0:
            raise FormatError("the turn does not end")
        out.append(parse_turn(body[: end + len("[/TURN]")]))
        body = body[end + len("[/TURN]") :]
    return out


# ---- tables ----------------------------------------------------------------------


def format_turns(rows: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, turn, role, text (for order), rendered.

    ``rows`` has conv_id, turn, role and text.
    """

    @F.pandas_udf("string")
    def run(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([render_turn(r or "", t or "") for r, t in zip(roles, texts)], dtype=object)

    return rows.select(
        "conv_id", "turn", run(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("rendered")
    )


def read_back(stored: DataFrame) -> DataFrame:
    """One row per conversation, from its rendered turns alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        none = object()
        key, state = none, None
        for batch in batches:
            done = []
            for conv_id, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv_id != key or key is none:
                    if state is not None:
                        done.append(finish(key, state))
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN) + len(END)]
                role, text, masked = parse_turn(rendered)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                state[4] += len(rendered)
                if masked:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "replace"))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([finish(key, state)], schema=arrow)

    def finish(key, state):
        return {
            "conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
            "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4],
        }

    arrow = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    ordered = stored.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select(F.col("conv_id").cast("long"), "rendered").mapInArrow(run, schema)


def conversations(stored: DataFrame) -> DataFrame:
    """Whole texts: conv_id, formatted. For tables whose conversations fit one value."""
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn"), "rendered")))
    joined = F.concat_ws("", F.transform(turns, lambda t: t["rendered"]))
    return stored.groupBy("conv_id").agg(F.concat(F.lit(BEGIN), joined, F.lit(END)).alias("formatted"))


def round_trip(rows: DataFrame) -> DataFrame:
    """Format, store, read back."""
    return read_back(written(format_turns(rows), "chat"))
