"""Repairs against every string of edits, and tables against one symbol at a time."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textmatch.llm import repair

from .cases import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault), by growing all edit strings.

    Of the strings that reach one place with one cost only the least can be the start of
    the least whole one, since each row gives one of D, K, R and inserts cost.
    """

    def better(table, place, cost, audit, out):
        if place not in table or (cost, audit) < table[place][:2]:
            table[place] = (cost, audit, out)
            return True
        return False

    def insert(table):
        todo = list(table)
        while todo:
            place = todo.pop()
            cost, audit, out = table[place]
            to = STEP[place, DUE[place][0]]
            if better(table, to, cost + 2, audit + "I", out + [f"{DUE[place]}:"]):
                todo.append(to)
        return table

    now = insert({0: (0, "", [])})
    for role, text, fault in rows:
        new, cut = {}, fault == "truncated"
        for place, (cost, audit, out) in now.items():
            better(new, place, cost + 3, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            if (place, role[:1]) in STEP:
                better(new, STEP[place, role[:1]], cost + cut, audit + "K", out + [f"{role}:{text}"])
            to = STEP[place, DUE[place][0]]
            better(new, to, cost + 2 + cut, audit + "R", out + [f"{DUE[place]}:{text}"])
        now = insert(new)
    return min(now[p] for p in (0, 3) if p in now)


def plain(rows):
    """All columns of one conversation, from its rows (turn, role, text) before damage."""
    out = []
    conv = rows[0][0]
    for _, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(turn, role, text)] * (2 if case == 3 else 1)
    tie = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))
    seen, judged = set(), []
    for _, role, text in out:
        words = re.sub("[ \t-\r]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, repaired = cheapest(judged)
    turns = [r[0] for r in out if r[0] is not None]
    count = lambda f: sum(j[2] == f for j in judged)
    legal = {"su", "ua", "au"}
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(a[0][:1] + b[0][:1] not in legal for a, b in zip(judged, judged[1:])), cost, audit,
        hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    )


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows(seed=5):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "us"], ["Fine.", "cut off", " ", "", None, "Why? ", "Ü 漢!", "two.\nlines", "x."]
    out = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = draw.choice(texts) if draw.random() < 0.5 else f"text {draw.random()}."
            out.append((conv, None if draw.random() < 0.1 else turn * draw.choice((1, 1, 2)), role, text))
    out += [(100, 3, "user", "Same."), (100, 3, "user", "Same."), (100, 3, "assistant", "Same.")]
    out += [(101, i, ("user", "assistant")[i % 2], "word " * 300 + f"{i}.") for i in range(300)]  # over many tasks
    out += [(102, None, "user", None), (103, -7, "system", "s."), (104, 5, "user", "x" * 300_000)]
    return out


def expected(table):
    by_conv = {}
    for r in table:
        by_conv.setdefault(r[0], []).append(r)
    return sorted(map(str, map(plain, by_conv.values())))


def got(frame):
    return sorted(str(tuple(r[n] for n in NAMES)) for r in frame.collect())


@pytest.mark.parametrize("part_bytes, chunk_bytes", [(1 << 26, 1 << 23), (4000, 1500), (1 << 26, 500)])
def test_damaged_conversations(spark, part_bytes, chunk_bytes):
    table = with_clashes(spark.createDataFrame(rows(), SCHEMA)).repartition(4)
    found = repair.repair(repair.damage(table), part_bytes, chunk_bytes)
    assert sorted(found.columns) == sorted(NAMES)
    assert got(found) == expected(rows())


def test_one_row_repeated_often(spark):
    """A row that a third of the table repeats is one row with a number."""
    table = spark.range(40_000).selectExpr("1L AS conv_id", "2L AS turn", "'user' AS role", "'Yes.' AS text")
    (row,) = repair.repair(table).collect()
    assert (row["duplicate"], row["illegal"], row["gaps"]) == (39_999, 39_999, 0)
    # Keep, insert the answer, or delete all: the copies go either way.
    assert row["cost"] == 2 + 3 * 39_999 and row["audit"] == "K" + "D" * 39_999 + "I"


def test_empty_table_and_repeats_under_many_turns(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    table = [(1, t, "user", "Hello.") for t in range(500)] + [(2, t, "assistant", f"{t}.") for t in range(3)]
    found = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(table, SCHEMA), part_bytes=4000).collect()}
    assert found[1]["duplicate"] == 499 and found[1]["cost"] == 2 + 3 * 499
    assert found[2]["audit"] == cheapest([("assistant", f"{t}.", "") for t in range(3)])[1]


CODES = st.lists(st.integers(0, 8), max_size=40)


def as_rows(codes):
    return [("suax"[c % 4], "t", "blank" if c == 8 else "truncated" if c > 3 else "") for c in codes]


@settings(max_examples=300, deadline=None)
@given(CODES, st.sampled_from([1, 2, 3, 4]))
def test_blocks_equal_plain(codes, block):
    cost, edits, places = repair.trace(np.array(codes, dtype=np.uint8), block=block)
    assert (cost, "".join(edits) + repair.last_edits(places[-1])) == cheapest(as_rows(codes))[:2]


@settings(max_examples=100, deadline=None)
@given(CODES, CODES)
def test_effects_compose(first, second):
    """Two segments joined by their effects are traced as one."""
    left, right = (np.array(c, dtype=np.uint8) for c in (first, second))
    vector, cost, places = repair.effect(right)
    behind_left = int(vector[0])
    _, edits, around = repair.trace(left, behind_left)
    _, more, end = repair.trace(right, 0, around[-1])
    whole = repair.trace(np.concatenate((left, right)))
    assert (edits + more, end[-1]) == (whole[1], whole[2][-1]) and places[0][around[-1]] == end[-1]
    vector, more_cost, _ = repair.effect(left)
    assert cost[0] + more_cost[behind_left] + repair.tables().vectors[int(vector[behind_left])][0] == whole[0]


def test_few_vectors():
    assert len(repair.tables().vectors) < 100
    for v in repair.tables().vectors:
        assert min(v) == 0 and max(v) <= 9
