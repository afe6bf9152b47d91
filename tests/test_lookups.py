"""Vocabulary look-ups in tasks against joins."""

import random

import pytest
from pyspark.sql import functions as F

from textmatch.functions.unicode import basic_tokens, clean_characters, space_ideographs, space_punctuation, strip_accents, word_array
from textmatch.operators import encoding as E, tokens as K

from test_training import PIECES, vocabulary


def texts(spark):
    draw = random.Random(3)
    rows = [(i, 0, " ".join("".join(draw.choices("abcé!", k=draw.randint(1, 9))) for _ in range(draw.randint(0, 20)))) for i in range(60)]
    rows += [(100, 0, None), (101, 0, ""), (102, 0, "a" * 201 + " ab"), (103, 0, "ab ||| c abc"), (104, 0, " \t\n")]
    return spark.createDataFrame(rows, "doc_id int, pos int, sentence string").repartition(3)


def both(monkeypatch, run):
    """The result with look-ups in tasks, and by joins."""
    narrow = sorted(map(str, run().collect()))
    monkeypatch.setattr(K, "MAX_VOCABULARY_BYTES", 0)
    return narrow, sorted(map(str, run().collect()))


def test_tokens_are_those_of_the_join(spark, monkeypatch):
    df, vocab = texts(spark), vocabulary(spark, PIECES)
    narrow, joined = both(monkeypatch, lambda: K.tokenize(df, vocab))
    assert narrow == joined and len(narrow) == 65


def test_model_inputs_are_those_of_the_join(spark, monkeypatch):
    df, vocab = texts(spark), vocabulary(spark, PIECES)
    narrow, joined = both(monkeypatch, lambda: E.encode_texts(df, vocab, length=16))
    assert narrow == joined


def test_ids_and_tokens_are_those_of_the_join(spark, monkeypatch):
    vocab = vocabulary(spark, PIECES)
    lists = spark.createDataFrame([(1, ["ab", "##c", "ab"]), (2, []), (3, None), (4, ["[UNK]"])], "k int, tokens array<string>")

    def run():
        ids = K.tokens_to_ids(lists, vocab, ["k"])
        return ids.join(K.ids_to_tokens(ids, vocab, ["k"]), "k")

    narrow, joined = both(monkeypatch, run)
    assert narrow == joined
    wrong = spark.createDataFrame([(1, ["nope"])], "k int, tokens array<string>")
    for limit in (0, 1 << 20):
        monkeypatch.setattr(K, "MAX_VOCABULARY_BYTES", limit)
        with pytest.raises(Exception, match="not in the vocabulary: nope"):
            K.tokens_to_ids(wrong, vocab, ["k"]).collect()


def test_no_row_moves(spark):
    plan = K.tokenize(texts(spark).coalesce(2), vocabulary(spark, PIECES)).drop("pos")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and text.count("Exchange") == 1  # the repartition of the test's own table


def test_ascii_texts_take_the_short_way(spark):
    """The short pattern gives what the whole chain gives."""
    draw = random.Random(4)
    chars = [chr(c) for c in range(128)] + ["é", "漢", " ", " ", "ß", "İ"]
    rows = [("".join(draw.choices(chars[: 128 if i % 2 else None], k=40)),) for i in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    for lower in (True, False):
        spaced = space_ideographs(clean_characters(F.col("t")))
        spaced = strip_accents(F.lower(spaced)) if lower else spaced
        chain = word_array(space_punctuation(spaced))
        assert df.filter(~basic_tokens(F.col("t"), lower).eqNullSafe(chain)).count() == 0


def test_a_filter_on_pieces_does_not_find_them_twice(spark):
    toks = K.tokenize(texts(spark), vocabulary(spark, PIECES))
    for rows in (toks.filter(F.size("ids") > 0), toks.select("doc_id", F.explode("tokens"))):
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("items", [1, 5, 64])
def test_a_batch_is_looked_up_by_parts(spark, monkeypatch, items):
    import pyarrow as pa

    monkeypatch.setattr(K, "PART_ITEMS", items)
    draw, sizes = random.Random(items), []
    rows = [None if draw.random() < 0.2 else ["x"] * draw.choice((0, 1, 2, 9)) for _ in range(80)]

    def look_up(part):
        sizes.append(sum(len(r or ()) for r in part.to_pylist()))
        return pa.array([len(r or ()) for r in part.to_pylist()])

    column = pa.array([["y"], *rows], pa.list_(pa.string())).slice(1)
    assert K._in_parts(column, look_up).to_pylist() == [len(r or ()) for r in rows]
    assert max(sizes) < items + 9 and len(K._in_parts(column.slice(0, 0), look_up)) == 0
