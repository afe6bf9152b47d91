"""Text rules restated in plain Python."""

import re
import unicodedata

from pyspark.sql import functions as F

from textmatch.functions import text as T, unicode as U
from textmatch.operators import encoding as E, sentences as S
from textmatch.options import OPENING_BORDERS, STOP_WORDS

LONG = " ".join(f"kata{c}" for c in "abcdefghijklmnopqrstuvwxyzabcdef")


def plain_clean(s):
    s = s.replace("\\n", "").replace("\n", "")
    s = re.sub("[^.a-zA-Z ]+", "", s).replace(" .", ".")
    return " ".join(s.split())


def test_fixed_values():
    assert len(STOP_WORDS) == 68 and len(OPENING_BORDERS) == 43
    assert OPENING_BORDERS[0] == "BAB I \nPENDAHULUAN" and OPENING_BORDERS[1] == "BAB I \\nPENDAHULUAN"


def test_sentences(spark):
    docs = [(1, f"Short one. {LONG}\nnext LINE\\nmore 123 !. {LONG} . tail"), (2, ""), (3, "no dot")]
    got = S.sentences(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    want = []
    for doc_id, text in docs:
        kept = [c for c in map(plain_clean, text.lower().split(".")) if c.count(" ") > 26]
        want += [(doc_id, i, s) for i, s in enumerate(kept)]
    assert sorted(map(tuple, got)) == want and len(want) == 2


def test_paragraphs_of_chapters(spark):
    body = "\n\n".join(f"{LONG} nomor {i}" for i in range(25))
    text = f"Judul\nBAB I PENDAHULUAN awal BAB II x BAB III {body} BAB V akhir"
    cut = text.split("BAB I PENDAHULUAN")[1]
    cut = re.search("(?s)BAB III(.*)BAB V", cut).group(0)
    want = [p for p in map(plain_clean, cut.split("\n\n")) if p.count(" ") > 26]
    df = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    got = [r.sentence for r in S.paragraphs(df).orderBy("pos").collect()]
    assert got == want and len(got) == 25


def plain_tokens(text):
    out = []
    for c in text:
        cat = unicodedata.category(c)
        if c in "\t\n\r" or cat == "Zs":
            out.append(" ")
        elif c == "�" or cat in ("Cc", "Cf"):
            continue
        elif any(a <= ord(c) <= b for a, b in U.IDEOGRAPHS):
            out.append(f" {c} ")
        else:
            out.append(c)
    plain = unicodedata.normalize("NFD", "".join(out).lower())
    spaced = ""
    for c in plain:
        cat = unicodedata.category(c)
        if cat == "Mn":
            continue
        ascii_punct = 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126
        spaced += f" {c} " if ascii_punct or cat.startswith("P") else c
    return spaced.split()


def test_basic_tokens(spark):
    texts = [
        "Héllo, wörld! naïve—test", "中文字符 and 한국어 말", "a b c​d\tE\x07f", "ﬁ Åström Ğ İx ÑÇ", "",
        "ୋ x ో ৌ ꥓ 𑂚", "plain ascii [x]^y", "ṩ q̣̇ ǖ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", U.basic_tokens(F.col("t"))).collect())
    for i, t in enumerate(texts):
        assert got[i] == plain_tokens(t), t


def test_decode_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray("é".encode() + b"\xff" + b"x"),)], "b binary")
    assert df.select(U.decode_text(F.col("b"))).first()[0] == "éx"


def test_split_pairs(spark):
    df = spark.createDataFrame([("a ||| b",), (" x ||| y ||| z ",), ("none",)], "sentence string")
    got = [(r.text_a, r.text_b) for r in E.split_pairs(df).collect()]
    assert got == [("a", "b"), ("x ||| y", "z"), ("none", None)]


def test_pair_lengths_follow_the_loop(spark):
    rows = [(a, b) for a in range(16) for b in range(16)]
    df = spark.createDataFrame(rows, "a int, b int")
    for total in (2, 5, 8, 13):
        ka, kb = E.kept_lengths(F.col("a"), F.col("b"), total)
        for a, b, x, y in df.select("a", "b", ka, kb).collect():
            la, lb = a, b
            while la + lb > total:
                if la > lb:
                    la -= 1
                else:
                    lb -= 1
            assert (x, y) == (la, lb)
