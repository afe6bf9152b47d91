"""Small tables with the awkward cases every operator must take."""

import random

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names operators use inside.
CLASHING = ("rank", "size", "row", "new", "_order", "node", "key", "_key", "fp", "hash", "target", "n", "shard", "payload", "dim")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def say(draw, n, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def document_rows(seed=7):
    draw = random.Random(seed)
    long = say(draw, 30_000, 9000)
    base = say(draw, 120, 5000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4), (None, "no id at all", "en", "a", 12),
        (None, None, None, None, None), (4, "one", "en", None, 3), (5, long, "en", "c", len(long)),
        (6, base, "en", "a", len(base)), (7, base, "en", "a", len(base)), (8, base.upper(), "en", "b", len(base)),
        (9, base + " tail", "en", "c", 1), (6, base, "en", "a", len(base)), (10, "Ünïcode é words ☃ here 漢字 and more", "fr", "a", 3),
        (11, "one", "en", "c", 3), (12, "x" * 5000, "en", "a", 5000),
    ]
    rows += [(100 + i, say(draw, draw.randint(1, 150), 3000), "en", f"s{i % 5}", 1) for i in range(40)]
    return rows


def documents(spark, rows=None, clashes=True):
    df = spark.createDataFrame(document_rows() if rows is None else rows, DOC_SCHEMA)
    return with_clashes(df) if clashes else df


def words(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(low).split()
