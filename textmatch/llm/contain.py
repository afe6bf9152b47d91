"""Benchmark decontamination: short test items inside long documents.

An item and a document are sets of word shingles; a document is contaminated by an item
if it holds at least ``threshold`` of the item's shingles. The search runs on MinHash
sketches of the items: the ``k`` smallest hash values of an item's shingles. Items are
partitioned by size, and each size has its own sketch length, k = n - ceil(threshold n)
+ 1: a document that holds enough of the item lacks at most n - ceil(threshold n)
shingles, so it holds one of the k smallest, and no containment is missed. Documents
need no sketch and are never compared with each other: their shingle hashes meet the
sketches in one join. Candidates are verified by counting exact common shingles.

Only DataFrame functions are used. The sketches are broadcast when they measure below
``BROADCAST_BYTES``; beyond it the join shuffles hashes and gives the same rows.

Defined results: a text of fewer words than a shingle is one shingle, its whole word
sequence; empty and null texts have none and match nothing. Rows with the same id are
judged each by its own text, and the larger count is reported. Null ids match as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bind import let
from ..session import written

WORDS = 5
THRESHOLD = 0.8
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 64  # upper bound of a sketch row in memory


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.btrim(plain, F.lit(" \t\n\v\f\r"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def _shingled(text: Column, n: int, make) -> Column:
    """``make(words, i)`` for each shingle start i; one for a shorter text, none without words."""

    def body(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - F.lit(n), F.lit(0)))
        return F.when(F.size(ws) > 0, F.transform(starts, lambda i: make(ws, i))).otherwise(F.array().cast("array<string>"))

    return let(words(text), body)


def shingles(text: Column, n: int = WORDS) -> Column:
    """Shingles as text."""
    return _shingled(text, n, lambda ws, i: F.concat_ws(" ", F.slice(ws, i + 1, n)))


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the shingles; words beyond the end count as null."""

    def body(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - F.lit(n), F.lit(0)))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(n)]))
        return F.when(F.size(ws) > 0, hashes).otherwise(F.array().cast("array<long>"))

    return let(words(text), body)


def sketches(items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """MinHash sketch rows of the items: item_id, n_item, hash."""
    hashes = F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), n)))
    sized = items.select("item_id", hashes.alias("hashes")).withColumn("n_item", F.size("hashes")).filter("n_item > 0")
    length = F.col("n_item") - F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)) + 1
    sketch = F.slice("hashes", F.lit(1), length.cast("int"))
    return sized.select("item_id", "n_item", F.explode(sketch).alias("hash"))


def _matches(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """Verified matches of texts: doc_id, doc_key, doc_text (digest), item_id, n_item, n_shared, containment."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    items = items.select("item_id", "text").distinct()
    probes = written(sketches(items, n, threshold), "sketches")
    # One hash leads to all its items later, so a frequent passage does not multiply rows here.
    hashes = probes.select("hash").distinct()
    if probes.count() * _ROW_BYTES <= BROADCAST_BYTES:
        hashes = F.broadcast(hashes)
    found = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"), n)).alias("hash")).join(hashes, "hash")
    found = written(found.distinct(), "found-hashes")
    pairs = written(
        found.join(probes, "hash").select(known("doc_id").alias("doc_key"), known("item_id").alias("item_key")).distinct(),
        "candidates",
    )
    # Exact check: shingles of the candidate documents against those of their items.
    parts = items.select(
        known("item_id").alias("item_key"), "item_id", F.array_distinct(shingles(F.col("text"), n)).alias("parts")
    )
    parts = parts.select(
        "item_key", F.md5(F.concat_ws(" ", "parts")).alias("item_text"), "item_id",
        F.size("parts").cast("long").alias("n_item"), F.explode("parts").alias("shingle"),
    )
    whole = docs.withColumn("doc_key", known("doc_id")).join(pairs.select("doc_key").distinct(), "doc_key", "left_semi")
    whole = whole.select(
        "doc_key", "doc_id", F.md5("text").alias("doc_text"),
        F.explode(F.array_distinct(shingles(F.col("text"), n))).alias("shingle"),
    )
    shared = (
        whole.join(parts, "shingle").join(pairs, ["doc_key", "item_key"], "left_semi")
        .groupBy("doc_id", "doc_key", "doc_text", "item_id", "item_text", "n_item")
        .agg(F.countDistinct("shingle").alias("n_shared"))
    )
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(
        F.col("containment") >= F.lit(threshold - 1e-9)
    )


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", n: int = WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Documents that hold test items: doc_id, item_id, n_item, n_shared, containment."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col("text"))
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("best")
    return _matches(docs, items, n, threshold).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment"
    )


def clean(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    n: int = WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without contaminated documents; all columns kept."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hit = _matches(plain, items.select("item_id", "text"), n, threshold)
    hit = written(hit.select(F.col("doc_key").alias("_key"), F.col("doc_text").alias("_text")).distinct(), "contaminated")
    keyed = docs.withColumns({"_key": F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), "_text": F.md5(F.col(text))})
    return keyed.join(hit, ["_key", "_text"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
