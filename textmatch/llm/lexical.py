"""Ranked lexical search by products of dense tiles, exact in double precision.

Scores are sums of integer impacts ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``: ``w`` falls
with the number of documents that hold a term, ``m`` grows with the length of a document.
Three passes run over the documents, each a narrow one without a shuffle of texts:

1. Texts are cut to terms in array operations. Of each document only its length and the
   terms that some item holds are kept, as numbers with their counts, in a written table.
2. Document frequencies, the number of documents and of terms are summed from that table.
3. A task lays ``DOC_TILE`` documents out as a dense tile of impacts over the compact
   vocabulary of a tile of items, and multiplies it with the zero-one tile of those items.
   An impact is an integer below ``w * 10**6``; a tile has so few columns that every
   partial sum stays below 2**53, so the product is exact in any order of summation, and the
   sums of tiles are added as 64-bit integers. The best ``k`` of each item are kept from
   tile to tile, whole ties included until the smaller ids have won.

Tasks pass on at most ``k`` rows per item; a rank over those is the result. Items go to the
tasks as they are, so they are dealt to groups of bounded size (``GROUP_TERMS``), counted
before they are sent; passes 1 to 3 are made for each group, and the result is the same.

Defined results: a term is a longest run of letters and digits of ASCII and of all
characters beyond it, A-Z lower-cased. Null and empty texts have no terms: such documents are
not counted, such items return no row. Rows that share an item id, null included, are one
item with the terms of all. Every row of documents is a document of its own, also where ids
repeat; equal scores rank by ascending id, null last. Without documents or items there are no
rows. Other columns are not looked at. Texts are read whole. Terms are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import written
from .words import buffers, hash_slices, lower, owners, word_slices

GROUP_TERMS = 1 << 21  # (item, term) rows that a pass hands to every task: 32 MB
ITEM_TILE = 256
DOC_TILE = 1024
MAX_COLUMNS = 4096
EXACT = 1 << 53

_NO_TERM = np.ones(256, dtype=bool)
_NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# ---- terms -------------------------------------------------------------------


def _terms(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of every term, buffer by buffer."""
    for buffer, pieces in buffers(lower(t) for t in texts):
        starts, ends = word_slices(buffer, _NO_TERM)
        number = np.array([p.text for p in pieces])[owners(starts, pieces)]
        yield number, hash_slices(buffer, starts, ends)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes in _terms(batch.column(1).to_pylist()):
                yield pa.record_batch([batch.column(0).take(pa.array(number)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term long").distinct()


class Group(NamedTuple):
    """Items of one pass: their ids, the hashes of their terms, and which item holds which."""

    ids: list
    vocabulary: np.ndarray  # sorted
    first: np.ndarray  # item i holds columns[first[i] : first[i + 1]]
    columns: np.ndarray


def groups(terms: DataFrame, most: int = GROUP_TERMS) -> Iterator[Group]:
    """Items dealt to groups of about ``most`` (item, term) rows; an item is never cut."""
    n_items, n_rows = terms.agg(F.count_distinct(F.struct("item_id")), F.count("*")).first()
    parts = max(1, -(-n_rows // most))
    dealt = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while parts < n_items and terms.groupBy(dealt(parts)).count().agg(F.max("count")).first()[0] > most:
        parts = min(2 * parts, n_items)
    for part in range(parts if n_rows else 0):
        table = terms.filter(dealt(parts) == part).toArrow().sort_by("item_id")
        if not table.num_rows:
            continue
        numbers = table["item_id"].combine_chunks().dictionary_encode("encode")
        item = numbers.indices.to_numpy()
        vocabulary, columns = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
        first = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        yield Group(numbers.dictionary.to_pylist(), vocabulary, first, columns.astype(np.int32))


# ---- postings ------------------------------------------------------------------


def postings(docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document (doc_id, n, terms, tfs): its length and the counts of known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, keys = np.zeros(rows, dtype=np.int64), [np.zeros(0, dtype=np.int64)]
            for number, hashes in _terms(batch.column(1).to_pylist()):
                n += np.bincount(number, minlength=rows)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                keys.append(number[known] * len(vocabulary) + at[known])
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            row, term = np.divmod(key, len(vocabulary))
            offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, tf)]
            yield pa.record_batch([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; a row per term, at most ``size``, reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0))[0], minlength=size)
        term = np.flatnonzero(df)
        yield pa.record_batch([pa.array(term), pa.array(df[term])], names=["term", "df"])

    counted = posted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[counted["term"].to_numpy()] = counted["df"].to_numpy()
    return out


# ---- products --------------------------------------------------------------------


class Best:
    """The best ``k`` of each item so far: score down, id up, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, dtype=np.int64)  # a score that still counts
        self.rows = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, first_item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Scores of documents (rows) for items from ``first_item`` on (columns)."""
        doc, item = np.nonzero(scores >= self.least[first_item : first_item + scores.shape[1]])
        if not len(doc):
            return
        new = (item + first_item, scores[doc, item], missing[doc], ids[doc])
        item, score, none, doc_id = (np.concatenate(pair) for pair in zip(self.rows, new))
        order = np.lexsort((doc_id, none, -score, item))
        item = item[order]
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begin, np.diff(begin, append=len(item)))
        stay = order[place < self.k]
        self.rows = tuple(column[stay] for column in (np.concatenate((self.rows[0], new[0])), score, none, doc_id))
        last = order[place == self.k - 1]
        self.least[item[place == self.k - 1]] = score[last]


def _tiles(group: Group, width: int, tile: int):
    """Per tile of items: first item, column of each term (-1: none), zero-one tiles by column."""
    for start in range(0, len(group.ids), tile):
        end = min(start + tile, len(group.ids))
        held = group.columns[group.first[start] : group.first[end]]
        compact, place = np.unique(held, return_inverse=True)
        column = np.full(len(group.vocabulary), -1, dtype=np.int32)
        column[compact] = np.arange(len(compact))
        owner = np.repeat(np.arange(end - start), np.diff(group.first[start : end + 1]))
        blocks = []
        for at in range(0, len(compact), width):
            own = (place >= at) & (place < at + width)
            block = np.zeros((min(width, len(compact) - at), end - start))
            block[place[own] - at, owner[own]] = 1.0
            blocks.append((at, block))
        yield start, column, blocks


def best_matches(
    posted: DataFrame, group: Group, n_docs: int, n_terms: int, df: np.ndarray, k: int = 10,
    exact: int = EXACT, doc_tile: int = DOC_TILE, item_tile: int = ITEM_TILE,
) -> DataFrame:
    """At most ``k`` rows (item, doc_id, score) of each item and task; item is a number."""
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    top = max(1, int(weights.max(initial=0))) * 10**6  # above every impact
    width = max(1, min(MAX_COLUMNS, (exact - 1) // top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tiles = Best(len(group.ids), k), None
        for batch in batches:
            tiles = tiles or list(_tiles(group, width, item_tile))
            ids = batch.column(0).fill_null(0).to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // n_terms
            terms, offsets = _flat(batch.column(2))
            tfs = _flat(batch.column(3))[0].astype(np.int64)
            for at in range(0, batch.num_rows, doc_tile):
                end = min(at + doc_tile, batch.num_rows)
                own = slice(offsets[at], offsets[end])
                row, term, tf = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1])), terms[own], tfs[own]
                impact = weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m[at:end][row]))
                for start, column, blocks in tiles:
                    place = column[term]
                    scores = np.zeros((end - at, blocks[0][1].shape[1]), dtype=np.int64)
                    for left, block in blocks:
                        here = (place >= left) & (place < left + len(block))
                        dense = np.zeros((end - at, len(block)))
                        dense[row[here], place[here] - left] = impact[here]
                        scores += (dense @ block).astype(np.int64)
                    best.add(start, scores, ids[at:end], missing[at:end])
        item, score, none, doc_id = best.rows
        yield pa.record_batch([pa.array(item), pa.array(doc_id, mask=none), pa.array(score)], names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each item (item_id, rank, doc_id, score), scores above 0."""
    spark = docs.sparkSession
    terms = written(item_terms(items, item_id, text), "item-terms")
    kind = terms.schema["item_id"].dataType.simpleString()
    found = []
    for group in groups(terms, group_terms):
        posted = written(postings(docs, group.vocabulary, doc_id, text), "postings")
        n_docs, n_terms = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        df = document_frequencies(posted, len(group.vocabulary))
        names = spark.createDataFrame(list(enumerate(group.ids)), f"item long, item_id {kind}")
        rows = best_matches(posted, group, n_docs, n_terms, df, k)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
