"""Word-piece tokens by looking words up in the vocabulary, or by joining distinct words with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.unicode import basic_tokens
from ..options import DEFAULTS, SPECIAL_TOKENS
from ..session import written
from .skew import lookup_join

UNKNOWN = "[UNK]"
MAX_VOCABULARY_BYTES = 32 << 20
REMEMBERED_WORDS = 1 << 16
PART_ITEMS = 1 << 16  # words of a batch that a task looks up at once


def words_of(
    texts: DataFrame, keys: Sequence[str], text: str, lower: bool = True
) -> DataFrame:
    """One row per word occurrence (keys, tok, word); a text without words keeps one row."""
    return texts.select(*keys, F.posexplode_outer(basic_tokens(F.col(text), lower)).alias("tok", "word"))


def part_counts(texts: DataFrame, text: str) -> DataFrame:
    """Distinct parts of all texts between blanks (part, n).

    No word spans a blank and none depends on what lies behind one, so the words of the parts, taken
    ``n`` times, are those of the texts; a part is split to words once, however often it comes.
    """
    parts = texts.select(F.explode(F.split(F.col(text), " ", -1)).alias("part"))
    return parts.filter(F.col("part") != "").groupBy("part").agg(F.count("*").alias("n"))


def word_counts(words: DataFrame, word: str = "word", weight: str | None = None) -> DataFrame:
    """Occurrences of each word (word, n); with ``weight``, a row stands for so many."""
    n = F.count("*") if weight is None else F.sum(weight)
    return words.filter(F.col(word).isNotNull()).groupBy(word).agg(n.alias("n"))


def vocabulary_matches(words: DataFrame, vocab: DataFrame, max_chars: int = DEFAULTS.max_word_chars) -> DataFrame:
    """Longest vocabulary entry at every place of every distinct word (word, start, len, id)."""
    longest = vocab.agg(F.max(F.length(F.regexp_replace("token", "^##", "")))).scalar()
    starts = words.filter(F.length("word") <= max_chars).select(
        "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")
    )
    most = F.least(F.length("word") - F.col("start") + 1, F.col("_longest"))
    spans = starts.withColumn("_longest", longest).select(
        "word", "start", F.explode(F.sequence(F.lit(1), most)).alias("len")
    )
    prefix = F.when(F.col("start") > 1, "##").otherwise("")
    pieces = spans.withColumn("token", F.concat(prefix, F.substring("word", F.col("start"), F.col("len"))))
    # Broadcast by measured size; else adaptive execution splits the frequent tokens.
    found = pieces.join(vocab.select("token", "id"), "token")
    best = found.groupBy("word", "start").agg(F.max(F.struct("len", "id")).alias("m"))
    return best.select("word", "start", "m.len", "m.id")


def word_pieces(words: DataFrame, vocab: DataFrame, max_chars: int = DEFAULTS.max_word_chars) -> DataFrame:
    """Greedy longest-match pieces of distinct words (word, pieces, ids).

    Walks over the matches in order of their start: a match that begins where the
    last taken one ended is taken. A word that is not covered becomes ``[UNK]``.
    """
    # Dealt by word once, so that neither a word's matches nor its pieces are moved.
    words = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    matches = vocabulary_matches(words, vocab, max_chars)
    ordered = F.array_sort(F.collect_list(F.struct("start", "len", "id")))
    none = F.array()
    first = F.struct(
        F.lit(1).alias("next"), none.cast("array<string>").alias("pieces"), none.cast("array<int>").alias("ids")
    )

    def step(state: Column, match: Column) -> Column:
        part = F.substring(F.col("word"), match["start"], match["len"])
        piece = F.concat(F.when(match["start"] > 1, "##").otherwise(""), part)
        taken = F.struct(
            (match["start"] + match["len"]).alias("next"),
            F.concat(state["pieces"], F.array(piece)).alias("pieces"),
            F.concat(state["ids"], F.array(match["id"])).alias("ids"),
        )
        return F.when(match["start"] == state["next"], taken).otherwise(state)

    walked = matches.groupBy("word").agg(ordered.alias("matches")).select(
        "word", F.aggregate("matches", first, step).alias("walk")
    )
    covered = walked.filter(F.col("walk.next") == F.length("word") + 1).select("word", "walk.pieces", "walk.ids")
    unknown = vocab.filter(F.col("token") == UNKNOWN).select("id").scalar()
    return words.select("word").join(covered, "word", "left").select(
        "word",
        F.coalesce("pieces", F.array(F.lit(UNKNOWN))).alias("pieces"),
        F.coalesce("ids", F.array(unknown)).alias("ids"),
    )


def attach_pieces(words: DataFrame, vocab: DataFrame, spread: Column) -> DataFrame:
    """Add the pieces and ids of every word occurrence.

    Only distinct words meet the vocabulary; their pieces are joined back to the
    occurrences, with frequent words spread over several tasks by ``spread``. The word
    counts feed several branches and are written first, so that texts are split twice
    in all, once to count and once to join.
    """
    counts = written(word_counts(words), "word-counts")
    return lookup_join(words, word_pieces(counts, vocab), "word", counts, spread)


# ---- vocabularies that every task can hold -----------------------------------------
#
# A vocabulary of bounded size goes to the tasks, which look words up batch by batch; then
# no occurrence is moved. A larger one is joined: distinct words meet it, and their pieces are
# joined back to the occurrences.


def fits(vocab: DataFrame) -> bool:
    """Whether the vocabulary can be handed to every task, by its measured size."""
    size = vocab.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0
    return size <= MAX_VOCABULARY_BYTES


def _table(vocab: DataFrame, source: str, target: str) -> dict:
    rows = vocab.select(source, target).toArrow()
    return dict(zip(rows[source].to_pylist(), rows[target].to_pylist()))


class Pieces:
    """Greedy longest-match pieces of words; those of recent words are remembered."""

    def __init__(self, ids: dict[str, int], max_chars: int):
        self.ids, self.max_chars = ids, max_chars
        self.longest = max((len(t.removeprefix("##")) for t in ids), default=0)
        self.known: dict[str, list[str]] = {}

    def split(self, word: str) -> list[str]:
        pieces = self.known.get(word)
        if pieces is None:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            pieces = self.known[word] = self._split(word)
        return pieces

    def _split(self, word: str) -> list[str]:
        if len(word) > self.max_chars:
            return [UNKNOWN]
        pieces, start = [], 0
        while start < len(word):
            prefix = "##" if start else ""
            for end in range(min(len(word), start + self.longest), start, -1):
                piece = prefix + word[start:end]
                if piece in self.ids:
                    break
            else:
                return [UNKNOWN]
            pieces.append(piece)
            start = end
        return pieces


def _lists(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Values of a list column by distinct value, and where each row ends; a null is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().dictionary_encode("encode"), np.cumsum(sizes)


def places_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every item of lists of these sizes, and its place in the list."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]


def item_parts(column: pa.Array) -> list[tuple[int, int]]:
    """Parts of about ``PART_ITEMS`` items of a list column, as (first row, rows); a longer row is a part."""
    if len(column) == 0:
        return [(0, 0)]
    before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()[:-1], dtype=np.int64)))
    starts = np.flatnonzero(np.diff(before // PART_ITEMS, prepend=-1))
    return [(int(at), int(to - at)) for at, to in zip(starts, [*starts[1:], len(column)])]


def _in_parts(column: pa.Array, look_up: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``look_up`` of a list column part by part."""
    return pa.concat_arrays([look_up(column.slice(at, n)) for at, n in item_parts(column)])


def pieces_of(words: Column, vocab: DataFrame, max_chars: int = DEFAULTS.max_word_chars) -> Column:
    """Pieces and ids (tokens, ids) of arrays of words, by a vocabulary that ``fits``.

    Called non-deterministic, so that no filter on the pieces is pushed below, which would find them twice.
    """
    ids = _table(vocab.groupBy("token").agg(F.max("id").alias("id")), "token", "id")
    pieces = Pieces(ids, max_chars)

    def part(column: pa.Array) -> pa.Array:
        values, ends = _lists(column)
        split = [pieces.split(w) for w in values.dictionary.to_pylist()]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        at = values.indices.to_numpy()
        counts = sizes[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        place = pa.array(np.repeat(first[at] - total[:-1], counts) + np.arange(total[-1]))
        flat = [t for s in split for t in s]
        offsets = pa.array(np.concatenate(([0], total[ends])).astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(offsets, pa.array(flat, pa.string()).take(place)),
            pa.ListArray.from_arrays(offsets, pa.array([pieces.ids.get(t) for t in flat], pa.int32()).take(place)),
        ], ["tokens", "ids"])

    @arrow_udf("struct<tokens:array<string>,ids:array<int>>")
    def look_up(column: pa.Array) -> pa.Array:
        return _in_parts(column, part)

    return look_up.asNondeterministic()(words)


def tokenize(
    texts: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id", "pos"),
    text: str = "sentence",
    lower: bool = True,
) -> DataFrame:
    """Word pieces of every text (keys, tokens, ids), empty for a text without words.

    The keys name a text. No row is moved while the vocabulary ``fits``.
    """
    if fits(vocab):
        found = texts.select(*keys, pieces_of(basic_tokens(F.col(text), lower), vocab).alias("_p"))
        return found.select(*keys, "_p.tokens", "_p.ids")
    words = words_of(texts, keys, text, lower)
    joined = attach_pieces(words, vocab, F.struct(*keys, "tok"))
    found = F.filter(F.collect_list(F.struct("tok", "pieces", "ids")), lambda s: s["tok"].isNotNull())
    grouped = joined.groupBy(*keys).agg(F.array_sort(found).alias("_w"))
    return grouped.select(
        *keys,
        F.flatten(F.transform("_w", lambda s: s["pieces"])).alias("tokens"),
        F.flatten(F.transform("_w", lambda s: s["ids"])).alias("ids"),
    )


def listed(items: Column, vocab: DataFrame, source: str, target: str) -> Column:
    """Arrays looked up in a vocabulary that ``fits``; what it lacks is an error.

    Called non-deterministic, so that one look-up on the result of another is not folded into what uses it.
    """
    known = _table(vocab, source, target)
    kind = vocab.schema[target].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def part(column: pa.Array) -> pa.Array:
        values, ends = _lists(column)
        distinct = values.dictionary.to_pylist()
        lost = [v for v in distinct if v not in known]
        if lost:
            raise ValueError(f"not in the vocabulary: {lost[0]}")
        out = pa.array([known[v] for v in distinct], arrow).take(values.indices)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), out)

    @arrow_udf(f"array<{kind}>")
    def look_up(column: pa.Array) -> pa.Array:
        return _in_parts(column, part)

    return look_up.asNondeterministic()(items)


def looked_up(df: DataFrame, vocab: DataFrame, keys: Sequence[str], items: str, source: str, target: str, out: str) -> DataFrame:
    """``df`` with the array ``items`` looked up; the keys name a row. No row is moved if the vocabulary ``fits``."""
    if fits(vocab):
        return df.withColumn(out, listed(F.col(items), vocab, source, target))
    flat = df.select(*keys, F.posexplode_outer(items).alias("_pos", source))
    found = flat.join(vocab.select(source, target), source, "left")
    unknown = F.col(source).isNotNull() & F.col(target).isNull()
    message = F.concat(F.lit("not in the vocabulary: "), F.col(source).cast("string"))
    value = F.when(unknown, F.raise_error(message)).otherwise(F.col(target))
    ordered = F.array_sort(
        F.filter(F.collect_list(F.struct("_pos", value.alias("_v"))), lambda s: s["_pos"].isNotNull())
    )
    return df.join(found.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_v"]).alias(out)), list(keys))


def tokens_to_ids(df: DataFrame, vocab: DataFrame, keys: Sequence[str], tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """Vocabulary ids of token arrays (keys, ids); an unknown token is an error."""
    return looked_up(df, vocab, keys, tokens, "token", "id", out).select(*keys, out)


def ids_to_tokens(df: DataFrame, vocab: DataFrame, keys: Sequence[str], ids: str = "ids", out: str = "tokens") -> DataFrame:
    """Tokens of id arrays (keys, tokens); an unknown id is an error."""
    return looked_up(df, vocab, keys, ids, "id", "token", out).select(*keys, out)


def is_special(token: Column) -> Column:
    return token.isin(*SPECIAL_TOKENS)
