"""Vocabulary training: words are split to letters and frequent pairs merged.

At first a symbol is one character of a private alphabet, so a word is a short string and a
pair is two characters. Training works on arrays of symbol numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..options import DEFAULTS, SPECIAL_TOKENS, Options
from ..session import written
from .positions import running_total

_FIRST_CODE = 0x100
_SURROGATES = (0xD800, 0xE000)
ROUNDS_PER_WRITE = 8
LEAST_SYMBOLS, MOST_SYMBOLS = 1 << 14, 1 << 22  # of a task
_WORDS = "ids array<int>, n long"


def symbol(token_id: int) -> str:
    """The character that stands for a token; ids in order give characters in order."""
    code = _FIRST_CODE + token_id
    return chr(code if code < _SURROGATES[0] else code + _SURROGATES[1] - _SURROGATES[0])


def token_id(char: str) -> int:
    code = ord(char)
    return (code if code < _SURROGATES[0] else code - _SURROGATES[1] + _SURROGATES[0]) - _FIRST_CODE


def alphabet(counts: DataFrame, limit: int = DEFAULTS.max_alphabet) -> DataFrame:
    """The most frequent characters (char, n)."""
    chars = counts.select(F.explode(F.split("word", "")).alias("char"), "n")
    return chars.groupBy("char").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "char").limit(limit)


def first_symbols(counts: DataFrame, options: Options = DEFAULTS) -> tuple[DataFrame, list[str]]:
    """Words as symbol strings (symbols, n), and the first tokens in id order.

    Letters outside the alphabet are left out of their words.
    """
    chars = [r["char"] for r in alphabet(counts, options.max_alphabet).collect()]  # max_alphabet rows at most
    outside = "[^" + "".join(re.escape(c) for c in chars) + "]"
    words = counts.select(F.regexp_replace("word", outside, "").alias("word"), "n").filter(F.length("word") > 0)
    forms = words.select(F.posexplode(F.split("word", "")).alias("i", "char"))
    token = F.when(F.col("i") == 0, F.col("char")).otherwise(F.concat(F.lit("##"), F.col("char")))
    # At most two forms of each letter.
    tokens = list(SPECIAL_TOKENS) + [r["t"] for r in forms.select(token.alias("t")).distinct().orderBy("t").collect()]
    ids = {t: i for i, t in enumerate(tokens)}

    def letters(part: Column, prefix: str) -> Column:
        known = [c for c in chars if prefix + c in ids]
        return F.translate(part, "".join(known), "".join(symbol(ids[prefix + c]) for c in known))

    head, tail = F.substring("word", 1, 1), F.expr("substring(word, 2)")
    symbols = F.concat(letters(head, ""), letters(tail, "##")).alias("symbols")
    return words.select(symbols, "n").groupBy("symbols").agg(F.sum("n").alias("n")), tokens


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted count of neighbouring symbols (pair, n)."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols") - 1))
    pairs = words.filter(F.length("symbols") > 1).select("symbols", "n", at.alias("i"))
    return (
        pairs.select(F.substring("symbols", F.col("i"), F.lit(2)).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


# ---- training ----------------------------------------------------------------
#
# A pair can be merged before its turn if nothing that comes before it can change its
# count: it outranks every pair that ends with its left symbol and every pair that begins
# with its right one. Pairs that grow later hold a new symbol in place of a part of it, so they
# are no more frequent than such a pair, and younger. All pairs of that kind are merged in
# one round; the order of single merges is restored afterwards from the counts at which they were
# merged. A few hundred rounds make tens of thousands of merges.


def join_symbols(left: str, right: str) -> str:
    return left + right.removeprefix("##")


class Merges:
    """The merges so far, in the order in which single merges would have made them.

    A symbol's key sorts it by age: first tokens by id, merged ones by their count, most
    frequent first, then by the key of the pair. A merge that gives a token that exists may
    raise counts. It closes an era: it waits until all merges before it are made, merges
    behind it are undone, and later ones are younger whatever their counts.
    """

    def __init__(self, tokens: list[str], room: int):
        self.tokens = list(tokens)
        self.keys: list[tuple] = [(0, i) for i in range(len(tokens))]
        self.ages = list(range(len(tokens)))  # symbols, oldest first
        self.known = {t: i for i, t in enumerate(tokens)}
        self.first, self.room = len(tokens), room
        self.era, self.barrier = 1, None
        self.made: list[tuple[tuple, tuple[int, int], int]] = []  # (key, pair, symbol)

    def key(self, left: int, right: int, n: int) -> tuple:
        a, b = self.keys[left], self.keys[right]
        return (self.era, -n, max(a, b), a, b)

    def ranks(self) -> pa.Table:
        return pa.table({"symbol": pa.array(self.ages, pa.int32()), "rank": pa.array(range(len(self.ages)), pa.int32())})

    def before(self, key: tuple) -> int:
        """New tokens that are older than ``key``."""
        return bisect_left(self.ages, key, key=self.keys.__getitem__) - self.first

    def least(self) -> int:
        """Pairs with a lower count come after the last token that there is room for."""
        if len(self.ages) < self.first + self.room:
            return 0
        era, n, *_ = self.keys[self.ages[self.first + self.room - 1]]
        return -n if era == self.era else 0

    def ordered(self, pairs: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """Pairs (left, right, n) in rank order: most frequent first, then the oldest symbols."""
        rank = np.zeros(len(self.tokens), dtype=np.int64)
        rank[self.ages] = np.arange(len(self.ages))
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        a, b = rank[left], rank[right]
        order = np.lexsort((b, a, np.maximum(a, b), -n))
        return list(zip(left[order].tolist(), right[order].tolist(), n[order].tolist()))

    def safe(self, top: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Pairs (left, right, n) of a list in rank order that no pair before can change.

        The list is cut by rank, so what is not in it comes after all of it.
        """
        ends: dict[int, int] = {}
        begins: dict[int, int] = {}
        for place, (left, right, _) in enumerate(top):
            ends.setdefault(right, place)
            begins.setdefault(left, place)
        return [
            p for place, p in enumerate(top)
            if ends.get(p[0], place) >= place and begins.get(p[1], place) >= place
        ]

    def choose(self, top: list[tuple[int, int, int]]) -> tuple[dict[tuple[int, int], int], bool]:
        """Merges of the next round (pair to symbol), and whether merges were undone.

        Nothing to merge and nothing undone means that training has ended.
        """
        if not top or self.before(self.key(*top[0])) >= self.room:
            return {}, False
        left, right, n = top[0]
        if self.barrier is not None and self.key(left, right, n) >= self.barrier:
            self.era, self.barrier = self.era + 1, None
            symbol = self.known[join_symbols(self.tokens[left], self.tokens[right])]
            self.made.append(((self.era, 0), (left, right), symbol))
            self.era += 1
            return {(left, right): symbol}, False
        chosen = []
        for left, right, n in self.safe(top):
            key, joined = self.key(left, right, n), join_symbols(self.tokens[left], self.tokens[right])
            twin = self.known.get(joined)
            twin = self.keys[twin] if twin is not None else next((k for k, j, *_ in chosen if j == joined), None)
            if twin is not None:
                self.barrier = max(key, twin) if self.barrier is None else min(self.barrier, max(key, twin))
            chosen.append((key, joined, left, right))
        if self.barrier is not None and any(key >= self.barrier for key, *_ in self.made):
            self.undo()
            return {}, True
        out = {}
        for key, joined, left, right in chosen:
            if (self.barrier is None or key < self.barrier) and self.before(key) < self.room:
                symbol = len(self.tokens)
                self.tokens.append(joined)
                self.keys.append(key)
                self.known[joined] = out[left, right] = symbol
                insort(self.ages, symbol, key=self.keys.__getitem__)
                self.made.append((key, (left, right), symbol))
        return out, False

    def undo(self) -> None:
        """Forget merges from the barrier on; their symbols stay unused."""
        gone = {symbol for key, _, symbol in self.made if key >= self.barrier}
        self.made = [m for m in self.made if m[0] < self.barrier]
        self.ages = [s for s in self.ages if s not in gone]
        self.known = {t: s for t, s in self.known.items() if s not in gone}

    def order(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Place and symbol of every merge."""
        return {pair: (place, symbol) for place, (_, pair, symbol) in enumerate(sorted(self.made))}


def _codes(ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring pairs as numbers, and the word of each."""
    inside = word[1:] == word[:-1]
    return (ids[:-1][inside] << 32) | ids[1:][inside], word[:-1][inside]


def merge_rounds(ids: np.ndarray, word: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (symbols end to end, and the word of each) after all rounds; which words changed."""
    changed = np.zeros(int(word[-1]) + 1 if len(word) else 0, dtype=bool)
    known = 1 + max((int(max(p[-1] >> 32, (p & 0xFFFFFFFF).max(), s.max())) for p, s in rounds if len(p)), default=0)
    known = max(known, int(ids.max()) + 1 if len(ids) else 0)
    for pairs, symbols in rounds:
        if len(ids) < 2:
            break
        # Few symbols begin or end a pair of the round; only these are looked up.
        begins, ends = np.zeros(known, dtype=bool), np.zeros(known, dtype=bool)
        begins[pairs >> 32], ends[pairs & 0xFFFFFFFF] = True, True
        hit = np.flatnonzero(begins[ids[:-1]] & ends[ids[1:]])
        hit = hit[word[hit + 1] == word[hit]]
        codes = (ids[hit] << 32) | ids[hit + 1]
        at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
        found = pairs[at] == codes
        hit, at = hit[found], at[found]
        if not len(hit):
            continue
        # Pairs of one round overlap only in a run of one symbol, which is cut from its left.
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, np.arange(len(hit)), 0))
        first = (np.arange(len(hit)) - run) % 2 == 0
        hit, at = hit[first], at[first]
        ids = ids.copy()
        ids[hit] = symbols[at]
        changed[word[hit]] = True
        kept = np.ones(len(ids), dtype=bool)
        kept[hit + 1] = False
        ids, word = ids[kept], word[kept]
    return ids, word, changed


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols end to end, the word of each, and the words' counts."""
    lists = batch.column(0)
    offsets = lists.offsets.to_numpy()
    ids = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    return ids, np.repeat(np.arange(batch.num_rows), np.diff(offsets)), batch.column(1).to_numpy()


def _pair_changes(words: DataFrame, rounds: list[tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """(pair, n): what the rounds add to pairs and take away; without rounds, all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, n = _flat(batch)
            if rounds is None:
                codes, owner = _codes(ids, word)
                weight = n[owner]
            else:
                new, place, changed = merge_rounds(ids, word, rounds)
                if not changed.any():
                    continue
                old = changed[word]
                minus, plus = _codes(ids[old], word[old]), _codes(*(a[changed[place]] for a in (new, place)))
                codes = np.concatenate((minus[0], plus[0]))
                weight = np.concatenate((-n[minus[1]], n[plus[1]]))
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)])
            sums = np.add.reduceat(weight[order], first) if len(first) else weight[:0]
            kept = sums != 0
            yield pa.record_batch([pa.array(codes[first][kept]), pa.array(sums[kept])], names=["pair", "n"])

    return words.mapInArrow(run, "pair long, n long")


def _lists(ids: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Words of two symbols or more; no merge is left for the others."""
    size = np.bincount(word, minlength=len(n))
    long = size > 1
    offsets = np.concatenate(([0], np.cumsum(size[long]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[long[word]].astype(np.int32)))
    return pa.record_batch([lists, pa.array(n[long])], names=["ids", "n"])


def _merged(words: DataFrame, rounds: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, n = _flat(batch)
            ids, word, _ = merge_rounds(ids, word, rounds)
            yield _lists(ids, word, n)

    return words.mapInArrow(run, _WORDS)


def _replayed(words: DataFrame, order: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Words after single merges in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in batch.column(0).to_pylist():
                done = -1
                while True:
                    found = [order[p] for p in zip(ids, ids[1:]) if p in order and order[p][0] > done]
                    if not found:
                        break
                    done, symbol = min(found)
                    at, new = 0, []
                    while at < len(ids):
                        if order.get(tuple(ids[at : at + 2]), (None,))[0] == done:
                            new.append(symbol)
                            at += 2
                        else:
                            new.append(ids[at])
                            at += 1
                    ids = new
                out.append(ids)
            sizes = [len(o) for o in out]
            flat = np.array([i for o in out for i in o], dtype=np.int64)
            yield _lists(flat, np.repeat(np.arange(len(out)), sizes), batch.column(1).to_numpy())

    return words.mapInArrow(run, _WORDS)


def _as_ids(symbols: DataFrame) -> DataFrame:
    """(ids, n) of words as strings of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = np.array([token_id(c) for c in "".join(words)], dtype=np.int64)
            yield _lists(ids, np.repeat(np.arange(len(words)), [len(w) for w in words]), batch.column(1).to_numpy())

    return symbols.select("symbols", "n").mapInArrow(run, _WORDS)


def train_vocabulary(counts: DataFrame, options: Options = DEFAULTS, batch: int = 1 << 14) -> DataFrame:
    """Train a word-piece vocabulary (token, id) from word counts (word, n).

    A round is one Spark job. Tasks apply the merges since words and pair counts were last
    written, and pass on only what they change in the counts; the best ``batch`` pairs
    reach the driver, which holds the vocabulary and picks those that can be merged. The
    result is that of single merges; ties go to older symbols.
    """
    spark = counts.sparkSession
    symbols, tokens = first_symbols(counts, options)
    size = symbols.agg(F.sum(F.length("symbols"))).first()[0] or 0
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-size // LEAST_SYMBOLS)), -(-size // MOST_SYMBOLS), 1)
    start = words = written(_as_ids(symbols.repartition(tasks)), "words")
    pairs = _totals(_pair_changes(words, None), "pairs")
    state = Merges(tokens, options.vocab_size - len(tokens))
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    while state.room > 0:
        now = pairs if not rounds else pairs.unionByName(_pair_changes(words, rounds)).groupBy("pair").agg(F.sum("n").alias("n"))
        top = _top(now.filter(F.col("n") >= max(options.min_frequency, state.least())), state, batch)
        chosen, undone = state.choose(top)
        if undone:
            words, rounds = written(_replayed(start, state.order()), "words"), []
            pairs = _totals(_pair_changes(words, None), "pairs")
            continue
        if not chosen:
            break
        codes = np.array([left << 32 | right for left, right in chosen], dtype=np.int64)
        order = np.argsort(codes)
        rounds.append((codes[order], np.array(list(chosen.values()), dtype=np.int64)[order]))
        if len(rounds) == ROUNDS_PER_WRITE:
            merged = written(_merged(words, rounds), "words")
            pairs = _totals(pairs.unionByName(_pair_changes(words, rounds)), "pairs")
            words, rounds = merged, []
    made = [state.tokens[s] for s in state.ages][: max(options.vocab_size, len(tokens))]
    return spark.createDataFrame(list(zip(made, range(len(made)))), "token string, id int")


def _top(pairs: DataFrame, state: Merges, batch: int) -> list[tuple[int, int, int]]:
    """At most ``batch`` pairs (left, right, n) in rank order; no pair left out comes before one of them.

    Whole counts are taken, so that the driver can order ties. Only if one count alone has
    more pairs do their symbols' ranks meet the pairs.
    """
    found = pairs.orderBy(F.desc("n")).limit(batch).toArrow()
    codes, n = found["pair"].to_numpy(), found["n"].to_numpy()
    if len(n) < batch:
        return state.ordered(codes, n)
    whole = n > n.min()
    if whole.any():
        return state.ordered(codes[whole], n[whole])
    ranks = F.broadcast(pairs.sparkSession.createDataFrame(state.ranks()))  # a row per token
    left, right = (ranks.select(F.col("symbol").alias(s), F.col("rank").alias(f"{s}_rank")) for s in ("left", "right"))
    halves = F.shiftright("pair", 32).cast("int").alias("left"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("right")
    ranked = pairs.select(*halves, "n").join(left, "left").join(right, "right").orderBy(
        F.desc("n"), F.greatest("left_rank", "right_rank"), "left_rank", "right_rank"
    )
    return list(zip(*(c.to_pylist() for c in ranked.select("left", "right", "n").limit(batch).toArrow().columns)))


def _totals(changes: DataFrame, name: str) -> DataFrame:
    """Pair counts, written; pairs that are gone are left out."""
    return written(changes.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0"), name)


def number_tokens(tokens: DataFrame) -> DataFrame:
    """Number distinct tokens by kind, place and code points (token, id).

    ``tokens`` has kind, place and token. Running totals over prefixes of the sort key
    keep every window small, however many tokens there are.
    """
    group = F.concat_ws("-", "kind", F.lpad(F.col("place").cast("string"), 10, "0"))
    levels = [F.concat_ws("-", group, F.left(F.col("token"), F.lit(n))) for n in (1, 3, 5)]
    total = running_total(tokens, levels, ["token"], F.lit(1), "_end")
    return total.select("token", (F.col("_end") - 1).cast("int").alias("id"))
