"""Masked sentence-pair training records.

Documents are planned first: where each chunk starts, how it is split, and whether its
second half is replaced. A plan row holds segment numbers only. The tokens come in later
by joining plan rows with pages of consecutive segments. All draws are hashes of the
seed, the round, the document and the place, so a retried task repeats them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.bind import let
from ..functions.draws import digest, digests, integer, row_keys, uniform, uniforms
from ..functions.text import trimmed
from ..functions.vectors import pad
from ..options import DEFAULTS, Options
from ..session import written
from .encoding import framed, kept_lengths, type_ids
from .positions import position_by_digest, position_by_id
from .tokens import fits, item_parts, places_of

PAGE = 128  # segments per page
KEYS = ("round", "doc_id", "start")  # of an instance


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a document as (doc_id, seg_no, line), blank ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda s: trimmed(s))
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.filter(lines, lambda s: s != "")).alias("seg_no", "line"))


def packed(tokens: Column) -> Column:
    """Tokens as one text to move: joined by blanks, or as JSON behind a blank where that loses something.

    An array of short strings takes 16 bytes or more for each of them in a shuffle.
    """
    def pack(t: Column) -> Column:
        plain = F.array_join(t, " ")
        same = (F.split(plain, " ", -1) == t) & ~F.startswith(plain, F.lit(" "))
        return F.when(same, plain).otherwise(F.concat(F.lit(" "), F.to_json(t)))

    return let(tokens, pack)


def unpacked(text: Column) -> Column:
    """The tokens of a ``packed`` text."""
    return F.when(F.startswith(text, F.lit(" ")), F.from_json(text, "array<string>")).otherwise(F.split(text, " ", -1))


def _numbered(tokens: DataFrame) -> DataFrame:
    kept = tokens.filter(F.size("tokens") > 0).select(
        "doc_id", "seg_no", packed(F.col("tokens")).alias("packed"), F.size("tokens").alias("len")
    )
    order = W.partitionBy("doc_id").orderBy("seg_no")
    return kept.withColumn("seg_no", (F.row_number().over(order) - 1).cast("int"))


def numbered_segments(tokens: DataFrame) -> DataFrame:
    """Drop segments without tokens and number the others (doc_id, seg_no, tokens)."""
    return _numbered(tokens).select("doc_id", "seg_no", unpacked(F.col("packed")).alias("tokens"))


def stored_segments(tokens: DataFrame) -> DataFrame:
    """:func:`numbered_segments`, written. Their lengths and packed texts can be read without the tokens."""
    stored = written(_numbered(tokens), "segments")
    return stored.withColumn("tokens", unpacked(F.col("packed")))


def document_lengths(segs: DataFrame) -> DataFrame:
    """Segment lengths of each document as one array; 4 bytes per segment."""
    n = F.col("len") if "len" in segs.columns else F.size("tokens")
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", n.alias("len"))))
    return segs.groupBy("doc_id").agg(F.transform(ordered, lambda s: s["len"]).alias("lens"))


def rounds(docs: DataFrame, n: int) -> DataFrame:
    """Every document once per round."""
    return docs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def target_length(seed: int, limit: int, short_prob: float) -> Column:
    """Tokens wanted in a chunk: the limit, or now and then a random shorter length."""
    short = F.lit(2) + integer(uniform(seed, F.lit("short"), "round", "doc_id"), F.lit(limit - 1))
    is_short = uniform(seed, F.lit("is_short"), "round", "doc_id") < short_prob
    return F.when(is_short, short).otherwise(limit).cast("int")


def chunk_plan(lens: Column, target: Column, seed: int) -> Column:
    """Chunks of a document as an array of (start, a_end, end, is_random_next), ends exclusive.

    A chunk runs until it holds ``target`` tokens. When its second half is replaced, the
    next chunk begins with the segments not used; so each start depends on the last, and
    the walk goes over the segments, stopping where the next chunk starts.
    """
    chunk = "struct<start:int,a_end:int,end:int,is_random_next:boolean>"
    first = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{chunk}>").alias("plan"))

    def taken(i: Column) -> Column:
        def add(state: Column, n: Column) -> Column:
            more = F.struct((state["sum"] + n).alias("sum"), (state["n"] + 1).alias("n"))
            return F.when(state["sum"] >= target, state).otherwise(more)

        # A segment has a token or more, so ``target`` segments are enough.
        none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        return F.aggregate(F.slice(lens, i + 1, target), none, add)["n"]

    def step(state: Column, i: Column) -> Column:
        def close(size: Column) -> Column:
            more = integer(uniform(seed, F.lit("a_end"), "round", "doc_id", i), size - 1).cast("int")
            a_end = i + 1 + F.when(size >= 2, more).otherwise(0)
            is_random = (size == 1) | (uniform(seed, F.lit("random_next"), "round", "doc_id", i) < 0.5)
            return let(F.struct(a_end.alias("a_end"), is_random.alias("random")), lambda d: F.struct(
                F.when(d["random"], d["a_end"]).otherwise(i + size).alias("next"),
                F.concat(state["plan"], F.array(F.struct(
                    i.alias("start"), d["a_end"].alias("a_end"), (i + size).alias("end"), d["random"].alias("is_random_next")
                ))).alias("plan"),
            ))

        return F.when(i == state["next"], let(taken(i), close)).otherwise(state)

    places = F.when(F.size(lens) > 0, F.sequence(F.lit(0), F.size(lens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, first, step)["plan"]


def plan_chunks(lengths: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Chunk plans of all documents and rounds; ``lengths`` has doc_id, rank and lens."""
    limit = options.max_seq_length - 3
    # Lengths are few bytes and much work: left to file sizes, a task or two would plan them all.
    tasks = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = rounds(lengths.repartition(tasks, "doc_id"), options.dupe_factor).withColumn(
        "target", target_length(options.seed, limit, options.short_seq_prob)
    )
    plan = F.inline(chunk_plan(F.col("lens"), F.col("target"), options.seed))
    return wanted.select("round", "doc_id", "rank", "target", plan).select(
        "round", "doc_id", "rank", "start", "a_end", "end", "target", "is_random_next"
    )


def ranked_documents(lengths: DataFrame, seed: int) -> DataFrame:
    """Number documents in shuffled order (doc_id, lens, rank)."""
    hashed = lengths.withColumn("_digest", digest(seed, F.lit("order"), "doc_id"))
    return position_by_digest(hashed, "_digest", ["doc_id"], "rank").drop("_digest")


def other_document(plan: DataFrame, ranked: DataFrame, seed: int) -> DataFrame:
    """Add a random other document and a random start in it (b_doc, b_start).

    The step from the own rank is 1 .. n-1, so the document itself is never drawn,
    unless it is the only one.
    """
    others = F.greatest(F.col("_n") - 1, F.lit(1))
    step = integer(uniform(seed, F.lit("other"), "round", "doc_id", "start"), others) + 1
    drawn = (
        plan.withColumn("_n", ranked.agg(F.count("*")).scalar())
        .withColumn("_other", F.pmod(F.col("rank") + step, F.col("_n")))
        .drop("_n")
    )
    partner = ranked.select(
        F.col("rank").alias("_other"), F.col("doc_id").alias("b_doc"), F.size("lens").alias("_segments")
    )
    at = integer(uniform(seed, F.lit("b_start"), "round", "doc_id", "start"), F.col("_segments")).cast("int")
    return drawn.join(partner, "_other").withColumn("b_start", at).drop("_other", "_segments")


def pages(segs: DataFrame, reach: int) -> DataFrame:
    """Runs of consecutive packed segments (doc_id, page, segs): ``PAGE`` of them and some of the next page.

    A range of at most ``reach`` segments lies whole in the page of its first one.
    """
    last = F.floor(F.col("seg_no") / PAGE)
    first = F.greatest(F.lit(0), F.ceil((F.col("seg_no") - reach + 2) / PAGE) - 1)
    page = F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("page")
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "tokens")))
    text = F.col("packed") if "packed" in segs.columns else packed(F.col("tokens"))
    copied = segs.select("doc_id", "seg_no", text.alias("tokens"), page)
    return copied.groupBy("doc_id", "page").agg(F.transform(ordered, lambda s: s["tokens"]).alias("segs"))


def _first_of_random(segs: Column, target: Column) -> Column:
    """Segments up to the one that reaches the target."""
    start = F.struct(
        F.lit(0).alias("n"), target.alias("target"), F.array().cast("array<string>").alias("tokens")
    )

    def step(state: Column, s: Column) -> Column:
        longer = let(unpacked(s), lambda t: F.struct(
            (state["n"] + F.size(t)).alias("n"),
            state["target"].alias("target"),
            F.concat(state["tokens"], t).alias("tokens"),
        ))
        # At least one segment is taken, whatever the target.
        return F.when((state["n"] > 0) & (state["n"] >= state["target"]), state).otherwise(longer)

    return F.aggregate(segs, start, step)["tokens"]


def in_page(ranges: DataFrame, paged: DataFrame, doc: str, start: str, how: str = "inner") -> DataFrame:
    """Join each range to the page that its first segment lies in (segs, first: the page's first segment).

    What is taken of a page is cut out where the two meet, so that only the ranges' own
    columns and the pages are moved.
    """
    wanted = ranges.withColumn("_page", F.floor(F.col(start) / PAGE).cast("int"))
    theirs = paged.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_its_page"), "segs")
    met = (F.col(doc) == F.col("_doc")) & (F.col("_page") == F.col("_its_page"))
    return wanted.join(theirs, met, how).withColumn("first", F.col("_page") * PAGE).drop("_doc", "_page", "_its_page")


def _between(lo: Column, hi: Column) -> Column:
    """Packed segments [lo, hi) of the page at hand."""
    return F.slice("segs", lo - F.col("first") + 1, hi - lo)


def _tokens(segs: Column) -> Column:
    return F.flatten(F.transform(segs, unpacked))


def sentence_pairs(plan: DataFrame, segs: DataFrame, ranked: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Fill in the tokens of both sides (round, doc_id, start, tokens_a, tokens_b, is_random_next).

    A ``position`` of the plan's rows is kept. A range has at most as many segments as a chunk has tokens, so it lies in one page. Chunks
    with a replaced second half bring their first half to the page of the other document; the
    others are complete where they meet their own page.
    """
    paged = pages(segs, options.max_seq_length - 3)
    chunk = [c for c in ("round", "doc_id", "start", "position") if c in plan.columns]
    first_half = _between(F.col("start"), F.col("a_end"))
    follow = in_page(plan.filter(~F.col("is_random_next")), paged, "doc_id", "start").select(
        *chunk,
        _tokens(first_half).alias("tokens_a"),
        _tokens(_between(F.col("a_end"), F.col("end"))).alias("tokens_b"),
        "is_random_next",
    )
    drawn = other_document(plan.filter("is_random_next"), ranked, options.seed)
    halves = in_page(drawn, paged, "doc_id", "start").select(
        *chunk, first_half.alias("_half"), "is_random_next", "target", "b_doc", F.col("b_start").cast("int").alias("b_start")
    )
    # Each segment has a token or more, so `target` segments are always enough.
    theirs = _between(F.col("b_start"), F.col("b_start") + F.col("target"))
    both = in_page(halves, paged, "b_doc", "b_start", "left").select(
        *chunk, _tokens(F.col("_half")).alias("tokens_a"), theirs.alias("_theirs"), "target", "is_random_next"
    )
    random_b = _first_of_random(F.col("_theirs"), F.col("target") - F.size("tokens_a"))
    return both.select(*chunk, "tokens_a", random_b.alias("tokens_b"), "is_random_next").unionByName(follow)


def truncated(pairs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Shorten pairs to the limit, dropping at random from the front or the back."""
    size_a, size_b = F.size("tokens_a"), F.size("tokens_b")
    keep_a, keep_b = kept_lengths(size_a, size_b, options.max_seq_length - 3)
    sides = {"a": (size_a, keep_a), "b": (size_b, keep_b)}
    cuts = [F.when(size > keep, size - keep).otherwise(0).cast("int") for size, keep in sides.values()]
    drawn = pairs.withColumn("_front", _front_counts(options.seed)(row_keys(*KEYS), *cuts))
    kept = {f"tokens_{s}": F.slice(f"tokens_{s}", F.col(f"_front.{s}") + 1, keep) for s, (_, keep) in sides.items()}
    return drawn.withColumns(kept).drop("_front")


def _front_counts(seed: int):
    """How many of the tokens to drop go from the front of each side, one draw for each."""

    def side(name: str, keys: list[bytes], cuts: pa.Array) -> pa.Array:
        n = cuts.to_numpy()
        row, place = places_of(n)
        at_front = uniforms(seed, f"front_{name}", keys, row, place + 1) < 0.5
        return pa.array(np.bincount(row[at_front], minlength=len(n)).astype(np.int32))

    @arrow_udf("struct<a:int,b:int>")
    def counts(keys: pa.Array, cut_a: pa.Array, cut_b: pa.Array) -> pa.Array:
        texts = [k.encode() for k in keys.to_pylist()]
        return pa.StructArray.from_arrays([side("a", texts, cut_a), side("b", texts, cut_b)], ["a", "b"])

    return counts.asNondeterministic()


def assembled(pairs: DataFrame) -> DataFrame:
    """``[CLS] a [SEP] b [SEP]`` with segment ids."""
    tokens = framed(F.col("tokens_a"), F.col("tokens_b"), F.lit("[CLS]"), F.lit("[SEP]"))
    ids = type_ids(F.size("tokens_a"), F.size("tokens_b"))
    return pairs.withColumns({"tokens": tokens, "segment_ids": ids}).drop("tokens_a", "tokens_b")


def masked_count(n_tokens: Column, options: Options = DEFAULTS) -> Column:
    """How many tokens to mask; halves round to even."""
    wanted = F.rint(n_tokens * F.lit(options.masked_prob)).cast("int")
    return F.least(F.lit(options.max_predictions), F.greatest(F.lit(1), wanted))


def whole_words(tokens: Column) -> Column:
    """Positions grouped to words: a ``##`` piece joins the word before it."""
    candidates = F.filter(
        F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
        lambda x: ~x["t"].isin("[CLS]", "[SEP]"),
    )

    # Each word is cut out between two heads; words added one by one would be copied with every token.
    def groups(kept: Column) -> Column:
        numbered = F.transform(kept, lambda x, j: F.struct(j.alias("j"), x["t"].alias("t")))
        heads = F.filter(numbered, lambda x: (x["j"] == 0) | ~F.startswith(x["t"], F.lit("##")))
        return let(F.struct(F.transform(heads, lambda x: x["j"]).alias("at"), F.transform(kept, lambda x: x["i"]).alias("i")), words)

    def words(s: Column) -> Column:
        end = lambda k: F.coalesce(F.get(s["at"], k + 1), F.size(s["i"]))
        return F.transform(s["at"], lambda h, k: F.slice(s["i"], h + 1, end(k) - h))

    return let(candidates, groups)


class Words:
    """Whole words of a batch of token lists, each list's in a seeded random order.

    ``row`` is a word's list, ``size`` its tokens, ``at`` where they begin in ``place``.
    """

    def __init__(self, tokens: pa.Array, keys: list[bytes], seed: int):
        row, place = places_of(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
        values = tokens.flatten()
        special = pc.fill_null(pc.is_in(values, pa.array(["[CLS]", "[SEP]", None], values.type)), True)
        kept = ~special.to_numpy(zero_copy_only=False)
        row, self.place = row[kept], place[kept].astype(np.int32)
        head = ~pc.starts_with(values, "##").fill_null(False).to_numpy(zero_copy_only=False)[kept]
        at = np.flatnonzero(head | (np.diff(row, prepend=-1) != 0))
        size = np.diff(at, append=len(row))
        drawn = digests(seed, "mask", keys, row[at], self.place[at])
        order = np.lexsort((self.place[at], drawn[:, 1], drawn[:, 0], row[at]))
        self.row, self.at, self.size = row[at][order], at[order], size[order]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Tokens of the words, one after the other."""
        word, i = places_of(self.size[words])
        return self.place[self.at[words][word] + i]

    def picked(self, quotas: np.ndarray) -> np.ndarray:
        """The words that are taken until each list's quota is used; one that would pass it is skipped."""
        ends = np.searchsorted(self.row, np.arange(len(quotas)), "right").tolist()
        sizes, taken, word = self.size.tolist(), [], 0
        for left, end in zip(quotas.tolist(), ends):
            while word < end and left:
                if sizes[word] <= left:
                    left -= sizes[word]
                    taken.append(word)
                word += 1
            word = end
        return np.array(taken, dtype=np.int64)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def _lists_of(row: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Values grouped to lists by their sorted row, null where ``like`` is."""
    offsets = _offsets(np.bincount(row, minlength=len(like)))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=like.is_null())


def shuffled_words(instances: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Add the whole words of each instance, lists of positions, in a seeded random order (words)."""

    def part(tokens: pa.Array, keys: list[bytes]) -> pa.Array:
        words = Words(tokens, keys, options.seed)
        places = words.places(np.arange(len(words.row)))
        return _lists_of(words.row, pa.ListArray.from_arrays(pa.array(_offsets(words.size)), pa.array(places)), tokens)

    @arrow_udf("array<array<int>>")
    def run(tokens: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            part(tokens.slice(at, n), [k.encode() for k in keys.slice(at, n).to_pylist()]) for at, n in item_parts(tokens)
        ])

    return instances.withColumn("words", run.asNondeterministic()("tokens", row_keys(*KEYS)))


def picked_positions(instances: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Choose whole words in shuffled order until the quota is used (positions).

    A word that would pass the quota is skipped and the next one tried.
    """

    def part(tokens: pa.Array, keys: list[bytes], quotas: np.ndarray) -> pa.Array:
        words = Words(tokens, keys, options.seed)
        taken = words.picked(quotas)
        row, place = np.repeat(words.row[taken], words.size[taken]), words.places(taken)
        return _lists_of(row, pa.array(place[np.lexsort((place, row))]), tokens)

    @arrow_udf("array<int>")
    def run(tokens: pa.Array, keys: pa.Array, quotas: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            part(tokens.slice(at, n), [k.encode() for k in keys.slice(at, n).to_pylist()], quotas.slice(at, n).to_numpy())
            for at, n in item_parts(tokens)
        ])

    quota = masked_count(F.size("tokens"), options)
    return instances.withColumn("positions", run.asNondeterministic()("tokens", row_keys(*KEYS), quota))


def masked(instances: DataFrame, vocab: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Replace the picked tokens: 80 % by ``[MASK]``, 10 % kept, 10 % random.

    Random tokens are drawn by their place in the vocabulary, as ids may have gaps. No row is
    moved while the vocabulary ``fits``; else they are looked up by a join. An instance without a
    picked position stays as it is.
    """
    ranked = position_by_id(vocab.select("id", "token"), "id", "_drawn").select("_drawn", F.col("token").alias("_random"))

    if fits(vocab):
        changed = instances.withColumn("_masked", _masked_in_place(ranked, vocab.count(), options.seed)("tokens", "positions", row_keys(*KEYS)))
        return changed.withColumn("tokens", F.col("_masked.tokens")).select(
            *instances.drop("positions").columns, "_masked.masked_lm_positions", "_masked.masked_lm_labels"
        )
    with_changes = _changed_by_join(instances, ranked, vocab.agg(F.count("*")).scalar(), options.seed)
    new = F.map_from_entries(F.transform("_changes", lambda c: F.struct(c["p"], c["t"])))
    out = let(new, lambda m: F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at(m, i), t)))
    return with_changes.withColumns(
        {
            "tokens": out,
            "masked_lm_positions": F.transform("_changes", lambda c: c["p"]),
            "masked_lm_labels": F.transform("_changes", lambda c: c["label"]),
        }
    ).drop("_changes", "positions")


def _masked_in_place(ranked: DataFrame, n: int, seed: int):
    """Masked tokens, positions and labels of token lists; ``ranked`` goes to the tasks."""
    rows = ranked.toArrow()
    at_place = dict(zip(rows["_drawn"].to_pylist(), rows["_random"].to_pylist()))

    def random_tokens(draws: np.ndarray) -> list[str]:
        found = [at_place.get(at) for at in np.floor(draws * n).astype(np.int64).tolist()]
        if None in found:
            raise ValueError("no vocabulary token at a drawn place")
        return found

    def part(tokens: pa.Array, positions: pa.Array, keys: list[bytes]) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        row, _ = places_of(pc.fill_null(pc.list_value_length(positions), 0).to_numpy())
        place = positions.flatten().to_numpy()
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        values, first = tokens.flatten(), np.cumsum(sizes) - sizes
        labels = values.take(pa.array(first[row] + place))
        changed = uniforms(seed, "mask80", keys, row, place) < 0.8
        others = np.flatnonzero(~changed)
        drawn = others[uniforms(seed, "keep50", keys, row[others], place[others]) >= 0.5]
        new = np.array(labels.to_pylist(), dtype=object)
        new[changed] = "[MASK]"
        new[drawn] = random_tokens(uniforms(seed, "token", keys, row[drawn], place[drawn]))
        mask = np.zeros(len(values), dtype=bool)
        mask[first[row] + place] = True
        out = pc.replace_with_mask(values, pa.array(mask), pa.array(new, values.type))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(pa.array(_offsets(sizes)), out, mask=tokens.is_null()),
            _lists_of(row, pa.array(place), positions), _lists_of(row, labels, positions),
        ], ["tokens", "masked_lm_positions", "masked_lm_labels"])

    @arrow_udf("struct<tokens:array<string>,masked_lm_positions:array<int>,masked_lm_labels:array<string>>")
    def run(tokens: pa.Array, positions: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            part(tokens.slice(at, n), positions.slice(at, n), [k.encode() for k in keys.slice(at, n).to_pylist()])
            for at, n in item_parts(tokens)
        ])

    return run.asNondeterministic()


def _changed_by_join(instances: DataFrame, ranked: DataFrame, n: Column, seed: int) -> DataFrame:
    def draw(purpose: str, p: Column) -> Column:
        return uniform(seed, F.lit(purpose), *KEYS, p)

    p = F.col("p")
    choice = F.when(draw("mask80", p) < 0.8, "mask").when(draw("keep50", p) < 0.5, "keep").otherwise("random")
    flat = instances.select(*KEYS, F.explode("positions").alias("p"), F.element_at("tokens", F.col("p") + 1).alias("label"))
    # Rows that need no token get keys below 0, which match nothing and spread evenly.
    nowhere = -1 - F.pmod(F.xxhash64(*KEYS, "p"), F.lit(1 << 40))
    flat = flat.withColumn("_choice", choice).withColumn(
        "_drawn", F.when(F.col("_choice") == "random", integer(draw("token", p), n)).otherwise(nowhere)
    )
    looked = flat.join(ranked, "_drawn", "left")
    random = F.coalesce("_random", F.raise_error(F.lit("no vocabulary token at a drawn place")))
    new = F.when(F.col("_choice") == "mask", "[MASK]").when(F.col("_choice") == "keep", F.col("label")).otherwise(random)
    changes = looked.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("p", new.alias("t"), "label"))).alias("_changes")
    )
    none = F.array().cast("array<struct<p:int,t:string,label:string>>")
    return instances.join(changes, list(KEYS), "left").withColumn("_changes", F.coalesce("_changes", none))


def padded_records(rows: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Fixed-length records from ids (input_ids, segment_ids, positions, label ids)."""
    length, most = options.max_seq_length, options.max_predictions
    zero = F.lit(0)
    ones = F.transform("ids", lambda _: F.lit(1))
    weights = F.transform("masked_lm_positions", lambda _: F.lit(1.0).cast("float"))
    kept = [c for c in rows.columns if c in ("round", "doc_id", "start", "position", "shard")]
    return rows.select(
        *kept,
        pad(F.col("ids"), length, zero).alias("input_ids"),
        pad(ones, length, zero).alias("input_mask"),
        pad(F.col("segment_ids"), length, zero).alias("segment_ids"),
        pad(F.col("masked_lm_positions"), most, zero).alias("masked_lm_positions"),
        pad(F.col("label_ids"), most, zero).alias("masked_lm_ids"),
        pad(weights, most, F.lit(0.0).cast("float")).alias("masked_lm_weights"),
        F.array(F.col("is_random_next").cast("int")).alias("next_sentence_labels"),
    )


def shuffled(rows: DataFrame, seed: int, keys: Sequence[str], purpose: str = "instances", name: str = "position") -> DataFrame:
    """Number rows in a seeded random order."""
    hashed = rows.withColumn("_digest", digest(seed, F.lit(purpose), *keys))
    return position_by_digest(hashed, "_digest", list(keys), name).drop("_digest")
