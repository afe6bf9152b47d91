"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other: each logistic model sees the words of
a text and the probabilities of all categories before it. While training, those
probabilities come from models that did not see the row (out-of-fold), so a later model
meets them as they will be for new texts. The last category is the label itself; a text
is rejected if its probability reaches ``THRESHOLD``. The categories before it are the
labelled texts that hold one of the terms in ``TERMS``.

Features are the distinct words (runs of letters, A-Z in lower case) by hash, found for a
whole batch of texts in a few array operations. Weights come from at most ``SAMPLE``
labelled rows, those with the smallest seeded digest; everything else covers all rows.

Defined results: a null or empty text has no words and is scored by the constant terms;
labels that are null count as absent, and the larger label counts where an id has
several; without labels of both kinds nothing is rejected. Repeated rows get equal
scores. Other columns pass through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.draws import digest
from ..session import written
from .words import buffers, hash_slices, hash_word, lower, mix

SAMPLE = 20_000
VOCABULARY = 4096  # at most; a quarter of the labelled rows where those are fewer
MIN_TEXTS = 3
FOLDS = 5
THRESHOLD = 0.5
SEED = 42
# The terms that define the categories before the label.
TERMS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting"),
}
CATEGORIES = (*TERMS, "toxic")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Chain(NamedTuple):
    """Sorted hashes of the known words, and a row of weights for each category."""

    words: np.ndarray
    weights: list[np.ndarray]  # constant, words, earlier probabilities


def text_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of the distinct words of each text, sorted."""
    numbers, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for buffer, pieces in buffers(map(lower, texts)):
        inside = np.concatenate(([False], _LETTER[buffer], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        piece = np.searchsorted(np.array([p.start for p in pieces]), starts, side="right") - 1
        numbers.append(np.array([p.text for p in pieces], dtype=np.int64)[piece])
        hashes.append(hash_slices(buffer, starts, ends))
    return np.concatenate(numbers), np.concatenate(hashes)


def distinct_rows(numbers: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, numbers))
    numbers, hashes = numbers[order], hashes[order]
    new = np.ones(len(numbers), dtype=bool)
    new[1:] = (numbers[1:] != numbers[:-1]) | (hashes[1:] != hashes[:-1])
    return numbers[new], hashes[new]


# ---- training ------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression with an L2 penalty, by accelerated gradient steps."""
    n, k = len(y), extra.shape[1]
    w, look, t = np.zeros(1 + size + k), np.zeros(1 + size + k), 1.0
    x = np.full(1 + size + k, 1.0)  # largest curvature by a few power steps
    for _ in range(12):
        x /= np.linalg.norm(x)
        z = x[0] + np.bincount(rows, x[1 + cols], minlength=n) + extra @ x[1 + size :]
        x = np.concatenate(([z.sum()], np.bincount(cols, z[rows], minlength=size), extra.T @ z))
    step = 1.0 / (0.3 * float(np.linalg.norm(x)) + ridge)
    before = np.inf
    for _ in range(400):
        z = look[0] + np.bincount(rows, look[1 + cols], minlength=n) + extra @ look[1 + size :]
        residual = _sigmoid(z) - y
        gradient = np.concatenate(([residual.sum()], np.bincount(cols, residual[rows], minlength=size), extra.T @ residual))
        gradient[1:] += ridge * look[1:]
        new = look - step * gradient
        loss = float(np.logaddexp(0, -np.where(y > 0, z, -z)).sum() + 0.5 * ridge * (look[1:] ** 2).sum())
        if loss > before:  # momentum overshot: start it again
            t, look, before = 1.0, w.copy(), np.inf
            step *= 0.5
            continue
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t, before = new + (t - 1) / t_next * (new - w), new, t_next, loss
    return w


def predict(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int, size: int) -> np.ndarray:
    return _sigmoid(w[0] + np.bincount(rows, w[1 + cols], minlength=n) + extra @ w[1 + size :])


def train(words: np.ndarray, features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the chain. ``features`` has places in ``words``, ``labels`` a column per category."""
    n, size = len(features), len(words)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    cols = np.concatenate([np.zeros(0, dtype=np.int64), *features]).astype(np.int64)
    extra, weights = np.zeros((n, 0)), []
    for c in range(len(CATEGORIES)):
        y = labels[:, c].astype(float)
        held = np.zeros(n)
        for fold in range(FOLDS):
            out = folds == fold
            number = np.cumsum(~out) - 1
            use = ~out[rows]
            w = fit(number[rows[use]], cols[use], extra[~out], y[~out], size)
            held[out] = predict(w, rows, cols, extra, n, size)[out]
        weights.append(fit(rows, cols, extra, y, size))
        extra = np.column_stack([extra, held])
    return Chain(words, weights)


def telling_words(labelled: DataFrame) -> np.ndarray:
    """Hashes of the words whose share of toxic texts stands out most, sorted.

    ``labelled`` has toxic and words; only the chosen hashes come to the driver.
    """
    n, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not n or toxic in (0, n):
        return np.zeros(0, dtype=np.uint64)

    def count(batches):
        for batch in batches:
            each = [np.frombuffer(w, dtype=np.int64) for w in batch["words"]]
            word, place = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *each]), return_inverse=True)
            hit = np.repeat(batch["toxic"].to_numpy(), [len(e) for e in each])
            yield pd.DataFrame({
                "word": word, "texts": np.bincount(place, minlength=len(word)),
                "hits": np.bincount(place, hit, minlength=len(word)).astype(np.int64),
            })

    counts = labelled.select("toxic", "words").mapInPandas(count, "word long, texts long, hits long")
    counts = counts.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("hits").alias("hits"))
    rate = F.lit(toxic / n)
    score = F.abs(F.col("hits") - rate * F.col("texts")) / F.sqrt(F.col("texts") * rate * (1 - rate))
    best = counts.filter(F.col("texts") >= MIN_TEXTS).withColumn("score", score).filter("score > 0")
    best = best.orderBy(F.desc("score"), "word").limit(min(VOCABULARY, max(64, n // 4)))
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], dtype=np.int64).view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Chain:
    """Train on at most ``sample`` labelled documents.

    The driver gets the chosen words and, per document, which of them it holds.
    """
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.withColumn("_order", digest(seed, "doc_id")).orderBy("_order", "doc_id").limit(sample)
    known = F.broadcast(known.select(F.col("doc_id").alias("_id"), "_toxic"))  # at most ``sample`` rows
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    terms = [{hash_word(t.encode()) for t in group} for group in TERMS.values()]

    def extract(batches):
        for batch in batches:
            numbers, hashes = distinct_rows(*text_words(batch["text"]))
            cuts = np.searchsorted(numbers, np.arange(len(batch) + 1))
            own = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "toxic": (batch["_toxic"] > 0).astype(int),
                "holds": [[bool(g.intersection(o.tolist())) for g in terms] for o in own], "words": [o.tobytes() for o in own],
            })

    labelled = written(rows.mapInPandas(extract, "doc_id long, toxic int, holds array<boolean>, words binary"), "labelled")
    words = telling_words(labelled)
    if not len(words):  # labels of one kind, or no word that tells them apart
        return Chain(words, [np.concatenate(([-30.0], np.zeros(i))) for i in range(len(CATEGORIES))])

    def locate(batches):
        for batch in batches:
            places = []
            for w in batch["words"]:
                own = np.frombuffer(w, dtype=np.uint64)
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                places.append(at[words[at] == own].astype(np.uint16).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "holds": batch["holds"], "places": places})

    got = labelled.mapInPandas(locate, "doc_id long, toxic int, holds array<boolean>, places binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["places"]))
    toxic = np.array([r["toxic"] for r in got])
    holds = np.array([r["holds"] for r in got], dtype=int)
    ids = np.array([r["doc_id"] for r in got], dtype=np.int64).view(np.uint64)
    features = [np.frombuffer(r["places"], dtype=np.uint16) for r in got]
    y = np.column_stack([holds * toxic[:, None], toxic])
    return train(words, features, y, (mix(ids) % np.uint64(FOLDS)).astype(int))


# ---- scoring -------------------------------------------------------------------


def chain_scores(chain: Chain, texts) -> np.ndarray:
    """A column of probabilities for each category."""
    n, size = len(texts), len(chain.words)
    rows, hashes = text_words(texts)
    at = np.searchsorted(chain.words, hashes)
    at[at == size] = 0
    known = chain.words[at] == hashes if size else np.zeros(len(hashes), dtype=bool)
    rows, cols = distinct_rows(rows[known], at[known].astype(np.uint64))
    cols = cols.astype(np.int64)
    extra = np.zeros((n, 0))
    for w in chain.weights:
        extra = np.column_stack([extra, predict(w, rows, cols, extra, n, size)])
    return extra


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add ``toxicity``, a struct with the probability of each category."""

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def run(texts: pd.Series) -> pd.DataFrame:
        parts = [chain_scores(chain, texts.iloc[i : i + 1024]) for i in range(0, len(texts), 1024)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES))), columns=list(CATEGORIES))

    return docs.withColumn("toxicity", run(F.col(text)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept."""
    columns = docs.columns
    scored = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text")), learn(docs, labels))
    return scored.filter(F.col("toxicity.toxic") < threshold).select("row.*")
