"""The n-gram model against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from textmatch.llm import kneser_ney as kn

from .cases import DOC_SCHEMA, documents, document_rows, say, words


class Plain:
    """The same formulas, level by level."""

    def __init__(self, texts, order):
        self.order = order
        grams = Counter()
        self.tokens = Counter()
        for t in texts:
            ws = ["<s>"] * (order - 1) + [w.decode() for w in words(t)] + ["</s>"]
            self.tokens.update(ws[order - 1 :])
            grams.update(tuple(ws[i : i + order]) for i in range(len(ws) - order + 1))
        self.levels = {order: grams}
        for level in range(order - 1, 0, -1):
            self.levels[level] = Counter(g[1:] for g in self.levels[level + 1])
        self.d, self.context = {}, {}
        for level, c in self.levels.items():
            k = Counter(c.values())
            n1, n2, n3, n4 = (k[i] for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = [i - (i + 1) * y * b / a if a else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.d[level] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), raw)]
            stats = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in c.items():
                stats[g[:-1]][0] += n
                stats[g[:-1]][min(n, 3)] += 1
            self.context[level] = stats

    def p(self, gram):
        if not gram:
            return 1 / (len(self.tokens) + 1)
        level, stats = len(gram), self.context[len(gram)].get(gram[:-1])
        if stats is None:
            return self.p(gram[1:])
        n = self.levels[level][gram]
        cut = self.d[level][min(n, 3) - 1] if n else 0
        back = sum(a * b for a, b in zip(self.d[level], stats[1:])) / stats[0]
        return max(n - cut, 0) / stats[0] + back * self.p(gram[1:])

    def score(self, text):
        ws = ["<s>"] * (self.order - 1) + [w.decode() for w in words(text)] + ["</s>"]
        return sum(math.log10(self.p(tuple(ws[i : i + self.order]))) for i in range(len(ws) - self.order + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order, monkeypatch):
    draw = random.Random(order)
    rows = [(i, say(draw, draw.randint(0, 60), 40), "en", "a", 1) for i in range(150)] + [r for r in document_rows() if r[0] != 12]
    train = [r[1] for r in rows if (r[0] or 0) % 3]
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string"), order, shards=3)
    plain = Plain(train, order)
    assert model.tokens == sum(plain.tokens.values()) and model.vocabulary == len(plain.tokens)
    scored = kn.score(documents(spark, rows), model).collect()
    assert len(scored) == len(rows) and "rank" in scored[0]
    want = sorted((len(words(t)) + 1, round(plain.score(t), 6)) for _, t, *_ in rows)
    got = sorted((r["n_tokens"], round(r["score"], 6)) for r in scored)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-8, abs_tol=1e-5) for a, b in zip(got, want))


def test_probabilities_sum_to_one(spark):
    draw = random.Random(2)
    texts = [say(draw, 30, 25) for _ in range(60)]
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"), 2, shards=2)
    reader = kn.Reader(model)
    vocabulary = sorted({w for t in texts for w in words(t)})
    ids = np.array([kn.hash_slices(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0] for w in vocabulary] + [kn.END])
    for context in (ids[0], kn.START, np.uint64(12345)):
        grams = np.stack([np.full(len(ids), context), ids], axis=1)
        unknown = reader.probabilities(np.array([[context, np.uint64(99)]], dtype=np.uint64))[0]
        assert math.isclose(reader.probabilities(grams).sum() + unknown, 1.0, rel_tol=1e-9)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    text = say(random.Random(1), 5000, 300)
    whole = [g for _, g, _ in _rows([text], 1 << 21)]
    parts = [g for _, g, _ in _rows([text], 1000)]
    assert len(parts) > 5 and (np.concatenate(whole) == np.concatenate(parts)).all()


def _rows(texts, limit):
    from textmatch.llm.words import buffers, hash_slices, lower, word_slices

    carry = np.zeros(0, dtype=np.uint64)
    for buffer, pieces in buffers(map(lower, texts), limit):
        starts, ends = word_slices(buffer)
        number, grams, carry = kn.token_rows(pieces, starts, hash_slices(buffer, starts, ends), carry, 3)
        yield number, grams, carry


def test_without_training_rows(spark):
    model = kn.train(spark.createDataFrame([], "text string"))
    assert model.tokens == 0
    got = kn.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert got["n_tokens"] == 3 and got["n_known"] == 0 and math.isfinite(got["score"]) and math.isfinite(got["base_score"])
    assert kn.score(spark.createDataFrame([], DOC_SCHEMA), model).count() == 0


def test_folder_must_be_mounted():
    assert kn.mounted("file:///a/b") == "/a/b" and kn.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        kn.mounted("hdfs://host:9000/a")
