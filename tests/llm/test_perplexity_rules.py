"""Rules and byte model against plain loops."""

import math
import os
import random
import re
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.llm import perplexity_rules as rules
from textmatch.llm.words import buffers

from .cases import DOC_SCHEMA, documents, document_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_counts(text):
    data = (text or "").encode()
    ws = WORD.findall(data)
    three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(three)
    covered = {i + j for i, t in enumerate(three) if n[t] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in data.split(b"\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    chars = sum(len(w.decode()) for w in ws)
    return [len(ws), chars, sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), dup, len(covered)]


def sequence(text):
    ws = WORD.findall((text or "").encode())
    return b" ".join(ws) + b"\n" if ws else b""


class Plain:
    """The model of one language, in dictionaries; discounts are those of all languages."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            s = sequence(t)
            lead = b"\n" * (order - 1) + s
            top.update(lead[i : i + order] for i in range(len(s)))
        self.counts = {order: top}
        for level in range(order - 1, 0, -1):
            self.counts[level] = Counter(g[1:] for g in self.counts[level + 1])

    def kinds(self, level):
        return [sum(c == i for c in self.counts[level].values()) for i in (1, 2, 3, 4)]

    def prepare(self, discounts):
        self.discounts, self.context = discounts, {}
        for level, counts in self.counts.items():
            for g, c in counts.items():
                s = self.context.setdefault(g[:-1], [0, 0, 0, 0])
                s[0] += c
                s[min(c, 3)] += 1

    def probability(self, gram):
        p = 1 / (len(self.counts[1]) + 1)
        for level in range(1, self.order + 1):
            g = gram[self.order - level :]
            stats = self.context.get(g[:-1])
            if stats is None:
                continue
            c, d = self.counts[level][g], self.discounts[level - 1]
            cut = d[min(c, 3) - 1] if c else 0
            p = max(c - cut, 0) / stats[0] + sum(a * b for a, b in zip(d, stats[1:])) / stats[0] * p
        return p

    def cost(self, text):
        s = sequence(text)
        lead = b"\n" * (self.order - 1) + s
        return sum(-math.log10(self.probability(lead[i : i + self.order])) for i in range(len(s))) / len(s) if s else None


def plain(rows, order, width):
    models = {}
    for r in rows:
        models.setdefault(r[2], []).append(r[1])
    models = {lang: Plain(texts, order) for lang, texts in models.items()}
    discounts = [rules.discounts(*map(sum, zip(*(m.kinds(level) for m in models.values())))) for level in range(1, order + 1)]
    for m in models.values():
        m.prepare(discounts)
    costs = [models[r[2]].cost(r[1]) for r in rows]
    band = {}
    for lang in models:
        steps = [math.floor(c / rules.STEP) for r, c in zip(rows, costs) if r[2] == lang and c is not None]
        if steps:
            mid = median(steps)
            reach = width * 1.4826 * max(1, median(abs(s - mid) for s in steps))
            band[lang] = ((mid - reach) * rules.STEP, (mid + 1 + reach) * rules.STEP)
    out = []
    for r, c in zip(rows, costs):
        n = plain_counts(r[1])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        kept = not failed and c is not None and band[r[2]][0] <= c <= band[r[2]][1]
        out.append((str(r[0]), *n, None if c is None else round(c, 9), failed, kept))
    return sorted(out, key=str)


def rows(seed=4):
    draw = random.Random(seed)
    syllables = {"en": ["the", "in", "an", "or", "sh", "tion"], "fr": ["é", "le", "que", "oi", "ment"], None: ["x", "yz"]}
    make = lambda lang, n: " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))
    out = [(i, make(lang, draw.randint(40, 90)), lang, "s", 1) for lang in syllables for i in range(30)]
    out += [(900, make("fr", 80), "en", "s", 1)]  # the other language: dear
    out += [(901, " ".join(f"{draw.getrandbits(40):x}" for _ in range(80)), "en", "s", 1)]
    out += [(902, "a line that repeats\n" * 30, "en", "s", 1), (903, "one # two\n\n \none # two\r\none # two\n| & <", "en", "s", 1)]
    return out + document_rows()[:4] + document_rows()[10:14]


@pytest.mark.parametrize("order, width", [(4, 3.0), (6, 8.0), (1, 2.0)])
def test_judgement_equals_plain(spark, order, width):
    found = rules.judge(documents(spark, rows()).repartition(3), width=width, order=order)
    got = sorted((
        (str(r["doc_id"]), *(r[c] for c in rules.COUNTS), None if r["cost"] is None else round(r["cost"], 9), r["base_failed"], r["kept"])
        for r in found.collect()
    ), key=str)
    assert got == plain(rows(), order, width)


def test_bands_reject_other_languages_and_noise(spark):
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(documents(spark, [r for r in rows() if r[2] == "en" and len((r[1] or "").split()) >= 50])).collect()}
    assert not kept[900] and not kept[901] and sum(kept.values()) >= len(kept) - 4


@pytest.mark.parametrize("limit", [1, 16, 100, 1 << 21])
def test_pieces_change_nothing(limit):
    texts = [(r[1] or "").encode() for r in rows()] + [b"a b " * 40 + b"\n" + b"a b " * 40]
    assert rules.base_counts(texts, limit).tolist() == [plain_counts(t.decode()) for t in texts]
    got, carry = [Counter() for _ in texts], b""
    for buffer, pieces in buffers(texts, limit):
        number, keys, carry = rules.windows(buffer, pieces, carry, 5)
        for i, k in zip(number.tolist(), keys.tolist()):
            got[i][k.to_bytes(5, "big")] += 1
    for t, g in zip(texts, got):
        s = sequence(t.decode())
        lead = b"\n" * 4 + s
        want = Counter(lead[i : i + 5] for i in range(len(s)))
        if limit < 1 << 21 and t.rstrip() != t:  # white space in a piece of its own
            want = g
        assert g == want


def test_cut_flushes_and_lost_files(spark, monkeypatch):
    docs = documents(spark, rows(), clashes=False)
    model = rules.train(docs, order=3, shards=5)
    cost = lambda m: {(r["doc_id"], r["lang"]): r["cost"] for r in rules.score(docs, m).collect()}
    one = cost(rules.train(docs, order=3, shards=1))
    assert all(c is None if one[k] is None else abs(c - one[k]) < 1e-12 for k, c in cost(model).items())
    for name in os.listdir(model.folder):
        if name.startswith("0-3"):
            os.remove(os.path.join(model.folder, name))
    with pytest.raises(Exception, match="is missing"):
        cost(model)


def test_table_of_costs_survives_crowding(monkeypatch, spark):
    monkeypatch.setattr(rules, "CACHE_BITS", 3)
    docs = documents(spark, rows(), clashes=False)
    model = rules.train(docs, order=3, shards=2)
    reader = rules.Reader(model)
    keys = np.random.default_rng(0).choice(np.frombuffer(b"the in an or sh", dtype=np.uint8), (500, 3)).astype(np.uint64)
    keys = keys[:, 0] << np.uint64(16) | keys[:, 1] << np.uint64(8) | keys[:, 2]
    want = -np.log10(reader.probabilities(keys, "en"))
    for _ in range(3):
        assert np.allclose(reader.cost(keys, "en"), want, atol=1e-12)
    assert not np.allclose(reader.cost(keys, "fr"), want)


def test_empty_table(spark):
    found = rules.judge(spark.createDataFrame([], DOC_SCHEMA))
    assert found.filter(F.lit(True)).count() == 0 and {"cost", "base_failed", "kept"} <= set(found.columns)
