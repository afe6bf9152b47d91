"""Main text of pages: reading, decoding, and held-out pages."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.llm import html_trees as ht

from .cases import say, with_clashes


def page(draw, k):
    """A page and its main text."""
    blocks = [say(draw, draw.randint(3, 60)) + " &amp; &eacute;&#33;" for _ in range(draw.randint(1, 8))]
    body = "".join(f"<p>{b}\n  <b>bold{k}</b> tail" + ("</p>" if draw.random() < 0.7 else "") for b in blocks)
    want = f"Title {k} " + " ".join(f"{b.replace('&amp;', '&').replace('&eacute;', 'é').replace('&#33;', '!')} bold{k} tail" for b in blocks)
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in say(draw, 5).split())
    html = (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p><article>';</script></head><body><nav><ul>{menu}</ul></nav>"
        f'<!-- note --><div class="ad">{say(draw, 8)}.</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; {say(draw, 5)}</footer></body></html>'
    )
    return html, want


@pytest.fixture(scope="module")
def trees():
    draw = random.Random(3)
    rows = []
    for k in range(90):
        html, _ = page(draw, k)
        for variant in (html, ht.varied(html, draw), ht.varied(html, draw)):
            rows.append(ht.examples(ht.read(variant)))
    rows = np.concatenate(rows)
    return ht.boost(rows[:, :-1], rows[:, -1].astype(float))


def test_held_out_pages(trees):
    draw = random.Random(77)
    pages = [page(draw, k) for k in range(120)]
    got = ht.extract(trees, [h for h, _ in pages])
    assert sum(g == w for g, (_, w) in zip(got, pages)) >= 118


def test_held_out_variants(trees):
    draw = random.Random(78)
    same = total = 0
    for k in range(120):
        variant = ht.varied(page(draw, k)[0], draw)
        read = ht.read(variant)
        same += ht.extract(trees, [variant])[0] == ht.main_text(read, [bool(x) for x in ht.labels(read)])
        total += 1
    assert same >= 0.9 * total


def test_decoding_is_consistent_and_best():
    draw = np.random.default_rng(0)
    for _ in range(60):
        n = int(draw.integers(1, 9))
        parents = [-1] + [int(draw.integers(0, i)) for i in range(1, n)]
        odds = draw.normal(size=n) * 2
        kept = ht.keep(parents, odds)

        def value(choice):
            return sum(-np.logaddexp(0, -odds[i] if choice[i] else odds[i]) for i in range(1, n) if choice[parents[i]])

        best = max(
            value((True, *c)) for c in itertools.product((False, True), repeat=n - 1)
            if all(not c[i - 1] or (True, *c)[parents[i]] for i in range(1, n))
        )
        assert all(not kept[i] or kept[parents[i]] for i in range(1, n))
        assert abs(value(kept) - best) < 1e-9


def text_of(html):
    read = ht.read(html)
    return ht.main_text(read, [True] * len(read.tags))


def test_reading():
    assert text_of("a<p>b<p>c <i>d</i>e<br>f<div>g</div>h") == "a b c de f g h"
    assert text_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a b c d"
    assert text_of("x &lt;b&gt; &nbsp; &#x41;&unknown; 1 < 2 <3") == "x <b> A&unknown; 1 < 2 <3"
    assert text_of("<script>if (a</b) '<p>'</script>y<!-- z --><style>q</style>") == "y"
    assert text_of("</p></div>a</b>b<table><tr><td>c<td>d<tr><td>e</table>") == "ab c d e"
    assert text_of("<p title='a>b'>c</p><img alt=\"<p>\">d") == "c d"
    assert text_of("<script>never closed") == "" and text_of("") == "" and text_of(None) == ""


def test_broken_reading():
    assert text_of('a <b "c> d') == 'a <b "c> d' and text_of("x <! y <? z") == "x <! y <? z"
    assert text_of("<p>a</i></i></p></b>b<em>c</div>d") == "a bcd"
    assert text_of("<p><td><b>x<hr>y</td>z") == "x y z" and text_of("<ul><li>a<p>b<li>c</ul>d") == "a b c d"
    assert text_of("<i 'a\"'>b</i \"'>\">c") == "bc" and text_of("<a '\"<b \"'>c") == "c"


@pytest.mark.parametrize("made", [
    lambda n: '<a "' * n, lambda n: "<div>" * n + "</p></x>" * n, lambda n: "<a<b " * n, lambda n: "<!<?" * n,
    lambda n: "<p><td>" + "<b>" * n + "<hr>" * n, lambda n: "<i \"'" * n + ">", lambda n: "<i id='x" * n + '">',
])
def test_time_grows_with_length(made):
    def seconds(n):
        begin = time.process_time()
        ht.read(made(n))
        return time.process_time() - begin

    assert min(seconds(40_000) for _ in range(3)) < 3 * min(seconds(20_000) for _ in range(3)) + 0.2


def test_a_repeated_id_gives_the_sample_one_row(spark):
    rows = [(1, page(random.Random(i), i)[0]) for i in range(40)] + [(2, page(random.Random(50), 50)[0])]
    table = spark.createDataFrame(rows, "page_id long, html string")
    once = spark.createDataFrame([(1, min(h for i, h in rows if i == 1)), rows[-1]], "page_id long, html string")
    one, two = ht.learn(table), ht.learn(once)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_tables(spark):
    draw = random.Random(5)
    rows = [(i, f"u{i}", page(draw, i)[0]) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", "<p>x"), (102, "u", "plain text only"), (103, "u", "<div>" * 3000 + "deep"), (1, "u1", rows[1][2])]
    rows += [(104, "u", "<article>" + "<p>" + say(draw, 200_000) + "</article>")]
    table = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    trees = ht.learn(table)
    got = table.withColumn("text", ht.texts(F.col("html"), trees)).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], set()).add(r["text"])
    assert by[100] == {""} and by[101] == {""} and len(by[1]) == 1
    empty = table.limit(0)
    assert ht.extract(ht.learn(empty), ["<p>a"]) is not None and empty.select(ht.texts(F.col("html"), trees)).count() == 0
