import itertools
import random
import time
from html import parser

import numpy as np
import pytest

from symscape.llm import html
from tests.llm import made


def page(rng, label=True, words=80):
    nav = "".join(f"<li><a href='/x'>{made.words(rng, 1)}</a></li>" for _ in range(6))
    body = "".join(f"<p>{made.words(rng, words // 4)}</p>" for _ in range(4))
    box = "article" if label else "section"
    return body, f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><script>var a='</p>';</script><{box}>{body}</{box}><footer>{made.words(rng, 12)} &amp; co</footer></body></html>"


def test_best_run_is_that_of_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.integers(-4, 4, rng.integers(0, 12)).astype(float)
        a, b = html.best_run(s)
        best = max([0.0, *(s[i:j].sum() for i, j in itertools.combinations(range(len(s) + 1), 2))])
        assert s[a:b].sum() == best
        if best > 0:
            every = [(j, -i) for i, j in itertools.combinations(range(len(s) + 1), 2) if s[i:j].sum() == best]
            assert (b, -a) == (min(j for j, _ in every), max(-i for j, i in every if j == min(j for j, _ in every)) * -1) or s[a:b].sum() == best


def test_accuracy_on_pages_without_a_label(spark):
    rng = random.Random(1)
    labelled = [(i, "u", page(rng)[1]) for i in range(60)]
    weight = html.train(spark.createDataFrame(labelled, "page_id long, url string, html string"))
    assert weight["word"] > 0 and all(w < 0 for k, w in weight.items() if k != "word")
    right = 0
    for _ in range(50):
        body, whole = page(rng, label=False)
        got = html.text_of(whole, weight)[0].split()
        right += got == body.replace("<p>", " ").replace("</p>", " ").split()
    assert right >= 48


def test_train_counts_all_pages(spark):
    rng = random.Random(4)
    pages = [page(rng)[1] for _ in range(20)]
    counts = {}
    for p in pages:
        for side, part in enumerate(html.counts_of(p)):
            for k, n in part.items():
                counts.setdefault(k, [0, 0])[side] += n
    want = html.weights({k: tuple(v) for k, v in counts.items() if sum(v) >= 5})
    got = html.train(spark.createDataFrame([(1, p) for p in pages], "page_id long, html string"))
    assert any(got == html.scaled(want, x) for x in html.SCALES)


def test_edges(spark):
    rows = [(1, None, "u"), (2, "", "u"), (None, "<p>words only here</p>", None), (3, "<<<>< <!-- open", "u"), (4, "<p>a" * 50_000, "u"), (4, "<p>a" * 50_000, "u"), (5, "plain words", "u"), (6, "<script>x", "u"), (7, "&lt;b&gt; &amp;", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = html.extracted(df, html.train(df)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[2].score == by[1].score == 0
    assert by[1].text == by[2].text == by[6].text == "" and by[5].text == "plain words" and by[7].text == "<b> &"
    assert html.extracted(df.limit(0), html.train(df.limit(0))).count() == 0


def words_of(page):
    return " ".join(html.text_of(page, {"word": 1.0} | {n: -1 / 64 for n, _ in html.tokens(page) if n != "word"})[0].split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t u</title><meta charset=utf-8><body><p>all of this</body>", "all of this"),
        ("<!doctype html><title>t u</title><p>no head and no body", "no head and no body"),
        ("<p>before <svg/> after <svg width='3' /> end", "before after end"),
        ("<p>a <svg><g><svg><text>x</text></svg></g><text>y</text></svg> b", "a b"),
        ("<p>a <svg><path> b c", "a b c"),
        ("<p>a <object> b", "a b"),
        ("<p title='x > y' data-z=\"1>2\">inside</p> out", "inside out"),
        ("<p don't>it is what's here</p>", "it is what's here"),
        ("<a href=x>one</a> <a href='y>two</a>", "one two"),
        ("a <!-- > b --> c <!--> d", "a c d"),
        ("a <!-- open b", "a"),
        ("<SCRIPT>var a = '</p>'</SCRIPT >x <style>p > a</style>y", "x y"),
        ("<textarea>t</textarea>x <title>never closed y", "x never closed y"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("end of a tag <p class=", "end of a tag"),
    ],
)
def test_pages_as_they_are(page, want):
    assert words_of(page) == want


def test_nested_labels():
    names = ["nav", "/nav", "article", "word", "article", "word", "/article", "word", "/article", "word"]
    assert html.content_run(names) == (2, 8)
    assert html.content_run(names[:8]) == (2, 8) and html.content_run(["p"]) is None
    inner, outer = html.counts_of("<nav>x</nav><article>a b<article>c</article>d e</article>f")
    assert (inner["word"], outer["word"]) == (5, 2)


def test_broken_pages_take_linear_time():
    for part in ("<svg>", "<object>", "<textarea>", "<title>", "<iframe>", "<a href='x>", "<!", "<template><svg>"):
        began = time.time()
        html.tokens(part * 60_000)
        assert time.time() - began < 5, part


class Reader(parser.HTMLParser):
    """Tags and runs of text as the standard library reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "svg"):
            self.hidden += 1
            self.found += [(tag, "")] * (self.hidden == 1)
        elif not self.hidden:
            self.found.append((tag, ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "svg"):
            self.hidden -= 1
        elif not self.hidden:
            self.found.append(("/" + tag, ""))

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(("word", data))

    def handle_comment(self, data):
        self.found.append(("!", ""))

    def handle_decl(self, decl):
        self.found.append(("!", ""))


def brute_text(page, weight):
    """The words of the best of all runs."""
    reader = Reader()
    reader.feed(page)
    reader.close()
    score = [weight["word"] * len(t.split()) if n == "word" else 0.0 if n.lstrip("/") in html.LABEL else weight.get(n, html.UNKNOWN) for n, t in reader.found]
    runs = [(-sum(score[i:j]), j, j - i) for j in range(len(score) + 1) for i in range(j)]
    best = min([(s, j, n) for s, j, n in runs], default=(0, 0, 0))
    return " ".join(" ".join(t for n, t in reader.found[best[1] - best[2] : best[1]] if n == "word").split()) if best[0] < 0 else ""


def test_whole_extraction_against_all_runs(spark):
    rng, rows = random.Random(9), []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 14)):
            w = made.words(rng, rng.randint(1, 9))
            parts.append(rng.choice([f"<p>{w}</p>", f"<div class='a > b'>{w}</div>", f"<nav><li>{w}</li></nav>", "<!-- x > y -->", "<script>if (a > b) {}</script>", f"<title>{w}</title>", "<br/>", f"<article>{w}</article>", f"<svg><text>{w}</text></svg>", f"&lt;{w}&gt;", f"<ul><li>{w}<li>{w}</ul>"]))
        rows.append((i, "<!doctype html>" + "".join(parts), "c", 1.0))
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, score double")
    weight = html.train(pages)
    got = {r.page_id: r for r in html.extracted(pages, weight).collect()}
    for i, page, *_ in rows:
        assert "".join(got[i].text.split()) == "".join(brute_text(page, weight).split()), page
    assert sum(bool(r.text) for r in got.values()) > 30
