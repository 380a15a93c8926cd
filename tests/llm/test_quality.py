"""Distinct documents are counted, whatever lines are their extremes."""

import random

import pytest

from symscape.llm import quality
from tests.llm import made


def brute(rows):
    """(doc_id, text) of the documents that stay, line by line in plain Python."""
    normal = lambda x: " ".join(x.replace("\r", " ").split()).lower()
    hosts, docs = {}, {}
    for _, text, _, host, _ in rows:
        lines = [normal(x) for x in (text or "").split("\n")]
        hosts[host] = hosts.get(host, 0) + 1
        for x in {x for x in lines if x}:
            docs.setdefault((host, x), set()).add(tuple(x for x in lines if x))
    out = []
    for i, text, _, host, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not normal(x) or len(docs[host, normal(x)]) <= max(quality.MIN_DOCS, quality.MIN_SHARE * hosts[host])]
        was, left = (sum(len(x) for x in part if normal(x)) for part in (lines, kept))
        if left > 0 and left >= was * quality.MIN_LEFT:
            out.append((i, "\n".join(kept)))
    return out


@pytest.mark.parametrize("n", [100, 200])
def test_a_menu_in_all_documents_goes(spark, n):
    rng = random.Random(n)
    menu = "\n".join(made.words(rng, 4) for _ in range(40))
    rows = [(i, menu + "\n" + made.words(rng, 3), "en", "shop", 0) for i in range(n)] + [(1000, made.words(rng, 90), "en", "shop", 0)]
    docs = spark.createDataFrame(rows, made.DOCS)
    assert quality.frequent_lines(docs).count() == 40
    assert [(r.doc_id, r.text) for r in quality.filtered(docs).collect()] == brute(rows) == [(1000, rows[-1][1])]


def test_a_small_menu_goes_and_the_rest_stays(spark):
    rng = random.Random(4)
    menu = "\n".join(made.words(rng, 2) for _ in range(10))
    rows = [(i, menu + "\n" + made.words(rng, 60), "en", "shop", 0) for i in range(40)]
    got = sorted((r.doc_id, r.text) for r in quality.filtered(spark.createDataFrame(rows, made.DOCS)).collect())
    assert got == brute(rows) and len(got) == 40 and all("\n" not in t for _, t in got)


def test_copies_of_a_document_count_once(spark):
    rng = random.Random(5)
    text = "\n".join(made.words(rng, 9) for _ in range(6))
    rows = [(i, text, "en", "shop", 0) for i in range(300)] + [(400 + i, text.upper().replace(" ", "  "), "en", "shop", 0) for i in range(5)] + [(500 + i, made.words(rng, 20), "en", "shop", 0) for i in range(30)]
    got = sorted((r.doc_id, r.text) for r in quality.filtered(spark.createDataFrame(rows, made.DOCS)).collect())
    assert got == brute(rows) and len(got) == len(rows)
