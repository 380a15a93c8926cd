"""What a task of the language model holds: one part of the corpus, and the rows of its words and nodes."""

import tracemalloc

import numpy as np
import pytest

from symscape.llm import lm, own
from symscape.llm.own import Own, Tree
from tests.llm import made
from tests.llm.test_lm_own import BY, filled


def test_memory_is_that_of_the_rows_not_of_the_paths():
    n = 60_000
    tree, rng = Tree([(3, n // 3), (1, n - n // 3)], 10), np.random.default_rng(1)
    ranks = rng.permutation(np.arange(10, n))[: n // 2]
    states = rng.standard_normal((1500, 16)).astype(np.float32)
    tracemalloc.start()
    held = Own(tree, ranks, 16)
    for some in np.array_split(np.arange(len(ranks)), 20):
        _, back, nodes, grads = held.output(states, some, np.ones(1500, np.float32))
        held.step("v", nodes, grads, 1e-3)
        held.step("a", some, back, 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * (held.a.nbytes + held.v.nbytes)


@pytest.mark.parametrize("top", [0, 1, 5])
def test_products_made_for_all_words_at_once_change_nothing(monkeypatch, top):
    words = np.random.default_rng(3).integers(0, 50, 400)
    states, live = np.random.default_rng(2).standard_normal((400, 3)).astype(np.float32), np.linspace(0, 1, 400, dtype=np.float32)

    def out():
        some = filled(Tree(BY, 9), np.random.default_rng(1).permutation(np.arange(9, 59)), 3)
        ll, back, nodes, grads = some.output(states, words, live)
        order = np.argsort(nodes)
        assert len(set(nodes.tolist())) == len(nodes)
        return some.output(states, words)[0], ll, back, nodes[order], grads[order], some.used["v"]

    want = out()
    monkeypatch.setattr(own, "TOP", top)
    for a, b in zip(out(), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("most", [700, 10**6])
def test_a_part_ends_with_the_document_that_fills_it(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "TOGETHER", most)
    docs = spark.createDataFrame(made.corpus(60) + [(7000, None, "en", "x", 1), (7001, "", "en", "x", 1)], made.DOCS).coalesce(2)
    vocab = lm.vocabulary(lm.written(lm.word_counts(docs), "words"), 30, 0)
    ids = []
    for r in lm._parts(docs, vocab).collect():
        lengths = np.frombuffer(r.a, np.int64)
        assert lengths[:-1].sum() < most and lengths.sum() * 4 == len(r.b)
        ids += r.doc_id
    assert sorted(ids) == sorted(r.doc_id for r in docs.collect())
