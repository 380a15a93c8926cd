"""The language model's vectors for words beyond the most frequent ones."""

import random
from collections import Counter

import numpy as np
import pytest

from symscape.llm import lm
from symscape.llm.common import Words
from symscape.llm.own import Own, Tree
from tests.llm import made
from tests.llm.test_lm import words_of

BY = [(90, 1), (40, 2), (7, 5), (3, 11), (1, 40)]


def counts_by_rank():
    return np.array([n for n, w in BY for _ in range(w)])


def filled(tree, ranks, hidden, seed=1):
    own, rng = Own(tree, ranks, hidden), np.random.default_rng(seed)
    own.a[:], own.v[:] = rng.standard_normal(own.a.shape), rng.standard_normal(own.v.shape)
    return own


@pytest.mark.parametrize("vectors", [0, 2, 9, 57, 58])
def test_tree_has_all_words_with_their_exact_shares(vectors):
    tree, n = Tree(BY, vectors), counts_by_rank()
    ranks = np.random.default_rng(0).permutation(np.arange(vectors, 59))
    own = Own(tree, ranks, 4)
    assert len(own.nodes) == len(ranks) - 1
    states = np.random.default_rng(2).standard_normal((len(ranks), 4)).astype(np.float32)
    np.testing.assert_allclose(own.output(states, np.arange(len(ranks)))[0], np.log(n[ranks] / n[vectors:].sum()), atol=1e-5)
    other = filled(tree, ranks, 4)
    for h in states[:3]:
        assert np.exp(other.output(np.tile(h, (len(ranks), 1)), np.arange(len(ranks)))[0].astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_a_few_words_need_only_their_own_nodes():
    tree = Tree(BY, 9)
    some, every = np.array([50, 12, 30]), np.arange(9, 59)
    a, b = Own(tree, some, 3), filled(tree, every, 3)
    a.v[:] = b.v[np.searchsorted(b.nodes, a.nodes)]
    states = np.random.default_rng(2).standard_normal((3, 3)).astype(np.float32)
    assert len(a.nodes) < len(b.nodes)
    np.testing.assert_allclose(a.output(states, np.arange(3))[0], b.output(states, some - 9)[0], rtol=1e-5)


def test_gradients_of_own_vectors_are_those_of_differences(monkeypatch):
    vocab = lm.Vocabulary([(k, int(n)) for k, n in enumerate(counts_by_rank()[:9])], 9, int(counts_by_rank()[9:].sum()))
    rng = np.random.default_rng(4)
    own = filled(Tree(BY, 9), np.array([20, 11, 50, 33]), 5)
    docs = [rng.integers(0, 10, n).astype(np.int32) for n in (9, 6, 3)]
    words = np.where(np.concatenate(docs) == 9, rng.integers(0, 4, 18), -1)
    assert (words >= 0).sum() >= 2
    p, seen = lm.start(vocab, 5), {}
    monkeypatch.setattr(Own, "step", lambda self, kind, rows, g, rate: seen.setdefault(kind, (rows, g)))
    monkeypatch.setattr(lm.Trainer, "_step", lambda self, grads: seen.setdefault("p", grads))
    lm.Trainer(p, vocab).learn(docs, window=99, own=own, words=words)
    loss = lambda: -lm.likelihoods(p, vocab, docs, own=own, words=words).sum() / 18
    for kind, values in (("a", own.a), ("v", own.v), ("x", p["x"]), ("u", p["u"])):
        grads = np.zeros_like(values)
        if kind in seen:
            grads[seen[kind][0]] = seen[kind][1]
        else:
            grads = seen["p"][kind]
        for at in np.argsort(-np.abs(grads).ravel())[:4]:
            kept, got = values.ravel()[at], []
            for by in (2e-2, -2e-2):
                values.ravel()[at] = kept + by
                got.append(loss())
            values.ravel()[at] = kept
            assert grads.ravel()[at] == pytest.approx((got[0] - got[1]) / 4e-2, rel=0.03, abs=1e-4)


def test_ranks_are_the_order_of_the_vocabulary(spark):
    counts = lm.written(lm.word_counts(spark.createDataFrame(made.corpus(80), made.DOCS)), "words")
    rows = sorted(((r.word, r.n) for r in counts.collect()), key=lambda r: (-r[1], r[0]))
    got = {r.word: r.rank for r in lm.ranked(counts).collect()}
    assert [got[w] for w, _ in rows] == list(range(len(rows)))


def test_without_learning_scores_are_those_of_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 700)  # several parts in a task
    docs = spark.createDataFrame(made.odd()[:-4] + made.odd()[-3:], made.DOCS).repartition(3)
    counts = lm.written(lm.word_counts(docs), "words")
    vocab = lm.vocabulary(counts, 30)
    want = lm.scored(docs, counts, vocab, lm.start(vocab)).collect()
    got = lm.score(docs, rate=0.0, vectors=30).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.log_likelihood)
    assert len(got) == docs.count()
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a.doc_id, a.n_words) == (b.doc_id, b.n_words) and a.log_likelihood == pytest.approx(b.log_likelihood, rel=2e-4, abs=2e-2)
        assert (a.perplexity is None) == (b.perplexity is None)


def word_after_word(p, vocab, tree, n, a, v, ranks):
    """One word after the other; n: counts by rank; a, v: own vectors by rank and by node."""
    k, size = p["u"].shape[0], vocab.size
    s = lambda x: 1 / (1 + np.exp(-x))
    h, ll, before, offset = np.zeros(k), 0.0, size, np.zeros(k)
    for r in ranks:
        w = min(r, size - 1)
        x, u = p["x"][before].astype(float), h @ p["u"].astype(float)
        f = s(x[:k] + u[:k])
        h = h + f * (np.tanh(x[k:] + offset + f * u[k:]) - h)
        z = h @ p["wc"] + p["bc"]
        c = vocab.class_of[w]
        lo, hi = vocab.bounds[c], vocab.bounds[c + 1]
        y = h @ p["wo"][:, lo:hi] + p["bo"][lo:hi]
        ll += z[c] - np.log(np.exp(z).sum()) + y[w - lo] - np.log(np.exp(y).sum())
        lo, hi = size - 1, len(n)
        while r >= size - 1 and hi - lo > 1:
            at = int(tree.cut(np.array([lo]), np.array([hi]))[0][0])
            left = s(np.log(n[lo:at].sum() / n[at:hi].sum()) + np.append(h, 1) @ v.get(at, np.zeros(k + 1)))
            ll += np.log(left if r < at else 1 - left)
            lo, hi = (lo, at) if r < at else (at, hi)
        before, offset = w, a.get(r, np.zeros(k)) if r >= size - 1 else np.zeros(k)
    return ll


def test_scores_are_those_of_the_vectors_learnt_by_all_parts(spark, monkeypatch):
    """Against plain Python, with the tables of vectors put together whole; documents of several tasks and parts."""
    monkeypatch.setattr(lm, "TOGETHER", 900)
    sent, used = [], []
    for name, seen in (("_sent", sent), ("_scored", used)):
        monkeypatch.setattr(lm, name, lambda *args, f=getattr(lm, name), seen=seen: seen.append(args) or f(*args))
    docs = spark.createDataFrame(made.corpus(90), made.DOCS).repartition(4, "doc_id")
    rows = docs.collect()
    counts = Counter(w for r in rows for w in words_of(r.text))
    words = sorted(counts, key=lambda w: (-counts[w], int(Words([w]).hash.view(np.int64)[0])))
    rank, n = {w: i for i, w in enumerate(words)}, np.array([counts[w] for w in words])
    got = {r.doc_id: (r.n_words, r.log_likelihood) for r in lm.score(docs, rate=5e-2, vectors=25).collect()}
    _, vocab, tree, p, hidden, shards = used[0]
    a, v = {}, {}
    for r in sent[-1][1].collect():
        a |= dict(zip(np.frombuffer(r.a, np.int64).tolist(), np.frombuffer(r.b, np.float16).reshape(-1, hidden).astype(float), strict=True))
        v |= dict(zip(np.frombuffer(r.c, np.int64).tolist(), np.frombuffer(r.d, np.float16).reshape(-1, hidden + 1).astype(float), strict=True))
    assert shards > 4 and set(v) == set(range(26, len(n))) and set(a) <= set(range(25, len(n))) and len(a) > 0.9 * (len(n) - 25)
    for r in rows:
        ranks = [rank[w] for w in words_of(r.text)]
        assert got[r.doc_id][0] == len(ranks)
        assert got[r.doc_id][1] == pytest.approx(word_after_word(p, vocab, tree, n, a, v, ranks), rel=2e-4, abs=2e-3)


def test_rare_words_are_told_apart_by_what_stands_before_them(spark):
    rng = random.Random(5)
    pairs = [(f"left{i}", f"right{i}") for i in range(20)]
    line = lambda some: " ".join(f"the {a} {b}" for a, b in some)
    texts = [line(rng.choices(pairs, k=660)) for _ in range(40)]
    wrong = [(a, pairs[(i + 7) % 20][1]) for i, (a, _) in enumerate(pairs)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate([*texts, line(pairs), line(wrong)])], made.DOCS).coalesce(1)
    got = {r.doc_id: r.log_likelihood for r in lm.score(docs, rate=2e-2, vectors=1).collect()}
    assert got[40] > got[41] + 20
