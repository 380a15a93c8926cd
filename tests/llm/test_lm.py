import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symscape.llm import lm
from tests.llm import made


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(made.corpus(90), made.DOCS).union(spark.createDataFrame([(5000 + k, "the cat sat on the mat and the dog lay on the rug " * 8, "en", "x", 1) for k in range(40)], made.DOCS))
    vocab = lm.vocabulary(lm.written(lm.word_counts(docs), "words"), 120)
    return docs, vocab, lm.train(docs, vocab, rate=2e-2)


def slow(p, vocab, ids):
    """One word after the other, with the whole softmax."""
    k = p["u"].shape[0]
    h, ll, before = np.zeros(k), 0.0, vocab.size
    s = lambda x: 1 / (1 + np.exp(-x))
    for w in ids.tolist():
        x, a = p["x"][before].astype(float), h @ p["u"].astype(float)
        f = s(x[:k] + a[:k])
        h = h + f * (np.tanh(x[k:] + f * a[k:]) - h)
        z = h @ p["wc"] + p["bc"]
        c = vocab.class_of[w]
        ll += z[c] - np.log(np.exp(z).sum())
        lo, hi = vocab.bounds[c], vocab.bounds[c + 1]
        y = h @ p["wo"][:, lo:hi] + p["bo"][lo:hi]
        ll += y[w - lo] - np.log(np.exp(y).sum())
        before = w
    return ll


def test_likelihood_is_that_of_word_after_word(model):
    docs, vocab, p = model
    texts = [r.text or "" for r in docs.collect()]
    ids = vocab.numbers(texts)
    got = lm.likelihoods(p, vocab, ids)
    np.testing.assert_allclose(got, [slow(p, vocab, d) for d in ids], rtol=2e-4, atol=2e-3)
    np.testing.assert_allclose(lm.likelihoods(p, vocab, ids, window=7), got, rtol=1e-4, atol=1e-3)


def test_gradients_are_those_of_differences(model):
    _, vocab, _ = model
    p = {k: x.astype(np.float64) for k, x in lm.start(vocab, 5).items()}
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, vocab.size, n).astype(np.int32) for n in (9, 6, 3)]
    lay = lm.Layout(docs, vocab.size)

    def loss(q, grads=None):
        h = np.zeros((lay.ids.shape[1], 5), np.float32)
        states, _, saved = lm.forward(q, lay.before, lay.keep, h)
        flat = states.reshape(-1, 5)
        ll, back = lm.output(q, vocab.bounds, vocab.class_of, flat, lay.ids.reshape(-1), lay.live.reshape(-1), grads)
        if grads is not None:
            lm.backward(q, lay.before, lay.keep, saved, back.reshape(states.shape), grads)
        return -(ll * lay.live.reshape(-1)).astype(float).sum()

    grads = {k: np.zeros_like(x) for k, x in p.items()}
    loss(p, grads)
    for k in p:
        for at in np.argsort(-np.abs(grads[k]).ravel())[:3]:
            moved = [{**p, k: p[k].copy()} for _ in range(2)]
            moved[0][k].ravel()[at] += 1e-2
            moved[1][k].ravel()[at] -= 1e-2
            assert grads[k].ravel()[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-2, rel=0.03, abs=2e-3)


def test_training_beats_word_frequencies_on_held_out_documents(model):
    _, vocab, p = model
    held = vocab.numbers(["the dog sat on the mat and the cat lay on the rug"] * 2)
    assert lm.likelihoods(p, vocab, held)[0] > lm.likelihoods(lm.start(vocab), vocab, held)[0] + 3


def test_probabilities_sum_to_one(model):
    _, vocab, p = model
    one = [np.array([3, w], np.int32) for w in range(vocab.size)]
    alone = lm.likelihoods(p, vocab, [np.array([3], np.int32)])[0]
    each = lm.likelihoods(p, vocab, one) - alone
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-3)


def test_counts_and_edges(spark, model):
    docs, vocab, p = model
    odd = spark.createDataFrame(made.odd(), made.DOCS)
    counts = lm.written(lm.word_counts(docs), "words")
    got = lm.scored(odd, counts, vocab, p).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.perplexity is None) == (r.n_words == 0) and (r.n_words or r.log_likelihood == 0)
    long = next(r for r in got if r.doc_id == 900)
    assert long.n_words == 60_000
    same = [r.log_likelihood for r in got if r.doc_id == 1]
    assert len(same) == 3 and max(same) - min(same) < 1e-2
    total = lm.word_counts(docs).agg({"n": "sum"}).first()[0]
    assert total == sum(len(d) for d in vocab.numbers([r.text or "" for r in docs.collect()]))
    assert lm.score(odd.limit(0)).count() == 0


def words_of(text):
    return ["".join(g) for ok, g in itertools.groupby((text or "").lower(), lambda c: ord(c) >= 128 or c.isalnum()) if ok]


@pytest.mark.parametrize("looked_up", [0, 150, 10**6])
def test_scores_of_whole_documents_with_all_words(spark, model, looked_up):
    """Every word has its own probability, by its count where it has no vector, wherever the counts are looked up."""
    docs, _, _ = model
    more = docs.union(spark.createDataFrame([(7000, "the zzunseen cat zzunseen", "en", "x", 1), (7001, "", "en", "x", 1), (7001, None, "en", "x", 1)], made.DOCS))
    counts = lm.written(lm.word_counts(docs), "words")
    vocab = lm.vocabulary(counts, 60, looked_up)
    p = lm.train(docs, vocab, rate=2e-2, rounds=1)
    n = Counter(w for r in docs.collect() for w in words_of(r.text))
    assert vocab.counts.sum() == sum(n.values()) and vocab.size == 61
    rows = more.collect()
    got = sorted((r.doc_id, r.n_words, r.log_likelihood) for r in lm.scored(more, counts, vocab, p).collect())
    want = []
    for r in rows:
        ids = vocab.numbers([r.text or ""])[0]
        own = [np.log(max(n[w], 1) / vocab.counts[-1]) for w, i in zip(words_of(r.text), ids.tolist(), strict=True) if i == 60]
        want.append((r.doc_id, len(ids), slow(p, vocab, ids) + sum(own)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=2e-4, abs=2e-2)


def test_vectors_follow_the_corpus(spark):
    few, many = (spark.createDataFrame([(i, made.words(random.Random(i), 60), "en", "x", 0) for i in range(n)], made.DOCS) for n in (10, 160))
    sizes, distinct = [], []
    for docs in (few, many):
        counts = lm.written(lm.word_counts(docs), "words")
        distinct.append(counts.count())
        sizes.append(lm.vocabulary(counts).size - 1)
    assert sizes == [int(np.ceil(np.sqrt(n))) for n in distinct] and sizes[1] > 2 * sizes[0]


def test_copies_are_summed_in_a_tree(spark, model, monkeypatch):
    docs, vocab, _ = model
    p = lm.start(vocab)
    whole = lm._averaged(docs.repartition(7, "doc_id"), vocab, p, 1e-2)
    monkeypatch.setattr(lm, "FAN", 2)
    tree = lm._averaged(docs.repartition(7, "doc_id"), vocab, p, 1e-2)
    assert all(np.allclose(whole[k], tree[k], atol=1e-6) for k in p) and not np.allclose(whole["x"], p["x"])


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(3)
    texts = [made.words(rng, 40) + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(25)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(texts + texts[:40])], made.DOCS)
    got = {r.doc_id: r.perplexity for r in lm.score(docs).collect()}
    assert max(got[i] for i in range(40)) < np.quantile([got[i] for i in range(40, 120)], 0.1)


def test_columns_of_clashing_names(spark, model):
    docs, vocab, p = model
    counts = lm.written(lm.word_counts(docs), "words")
    more = docs.select("*", *[F.lit(f"c{i}").alias(c) for i, c in enumerate([*made.CLASH, "key", "far", "ll", "times", "copy"])])
    first, again = (sorted((r.doc_id, round(r.log_likelihood, 2)) for r in lm.scored(d, counts, vocab, p).collect()) for d in (docs, more))
    assert first == again
