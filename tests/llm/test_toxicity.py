import itertools
import random
from collections import Counter

import numpy as np
import pytest

from symscape.llm import toxicity
from tests.llm import made


def brute_kernel(s, t, d=float(toxicity.DECAY)):
    """All common subsequences of three characters, weighted by the lengths that they span."""
    total = 0.0
    for x in itertools.combinations(range(len(s)), 3):
        for y in itertools.combinations(range(len(t)), 3):
            if [s[i] for i in x] == [t[j] for j in y]:
                total += d ** (x[2] - x[0] + 1 + y[2] - y[0] + 1)
    return total


def test_kernel_is_that_of_all_subsequences():
    rng = random.Random(1)
    a = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(12)]
    b = a[:4] + ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(4)]
    want = [[brute_kernel(s, t) / np.sqrt(brute_kernel(s, s) * brute_kernel(t, t)) for t in b] for s in a]
    np.testing.assert_allclose(toxicity.kernels(a, b), want, rtol=1e-4, atol=1e-5)


def sentences(n, toxic, seed):
    rng, bad = random.Random(seed), ["grumblewort", "snotfiend"]
    out = []
    for _ in range(n):
        text = made.words(rng, 90).split()
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        out.append(" ".join(text) + ".")
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, 1) for t in sentences(120, True, 1)] + [(t, 0) for t in sentences(1500, False, 2)])


def test_held_out_accuracy_and_altered_spellings(model):
    score = toxicity.Scorer(model)
    bad, good = score(sentences(100, True, 3))[0] > 0, score(sentences(400, False, 4))[0] > 0
    assert bad.mean() > 0.97 and good.mean() < 0.01
    altered = [t.replace("grumblewort", w).replace("snotfiend", w) for w in ("gr*umblewort", "grumblewxort", "g-r-u-m-b-l-e-w-o-r-t") for t in sentences(20, True, 5)]
    assert (score(altered)[0] > 0).mean() > 0.9


def test_bound_skips_no_hit(model):
    rng = random.Random(6)
    strings = sorted({"".join(rng.choice("grumblewotsnfid") for _ in range(rng.randint(3, 12))) for _ in range(4000)} | {"grumblewort", "snotfiends", "grumxblewort"})
    sets = np.array([np.bitwise_or.reduce(toxicity._BITS[list(s.encode())]) for s in strings], np.uint64)
    weigh = [k >= 0 and model.weights[k] > 0 for k in model.hits(strings)]
    assert sum(weigh) >= 2 and not (np.array(weigh) & ~model.possible(sets)).any()


def test_scores_do_not_depend_on_what_is_scored_together(model):
    texts = sentences(30, True, 8) + sentences(30, False, 9)
    whole = toxicity.Scorer(model)(texts)[0]
    np.testing.assert_allclose(whole, [toxicity.Scorer(model)([t])[0][0] for t in texts], rtol=1e-6)


def test_tables(spark, model):
    rows = [*made.odd(), (2000, sentences(1, True, 11)[0], "en", "x", 1), (2000, sentences(1, True, 11)[0], "en", "x", 1)]
    docs = spark.createDataFrame(rows, made.DOCS)
    assert [r.doc_id for r in toxicity.toxic_documents(docs, model).collect()] == [2000, 2000]
    assert made.rows(toxicity.without_toxic(docs, model)) == made.rows(docs.where("doc_id IS NULL OR doc_id <> 2000"))
    assert toxicity.without_toxic(docs.limit(0), model).count() == toxicity.toxic_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None
    assert toxicity.toxic_documents(docs, None).count() == 0 and made.rows(toxicity.without_toxic(docs, None)) == made.rows(docs)


def features(s, d=float(toxicity.DECAY)):
    out = Counter()
    for x in itertools.combinations(range(len(s)), 3):
        out[s[x[0]] + s[x[1]] + s[x[2]]] += d ** (x[2] - x[0] + 1)
    return out


def brute_decisions(model, texts):
    """(score, term) of each text, with every string's kernels from its subsequences: no bound, nothing remembered."""
    own = [features(t) for t in model.landmarks]
    norm = lambda f: np.sqrt(sum(v * v for v in f.values()))
    known = {}

    def weight(s):
        if s not in known:
            f = features(s)
            k = np.array([sum(v * g[u] for u, v in f.items()) / (norm(f) * norm(g)) if f and g else 0 for g in own])
            near = k[: model.positive]
            known[s] = 0.0
            if k @ model.beta + model.bias > toxicity.CUT and near.max() >= toxicity.FLOORS[0]:
                known[s] = model.weights[near.argmax() * len(toxicity.FLOORS) + np.searchsorted(toxicity.FLOORS, near.max(), "right") - 1]
        return known[s]

    out = []
    for text in texts:
        n, strings = len((text or "").split()), Counter(toxicity.strings_of(text or ""))
        hits = {s: weight(s) for s in strings if weight(s) > 0}
        total = sum(w * min(strings[s], 1 + n // toxicity.PER) for s, w in hits.items())
        out.append((total - model.each * n - toxicity.MARGIN if total > 0 else -1.0, min(hits, key=lambda s: (-hits[s], s), default="")))
    return out


def test_decisions_are_those_of_plain_python(spark, model):
    rng = random.Random(12)
    texts = sentences(25, True, 13) + sentences(25, False, 14) + ["", None, "s n o t f i e n d here", "gr*umble-wort! snot_fiend"]
    texts += [" ".join(rng.choice(["grumblexwort", "snotfien", "grumblewort", "fine", "words", "and", "s-n-o-t-f-i-e-n-d"]) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    want = brute_decisions(model, texts)
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(texts)], made.DOCS)
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, model).collect()}
    assert set(got) == {i for i, (s, _) in enumerate(want) if s > 0} and len(got) > 25
    for i, r in got.items():
        assert r.score == pytest.approx(want[i][0], abs=1e-3) and r.term == want[i][1]


def test_sample_of_labelled_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts: seen.append(texts))
    rows = [(i, f"text {i} " + "x" * 90, "en", "a", 0) for i in range(40)] + [(3, "a second text of 3", "en", "a", 0), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, made.DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(5, 1, 0), (6, 1, 1), (7, 1, 1), (8, 0, None), (9, 0, 7), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels)
    assert Counter(y for _, y in seen[0]) == {1: 13, 0: 14}  # 5 and 6 are labelled both ways, 9 has a label that is none
    assert ("a second text of 3", 1) in seen[0] and not any(t.startswith(("text 3 ", "text 5 ", "text 6 ", "text 9 ")) for t, _ in seen[0])
    toxicity.train(docs, labels.where("doc_id <> 99"), toxic=5, clean=3)
    assert Counter(y for _, y in seen[1]) == {1: 5, 0: 3} and set(seen[1]) <= set(seen[0])
    toxicity.train(docs, labels, characters=500)
    assert all(300 < sum(len(t) for t, y in seen[2] if y == k) <= 500 for k in (0, 1)) and set(seen[2]) <= set(seen[0])


def test_held_out_accuracy_on_the_labelled_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.dropDuplicates(["doc_id"])
    learn, held = known.where("doc_id % 2 = 0"), known.where("doc_id % 2 = 1")
    model = toxicity.train(docs, learn)
    hit = {r.doc_id for r in toxicity.toxic_documents(docs, model).select("doc_id").collect()}
    rows = held.collect()
    found = [r.doc_id in hit for r in rows if r.toxic == 1]
    wrong = [r.doc_id in hit for r in rows if r.toxic == 0]
    # About a tenth of the documents labelled toxic hold no insult at all: the labels have noise.
    assert len(found) > 200 and np.mean(found) > 0.85 and np.mean(wrong) < 0.005
