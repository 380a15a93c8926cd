import itertools
import random
import re
from collections import defaultdict

import pytest

from symscape.llm import pii
from tests.llm import made


def brute(texts):
    """(text, start, length, kind) by the method, in plain Python over all texts: every pattern in every round."""
    found = [(i, *c, t[c[0] : c[1]]) for i, t in enumerate(texts) for c in pii.candidates_of(t)]
    held, other, seeds = defaultdict(set), defaultdict(set), {}
    for t in texts:
        words = re.split("[ \t\n\r\x0b\x0c]+", t.lower().strip(" \t\n\r\x0b\x0c"))
        for a, b in itertools.pairwise([None, *words, None]) if words != [""] else []:
            if a is not None and (b is None or not re.search("[0-9@]", b)):
                other[f"L:{a}"].add(b)
            if b is not None and (a is None or not re.search("[0-9@]", a)):
                other[f"R:{b}"].add(a)
    for _, _, _, s, x, y, k, v in found:
        for p in (f"S:{s}", f"L:{x}", f"R:{y}"):
            if len(p) > 2:
                held[p].add(v)
        if k:
            seeds[v, k] = 1.0
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        kept, miss = {}, defaultdict(lambda: 1.0)
        for p, vs in held.items():
            for k in pii.KINDS:
                mass = sum(scores.get((v, k), 0) for v in vs)
                score = mass / (len(vs) + len(other[p]) + 1)
                if mass >= pii.SUPPORT and score >= pii.DOUBT:
                    if score >= pii.CONFIDENCE:
                        kept[p, k] = score
                    for v in vs:
                        miss[v, k] *= 1 - min(score, 0.999)
        scores = {vk: max(1 - m, seeds.get(vk, 0)) for vk, m in miss.items()} | {vk: 1.0 for vk in seeds}
    out = set()
    for i, a, b, s, x, y, k, _ in found:
        hits = [(-kept[p, c], c) for p in (f"S:{s}", f"L:{x}", f"R:{y}") for c in pii.KINDS if (p, c) in kept] + ([(-1.0, k)] if k else [])
        if hits:
            out.add((i, a, b - a, min(hits)[1]))
    return out


TEXTS = [f"call me on +49 30 12345{k:02d} today, mail a{k}.b@mail{k % 3}.example.com" for k in range(20)] + [f"call me on 030-998{k:02d}7 today" for k in range(8)] + ["the year 1999 and 12 apples", "", "version 3.4.5 at 10.0.0.12", "no number"] * 3


def test_findings_are_those_of_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.length, r.kind) for r in pii.findings(docs).collect()}
    assert got == brute(TEXTS)
    assert any(i >= 20 and k == "phone" for i, _, _, k in got)  # never seen as a seed: found by its context


def test_redaction_replaces_just_the_findings(spark):
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long, value string")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    spans = brute(TEXTS)
    for i, t in enumerate(TEXTS):
        for _, a, n, k in sorted((s for s in spans if s[0] == i), key=lambda s: -s[1]):
            t = t[:a] + f"[{k.upper()}]" + t[a + n :]
        assert got[i].text == t and got[i].n_chars == len(t) and got[i].value == "x"


@pytest.mark.parametrize(("text", "kind"), [("4111 1111 1111 1111", "card"), ("4111-1111-1111-1112", None), ("a.b+c@d-e.org", "email"), ("256.1.1.1", None), ("192.168.0.1", "ip"), ("+1 (555) 010-2000", "phone"), ("(555) 010-2000", "phone"), ("+12", None)])
def test_seeds(text, kind):
    assert next((k for k, f in pii.KINDS.items() if f(text)), None) == kind


def test_counting_by_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    first = made.rows(pii.findings(docs).select("doc_id", "kind", "start", "length"))
    monkeypatch.setattr(pii, "COUNTED_AT_ONCE", 0)
    assert made.rows(pii.findings(docs).select("doc_id", "kind", "start", "length")) == first


def test_edges(spark):
    docs = spark.createDataFrame(made.odd(), made.DOCS)
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text LIKE '%@%'").count() == 0 and clean.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert pii.findings(docs.limit(0)).count() == pii.redacted(docs.limit(0)).count() == 0


def test_contexts_of_few_seeds_are_bootstrapped(spark):
    """A word of 4 seeds and 40 instances that another word discovers is kept, and finds what only it stands beside."""
    texts = [f"call +49 30 12345{k:02d} now{k}" for k in range(90)] + [f"call 030/{k:02d}-7{k}9 so{k}" for k in range(12)]
    texts += [f"ring +49 40 77788{k} well{k}" for k in range(4)] + [f"ring 030/{k:02d}-7{k}9 then{k}" for k in range(12)] + ["ring x5-12-77z later"]
    got = {(r.doc_id, r.start, r.length, r.kind) for r in pii.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(texts)
    assert (len(texts) - 1, 5, 9, "phone") in got


def test_random_tables_against_plain_python(spark):
    rng = random.Random(8)
    for _ in range(3):
        lead = ["call", "mail", "at", "no", "the", "card"]
        what = [lambda: f"+4{rng.randint(1, 9)} {rng.randint(10, 99)} {rng.randint(10**5, 10**6)}", lambda: f"u{rng.randint(1, 99)}@h{rng.randint(1, 4)}.org", lambda: f"0{rng.randint(10, 99)}/{rng.randint(100, 999)}", lambda: f"{rng.randint(1, 40)}", lambda: made.words(rng, 1)]
        texts = [" ".join(f"{rng.choice(lead)} {rng.choices(what, [4, 3, 3, 1, 1])[0]()}" for _ in range(rng.randint(1, 4))) for _ in range(120)]
        got = {(r.doc_id, r.start, r.length, r.kind) for r in pii.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == brute(texts)


def test_long_words_and_cards_are_whole(spark):
    assert pii._neighbour("a " + "y" * 500 + " 12 " + "z" * 700 + " b", 503, 505) == ("y" * 500, "z" * 700)
    assert pii._neighbour("12", 0, 2) == ("", "") and pii._neighbour("x 12 \u00a0 y", 2, 4) == ("x", "y")
    assert pii.shape("first.last+tag99_long.name@ab.cd") == pii.shape("a.b@xy.z") and "@" in pii.shape("abcdefghijkl!#$%mnop@x.y")
    assert pii.shape("a!b!c!d!e!f@x.y") != pii.shape("a!b!c!d!e!g!h@x.y")
    assert [(a, b) for a, b in pii.spans("pay 4000 0000 0000 0000 006 now")] == [(4, 27)] and pii._card("4000 0000 0000 0000 006")


def test_many_patterns_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [(i, t, len(t), "x") for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(None, None, None, None), (3, TEXTS[1], 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __key string")
    first = made.rows(pii.redacted(docs))
    monkeypatch.setattr(pii, "MOST_PATTERNS", 0)
    again = pii.redacted(docs)
    assert made.rows(again) == first and again.columns == docs.columns


def test_the_first_pass_never_counts_too_many(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    monkeypatch.setattr(pii, "PAIRS", 5)
    least = {(r.key, r.side): r.least for r in pii.least_contexts(docs).collect()}
    exact = {(r.key, r.side): r.plain for r in pii.contexts(docs).collect()}
    assert least.keys() == exact.keys() and all(n <= exact[k] for k, n in least.items())
