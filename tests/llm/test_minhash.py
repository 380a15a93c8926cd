import itertools
import json
import random

import numpy as np
import pytest

from symscape.llm import minhash
from tests.llm import made


def brute(rows, threshold=minhash.THRESHOLD):
    own, sig = minhash.signatures([t or "" for _, t, *_ in rows])
    best = {}
    for i, s in zip(own, sig, strict=True):
        if rows[i][0] is not None and rows[i][1] is not None:
            best[rows[i][0]] = min(best.get(rows[i][0], s.tobytes()), s.tobytes())
    parent = {i: i for i in best}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    width = minhash.HASHES // minhash.BANDS
    for a, b in itertools.combinations(sorted(best), 2):
        x, y = (np.frombuffer(best[k], np.uint32) for k in (a, b))
        same = x == y
        if same.sum() >= np.ceil(threshold * minhash.HASHES) and same.reshape(-1, width).all(1).any():
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(i, root(i)) for i in best if root(i) != i}


def test_groups_are_those_of_all_pairs(spark):
    rows = made.corpus(80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, made.DOCS)).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == brute(rows) and len(got) > 5
    assert len({r.doc_id for r in got}) == len(got)


def test_signature_minima_by_hand():
    text = "one two three four two three four"
    _, sig = minhash.signatures([text, "alone", ""])
    shingles = {tuple(text.split()[i : i + 3]) for i in range(5)}
    assert len(shingles) == 4 and len(sig) == 2
    _, again = minhash.signatures(["alone", "three four two three four one two three four two"])
    assert (sig[1] == again[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3), (102, 100), (100, 101)]
    got = {(r.node, r.root) for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 31)} | {(101, 100), (102, 100)}


def of_each_id(rows, gone):
    """The rows that stay: all without an id, and of each id that isn't gone the one with the smallest signature."""
    own, sig = minhash.signatures([t or "" for _, t, *_ in rows])
    by = {i: s.tobytes() for i, s in zip(own, sig, strict=True)}
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None and r[0] not in gone:
            as_json = json.dumps({c: v for c, v in zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True) if v is not None}, separators=(",", ":"))
            best[r[0]] = min(best.get(r[0], (2,)), (i not in by, by.get(i, b""), as_json, i))
    return made.rows_of([r for r in rows if r[0] is None] + [rows[b[3]] for b in best.values()])


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = made.odd()
    docs = spark.createDataFrame(rows, made.DOCS)
    kept = made.rows(minhash.deduplicated(docs))
    assert kept == of_each_id(rows, {a for a, _ in brute(rows)})
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(3)
    x, y = made.words(rng, 50), made.words(rng, 50)
    rows = [(5, x, "en", "a", 1), (5, y, "en", "a", 1), (3, x, "en", "a", 1), (7, y, "en", "a", 1), (9, x + " z", None, "b", 1), (9, x + " z", None, "b", 1), (11, "", None, None, 0), (11, None, None, None, 0), (11, "", None, None, 0)]
    docs = spark.createDataFrame(rows, made.DOCS)
    got = {(r.doc_id, r.keep_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows) and len(got) == 2  # 5 joins one of 3 and 7, never both
    assert made.rows(minhash.deduplicated(docs)) == of_each_id(rows, {a for a, _ in got})
    assert minhash.deduplicated(docs).where("doc_id IN (11)").count() == 1


@pytest.mark.parametrize("most", [2, 3, 7])
def test_large_buckets_are_verified_in_parts(spark, most):
    """Chains of texts that are alike one to the next, more than a task compares at once."""
    rng = random.Random(most)
    rows = []
    for c in range(4):
        t = made.words(rng, 60).split()
        for k in range(14):
            t[rng.randrange(60)] = made.words(rng, 1)
            rows.append((100 * c + k, " ".join(t), "en", "a", 1))
    docs = spark.createDataFrame(rows, made.DOCS)
    got = {(r.doc_id, r.keep_id) for r in minhash.near_duplicates(docs, most=most).collect()}
    assert got == brute(rows) and len(got) > 30


def test_across_finds_the_links_between_parts(spark):
    """A bucket whose parts lie apart: only comparing documents outside the greatest component with all others joins them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 128, dtype=np.uint32)
    sig = np.array([np.where(np.arange(128) < 10 * k, rng.integers(0, 1 << 32, 128, dtype=np.uint32), base) for k in range(12)])
    rows = [(1, k % 3, 3, k, sig[k].tobytes()) for k in range(12)]
    large = spark.createDataFrame(rows, "key long, part int, parts int, doc_id long, sig binary")
    none = spark.createDataFrame([], "a long, b long")
    near = minhash.verified(large, 71)
    edges = near.union(minhash.across(large, near, 71, 2))
    got = {(r.node, r.root) for r in minhash.components(edges).collect()}
    want = {(r.node, r.root) for r in minhash.components(spark.createDataFrame([(i, j) for i in range(12) for j in range(i) if (sig[i] == sig[j]).sum() >= 71], "a long, b long")).collect()}
    assert got == want and len(want) > 3
    assert {(r.node, r.root) for r in minhash.components(minhash.across(large, none, 71, 2)).collect()} == want
