"""Small tables for tests."""

import random
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["word", "bucket", "host", "line", "count", "sig", "rep", "__text", "__bad", "__gone", "__h", "value", "pattern", "kind", "score", "owner", "tokens", "n", "e", "v", "a", "b", "shard"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(n=60, seed=3):
    """Rows of documents with exact and near copies, shared lines, personal data, secrets, empty and null texts."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 2, 3, 40, 80, 150])) for _ in range(n)]
    for k in range(0, n, 6):
        copy = texts[(k + 3) % n].split()
        if len(copy) > 20:
            copy[5] = "changed"
        texts[k] = " ".join(copy)
    for k in range(1, n, 4):
        texts[k] += f"\nshared line here\nmail me at user{k}@example{k % 7}.org or call +1 555 010 {1000 + k}\napi_key = 'AbCd{k % 5}EfGhIjKlMnOpQr12{k % 5}'"
    texts[2], texts[4], texts[7] = None, "", " \n\t "
    return [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "x", None][i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]


def odd(seed=5):
    """corpus() with nulls in any column, repeated rows and one very long text."""
    rows = corpus(40, seed)
    return [*rows, rows[1], rows[1], rows[3], (None, "no id at all", None, None, None), (None, None, None, None, None), (900, words(random.Random(1), 60_000), "en", "hot", 5), (901, "x" * 300_000, None, "hot", None), (902, "\0\x01 odd ퟿ é b", "en", None, 7)]


def rows(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def rows_of(found):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in found)
