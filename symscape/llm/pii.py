"""Operator 9, personal data by bootstrapped contextual extraction.

Candidates are identifier-like spans of whole texts: tokens with a digit or an @, and numbers written in several groups; where a strict
recogniser (KINDS) finds identifiers inside such a span, those. Seeds are candidates that a recogniser accepts. Candidates induce lexical
patterns: their shape (letters as a, digits as 9 with their number), and the words to the left and right. Spark scores the graph of
patterns and instances for ROUNDS rounds. A pattern scores, for each kind, the sum of its instances' scores over one more than the
distinct contexts it has in the corpus: its distinct instances, and for a word also the distinct other tokens that it stands beside, so
that copies of a document count once. Only patterns whose instances sum to at least SUPPORT tell anything. An instance scores as the noisy-or
of its patterns of at least DOUBT, and seeds score 1. Every pattern takes part in every round: one that has few seeds can rise later,
through instances discovered before. After the last round the patterns of at least CONFIDENCE are kept, and every candidate that one of
them matches is personal data, seed or not.

The other tokens beside a word are counted in two passes. The first finds how many distinct ones a part of the corpus has at least; a
word that has too many there to reach DOUBT even if all its instances scored 1 can't in any round, and isn't counted further.

Defined results: null or empty texts have no candidates; repeated rows and values repeat in the result; a span of several kinds gets
the one with the highest score, then the first by name; words and texts of any length are taken whole; an empty table gives an empty
result. Only doc_id and text are read by findings(); redacted() keeps all columns, whatever their names, and changes text and n_chars
(where present) alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import TOKEN, Words, chunks, free, mix, quoted, texts_of, tidy, written

ROUNDS, CONFIDENCE, SUPPORT, DOUBT = 3, 0.75, 5, 0.2

_EMAIL = re.compile(r"[^\s@<>(),;:\"]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_GROUP = re.compile(r"[+(]?[0-9][0-9().\-/]*")
_HAS = np.array([48 <= b <= 57 or b == 64 for b in range(256)])


def _card(s: str) -> bool:
    digits = [int(c) for c in re.sub(r"[ -]", "", s)] if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", s) else []
    return bool(digits) and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(digits))) % 10 == 0


def _phone(s: str) -> bool:
    digits = sum(c.isdigit() for c in s)
    return (s[0] == "+" and 8 <= digits <= 15 and bool(re.fullmatch(r"\+[0-9(][0-9() .\-/]*", s))) or bool(re.fullmatch(r"\(\d{3}\) ?\d{3}[-. ]\d{4}", s))


def _rank(hit: tuple[float, str]) -> tuple[float, list[int]]:
    """The highest score is greatest, of equals the first kind by name."""
    return hit[0], [-ord(c) for c in hit[1]]


KINDS = {"card": _card, "email": lambda s: bool(_EMAIL.fullmatch(s)), "ip": lambda s: bool(_IP.fullmatch(s)), "phone": _phone}


def shape(s: str) -> str:
    """Letters as a, digits as 9 and their number; in tokens with an @ without it."""
    s = re.sub(r"[^\W\d_]+", "a", s)
    if "@" in s:
        return re.sub(r"[\d_]*a[a\d_.%+-]*|[\d_.]+", "a", s.partition("@")[0]) + "@" + re.sub(r"[a\d-]+", "a", s.partition("@")[2])
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", s)


#: What is looked for wherever it stands; each match must still satisfy its kind. Letters of scripts without blanks are no part of an e-mail.
_LOCAL = r"0-9A-Za-z_\u00c0-\u1fff"
_INSIDE = {
    "email": re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}](?:[{_LOCAL}.%+-]{{0,62}}[{_LOCAL}%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}})\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9@]|[-_][A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9A-Za-z])(?<![0-9A-Za-z]\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+\(?[0-9](?:[() .\-/]{0,3}[0-9]){7,14}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4})(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z+])(?<![0-9][.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"),
}


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate: an identifier wherever it stands, else the whole token or group of numbers, or what identifiers leave of it."""
    whole = _whole(text)
    seeds = [(a, b) for a, b in whole if any(f(text[a:b]) for f in KINDS.values())]
    if len(seeds) == len(whole):
        return whole
    taken = set().union(*(range(a, b) for a, b in seeds))
    for kind, pattern in _INSIDE.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if KINDS[kind](m[0]) and taken.isdisjoint(range(*m.span())):
                seeds.append(m.span())
                taken.update(range(*m.span()))
    out = set(seeds)
    for a, b in whole:
        if taken.isdisjoint(range(a, b)):
            out.add((a, b))
            continue
        cut = "".join("\n" if a + i in taken else c for i, c in enumerate(text[a:b]))
        out.update((a + x, a + y) for x, y in _whole(cut))
    return sorted(out)


def _whole(text: str) -> list[tuple[int, int]]:
    """Start and end of each token with a digit or an @, numbers in several groups as one."""
    out: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in "\"'<[{,;:!?=":
            a += 1
        while b > a and text[b - 1] in "\"'>]}.,;:!?|":
            b -= 1
        if a == b:
            continue
        if out and a - out[-1][1] == 1 and text[a - 1] == " " and text[a] != "+" and _GROUP.fullmatch(text[a:b]):
            whole = text[out[-1][0] : b]
            if "@" not in whole and _GROUP.match(text[out[-1][0] : out[-1][1]]) and re.fullmatch(r"[+(]?[0-9][0-9().\-/ ]*", whole) and sum(c.isdigit() for c in whole) <= (19 if whole[0] != "+" else 15) and max(map(len, whole.split(" "))) < 13:
                out[-1] = (out[-1][0], b)
                continue
        out.append((a, b))
    return out


def _neighbour(text: str, a: int, b: int) -> tuple[str, str]:
    """The words before a and after b in lower case, whole however long they are."""
    left, right, width = [], [], 64
    while not left or (len(left) < 2 and not text[lo].isspace() and lo):
        lo = max(0, a - width)
        left = text[lo:a].split()
        if not lo:
            break
        width *= 4
    width = 64
    while not right or (len(right) < 2 and not text[hi - 1].isspace() and hi < len(text)):
        hi = min(len(text), b + width)
        right = text[b:hi].split()
        if hi == len(text):
            break
        width *= 4
    return (left[-1].lower() if left else "", right[0].lower() if right else "")


def candidates_of(text: str) -> list[tuple[int, int, str, str, str, str | None]]:
    """(start, end, shape, left, right, seed kind) of each candidate of a text."""
    out = []
    for a, b in spans(text):
        value = text[a:b]
        out.append((a, b, shape(value), *_neighbour(text, a, b), next((k for k, f in KINDS.items() if f(value)), None)))
    return out


def _may(texts: list[str]) -> np.ndarray:
    words = Words(texts, TOKEN, hashed=False)
    at = np.flatnonzero(_HAS[words.buf])
    if not len(at) or not len(words.start):
        return np.zeros(0, np.int64)
    word = np.searchsorted(words.start, at, "right") - 1
    return np.unique(np.searchsorted(words.first, np.unique(word), "right") - 1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, value, shape, left, right, seed)."""
    schema = "doc_id long, start int, stop int, value string, shape string, left string, right string, seed string"

    def run(batches):
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(ids[i], a, b, texts[i][a:b], s, x, y, k) for i in _may(texts) for a, b, s, x, y, k in candidates_of(texts[i])]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5], strict=True)], ["doc_id", "start", "stop", "value", "shape", "left", "right", "seed"])

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


def word_keys(words: DataFrame, column: str) -> DataFrame:
    """words with key, the hash by which contexts() names each one."""
    schema = f"{column} string, key long"

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = Words(names, TOKEN)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found.hash[found.first[:-1]].view(np.int64))], [column, "key"])

    return words.select(column).mapInArrow(tidy(run), schema)


#: Context words whose neighbours alone are taken from the corpus (8 bytes each go to all tasks); with more than that all are, and joined, with the same result.
COUNTED_AT_ONCE = 1_000_000
#: Pairs of a word and its neighbour that a task makes distinct before it hands them on.
PAIRS = 500_000


def _pairs(batches, wanted: np.ndarray | None):
    """(key, side, other) arrays of distinct rows, again and again: for each wanted token, in lower case, its neighbours to the right (side 0: it stands to their left) and to the left (side 1) that are no candidates; a text's edge is a neighbour too. wanted: sorted keys, or None for all tokens."""
    held, n = [], 0

    def out():
        key, other, side = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one = np.unique(mix(mix(key) + other) + side, return_index=True)
        return key[one], side[one], other[one]

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for _, part in chunks(texts, texts):
            words = Words(part, TOKEN)
            if not len(words.start):
                continue
            digits = np.concatenate([[0], np.cumsum(_HAS[words.buf])])
            plain = digits[words.end] == digits[words.start]
            want = np.ones(len(plain), bool) if wanted is None else np.zeros(len(plain), bool) if not len(wanted) else wanted[np.minimum(np.searchsorted(wanted, words.hash), len(wanted) - 1)] == words.hash
            edge = np.zeros(len(plain), bool)
            edge[words.first[words.first < len(plain)]] = True
            for side, step in ((0, -1), (1, 1)):
                none = np.roll(edge, -1) if side == 0 else edge
                other = np.where(none, np.uint64(0), np.roll(words.hash, step))
                at = np.flatnonzero(want & (none | np.roll(plain, step)))
                held.append((words.hash[at], other[at], np.full(len(at), side, np.uint64)))
                n += len(at)
            if n > PAIRS:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _sides(side: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(side.astype(np.int8)), pa.array(["L", "R"])).cast(pa.string())


def least_contexts(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, side, least): of how many distinct plain neighbours a part of the corpus has the most; all of it has no fewer."""

    def run(batches):
        for key, side, _ in _pairs(batches, wanted):
            order = np.lexsort((side, key))
            key, side = key[order], side[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])) if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), _sides(side[at]), pa.array(np.diff(np.append(at, len(key))))], ["key", "side", "n"])

    return docs.where(F.col("text").isNotNull()).select("text").mapInArrow(tidy(run), "key long, side string, n long").groupBy("key", "side").agg(F.max("n").alias("least"))


def contexts(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, side, plain): the number of distinct plain neighbours; copies of a text add nothing."""

    def run(batches):
        for key, side, other in _pairs(batches, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), _sides(side), pa.array(other.view(np.int64))], ["key", "side", "other"])

    pairs = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(tidy(run), "key long, side string, other long")
    return pairs.distinct().groupBy("key", "side").agg(F.count("*").alias("plain"))


def _wanted(keys: DataFrame) -> np.ndarray | None:
    if keys.count() > COUNTED_AT_ONCE:
        return None
    return np.sort(np.array([r.key for r in keys.select("key").distinct().collect()], np.int64).view(np.uint64))


def totals(docs: DataFrame, links: DataFrame, doubt: float = DOUBT) -> DataFrame:
    """(pattern, n): the distinct contexts of each pattern that may score as much as doubt."""
    held = links.groupBy("pattern").agg(F.count("*").alias("k"))
    words = held.where("pattern NOT LIKE 'S:%'").select(F.substring("pattern", 3, 1 << 30).alias("word")).distinct()
    keys = written(word_keys(words, "word"), "keys")
    named = F.concat_ws(":", "side", "word").alias("pattern")
    least = least_contexts(docs, _wanted(keys)).join(keys, "key").select(named, "key", "least")
    may = held.join(least, "pattern", "left").where(F.col("k") >= doubt * (F.col("k") + F.coalesce("least", F.lit(0)) + 1))
    may = written(may.select("pattern", "k", "key"), "may")
    word = F.substring("pattern", 3, 1 << 30).alias("word")
    left = written(may.where("key IS NOT NULL").select("key", word).distinct(), "left", keys)
    plain = contexts(docs, _wanted(left)).join(left, "key").select(named, "plain")
    return written(may.join(plain, "pattern", "left").select("pattern", (F.col("k") + F.coalesce("plain", F.lit(0))).alias("n")), "totals")


def patterns(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, doubt: float = DOUBT) -> DataFrame:
    """(pattern, kind, score) of the patterns that are kept."""
    doubt = min(doubt, confidence)
    links = found.select("value", F.explode(F.array(F.concat(F.lit("S:"), "shape"), F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"))).alias("pattern")).where("length(pattern) > 2").distinct()
    seeds = found.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    # Scores are 1 at most, so a pattern of fewer values than SUPPORT can't reach it in any round.
    useful = links.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= support).select("pattern")
    links = written(links.join(useful, "pattern"), "links")
    links = written(links.join(totals(docs, links, doubt), "pattern"), "links", links)
    scores, held = seeds, None
    for _ in range(rounds):
        mass = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.first("n").alias("n"))
        held = written(mass.where(F.col("mass") >= support).select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= doubt), "held")
        reached = links.join(held, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("score"))
        scores = reached.union(seeds).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return held.where(F.col("score") >= confidence)


def findings(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, kind, start, length, identifier, score) of each span that is personal data; identifier is the md5 of its text."""
    found = written(candidates(docs), "candidates")
    kept = written(patterns(docs, found, **settings), "patterns")
    return decided(found, kept).select("doc_id", "kind", F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("length"), F.md5("value").alias("identifier"), "score")


def decided(found: DataFrame, kept: DataFrame) -> DataFrame:
    """The candidates that a seed or a kept pattern makes personal data, with kind and score."""
    best = kept.groupBy("pattern").agg(F.min(F.struct((-F.col("score")).alias("worse"), "kind")).alias("p"))
    part = lambda letter, column: best.where(F.col("pattern").startswith(f"{letter}:")).select(F.substring("pattern", 3, 1 << 20).alias(column), F.col("p").alias(letter))
    out = found
    for letter, column in (("S", "shape"), ("L", "left"), ("R", "right")):
        out = out.join(part(letter, column), column, "left")
    seed = F.when(F.col("seed").isNotNull(), F.struct(F.lit(-1.0).alias("worse"), F.col("seed").alias("kind")))
    return out.withColumn("d", F.least(seed, "S", "L", "R")).where("d IS NOT NULL").withColumns({"kind": F.col("d.kind"), "score": -F.col("d.worse")})


#: Kept patterns that redacted() sends to all executors; with more than that, documents are joined with their findings, with the same result.
MOST_PATTERNS = 500_000


def _replaced(text: str, hits: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, kind in hits:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


def redacted(docs: DataFrame, **settings) -> DataFrame:
    """docs with every finding replaced by its kind in brackets, such as [EMAIL]. No shuffle of the texts unless very many patterns are kept."""
    found = written(candidates(docs), "candidates")
    kept = written(patterns(docs, found, **settings), "patterns")
    return _by_patterns(docs, kept) if kept.count() <= MOST_PATTERNS else _by_findings(docs, kept)


def _by_patterns(docs: DataFrame, kept: DataFrame) -> DataFrame:
    best: dict[str, tuple[float, str]] = {}
    for r in kept.collect():
        best[r.pattern] = max(best.get(r.pattern, (0.0, "")), (r.score, r.kind), key=_rank)
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str) -> str:
        found = []
        for a, b, s, x, y, k in candidates_of(text):
            hits = [best[p] for p in (f"S:{s}", f"L:{x}", f"R:{y}") if p in best] + ([(1.0, k)] if k else [])
            if hits:
                found.append((a, b, max(hits, key=_rank)[1]))
        return _replaced(text, found) if found else text

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            filled = [t or "" for t in texts]
            first = 0
            for part, _ in chunks(filled, filled):
                for i in _may(part):
                    texts[first + i] = clean(part[i])
                first += len(part)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema[at].type)
            if n_at is not None:
                columns[n_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def _by_findings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Findings are made for each distinct text, by its hash, and joined with the documents."""
    key, own, new = free(docs, "__key", "__spans", "__new")
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("doc_id"), "text")
    spans = decided(written(candidates(texts).distinct(), "candidates"), kept).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "stop", "kind", "value")).alias(own))

    @F.udf("string", useArrow=True)
    def replaced(text, spans):
        # Should two texts have one hash, only those spans count that are in this one.
        return None if text is None else _replaced(text, sorted((r["start"], r["stop"], r["kind"]) for r in spans or [] if text[r["start"] : r["stop"]] == r["value"]))

    both = docs.withColumn(key, F.xxhash64("text")).join(spans, key, "left").withColumn(new, replaced("text", F.col(own)))
    values = {"text": F.col(new), "n_chars": F.length(new)}
    return both.select(*[(values[c] if c in values else F.col(quoted(c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
