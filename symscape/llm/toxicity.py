"""Operator 6, toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The string of a token is its letters and digits in lower case (so "i-d-i-o-t" reads "idiot"); three or more single letters in a row are one
token too. The kernel of two strings sums their common subsequences of ORDER characters, each weighted by DECAY to the length it
spans, normalised to 1 for equal strings: gaps and inserted characters lower it only a little. A token that the machine scores above CUT
is a hit of the nearest toxic landmark. Hits add up to a log-likelihood ratio of their rates in toxic and clean sentences, since some
terms are proof and others occur in clean texts now and then; a document whose ratio is above MARGIN is toxic.

Training: sentences of a bounded sample of the labelled documents, at most TOXIC and CLEAN of them (the ones with the least hash of
doc_id) and CHARACTERS characters of each kind. Sentences of toxic documents are positive where they hold a token that occurs in many
different contexts there and hardly in clean documents; repeated sentences count once, so groups of copies teach nothing. Landmarks are
LANDMARKS at most of the CONSIDERED most telling tokens, those of at most LETTERS different characters (the bound below has a table of
all sets of them), and HARD clean strings at most of the TRIED nearest to them. Positive strings are trained on with gapped and inserted
variants too; negative ones are the NEGATIVES nearest to the landmarks and as many at random. These bounds shape what is learnt from the
sample alone; every document is scored whole.

Scoring sees every token: an upper bound of a token's score from the set of its characters, which follows from Cauchy-Schwarz, skips
tokens that can't be positive; all others get the exact kernel.

Defined results: null or empty texts are not toxic; without labels of both classes, or without telling tokens, nothing is toxic;
repeated labels count once, null labels not at all, and a document that is labelled both ways teaches nothing; repeated documents are
decided alike; texts of any length are scored whole; an empty table gives an empty result. toxic_documents() reads doc_id and text alone;
without_toxic() passes on all columns, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symscape.llm.common import TOKEN, WORD, Words, chunks, texts_of, tidy

ORDER, DECAY = 3, np.float32(0.6)
TOXIC, CLEAN, CHARACTERS = 1500, 2500, 20_000_000
LANDMARKS, CONSIDERED, LETTERS, HARD, TRIED, NEGATIVES, NEAR = 24, 600, 16, 8, 400, 4000, 0.6
#: How many times as frequent a token must be in toxic sentences; the ridge of the support vector machine; the score from which a string is a hit; the log-likelihood ratio from which a document is toxic.
TELLING, RIDGE, CUT, MARGIN = 8.0, 2e-3, -0.3, 2.5
#: Hits are told apart by their kernel with the nearest landmark.
FLOORS = np.array([0.45, 0.6, 0.75, 0.9], np.float32)
#: Hits of less weight count for nothing; a string counts once, and again for each PER tokens of its document.
LEAST, PER = 1.0, 100
#: The share of a landmark's hits that altered spellings are taken to have in toxic sentences.
VARIANTS = 0.05
#: A worker forgets the strings it weighed beyond so many.
REMEMBERED = 300_000
_OTHER = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+\s*")


# --- the kernel


def _codes(strings: list[str]) -> np.ndarray:
    """Code points, a column for each string; all of one length."""
    return np.ascontiguousarray(np.array(strings, dtype=f"<U{len(strings[0])}").view(np.uint32).reshape(len(strings), -1).T)


def _kernel(width: int, m: int, n: int, equal) -> np.ndarray:
    """Unnormalised kernels of n pairs of strings of width and m characters; equal(p, j): 1.0 where the characters p and j agree."""
    d = DECAY
    old, new = (np.zeros((2, m, n), np.float32) for _ in range(2))
    out, a, b, t = (np.zeros(n, np.float32) for _ in range(4))
    for p in range(width):
        a[:] = 0
        b[:] = 0
        for j in range(m):
            same = equal(p, j)
            if j:
                np.multiply(same, old[1, j - 1], out=t)
                out += t
                np.multiply(same, old[0, j - 1], out=t)
                b *= d
                b += t
            a *= d
            a += same
            for k, run in ((0, a), (1, b)):
                np.multiply(old[k, j], d, out=new[k, j])
                new[k, j] += run
        old, new = new, old
    return out * d**6  # every matching character lies within both spans


def _by_length(strings: list[str], most: int = 4096):
    by: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(strings):
        by[len(s)].append(i)
    for width, own in by.items():
        if width >= ORDER:
            for at in range(0, len(own), most):
                part = own[at : at + most]
                yield width, part, _codes([strings[i] for i in part])


def norms(strings: list[str]) -> np.ndarray:
    """Square root of the kernel of each string with itself."""
    out = np.zeros(len(strings), np.float32)
    for width, own, codes in _by_length(strings):
        out[own] = np.sqrt(_kernel(width, width, len(own), lambda p, j, c=codes: (c[p] == c[j]).astype(np.float32)))
    return out


def _least_norm(width: int) -> np.float32:
    """No string of so many characters has a smaller norm: the matches of each triple of places with itself alone give this."""
    return np.sqrt(sum((width - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(ORDER, width + 1)))


def kernels(strings: list[str], landmarks: list[str], least: float = 0.0) -> np.ndarray:
    """Normalised kernels, a row for each string and a column for each landmark; 0 where either is shorter than ORDER. Rows with no kernel of at least `least` may be 0."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    own_norm = norms(landmarks)
    m, d = max(map(len, landmarks)), DECAY
    letters = sorted(set("".join(landmarks)))
    which = np.array([[*map(letters.index, t)] + [len(letters)] * (m - len(t)) for t in landmarks])
    for width, own, codes in _by_length(strings, 512):
        n = len(own)
        shape = (len(landmarks), n)
        old, new = (np.zeros((2, m, *shape), np.float32) for _ in range(2))
        total, a, b, t = (np.zeros(shape, np.float32) for _ in range(4))
        table = np.zeros((len(letters) + 1, n), np.float32)
        for p in range(width):
            for k, x in enumerate(letters):
                table[k] = codes[p] == ord(x)
            a[:] = 0
            b[:] = 0
            for j in range(m):
                same = table[which[:, j]]
                if j:
                    np.multiply(same, old[1, j - 1], out=t)
                    total += t
                    np.multiply(same, old[0, j - 1], out=t)
                    b *= d
                    b += t
                a *= d
                a += same
                for k, run in ((0, a), (1, b)):
                    np.multiply(old[k, j], d, out=new[k, j])
                    new[k, j] += run
            old, new = new, old
        ratio = np.where(own_norm[:, None] > 0, total * d**6 / np.maximum(own_norm[:, None], np.float32(1e-9)), 0)
        some = np.flatnonzero(ratio.max(0) >= least * _least_norm(width) * 0.999)
        if len(some):
            codes = codes[:, some]
            norm = np.sqrt(_kernel(width, width, len(some), lambda p, j, c=codes: (c[p] == c[j]).astype(np.float32)))
            out[np.array(own)[some]] = (ratio[:, some] / norm).T
    return out


# --- the model


def _bit(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 40


#: The bit of each byte of a lower-case text; bytes of letters outside ASCII share one.
_BITS = np.array([1 << _bit(chr(b)) if b < 128 and chr(b).isalnum() else (1 << 40 if b >= 128 else 0) for b in range(256)], np.uint64)


def _share(landmark: str) -> tuple[list[int], np.ndarray]:
    """(bits, table): table[s] is the most that the landmark's kernel can be for a string whose characters are the set s of bits."""
    bits = sorted({_bit(c) for c in landmark})
    at = {b: i for i, b in enumerate(bits)}
    weight: dict[str, float] = defaultdict(float)

    def walk(i: int, first: int, u: str) -> None:
        for j in range(i, len(landmark)):
            start = j if not u else first
            if len(u) + 1 == ORDER:
                weight[u + landmark[j]] += float(DECAY) ** (j - start + 1)
            else:
                walk(j + 1, start, u + landmark[j])

    walk(0, 0, "")
    table = np.zeros(1 << len(bits))
    for u, w in weight.items():
        table[sum({1 << at[_bit(c)] for c in u})] += w * w
    for i in range(len(bits)):  # sums over subsets
        view = table.reshape(-1, 2, 1 << i)
        view[:, 1] += view[:, 0]
    return bits, np.sqrt(table / table[-1]).astype(np.float32) + np.float32(1e-5)


class Model:
    """score(string) = kernels with the landmarks @ beta + bias. A string that scores above CUT is a hit of the positive landmark nearest to
    it, in the bin of that kernel, and adds the weight of both to its document; each token of the document takes off `each`."""

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, positive: int, weights: np.ndarray | None = None, each: float = 0.0):
        self.landmarks, self.beta, self.bias, self.positive = landmarks, beta.astype(np.float32), float(bias), positive
        self.weights, self.each = np.ones(positive * len(FLOORS)) if weights is None else weights, each
        self.key = hash((tuple(landmarks), self.beta.tobytes(), self.weights.tobytes()))
        bins = self.weights.reshape(positive, -1)
        #: Of each positive landmark whose hits weigh: (least kernel that does, characters, most kernel for each set of them).
        self.bounds = [(float(FLOORS[np.flatnonzero(bins[k])[0]]), *_share(landmarks[k])) for k in range(positive) if bins[k].any()]

    def hits(self, strings: list[str]) -> np.ndarray:
        """For each string the number of its nearest positive landmark and bin, -1 if it is none."""
        k = kernels(strings, self.landmarks, float(FLOORS[0]))
        near = k[:, : self.positive]
        top = near.max(1)
        return np.where((k @ self.beta + self.bias > CUT) & (top >= FLOORS[0]), near.argmax(1) * len(FLOORS) + np.searchsorted(FLOORS, top, "right") - 1, -1)

    def possible(self, sets: np.ndarray) -> np.ndarray:
        """Whether a token with such a set of characters may be a hit that weighs."""
        out = np.zeros(len(sets), bool)
        for least, bits, table in self.bounds:
            index = np.zeros(len(sets), np.uint16)
            for i, b in enumerate(bits):
                index |= ((sets >> np.uint64(b)) & np.uint64(1)).astype(np.uint16) << np.uint16(i)
            out |= (table >= least)[index]
        return out


def string_of(token: str) -> str:
    return _OTHER.sub("", token.lower())


def strings_of(text: str) -> list[str]:
    """The strings of a text's tokens, and of the runs of single letters in it."""
    out = [string_of(t) for t in text.split()]
    run: list[str] = []
    for s in [*out, ""]:
        if len(s) == 1:
            run.append(s)
        else:
            if len(run) >= ORDER:
                out.append("".join(run))
            run = []
    return [s for s in out if len(s) >= ORDER]


def fit(texts: list[tuple[str, int]]) -> Model | None:
    """texts: (text, label), label 1 for toxic."""
    seen: tuple[set[int], set[int]] = (set(), set())
    contexts: dict[str, set[int]] = defaultdict(set)  # of the positive documents, as hashes of the neighbours
    count: tuple[Counter, Counter] = (Counter(), Counter())  # as a document's score counts them
    holders = Counter()
    docs = sum(1 for _, y in texts if y)
    if not docs or docs == len(texts):
        return None
    total = [0, 0]
    for text, y in texts:
        own, tokens = Counter(), 0
        for sentence in _SENTENCE.split(text):
            key = zlib.crc32(sentence.encode()) << 32 | zlib.adler32(sentence.encode())
            if key in seen[y]:
                continue
            seen[y].add(key)
            words = ["", *strings_of(sentence), ""]
            tokens += len(sentence.split())
            own.update(words[1:-1])
            for a, w, b in zip(words, words[1:], words[2:], strict=False) if y else ():
                contexts[w].add(zlib.crc32(f"{a} {b}".encode()))
        total[y] += tokens
        count[y].update({w: min(n, 1 + tokens // PER) for w, n in own.items()})
        holders.update(own.keys() if y else ())
    if not total[0] or not total[1]:
        return None
    rate = lambda w: (count[1][w] / total[1]) / ((count[0][w] + 0.5) / total[0])
    least = max(5, 0.006 * docs)
    telling = {w: len(c) for w, c in contexts.items() if len(c) >= least and holders[w] >= 3 and rate(w) >= TELLING}
    # Landmarks: again and again the token to which most contexts of tokens without a near landmark are near.
    some = [w for w in sorted(telling, key=lambda w: (-telling[w], w))[:CONSIDERED] if len({_bit(c) for c in w}) <= LETTERS]
    chosen: list[str] = []
    if some:
        close, rest = kernels(some, some) >= NEAR, np.array([float(telling[w]) for w in some])
        while len(chosen) < LANDMARKS and rest.max() > 0:
            k = int((close @ rest).argmax())
            chosen.append(some[k])
            rest[close[k]] = 0
    if not chosen:
        return None
    rng = np.random.default_rng(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    positive = sorted(telling)
    for w in chosen:
        for _ in range(24):
            i = int(rng.integers(1, len(w)))
            positive.append(w[:i] + letters[rng.integers(36)] + w[i:])
        positive.append(f"{w}s")
    pool = sorted(w for w in count[0] if w not in telling)
    near = kernels(pool, chosen).max(1)
    order = np.argsort(-near, kind="stable")
    negative = [pool[i] for i in order[:NEGATIVES]] + [pool[i] for i in rng.permutation(len(pool))[:NEGATIVES]]
    hard: list[str] = []
    for i in order[:TRIED]:
        if len(hard) < HARD and len({_bit(c) for c in pool[i]}) <= LETTERS and kernels([pool[i]], chosen + hard).max() < 0.7:
            hard.append(pool[i])
    landmarks = chosen + hard
    gram = kernels(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: phi(x) = k(x, landmarks) @ root
    x = np.concatenate([kernels(positive, landmarks), kernels(negative, landmarks)]) @ root
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    family = kernels(positive, chosen).argmax(1)  # each landmark's strings weigh alike
    weight = np.concatenate([0.5 / len(set(family)) / np.bincount(family)[family], np.full(len(negative), 0.5 / len(negative))])
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([RIDGE] * x.shape[1] + [1e-8])
    for _ in range(30):  # Newton steps on the squared hinge
        on = y * (x1 @ w) < 1
        a = x1[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x1[on] + ridge, a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    model = Model(landmarks, root @ w[:-1], w[-1], len(chosen))
    hits = np.zeros((2, len(chosen) * len(FLOORS)))
    for label in (0, 1):
        own = list(count[label])
        for s, k in zip(own, model.hits(own), strict=True):
            if k >= 0:
                hits[label, k] += count[label][s]
    each = float(max(0, (hits[1] / total[1] - hits[0] / total[0]).sum()))
    hits[1] += VARIANTS * np.repeat(hits[1].reshape(len(chosen), -1)[:, -1], len(FLOORS))
    rates = (hits + 0.5) / np.array(total)[:, None]
    weights = np.log(rates[1] / rates[0])
    return Model(landmarks, model.beta, model.bias, len(chosen), np.where(weights >= LEAST, weights, 0), each)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, characters: int = CHARACTERS) -> Model | None:
    """A model from a bounded sample of the labelled documents: of each kind so many of the least hashes, as long as they have no more characters together."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("y"), F.max(F.col("toxic").cast("int")).alias("most")).where("y = most AND y IN (0, 1)")
    ids = None
    for y, most in ((1, toxic), (0, clean)):
        part = known.where(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # Rows of one id count as the least text; of so few documents the running sum is one small task's.
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= characters).select("doc_id", "text", "y").collect()
    return fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.y, r.text))])


# --- documents


#: What strings of the models in use weigh, for all tasks of a worker process: model key -> hash of a token -> (weight, string).
_known: dict[int, dict[int, tuple[float, str] | None]] = {}


class Scorer:
    """Scores whole texts with a model."""

    def __init__(self, model: Model):
        self.model = model
        if model.key not in _known:
            _known.clear()
        self.known = _known.setdefault(model.key, {})

    def _weigh(self, strings: list[str]) -> list[tuple[float, str] | None]:
        hits = self.model.hits(strings) if strings else []
        return [(float(self.model.weights[k]), s) if k >= 0 and self.model.weights[k] > 0 else None for s, k in zip(strings, hits, strict=True)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """(score, term) of each text: the score, -1 where nothing hits, and the string of the most telling hit."""
        words = Words(texts, TOKEN)
        score, term = np.full(len(texts), -1.0), [""] * len(texts)
        if not len(words.start):
            return score, term
        tokens, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, keys = self.known, tokens.tolist()
        fresh = np.array([i for i, h in enumerate(keys) if h not in known], np.int64)
        if len(fresh):
            sets = np.bitwise_or.reduceat(_BITS[words.buf], words.start)[at[fresh]]
            may = fresh[self.model.possible(sets)]
            known.update(dict.fromkeys(tokens[fresh].tolist()))
            strings = [string_of(words.word(at[i])) for i in may]
            new = list(dict.fromkeys(x for x in strings if len(x) >= ORDER))
            weights = dict(zip(new, self._weigh(new), strict=True))
            known.update({keys[i]: weights.get(x) for i, x in zip(may.tolist(), strings, strict=True)})
        hit = np.array([known[h] is not None for h in keys])
        where = np.flatnonzero(hit[back])
        found = [(int(d), known[keys[back[i]]]) for d, i in zip(np.searchsorted(words.first, where, "right") - 1, where, strict=True)]
        found += self._spelt(words)
        tokens = np.diff(words.first)
        sums, best = np.zeros(len(texts)), np.zeros(len(texts))
        for (d, (w, s)), n in Counter(found).items():
            sums[d] += w * min(n, 1 + tokens[d] // PER)
            if (-w, s) < (-best[d], term[d]):
                best[d], term[d] = w, s
        return np.where(sums > 0, sums - self.model.each * tokens - MARGIN, score), term

    def _spelt(self, words: Words) -> list[tuple[int, tuple[float, str]]]:
        """Hits among the runs of single letters, as (text, (weight, string))."""
        letters = (WORD[words.buf] & ((words.buf < 0x80) | (words.buf >= 0xC0))).astype(np.int32)
        short = np.flatnonzero(np.add.reduceat(letters, words.start) == 1)
        if len(short) < ORDER:
            return []
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(short) != 1) | np.isin(short[1:], words.first)]))
        runs: list[tuple[int, str]] = []
        lengths = np.diff(np.append(begins, len(short)))
        for i, n in zip(begins, lengths, strict=True):
            if n >= ORDER:
                owner = int(np.searchsorted(words.first, short[i], "right") - 1)
                runs.append((owner, "".join(string_of(words.word(k)) for k in short[i : i + n])))
        strings = sorted({x for _, x in runs})
        weights = dict(zip(strings, self._weigh(strings), strict=True))
        return [(d, weights[x]) for d, x in runs if weights[x]]


def toxic_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, term) of the toxic documents: the score and the string of the worst token."""
    columns = "doc_id long, score double, term string"
    if model is None:
        return docs.sparkSession.createDataFrame([], columns)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                score, term = scorer(texts)
                hit = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()), pa.array(score[hit]), pa.array([term[i] for i in hit], pa.string())], ["doc_id", "score", "term"])

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), columns)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, all columns, without its toxic rows; rows of null text stay. No shuffle."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            score = np.concatenate([scorer(part)[0] for _, part in chunks(texts, texts)]) if texts else np.zeros(0)
            yield batch.filter(pa.array(score <= 0))

    return docs.mapInArrow(tidy(run), docs.schema)
