"""Operator 2, log-likelihood of whole documents under a gated recurrent language model.

Words are runs of letters and digits in lower case. All of the corpus are counted, and all belong to the vocabulary: as many as the root
of the number of distinct ones, the most frequent (ties by hash), have vectors in the dense part, of which each task has a copy; every other
word w of the corpus is a member of one more class, is told apart in it by a tree of words and has vectors of its own, too (own.py). A task
gets and returns the rows of just the words and nodes that its documents use. Before something is learnt, w has the probability
n(w) / n(class) in its class, by its exact count; train() and scored() are this model without own vectors, and score() is the whole. So
both what is learnt and what is counted grow with the corpus. The model is a minimal gated unit of HIDDEN cells: f = s(X[w] + hU), c = tanh(X'[w] + f * hU'), h = h + f(c - h). The output
softmax is factored: first a class, then a word in it; the classes of words with vectors are runs of them with like sums of root
frequencies, half as many as the root of their number.

Training goes once over all documents. In score() they are in parts of about TOGETHER words, each of one of ROUNDS rounds by its number; in
train() the rounds are by the hash of the text. In each round every part (train(): task) trains a copy of the model so
far by backpropagation truncated to WINDOW words (Adam; own vectors: Adagrad), and the copies are averaged by their numbers of words, by a tree of sums of
FAN copies at most; own vectors are averaged by their uses, over the copies that used them. They travel as 16-bit floats. Documents lie one after another in parallel streams; the state is zero where one begins and is carried from window to
window, in training and in scoring, so that a likelihood is that of the complete document.

In scored(), counts of the LOOKED_UP most frequent words are sent to all tasks; occurrences of rarer ones are joined with the table of counts, with
the same result. The model depends on how the table is split into tasks, but not on the order in which they run or whether one runs again.

Defined results: a null or empty text, and one without a word, has n_words 0, log_likelihood 0 and a null perplexity; repeated rows are
scored alike (up to rounding in the last digits); texts of any length are scored whole; an empty table gives an empty result; in scoring,
a word that the counted corpus hasn't counts as occurring once. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import heapq
from contextlib import contextmanager
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symscape.llm.common import Words, chunks, drop, released, tidy, written
from symscape.llm.own import Own, Tree, summed

HIDDEN, WINDOW, ROUNDS = 16, 32, 6
RATE, STREAMS = 6e-3, 256
#: Words in the dense part at most, whatever the corpus (the others have their vectors in tables): 200 bytes each in every task; and words of which tasks get the counts: 12 bytes each.
VECTORS, LOOKED_UP = 1 << 18, 1_000_000
#: Words that are trained on or scored together, and distinct words that a task counts before it hands them on.
TOGETHER, DISTINCT = 1_500_000, 1_000_000
#: The parameters' numbers are summed in so many blocks, and of so many copies at once.
BLOCKS, FAN = 16, 64


# --- vocabulary


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in the corpus, by its 64-bit hash."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, part in chunks(texts, texts):
                k, n = np.unique(Words(part).hash, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > DISTINCT:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    return docs.where(F.col("text").isNotNull()).select("text").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words by number: the frequent ones with vectors, then the class of all others."""

    def __init__(self, words: list[tuple[int, int]], vectors: int, others: int):
        """words: (hash, count), the most frequent first, the first `vectors` of them with vectors; others: occurrences of all but those in the corpus."""
        hashes, counts = np.array([h for h, _ in words], np.int64).view(np.uint64), np.array([n for _, n in words], float)
        vectors = min(vectors, len(words))
        self.order = np.argsort(hashes[:vectors]).astype(np.int32)
        self.sorted = hashes[self.order]
        self.size = vectors + 1
        self.counts = np.append(counts[:vectors], max(others, 1))
        rest = np.argsort(hashes[vectors:])
        #: The rarer words whose counts are known here, and the logarithms of their shares in their class.
        self.rare, self.share = hashes[vectors:][rest], np.log(counts[vectors:][rest] / self.counts[-1]).astype(np.float32)
        root = np.cumsum(np.sqrt(self.counts[:-1]))
        parts = max(1, int(np.sqrt(vectors) / 2))
        edges = np.unique(np.searchsorted(root, np.arange(1, parts) / parts * root[-1]) + 1) if vectors else []
        #: Class c has the words bounds[c] to bounds[c + 1]; the last holds the others alone.
        self.bounds = np.unique([0, *edges, self.size - 1, self.size]).astype(int)
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        words = Words(texts)
        ids = self._ids(words.hash)
        return [ids[a:b] for a, b in pairwise(words.first.tolist())]

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.size - 1).astype(np.int32)

    def split(self, texts: list[str]) -> list[tuple[np.ndarray, float, np.ndarray]]:
        """For each text its words' numbers, the sum of the shares of the rarer words known here, and the hashes of those that aren't."""
        words = Words(texts)
        ids = self._ids(words.hash)
        place = np.flatnonzero(ids == self.size - 1)
        rare = words.hash[place]
        at = np.minimum(np.searchsorted(self.rare, rare), max(len(self.rare) - 1, 0))
        hit = self.rare[at] == rare if len(self.rare) else np.zeros(len(rare), bool)
        sums = np.concatenate([[0.0], np.cumsum(np.where(hit, self.share[at] if len(self.rare) else 0, 0), dtype=float)])
        far = np.flatnonzero(~hit)
        out, cut = [], np.searchsorted(place, words.first)
        cut_far = np.searchsorted(far, cut)
        for k, (a, b) in enumerate(pairwise(words.first.tolist())):
            out.append((ids[a:b], sums[cut[k + 1]] - sums[cut[k]], rare[far[cut_far[k] : cut_far[k + 1]]].view(np.int64)))
        return out


def vocabulary(counts: DataFrame, vectors: int | None = None, looked_up: int = LOOKED_UP) -> Vocabulary:
    """counts: a written table of word_counts(). Words of one frequency are all looked up or none of them."""
    by = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    distinct = sum(w for _, w in by)
    vectors = min(VECTORS, int(np.ceil(np.sqrt(distinct)))) if vectors is None else vectors
    so_far = np.cumsum([w for _, w in by])
    enough = np.flatnonzero(so_far >= vectors)
    # The frequencies down to which words are taken: all that are wanted for vectors, and as many more as are looked up.
    least = min(by[enough[0]][0] if len(enough) else 0, next((by[k - 1][0] for k in range(len(by), 0, -1) if so_far[k - 1] <= looked_up), by[0][0])) if by else 0
    if len(enough) and so_far[enough[0]] > looked_up:  # of a frequency that too many words have, just those for vectors
        last = by[enough[0]][0]
        rows = counts.where(F.col("n") > last).union(counts.where(F.col("n") == last).orderBy("word").limit(int(vectors - (so_far[enough[0] - 1] if enough[0] else 0))))
    else:
        rows = counts.where(F.col("n") >= least)
    found = rows.toArrow()
    hashes, numbers = np.array(found.column("word")), np.array(found.column("n"))
    order = np.lexsort((hashes, -numbers))
    words = list(zip(hashes[order].tolist(), numbers[order].tolist(), strict=True))
    return Vocabulary(words, vectors, sum(n * w for n, w in by) - sum(n for _, n in words[:vectors]))


# --- the network


def start(vocab: Vocabulary, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training: outputs as the words' frequencies."""
    rng = np.random.default_rng(seed)
    n, k, b = vocab.size, hidden, vocab.bounds
    mass = np.add.reduceat(vocab.counts, b[:-1])
    some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "x": some(n + 1, 2 * k, scale=0.3),  # the last row begins a document
        "u": some(k, 2 * k, scale=0.5 / np.sqrt(k)),
        "wc": some(k, len(b) - 1, scale=0.05),
        "bc": np.log(mass / mass.sum()).astype(np.float32),
        "wo": some(k, n, scale=0.05),
        "bo": np.log(vocab.counts / mass[vocab.class_of]).astype(np.float32),
    }


class Layout:
    """Documents in parallel streams. ids, before: the word and the one before it, (steps, streams); keep: 0 where a document begins; live: 0 where a stream has ended; place: for all words, document by document, their place in ids."""

    def __init__(self, docs: list[np.ndarray], size: int):
        lengths = np.array([len(d) for d in docs], np.int64)
        total, most = int(lengths.sum()), int(lengths.max())
        b = int(np.clip(total // max(most, 256), 1, STREAMS))
        heap = [(0, s) for s in range(b)]
        stream, begin = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n, s = heapq.heappop(heap)
            stream[i], begin[i] = s, n
            heapq.heappush(heap, (n + int(lengths[i]), s))
        steps = max(n for n, _ in heap)
        flat = np.concatenate(docs)
        first = np.cumsum(lengths) - lengths
        kind = np.int32 if steps * b < 1 << 31 else np.int64
        self.place = np.arange(total, dtype=kind)
        self.place += np.repeat((begin - first).astype(kind), lengths)
        self.place *= b
        self.place += np.repeat(stream.astype(kind), lengths)
        self.first = first
        self.ids, self.before = np.full(steps * b, size - 1, np.int32), np.full(steps * b, size, np.int32)
        self.keep, self.live = np.ones((2, steps * b), np.float32)
        self.live[:] = 0
        self.ids[self.place], self.live[self.place] = flat, 1
        self.before[self.place[1:]] = flat[:-1]
        self.before[self.place[first]] = size
        self.keep[self.place[first]] = 0
        self.ids, self.before, self.keep, self.live = (x.reshape(steps, b) for x in (self.ids, self.before, self.keep, self.live))


def forward(p: dict[str, np.ndarray], before: np.ndarray, keep: np.ndarray, h: np.ndarray, x: np.ndarray | None = None):
    """States after each step of a window, the last one, and what backward() needs. x: the inputs, if they aren't just those of p."""
    k = h.shape[1]
    x = p["x"][before] if x is None else x
    states = np.empty((len(before), *h.shape), np.float32)
    saved = []
    for t in range(len(before)):
        h = h * keep[t][:, None]
        a = h @ p["u"]
        f = x[t, :, :k] + a[:, :k]
        f *= 0.5
        np.tanh(f, out=f)
        f += 1
        f *= 0.5
        c = a[:, k:] * f
        c += x[t, :, k:]
        np.tanh(c, out=c)
        d = c - h
        saved.append((h, a, f, c, d))
        h = d * f
        h += saved[-1][0]
        states[t] = h
    return states, h, saved


def output(p: dict[str, np.ndarray], bounds: np.ndarray, class_of: np.ndarray, states: np.ndarray, ids: np.ndarray, live: np.ndarray | None = None, grads: dict[str, np.ndarray] | None = None):
    """(log-likelihood of each word, gradient with respect to states). With grads, live weighs the words and their gradients are added."""
    n, k = len(ids), states.shape[1]
    own = class_of[ids]
    z = states @ p["wc"]
    z += p["bc"]
    z -= z.max(1, keepdims=True)
    rows = np.arange(n)
    hit = z[rows, own]
    np.exp(z, out=z)
    total = z.sum(1)
    ll = hit - np.log(total)
    back = None
    if grads is not None:
        z *= (live / total)[:, None]
        z[rows, own] -= live
        grads["wc"] += states.T @ z
        grads["bc"] += z.sum(0)
        back = z @ p["wc"].T
    order = np.argsort(own.astype(np.uint8 if len(bounds) < 257 else np.int32), kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(bounds)))
    s, word = states[order], ids[order]
    inner, inner_back = np.zeros(n, np.float32), np.zeros((n, k), np.float32) if grads is not None else None
    for c in range(len(bounds) - 1):
        a, b, lo, hi = edges[c], edges[c + 1], bounds[c], bounds[c + 1]
        if a == b or hi - lo == 1:
            continue
        w = p["wo"][:, lo:hi]
        z = s[a:b] @ w
        z += p["bo"][lo:hi]
        z -= z.max(1, keepdims=True)
        rows, target = np.arange(b - a), word[a:b] - lo
        hit = z[rows, target]
        np.exp(z, out=z)
        total = z.sum(1)
        inner[a:b] = hit - np.log(total)
        if grads is not None:
            weight = live[order[a:b]]
            z *= (weight / total)[:, None]
            z[rows, target] -= weight
            grads["wo"][:, lo:hi] += s[a:b].T @ z
            grads["bo"][lo:hi] += z.sum(0)
            inner_back[a:b] = z @ w.T
    ll[order] += inner
    if grads is not None:
        back[order] += inner_back
    return ll, back


def backward(p: dict[str, np.ndarray], before: np.ndarray, keep: np.ndarray, saved: list, back: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
    """Adds the gradients of a window, through all its steps, and returns those with respect to the inputs."""
    steps, b, k = back.shape
    da, dx = np.empty((steps, b, 2 * k), np.float32), np.empty((steps, b, 2 * k), np.float32)
    ut = np.ascontiguousarray(p["u"].T)
    carried = np.zeros((b, k), np.float32)
    for t in range(steps - 1, -1, -1):
        h, a, f, c, d = saved[t]
        g = back[t] + carried
        dc = (1 - c * c) * f
        dc *= g
        df = dc * a[:, k:]
        df += g * d
        df *= f * (1 - f)
        dx[t, :, :k], dx[t, :, k:] = df, dc
        da[t, :, :k], da[t, :, k:] = df, dc * f
        carried = g * (1 - f)
        carried += da[t] @ ut
        carried *= keep[t][:, None]
    grads["u"] += np.concatenate([s[0] for s in saved]).T @ da.reshape(-1, 2 * k)
    flat = before.reshape(-1)
    order = np.argsort(flat.astype(np.uint16 if len(p["x"]) < 65536 else np.int32), kind="stable")
    word, at = np.unique(flat[order], return_index=True)
    grads["x"][word] += np.add.reduceat(dx.reshape(-1, 2 * k)[order], at)
    return dx


def _placed(lay: Layout, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words: rows in Own of all words, document by document, -1 for words of the dense part. The same as ids and before of the layout."""
    now, before = np.full((2, lay.ids.size), -1, np.int32)
    now[lay.place] = words
    before[lay.place[1:]] = words[:-1]
    before[lay.place[lay.first]] = -1
    return now.reshape(lay.ids.shape), before.reshape(lay.ids.shape)


def _inputs(p: dict[str, np.ndarray], own: Own, before: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = p["x"][before]
    at = rows >= 0
    x[at, p["u"].shape[0] :] += own.a[rows[at]]
    return x


class Trainer:
    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary, rate: float = RATE):
        self.p, self.vocab, self.rate, self.n, self.words = {k: v.copy() for k, v in p.items()}, vocab, rate, 0, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def learn(self, docs: list[np.ndarray], window: int = WINDOW, own: Own | None = None, words: np.ndarray | None = None) -> None:
        """own learns too, if it is given; words: its rows for all words, document by document, -1 for the dense part's."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        lay = Layout(docs, self.vocab.size)
        now, last = _placed(lay, words) if own else (None, None)
        h = np.zeros((lay.ids.shape[1], self.p["u"].shape[0]), np.float32)
        self.words += int(lay.live.sum())
        for a in range(0, len(lay.ids), window):
            part = slice(a, a + window)
            live = lay.live[part].reshape(-1)
            states, h, saved = forward(self.p, lay.before[part], lay.keep[part], h, _inputs(self.p, own, lay.before[part], last[part]) if own else None)
            grads = {k: np.zeros_like(x) for k, x in self.p.items()}
            flat = states.reshape(-1, h.shape[1])
            weight = live / np.float32(max(live.sum(), 1))
            _, back = output(self.p, self.vocab.bounds, self.vocab.class_of, flat, lay.ids[part].reshape(-1), weight, grads)
            if own:
                rest = np.flatnonzero(now[part].reshape(-1) >= 0)
                _, more, nodes, of_nodes = own.output(flat[rest], now[part].reshape(-1)[rest], weight[rest])
                back[rest] += more
            dx = backward(self.p, lay.before[part], lay.keep[part], saved, back.reshape(states.shape), grads)
            self._step(grads)
            if own:
                at = last[part] >= 0
                rows, of_rows, uses = summed(last[part][at], dx[at][:, h.shape[1] :])
                own.used["a"][rows] += uses
                own.step("v", nodes, of_nodes, self.rate)
                own.step("a", rows, of_rows, self.rate)

    def _step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        size = self.rate / (1 - 0.9**self.n) * np.sqrt(1 - 0.99**self.n)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            g *= g
            v *= 0.99
            v += 0.01 * g
            self.p[k] -= (size * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def likelihoods(p: dict[str, np.ndarray], vocab: Vocabulary, docs: list[np.ndarray], window: int = WINDOW, own: Own | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each document's likelihood, 0 for one without words; without own, of the rarer words just their class counts."""
    out = np.zeros(len(docs))
    full = [i for i, d in enumerate(docs) if len(d)]
    if not full:
        return out
    lay = Layout([docs[i] for i in full], vocab.size)
    now, last = _placed(lay, words) if own else (None, None)
    h = np.zeros((lay.ids.shape[1], p["u"].shape[0]), np.float32)
    ll = np.empty(lay.ids.shape, np.float32)
    for a in range(0, len(lay.ids), window):
        part = slice(a, a + window)
        states, h, _ = forward(p, lay.before[part], lay.keep[part], h, _inputs(p, own, lay.before[part], last[part]) if own else None)
        flat = states.reshape(-1, h.shape[1])
        each = output(p, vocab.bounds, vocab.class_of, flat, lay.ids[part].reshape(-1))[0]
        if own:
            rest = np.flatnonzero(now[part].reshape(-1) >= 0)
            each[rest] += own.output(flat[rest], now[part].reshape(-1)[rest])[0]
        ll[part] = each.reshape(states.shape[:2])
    each = ll.reshape(-1)[lay.place].astype(float)
    out[full] = np.add.reduceat(each, lay.first)
    return out


# --- tables


def _gathered(batches, split):
    """(ids, what split makes of each text) of about TOGETHER words at a time."""
    ids, docs, n = [], [], 0
    for batch in batches:
        for some, texts in chunks(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
            new = split(texts)
            ids += some
            docs += new
            n += sum(len(x[0]) for x in new)
            if n >= TOGETHER:
                yield ids, docs
                ids, docs, n = [], [], 0
    if ids:
        yield ids, docs


COPIES = "block int, copy int, words long, sums binary"


def _copy(trainer: Trainer, number: int) -> pa.RecordBatch:
    flat = np.concatenate([x.reshape(-1) for x in trainer.p.values()]).astype(float) * trainer.words
    parts = np.array_split(flat, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([number] * BLOCKS, pa.int32()), pa.array([trainer.words] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "copy", "words", "sums"])


def _averaged(docs: DataFrame, vocab: Vocabulary, p: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """The mean of the copies that the tasks train, beginning with p."""
    kind = np.uint16 if vocab.size < 65536 else np.int32

    def run(batches):
        from pyspark import TaskContext

        trainer = Trainer(p, vocab, rate)
        for _, some in _gathered(batches, lambda texts: [(d.astype(kind),) for d in vocab.numbers(texts)]):
            trainer.learn([d for (d,) in some])
        if trainer.words:
            yield _copy(trainer, TaskContext.get().partitionId())

    copies = docs.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), COPIES)
    return _mean(written(copies, "copies"), p)


def _mean(copies: DataFrame, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of a table of copies, p if there are none."""

    def add(key, table):
        total = sum(np.frombuffer(raw) for raw in table.sort_by("copy").column("sums").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "copy": pa.array([key[1].as_py()], pa.int32()), "words": pa.array([sum(table.column("words").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    n = (copies.agg(F.max("copy")).first()[0] or 0) + 1
    while n > 1:
        copies = copies.withColumn("copy", F.floor(F.col("copy") / FAN).cast("int")).groupBy("block", "copy").applyInArrow(add, COPIES)
        n = -(-n // FAN)
    rows = sorted(copies.collect(), key=lambda r: r.block)
    if not rows:
        return p
    flat = np.concatenate([np.frombuffer(r.sums) for r in rows]) / rows[0].words
    out, at = {}, 0
    for k, x in p.items():
        out[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def train(docs: DataFrame, vocab: Vocabulary, hidden: int = HIDDEN, rate: float = RATE, rounds: int = 1) -> dict[str, np.ndarray]:
    """Parameters learnt from all documents, each in one of the rounds."""
    p = start(vocab, hidden)
    for k in range(rounds):
        p = _averaged(docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)), vocab, p, rate)
    return p


def scored(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity): a row for each row of docs. Texts aren't shuffled, only words that are rarer than those looked up."""
    kind = np.uint16 if vocab.size < 65536 else np.int32

    def run(batches):
        for ids, some in _gathered(batches, lambda texts: [(d.astype(kind), share, far, t) for (d, share, far), t in zip(vocab.split(texts), texts, strict=True)]):
            n, ll = np.array([len(d) for d, *_ in some], np.int64), likelihoods(p, vocab, [d for d, *_ in some])
            ll += np.array([share for _, share, *_ in some])
            far = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f) for _, _, f, _ in some]), pa.int32()), pa.array(np.concatenate([f for _, _, f, _ in some])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) if len(f) else None for _, _, f, t in some], pa.int64()), pa.array(n), pa.array(ll), far], ["doc_id", "key", "n_words", "ll", "far"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, key long, n_words long, ll double, far array<long>")
    rows = written(rows, "scored")
    # Equal texts have equal words: each is looked up once.
    words = rows.where("key IS NOT NULL").dropDuplicates(["key"]).select("key", F.explode("far").alias("word")).groupBy("key", "word").agg(F.count("*").alias("times"))
    share = F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)) / F.lit(float(vocab.counts[-1]))))
    sums = words.join(counts, "word", "left").groupBy("key").agg(share.alias("share"))
    ll = F.col("ll") + F.coalesce("share", F.lit(0.0))
    return rows.join(sums, "key", "left").select("doc_id", "n_words", ll.alias("log_likelihood"), F.when(F.col("n_words") > 0, F.exp(-ll / F.col("n_words"))).alias("perplexity"))


# --- tables of all words' vectors

#: What a part of the corpus needs and makes. Of a part itself (shard -1): lengths of its documents, words (those without vectors as
#: size - 1 and more, by their place among `c`, their sorted hashes); ranks (-2); rows of vectors (0 and more). Whatever is sent by shards
#: is the rows whose rank or node has the shard as its remainder.
PIECES = "part int, shard int, a binary, b binary, c binary, d binary, doc_id array<long>"


def _pieces(rows: list[tuple]) -> pa.Table:
    """rows: (part, shard, up to four arrays, [list of ids])."""
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(2)]
    columns += [pa.array([r[i].tobytes() if len(r) > i and r[i] is not None else None for r in rows], pa.binary()) for i in range(2, 6)]
    columns.append(pa.array([r[6] if len(r) > 6 else None for r in rows], pa.list_(pa.int64())))
    return pa.Table.from_arrays(columns, names=["part", "shard", "a", "b", "c", "d", "doc_id"])


def _array(raw: bytes, kind, *shape: int) -> np.ndarray:
    out = np.frombuffer(raw, kind)
    return out.reshape(shape) if shape else out


def _parts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The documents in rows of about TOGETHER words."""

    def run(batches):
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        docs, lengths, ids, hashes, n = [], [], [], [], 0

        def row():
            nonlocal docs, lengths, ids, hashes, n, done
            words = np.concatenate([np.zeros(0, np.int32), *ids])
            keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_inverse=True)
            words[words == vocab.size - 1] += at.astype(np.int32)
            one = (None, -1, np.concatenate(lengths), words, keys, np.array([task, done], np.int64), docs)
            docs, lengths, ids, hashes, n, done = [], [], [], [], 0, done + 1
            yield from _pieces([one]).to_batches()

        for batch in batches:
            for some, texts in chunks(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
                words = Words(texts)
                numbers = vocab._ids(words.hash)
                a = 0
                while a < len(some):  # up to the document that fills a part
                    b = min(int(np.searchsorted(words.first, words.first[a] + TOGETHER - n)), len(some))
                    of = slice(words.first[a], words.first[b])
                    docs += some[a:b]
                    lengths.append(np.diff(words.first[a : b + 1]).astype(np.int64))
                    ids.append(numbers[of])
                    hashes.append(words.hash[of][numbers[of] == vocab.size - 1].view(np.int64))
                    n += len(numbers[of])
                    if n >= TOGETHER:
                        yield from row()
                    a = b
        if docs:
            yield from row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), PIECES)


def ranked(counts: DataFrame) -> DataFrame:
    """(word, rank): the order of Vocabulary, of all words. No step orders more than words of one frequency and one 4096th of the hashes."""
    by = counts.withColumn("cell", F.expr("shiftright(word, 52)"))
    cells = by.groupBy("n", "cell").agg(F.count("*").alias("words"))
    # Distinct frequencies are few: a corpus of t words has less than the root of 2t.
    before = cells.groupBy("n").agg(F.sum("words").alias("all")).select("n", (F.sum("all").over(Window.orderBy(F.desc("n"))) - F.col("all")).alias("before"))
    inside = F.sum("words").over(Window.partitionBy("n").orderBy("cell")) - F.col("words")
    begin = cells.select("n", "cell", inside.alias("inside")).join(before, "n").select("n", "cell", (F.col("before") + F.col("inside")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("n", "cell").orderBy("word"))
    return by.select("word", "n", "cell", place.alias("place")).join(begin, ["n", "cell"]).select("word", (F.col("begin") + F.col("place") - 1).alias("rank"))


def _ranks(parts: DataFrame, ranks: DataFrame) -> DataFrame:
    """For each part the ranks of its words without vectors, in the order of their hashes."""

    def asked(batches):
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _array(raw, np.int64)
                for a in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[a : a + (1 << 16)]), part, np.int32)), pa.array(keys[a : a + (1 << 16)])], ["part", "word"])

    def put(key, table):
        order = np.argsort(table.column("word").to_numpy())
        return _pieces([(key[0].as_py(), -2, table.column("rank").to_numpy()[order])])

    words = parts.select("part", "c").mapInArrow(tidy(asked), "part int, word long")
    return words.join(ranks, "word").groupBy("part").applyInArrow(released(put), PIECES)


def _by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard the places of its keys, in order."""
    shard = (keys % shards).astype(np.uint16 if shards < 65536 else np.int32)
    return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))[:-1])


def _kind(tree: Tree) -> type:
    """Of ranks and nodes that travel."""
    return np.int32 if tree.distinct < 1 << 31 else np.int64


class _Part:
    """A part's rows put together."""

    def __init__(self, table: pa.Table, vocab: Vocabulary, tree: Tree, hidden: int, shards: int):
        rows = {s: i for i, s in enumerate(table.column("shard").to_pylist())}

        def bytes_of(shard, column):  # where the table has them, without a copy
            return table.column(column)[rows[shard]].as_buffer()

        self.number, self.doc_ids, lengths, words = table.column("part")[0].as_py(), table.column("doc_id")[rows[-1]].as_py(), _array(bytes_of(-1, "a"), np.int64), _array(bytes_of(-1, "b"), np.int32)
        self.own = Own(tree, _array(bytes_of(-2, "a"), np.int64), hidden) if -2 in rows else None
        if self.own:
            of_rank, of_node = (_by_shard(x, shards) for x in (self.own.ranks, self.own.nodes))
            for s in range(shards):
                if s in rows:
                    self.own.a[of_rank[s]] = _array(bytes_of(s, "a"), np.float16, -1, hidden)
                    self.own.v[of_node[s]] = _array(bytes_of(s, "b"), np.float16, -1, hidden + 1)
        ids = np.minimum(words, vocab.size - 1).astype(np.uint16 if vocab.size < 65536 else np.int32)
        self.docs = np.split(ids, np.cumsum(lengths)[:-1])
        self.words = np.maximum(words - (vocab.size - 1), -1)


def _asked(ranks: DataFrame, tree: Tree, shards: int) -> DataFrame:
    """The ranks and nodes whose vectors parts need, by shard."""

    def run(batches):
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ranks = _array(raw, np.int64)
                nodes = tree.nodes(np.sort(ranks))[0]
                of_rank, of_node = _by_shard(ranks, shards), _by_shard(nodes, shards)
                yield from _pieces([(part, s, ranks[of_rank[s]].astype(_kind(tree)), nodes[of_node[s]].astype(_kind(tree))) for s in range(shards)]).to_batches()

    return ranks.select("part", "a").mapInArrow(tidy(run), PIECES)


def _sent(asked: DataFrame, vectors: DataFrame, hidden: int, tree: Tree) -> DataFrame:
    """The vectors asked for, 0 where nothing has been learnt."""

    kind = _kind(tree)

    def rows(keys, values, wide, wanted):
        wanted = _array(wanted, kind)
        out = np.zeros((len(wanted), wide), np.float16)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        out[hit] = values[at[hit]]
        return out

    def run(key, left, right):
        if not right.num_rows:  # as good as a row of zeros
            return _pieces([])
        ranks, a, nodes, v = (right.column(c)[0].as_buffer() for c in "abcd")
        ranks, nodes = (_array(x, np.int64).astype(kind) for x in (ranks, nodes))
        a, v = _array(a, np.float16, -1, hidden), _array(v, np.float16, -1, hidden + 1)
        return _pieces([(r["part"], r["shard"], rows(ranks, a, hidden, r["a"]), rows(nodes, v, hidden + 1, r["b"])) for r in left.to_pylist()])

    return asked.groupBy("shard").cogroup(vectors.groupBy("shard")).applyInArrow(released(run), PIECES)


def _merged(learnt: DataFrame, before: DataFrame | None, tree: Tree) -> DataFrame:
    """One row for each shard: ranks, their vectors, nodes, theirs. Means of what parts learnt, by uses; what none of them used stays as before."""

    kind = _kind(tree)

    def run(key, table):
        rows = table.to_pylist()
        out = []
        for keys, values in (("a", "b"), ("c", "d")):
            old = [r for r in rows if r["part"] == -1]
            new = [r for r in rows if r["part"] >= 0]
            # of a part: (key, uses) pairs, and the vectors
            pairs = np.concatenate([np.zeros((0, 2), kind), *(_array(r[keys], kind, -1, 2) for r in sorted(new, key=lambda r: r["part"]))])
            if not len(pairs):
                k, v = (_array(old[0][x], t) for x, t in ((keys, np.int64), (values, np.float16))) if old else (np.zeros(0, np.int64), np.zeros(0, np.float16))
                out += [k, v]
                continue
            raw = np.concatenate([_array(r[values], np.float16) for r in sorted(new, key=lambda r: r["part"])]).reshape(len(pairs), -1)
            uses = pairs[:, 1:].astype(np.float32)
            ids, total, _ = summed(pairs[:, 0].astype(np.int64), np.concatenate([raw * uses, uses], 1))
            mean = (total[:, :-1] / total[:, -1:]).astype(np.float16)
            if old:
                k, v = _array(old[0][keys], np.int64), _array(old[0][values], np.float16, -1, mean.shape[1])
                keep = ~np.isin(k, ids)
                ids, mean = np.concatenate([ids, k[keep]]), np.concatenate([mean, v[keep]])
                order = np.argsort(ids)
                ids, mean = ids[order], mean[order]
            out += [ids, mean]
        return _pieces([(-1, key[0].as_py(), *out)])

    return (learnt.unionByName(before) if before is not None else learnt).groupBy("shard").applyInArrow(released(run), PIECES)


def _learnt(pieces: DataFrame, vocab: Vocabulary, tree: Tree, p: dict[str, np.ndarray], rate: float, hidden: int, shards: int) -> DataFrame:
    """What each part of a round learns, beginning with p and the vectors it was sent: blocks of its copy of the dense part, and vectors with their uses by shard."""

    def run(key, table):
        part = _Part(table, vocab, tree, hidden, shards)
        trainer, own = Trainer(p, vocab, rate), part.own
        trainer.learn(part.docs, own=own, words=part.words)
        out = _pieces([])
        if own:
            rows = []
            of = {"a": (own.ranks, _by_shard(own.ranks, shards)), "v": (own.nodes, _by_shard(own.nodes, shards))}
            for s in range(shards):
                both = []
                for kind, (keys, places) in of.items():
                    at = places[s][own.used[kind][places[s]] > 0]
                    both += [np.stack([keys[at], own.used[kind][at]], 1).astype(_kind(tree)), getattr(own, kind)[at].astype(np.float16)]
                rows.append((part.number, s, *both))
            out = _pieces(rows)
        dense = pa.Table.from_batches([_copy(trainer, part.number)] if trainer.words else [], pa.schema([("block", pa.int32()), ("copy", pa.int32()), ("words", pa.int64()), ("sums", pa.binary())]))
        return pa.concat_tables([out, dense], promote_options="default")

    return pieces.groupBy("part").applyInArrow(released(run), f"{PIECES}, {COPIES}")


def _scored(pieces: DataFrame, vocab: Vocabulary, tree: Tree, p: dict[str, np.ndarray], hidden: int, shards: int) -> DataFrame:
    def run(key, table):
        part = _Part(table, vocab, tree, hidden, shards)
        ll = likelihoods(p, vocab, part.docs, own=part.own, words=part.words)
        return pa.table({"doc_id": pa.array(part.doc_ids, pa.int64()), "n_words": pa.array([len(d) for d in part.docs], pa.int64()), "log_likelihood": pa.array(ll)})

    rows = pieces.groupBy("part").applyInArrow(released(run), "doc_id long, n_words long, log_likelihood double")
    return rows.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words"))))


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files of each query inside are removed when it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def score(docs: DataFrame, hidden: int = HIDDEN, rate: float = RATE, rounds: int = ROUNDS, vectors: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity): a row for each row of docs, under a model with vectors for all words."""
    with _cleaning(docs.sparkSession):
        counts = written(word_counts(docs), "words")
        vocab = vocabulary(counts, vectors, 0)
        tree = Tree(sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True), vocab.size - 1)
        parts = written(_parts(docs, vocab), "parts")
        names = sorted(tuple(_array(r.d, np.int64).tolist()) for r in parts.select("d").collect())
        shards, rounds = max(len(names), 1), min(rounds, max(len(names), 1))
        number = parts.sparkSession.createDataFrame([(np.array(x, np.int64).tobytes(), i, i % rounds) for i, x in enumerate(names)], "d binary, number int, round int")
        parts = parts.join(F.broadcast(number), "d").withColumn("part", F.col("number")).drop("number").select(*parts.columns, "round")
        ranks = written(_ranks(parts, ranked(counts)), "ranks")
        drop(counts)
    p, found = start(vocab, hidden), None

    def pieces(part: DataFrame) -> DataFrame:
        own = ranks.join(F.broadcast(part.select("part").distinct()), "part", "left_semi").select(*ranks.columns)
        every = part.drop("round").unionByName(own)
        return every if found is None else every.unionByName(_sent(_asked(own, tree, shards), found, hidden, tree))

    with _cleaning(docs.sparkSession):
        for k in range(rounds):
            learnt = written(_learnt(pieces(parts.where(F.col("round") == k)), vocab, tree, p, rate, hidden, shards), "learnt")
            p = _mean(learnt.where("block IS NOT NULL").select("block", "copy", "words", "sums"), p)
            found = written(_merged(learnt.where("block IS NULL").drop("block", "copy", "words", "sums"), found, tree), "vectors", found)
            drop(learnt)
        # Two rounds at a time, as the vectors that are sent are several times the texts.
        rows = [written(_scored(pieces(parts.where(F.col("round").isin(k, k + 1))), vocab, tree, p, hidden, shards), "scored") for k in range(0, rounds, 2)]
    return reduce(DataFrame.unionByName, rows)
