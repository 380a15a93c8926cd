"""Vectors of the words that the language model's dense part has none for: all words of the corpus beyond the most frequent ones.

By frequency (ties by hash) these words stand in one order; a binary tree over it, cut at each node where the occurrences are nearest to half,
tells them apart: a node, which is named by the rank where it is cut, goes left with the probability s(b + (h, 1)V), b the logarithm of the
exact counts' ratio. A word also has an offset A to the common input of its class, in the candidate's half. A and V are 0 until
something is learnt, so that the probabilities in the class are then those of the exact counts; what isn't in a table is 0 and needn't be
sent. A task holds rows of the words and nodes that its own texts use, whatever the size of the vocabulary; all sums are over all words.
"""

from __future__ import annotations

import numpy as np


class Tree:
    """by: (frequency, number of words), the most frequent first; vectors: so many words, the first ones, are not in it."""

    def __init__(self, by: list[tuple[int, int]], vectors: int):
        self.n = np.array([n for n, _ in by], np.int64)
        words = np.array([w for _, w in by], np.int64)
        self.start = np.cumsum(words) - words
        self.before = np.cumsum(words * self.n) - words * self.n
        self.vectors, self.distinct = vectors, int(words.sum())

    def mass(self, rank: np.ndarray) -> np.ndarray:
        """Occurrences of the words before a rank."""
        j = np.searchsorted(self.start, rank, "right") - 1
        return self.before[j] + self.n[j] * (rank - self.start[j])

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where nodes from lo to hi are cut, and the logarithms of the counts' ratios, left to right."""
        low, high = self.mass(lo), self.mass(hi)
        half = low + (high - low) // 2
        j = np.searchsorted(self.before, half, "right") - 1
        at = np.clip(self.start[j] + (half - self.before[j] + self.n[j] // 2) // self.n[j], lo + 1, hi - 1)
        mid = self.mass(at)
        return at, np.log((mid - low) / (high - mid)).astype(np.float32)

    def nodes(self, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(node, base, cut, left, right) of all nodes on the paths of some words, whose ranks are given in order: those before place cut go
        left. The nodes are in order too; left and right are places among them, their number where a path ends."""
        lo, hi, a, b = (np.array([x], np.int64) for x in (self.vectors, self.distinct, 0, len(ranks)))
        if not len(ranks) or self.distinct - self.vectors < 2:
            return tuple(np.zeros(0, t) for t in (np.int64, np.float32, np.int32, np.int32, np.int32))
        found, n = [], 0
        while len(lo):
            at, base = self.cut(lo, hi)
            m = np.searchsorted(ranks, at)
            left, right = (m > a) & (at - lo > 1), (b > m) & (hi - at > 1)
            n += len(lo)
            children = np.full((2, len(lo)), -1, np.int64)
            children[0, left] = n + np.arange(left.sum())
            children[1, right] = n + left.sum() + np.arange(right.sum())
            found.append((at, base, m, *children))
            lo, hi, a, b = (np.concatenate([x[left], y[right]]) for x, y in ((lo, at), (at, hi), (a, m), (m, b)))
        node, base, cut, *children = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node)
        place = np.full(len(node) + 1, len(node), np.int32)
        place[order] = np.arange(len(node), dtype=np.int32)
        return node[order], base[order], cut[order].astype(np.int32), *(place[x[order]] for x in children)


#: The rate of a row's first step, as a multiple of the dense part's; nodes at most whose products are made for all words at once; the logit of what is certain.
FIRST, TOP, END = 16, 127, 80.0


class Own:
    """The rows of some words, by rank, and of all nodes on their paths. What it learns is steps of Adagrad with one sum of squares a row, taken by a row only where it is used."""

    def __init__(self, tree: Tree, ranks: np.ndarray, hidden: int):
        self.ranks = ranks
        order = np.argsort(ranks)
        self.place = np.empty(len(ranks), np.int32)
        self.place[order] = np.arange(len(ranks), dtype=np.int32)
        self.nodes, *rest = tree.nodes(ranks[order])
        self.root = int(np.searchsorted(self.nodes, tree.cut(np.array([tree.vectors]), np.array([tree.distinct]))[0][0])) if len(self.nodes) else 0
        # One node more, where paths that have ended stay with probability 1.
        ends = (END, np.iinfo(np.int32).max, len(self.nodes), len(self.nodes))
        self.base, self.cut, self.left, self.right = (np.append(x, np.array(y, x.dtype)) for x, y in zip(rest, ends, strict=True))
        # The nodes of the first levels, which most words pass, and for all nodes the column there.
        level, top = np.array([self.root] if len(self.nodes) else [], np.int32), np.zeros(0, np.int32)
        self.levels = 0
        while len(level) and len(top) + len(level) <= TOP:
            top, level = np.concatenate([top, level]), np.unique(np.concatenate([self.left[level], self.right[level]]))
            level, self.levels = level[level < len(self.nodes)], self.levels + 1
        self.top = top
        self.column = np.full(len(self.nodes) + 1, len(top), np.int16)
        self.column[top] = np.arange(len(top), dtype=np.int16)
        self.a, self.v = np.zeros((len(ranks), hidden), np.float32), np.zeros((len(self.nodes), hidden + 1), np.float32)
        self.squares: dict[str, np.ndarray] = {}
        self.used = {"a": np.zeros(len(ranks), np.int32), "v": np.zeros(len(self.nodes), np.int32)}

    def output(self, states: np.ndarray, words: np.ndarray, live: np.ndarray | None = None):
        """(log-likelihood of each word in its class, gradient with respect to states, nodes, their gradients); the last three with live, the words' weights."""
        n, k = states.shape
        out, turned = np.zeros(n, np.float32), np.zeros((n, k), np.float32) if live is not None else None
        nodes, grads = [np.zeros(0, np.int32)], [np.zeros((0, k + 1), np.float32)]
        # In the words' order those that pass a node stand together, at each level. Nodes of two levels are never the same.
        word = np.argsort(self.place[words], kind="stable")
        place, h, end = self.place[words][word], np.concatenate([states, np.ones((n, 1), states.dtype)], 1)[word], len(self.nodes)
        node, ll = np.full(n, self.root if end else end, np.int32), np.zeros(n, np.float32)
        if live is not None:
            weight, back = -live[word], np.zeros((n, k + 1), np.float32)
        if len(self.top):
            v = self.v.take(self.top, 0)
            z = np.zeros((n, len(self.top) + 1), np.float32)
            np.matmul(h, v.T, out=z[:, :-1])
            g, many, row = np.zeros_like(z) if live is not None else None, 0, np.arange(n) * z.shape[1]
            for _ in range(self.levels):
                column = self.column.take(node)
                left, side = self._level(z.take(row + column), node, place, ll, weight if live is not None else None)
                if live is not None:
                    g.reshape(-1)[row + column] = side
                    many = many + np.bincount(column, minlength=z.shape[1])
                node = np.where(left, self.left.take(node), self.right.take(node))
            if live is not None:
                g, passed = g[:, :-1], np.flatnonzero(many[:-1])
                back += g @ v
                self.used["v"][self.top[passed]] += many[passed].astype(np.int32)
                nodes.append(self.top[passed])
                grads.append((g.T @ h)[passed])
        while True:
            gone = node == end
            if (ended := np.count_nonzero(gone)) > len(node) // 8 or ended == len(node):
                out[word[gone]] = ll[gone]
                stay = np.flatnonzero(~gone)
                if live is not None:
                    turned[word[gone]] = back[gone, :-1]
                    weight, back = weight.take(stay), back.take(stay, 0)
                word, place, h, node, ll = word.take(stay), place.take(stay), h.take(stay, 0), node.take(stay), ll.take(stay)
            if not len(node):
                break
            v = self.v.take(node, 0, mode="clip")  # clip: the last node has no row, and any will do
            left, g = self._level(np.einsum("ij,ij->i", h, v), node, place, ll, weight if live is not None else None)
            if live is not None:
                v *= g[:, None]
                back += v
                np.multiply(h, g[:, None], out=v)
                at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                many = np.diff(np.append(at, len(node)))
                some, sums = node[at], _runs(v, at, many)
                if (some == end).any():
                    at = np.flatnonzero(some != end)
                    some, many, sums = some[at], many[at], sums[at]
                self.used["v"][some] += many.astype(np.int32)
                nodes.append(some)
                grads.append(sums)
            node = np.where(left, self.left.take(node), self.right.take(node))
        return (out, turned, np.concatenate(nodes), np.concatenate(grads)) if live is not None else (out, None, None, None)

    def _level(self, z: np.ndarray, node: np.ndarray, place: np.ndarray, ll: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """(which words go left, gradients of the logits) at their nodes; adds to ll."""
        left = place < self.cut.take(node)
        z += self.base.take(node)
        np.negative(z, out=z, where=~left)
        small = np.exp(-np.abs(z))
        ll += np.minimum(z, 0)
        ll -= np.log1p(small)
        if weight is None:
            return left, None
        g = np.where(z > 0, small, 1)
        g /= 1 + small
        g *= weight
        np.negative(g, out=g, where=~left)
        g[node == len(self.nodes)] = 0
        return left, g

    def step(self, kind: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        p = getattr(self, kind)
        if kind not in self.squares:
            self.squares[kind] = np.zeros(len(p), np.float32)
        total = np.einsum("ij,ij->i", g, g)
        total /= max(g.shape[1], 1)
        total += self.squares[kind][rows]
        self.squares[kind][rows] = total
        g *= (np.float32(-FIRST * rate) / np.sqrt(np.maximum(total, np.float32(1e-30))))[:, None]
        g += p.take(rows, 0)
        p[rows] = g


def _runs(values: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of many[i] rows of values from at[i] on, for all rows. Most runs are of a few rows where there are many: one row after another is then faster."""
    if 4 * len(at) < len(values):
        return np.add.reduceat(values, at)
    out, run, j = values.take(at, 0), np.flatnonzero(many > 1), 1
    at, many = at[run], many[run]
    while len(run) > 64 and j < 9:
        out[run] += values.take(at + j, 0)
        j += 1
        more = np.flatnonzero(many > j)
        run, at, many = run[more], at[more], many[more]
    if len(run):
        ends = np.stack([at + j, at + many], 1).ravel()
        out[run] += np.add.reduceat(values, ends[:-1] if ends[-1] == len(values) else ends)[::2]
    return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the sums of the rows of values with the same key, and their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    many = np.diff(np.append(at, len(keys)))
    return keys[at], _runs(values.take(order, 0), at, many) if len(keys) else values[:0], many.astype(np.int32)
