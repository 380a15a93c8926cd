"""Operator 4, BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary is a certain cut: no merge can ever cross it. Texts are cut at all such
pairs that the splitting rule of the vocabulary can't see across either (see Tokenizer.cuts), each distinct fragment is encoded once,
and the fragments' tokens are put together again. The tokens are those of encoding the whole text at once.

Decoding looks up the bytes of all tokens of many texts at once. A token that is null, negative or of no entry of the vocabulary decodes
to U+FFFD, and so do bytes that are no text, as in a list cut within a character.

Defined results: a null text has null tokens, an empty one none; repeated rows are encoded alike; a text of any length is encoded
whole; strings of special tokens are ordinary text; lone surrogates can't occur in Spark's strings; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import _power_tables, chunks, mix, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before bytes are merged; a piece of it never shares a token with the next.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a token that the vocabulary hasn't decodes to.
UNKNOWN = "\ufffd".encode()
#: A worker forgets what it encoded beyond so many distinct fragments.
REMEMBERED = 400_000

_BLANK = np.array([b in b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" for b in range(256)])
#: Last bytes of the white space outside ASCII.
_BLANK_END = np.array([b in {0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F} for b in range(256)])
_LATER = (np.arange(256) & 0xC0) == 0x80
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Tokenizer:
    """A byte-level BPE vocabulary in a file of ranks."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut_pairs = self._cuts(ranks)
        most = max(ranks.values()) + 1
        tokens = [b""] * most
        for t, r in ranks.items():
            tokens[r] = t
        tokens = [*(t or UNKNOWN for t in tokens), UNKNOWN]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        #: Number of each fragment met; its tokens are flat[begin[k] : begin[k] + n[k]].
        self.memo: dict[bytes, int] = {}
        self.flat, self.begin, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _cuts(ranks: dict[bytes, int]) -> np.ndarray:
        """[x, y] is whether a text may be cut between the bytes x and y: the pair is in no token, and the splitting rule takes the same pieces
        on both sides of it. The rule looks ahead only behind white space, so x is none; it takes an apostrophe with the letters that follow
        unless other signs come before, so y is an apostrophe only after letters and digits; and no character is cut."""
        inside = np.zeros((256, 256), bool)
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            inside[b[:-1], b[1:]] = True
        cut = ~inside
        cut[_BLANK | _BLANK_END, :] = False
        cut[:, _LATER] = False
        cut[~_ALNUM, ord("'")] = False
        return cut.reshape(-1)

    def fragments(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, start of each fragment and their end, number of fragments before each text); no fragment has bytes of two texts."""
        buf = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        pair = buf[:-1].astype(np.uint16) << np.uint16(8) | buf[1:]
        cut = np.flatnonzero(self.cut_pairs[pair]) + 1
        edges = np.union1d(cut, np.concatenate([[0], ends])).astype(np.int64)
        first = np.searchsorted(edges, np.concatenate([[0], ends]))
        return buf, edges, first

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, offsets of each text's)."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        buf, edges, first = self.fragments(parts)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        start, end = edges[:-1], edges[1:]
        up, down = _power_tables(len(buf) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
            key = mix((total[end] - total[start]) * down[start])
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        known = self._numbers(words)[back]
        n = self.n[known]
        tokens = self.flat[_runs(self.begin[known], n)]
        offsets = np.concatenate([[0], np.cumsum(n)])
        return tokens, offsets[first]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each fragment; new ones are encoded."""
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
            self.flat, self.begin, self.n = self.flat[:0], self.begin[:0], self.n[:0]
        encode = self.encoding.encode_ordinary
        new: list[list[int]] = []
        for w in words:
            if w not in memo:
                memo[w] = len(self.n) + len(new)
                new.append(encode(w.decode()))
        if new:
            n = np.array([len(x) for x in new], np.int64)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.flat = np.concatenate([self.flat, np.array([t for x in new for t in x], np.int32)])
        return np.array([memo[w] for w in words], np.int64)

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        tokens = np.where((tokens < 0) | (tokens >= len(self.lengths)), len(self.lengths) - 1, tokens)
        n = self.lengths[tokens]
        raw = self.bytes[_runs(self.starts[tokens], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those from begin[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, md5): a row for each row of docs; md5 is that of the bytes that the tokens decode to. No shuffle."""

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
                tokens, offsets = own.encode(texts)
                parts = own.decode(tokens, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(np.diff(offsets)), pa.array([len(p) for p in parts], pa.int64()), pa.array([hashlib.md5(p).hexdigest() for p in parts])], ["doc_id", "tokens", "n_tokens", "n_bytes", "md5"])

    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, tokens array<int>, n_tokens long, n_bytes long, md5 string"
    out = full.where(F.col("text").isNotNull()).mapInArrow(tidy(run), schema)
    none = full.where(F.col("text").isNull()).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("tokens", "array<int>"), ("n_tokens", "long"), ("n_bytes", "long"), ("md5", "string"))])
    return out.unionByName(none)


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens give a null text, unknown ones U+FFFD."""

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            lists = batch.column(1)
            filled = [x or [] for x in lists.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in filled])]).astype(np.int64)
            parts = own.decode(np.array([-1 if t is None else t for x in filled for t in x], np.int64), offsets)
            texts = [p.decode("utf-8", "replace") if v else None for p, v in zip(parts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<long>").alias("tokens")).mapInArrow(tidy(run), "doc_id long, text string")
