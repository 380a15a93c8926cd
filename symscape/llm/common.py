"""Shared pieces: tables kept in the cluster's shared folder, byte-vectorised word hashing, column clean-up."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symscape.storage import drop, written  # noqa: F401 (operators take them from here)

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of a batch that goes to a Python worker: texts can be long, and the batch lies in the JVM's memory too.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Where a session still has Spark's own size of batches, it gets a smaller one."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each longer by underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more...) without rows whose id or text is null; other columns, whatever their names, are dropped."""
    return docs.select("doc_id", "text", *more).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


#: Rows of a batch that a task turns into Python's objects at once.
SLICE = 1000


def tidy(run):
    """run for mapInArrow, with batches of SLICE rows at most; when a task has ended its memory goes back to the machine, as workers live on for other stages."""

    def small(batches):
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), SLICE):
                yield batch.slice(a, SLICE)

    def whole(batches):
        try:
            yield from run(small(batches))
        finally:
            _give_back()

    return whole


def _give_back() -> None:
    _power_tables(0)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def released(run):
    """run for applyInArrow on groups or pairs of groups, with memory given back after each group."""

    def of_group(key, table):
        try:
            return run(key, table)
        finally:
            _give_back()

    def of_pair(key, left, right):
        try:
            return run(key, left, right)
        finally:
            _give_back()

    return of_pair if run.__code__.co_argcount == 3 else of_group


# --- words of many texts at once, as 64-bit polynomial hashes

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Letters and digits; bytes of 128 and more belong to letters outside ASCII.
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Everything but white space.
TOKEN = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n; with n = 0 those that are kept are dropped."""
    if not n:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, _R_INV)):
            steps = np.full(max(n, 1 << 20), r, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of several texts: buf the bytes, start and end of each word there, hash, first[i] the number of words before text i."""

    def __init__(self, texts: list[str], kind: np.ndarray = WORD, hashed: bool = True):
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join([*parts, b""]) if parts else b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        inside = kind[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.append(edge, len(buf))
        self.buf, self.start, self.end = buf, edge[::2], edge[1::2]
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(self.start, bounds)
        if hashed:
            up, down = _power_tables(len(buf) + 1)
            with np.errstate(over="ignore"):
                total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)
                before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
                self.hash = mix((total[self.end - 1] - before) * down[self.start])

    def word(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].decode("utf-8", "replace")


def chunks(ids: list, texts: list[str], most: int = 1 << 20):
    """Consecutive (ids, texts) of about so many characters; a text is never cut."""
    a, n = 0, 0
    for b, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield ids[a : b + 1], texts[a : b + 1]
            a, n = b + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]
