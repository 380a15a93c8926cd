"""Operator 1, near duplicates of texts: MinHash signatures, banding, verification by signature, connected components.

Every text is a set of 64-bit hashes of SHINGLE consecutive words (letters and digits, lower case; a shorter text is one shingle).
HASHES functions (a*x+b) >> 32 give a signature; texts that agree in a whole band are candidates; candidates whose signatures agree
in at least the share THRESHOLD are linked; each component keeps its smallest doc_id.

Equal signatures are one from the start. A bucket of a band is never gathered as a whole: bands that hold the same documents are told by a
fingerprint of their ids, and a bucket of more than MOST documents is verified in parts. Then only its documents outside the bucket's
greatest component can still have a link that is missing, and they are compared with the whole bucket, block by block, so no link is lost.

Defined results: rows with a null doc_id or text, and texts without a word, belong to no group. Rows that share a doc_id are one
document, the one with the smallest signature; deduplicated() keeps just that row of them (of rows with equal signatures the first as
JSON; rows without a word come last), and all rows without an id. A tie for the document to keep can't occur, as ids differ. Texts of any
length are taken whole. An empty table gives an empty result. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import Words, chunks, drop, free, mix, quoted, texts_of, tidy, written

HASHES, BANDS, SHINGLE, THRESHOLD = 128, 32, 3, 0.55
#: Signatures that are compared with one another in one task at a time.
MOST = 4096

_rng = np.random.default_rng(20240607)
A = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)


def signatures(texts: list[str], hashes: int = HASHES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have words, a row of minima for each)."""
    words = Words(texts)
    count = np.diff(words.first)
    own = np.flatnonzero(count)
    if not len(own):
        return own, np.zeros((0, hashes), np.uint32)
    n = len(words.hash)
    padded = np.concatenate([words.hash, np.zeros(shingle, np.uint64)])
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for j in range(shingle):
            s = s * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + n]
        whole = np.repeat(count[own] < shingle, count[own])
        keep = (np.repeat(words.first[own + 1], count[own]) - np.arange(n)) >= shingle
        for i in own[count[own] < shingle]:  # fewer words than a shingle has: all of them are one
            h = np.uint64(count[i])
            for w in words.hash[words.first[i] : words.first[i + 1]]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + w
            s[words.first[i]] = h
        keep |= whole & np.isin(np.arange(n), words.first[own])
        s = mix(s[keep])
        at = np.concatenate([[0], np.cumsum(np.maximum(1, count[own] - shingle + 1))[:-1]])
        out = np.empty((len(own), hashes), np.uint32)
        for k in range(hashes):
            v = s * A[k]
            v += B[k]
            v >>= np.uint64(32)
            out[:, k] = np.minimum.reduceat(v, at)
    return own, out


def sketch(docs: DataFrame, hashes: int = HASHES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig): sig has 4 bytes for each hash function."""

    def run(batches):
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, sig = signatures(texts, hashes, shingle)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], pa.int64()), pa.array([row.tobytes() for row in sig], pa.binary())], ["doc_id", "sig"])

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, sig binary")


def linked(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links rows agreeing in at least `least` places: a breadth-first search that compares each row only with rows not yet reached."""
    rest, edges = np.arange(len(sig)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            close = (sig[rest] == sig[u]).sum(1) >= least
            edges += [(int(u), int(v)) for v in rest[close]]
            queue += list(rest[close])
            rest = rest[~close]
    return edges


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def verified(members: DataFrame, least: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each part of a bucket; members (key, part, doc_id, sig)."""

    def run(batches):
        bucket, ids, sigs = None, [], []

        def flush():
            return [(ids[i], ids[j]) for i, j in linked(np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1), least)] if len(ids) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, part, d, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, part) != bucket:
                    found += flush()
                    bucket, ids, sigs = (k, part), [], []
                ids.append(d)
                sigs.append(s)
            yield out(found)
        yield out(flush())

    return members.select("key", "part", "doc_id", "sig").repartition("key", "part").sortWithinPartitions("key", "part", "doc_id").mapInArrow(tidy(run), "a long, b long")


def across(large: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(a, b): links between components of edges that hold documents of a large bucket (key, part, parts, doc_id, sig). The documents outside the component that has most of the bucket are compared with all of it, in blocks of about so many."""
    roots = components(edges)
    large = large.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "part", "parts", "doc_id", "sig", F.coalesce("root", "doc_id").alias("root"))
    counts = large.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    large = written(large.join(counts.where("rest > 0").withColumn("blocks", F.ceil(F.col("rest") / most).cast("int")), "key"), "large")
    asked = large.where("root <> main").select("key", F.pmod(F.xxhash64("doc_id", F.lit(2)), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", "sig", "root")
    whole = large.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "doc_id", "sig", "root")

    def compare(q, b):
        found: list[tuple[int, int]] = []
        if q.num_rows and b.num_rows:
            ids, other, root, sig = q.column("doc_id").to_pylist(), np.array(b.column("doc_id")), np.array(b.column("root")), _matrix(b.column("sig"))
            for i, own, s in zip(ids, q.column("root").to_pylist(), _matrix(q.column("sig")), strict=True):
                close = np.flatnonzero(((sig == s).sum(1) >= least) & (root != own))
                found += [(i, int(other[close[k]])) for k in np.unique(root[close], return_index=True)[1]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    keys = ["key", "block", "part"]
    return asked.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the least node of its component, by alternating large-star and small-star until nothing changes. Self-loops, repeated and null edges are harmless. Least neighbours are found by an aggregation and joined, so that a node with very many edges is no task's alone."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = written(small, "edges", edges)
        drop(large)
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES, bands: int = BANDS, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, keep_id): every document that repeats another, with the document of its group that stays."""
    rows, least = hashes // bands, int(np.ceil(threshold * hashes))
    sigs = sketch(docs, hashes, shingle).groupBy("doc_id").agg(F.min("sig").alias("sig"))
    sigs = written(sigs.withColumn("h", F.unhex(F.md5("sig"))), "sketch")
    # Equal signatures are linked without a comparison, and only one document of each goes on.
    same = sigs.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    equal = sigs.select("h", "doc_id").join(same.where("n > 1").select("h", "rep"), "h").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = written(sigs.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sig"), "reps")
    keys = reps.select("doc_id", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * rows * k, 4 * rows)) for k in range(bands)])).alias("key"))
    # Bands often give the same bucket again; one of those with equal numbers and hashes of ids is enough.
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    buckets = written(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "buckets")
    members = keys.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).join(reps, "doc_id")
    near = written(verified(members, least).union(equal), "links")
    if buckets.where("parts > 1").count():
        near = near.union(across(written(members.where("parts > 1"), "members"), near, least, most))
    return components(near).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """docs without the documents that repeat another; of each group the one with the smallest doc_id stays, as one row. No shuffle of texts but those whose doc_id repeats."""
    gone, again, sig = free(docs, "__gone", "__again", "__sig")
    columns = [quoted(c) for c in docs.columns]
    out = docs.join(near_duplicates(docs, **settings).select(F.col("doc_id").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")
    repeated = written(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(again)).count().where("count > 1").select(again), "repeated")
    one = out.join(repeated, F.col("doc_id") == F.col(again), "left_anti")
    hashes, shingle = settings.get("hashes", HASHES), settings.get("shingle", SHINGLE)

    @F.pandas_udf("binary")
    def signature(texts: pd.Series) -> pd.Series:
        own, found = signatures([t or "" for t in texts], hashes, shingle)
        by = dict(zip(own.tolist(), found, strict=True))
        return pd.Series([by[i].tobytes() if i in by else None for i in range(len(texts))], dtype=object)

    many = out.join(repeated, F.col("doc_id") == F.col(again), "left_semi").withColumn(sig, signature("text"))
    first = F.struct(F.col(sig).isNull(), F.col(sig), F.to_json(F.struct(*columns)))
    many = many.groupBy("doc_id").agg(F.min_by(F.struct(*columns), first).alias(sig)).select(f"{sig}.*")
    return one.union(many)
