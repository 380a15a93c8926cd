"""Operator 10, near duplicates of embeddings by a robust-pruned flat graph.

Vectors are divided among cluster shards, each to the OVERLAP nearest centres, so that shards overlap; the nearest is its home. A shard of
more than LARGE vectors is divided again by centres of its own, chunk by chunk. In every shard a graph is built: a vector's nearest others
and some far ones are pruned so that no edge is kept to a vector that an earlier edge leads ALPHA times nearer to. The adjacency lists of
all shards are united and edges made to run both ways. Then every vector is a query: greedy search with a beam from the medoids of its home
over the united graph, and once vectors within the THRESHOLD of cosine similarity are met, the range expands over their neighbours until
it holds no new one. Where the united lists lead out of a query's home, the range expands there too, by joins, until nothing new is met.
All links found are verified with double precision. An audit compares queries with a scan of all vectors: AUDITED at random and as many
of those that have links. Below RECALL the search is done again with more overlap and a wider beam, TRIES times at most; the best result
counts, and a warning says so if it is still below.

Centres are fitted on a bounded sample, the CENTRES vectors of least hash at most, without those within twice the search radius of
another: groups of near copies, however large, have one centre at most and stay together. Every vector is indexed and searched.

The result has a row for each vector, not for each pair: its class, which is the least id among all that links lead to from it, and
the number of its links. Equal vectors are searched once, and count as links each.

Defined results: rows with a null id, a null, empty, zero or non-finite vector, or one of another length than most rows have (a tie goes
to the longer) are left out; rows that share an id are one, with the least vector; a vector without links is a class of its own; an empty
table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import tidy, written
from symscape.llm.minhash import components

THRESHOLD, SHARD, OVERLAP = 0.95, 2000, 2
#: The most centres that are collected and sent to all tasks, and those that divide one large shard.
CENTRES, BRANCHES = 4096, 64
#: A shard is divided when it is so many times SHARD, again and again, LEVELS times at most.
LARGE, LEVELS = 3, 8
NEAREST, NEAR_EDGES, FAR_EDGES, ALPHA = 32, 16, 6, 1.2
BEAM, MEDOIDS = 8, 16
AUDITED, RECALL, TRIES = 512, 0.95, 4
#: A search or a comparison holds so many similarities at once.
CELLS = 2_000_000


# --- in one shard ------------------------------------------------------------------------------


def pruned(v: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> list[np.ndarray]:
    """For each row of own its robust-pruned candidates: nearest first, without those that a kept one is alpha times nearer to."""
    out: list[np.ndarray] = []
    size = candidates.shape[1]
    for a in range(0, len(own), max(1, CELLS // (size * (size + v.shape[1])))):
        c = candidates[a : a + max(1, CELLS // (size * (size + v.shape[1])))]
        x = v[c]
        to = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bkd,bd->bk", x, v[own[a : a + len(c)]])))
        order = np.argsort(to, axis=1, kind="stable")
        c, to = np.take_along_axis(c, order, 1), np.take_along_axis(to, order, 1)
        x = np.take_along_axis(x, order[:, :, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * x @ x.transpose(0, 2, 1)))
        alive, kept = np.ones(c.shape, bool), np.zeros(c.shape, bool)
        count = np.zeros(len(c), int)
        for k in range(size):
            take = alive[:, k] & (count < degree)
            kept[:, k] = take
            count += take
            alive &= ~(take[:, None] & (alpha * between[:, k] <= to))
        out += [row[m] for row, m in zip(c, kept, strict=True)]
    return out


def graph(v: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard."""
    n = len(v)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    k = min(NEAREST, n - 1)
    near = np.empty((n, k), np.int64)
    for a in range(0, n, max(1, CELLS // n)):
        s = v[a : a + max(1, CELLS // n)] @ v.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -9
        near[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    own = np.arange(n)
    lists = pruned(v, own, near, NEAR_EDGES)
    rng = np.random.default_rng(n)
    far = (own[:, None] + rng.integers(1, n, (n, NEAREST))) % n
    return [np.union1d(a, b) for a, b in zip(lists, pruned(v, own, far, FAR_EDGES), strict=True)]


def medoids(v: np.ndarray, most: int = MEDOIDS) -> np.ndarray:
    """The vector nearest to the mean, then those of parts around vectors that are far from all before."""
    first = int((v @ v.mean(0)).argmax())
    pivots, best = [first], v @ v[first]
    while len(pivots) < min(most, len(v)):
        pivots.append(int(best.argmin()))
        best = np.maximum(best, v @ v[pivots[-1]])
    part = (v @ v[pivots].T).argmax(1)
    out = {first}
    for p in np.unique(part):
        members = np.flatnonzero(part == p)
        out.add(int(members[(v[members] @ v[members].mean(0)).argmax()]))
    return np.array(sorted(out))


def search(v: np.ndarray, lists: list[np.ndarray], threshold: float, beam: int = BEAM, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): b was met from the query a within the threshold; the queries are the vectors asked, or all."""
    n, asked = len(v), np.arange(len(v)) if asked is None else asked
    begin = np.cumsum([0] + [len(x) for x in lists])
    flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    starts = medoids(v)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = max(1, CELLS // n)
    for a in range(0, len(asked), size):
        q = v[asked[a : a + size]]
        seen = np.full((len(q), n), -9, np.float32)
        opened = np.zeros((len(q), n), bool)
        seen[:, starts] = q @ v[starts].T
        greedy = np.ones(len(q), bool)
        while True:
            # Open what is within the range, and for queries still on their way the best four of the beam.
            row, node = np.nonzero((seen >= threshold) & ~opened)
            way = np.flatnonzero(greedy)
            if len(way):
                some = min(beam, n)
                top = np.argpartition(-seen[way], some - 1, axis=1)[:, :some]
                value = np.where(opened[way[:, None], top], -9, seen[way[:, None], top])
                pick = np.argsort(-value, axis=1, kind="stable")[:, :4]
                good = np.take_along_axis(value, pick, 1) > -9
                greedy[way] = good.any(1)
                row = np.concatenate([row, np.repeat(way, pick.shape[1])[good.ravel()]])
                node = np.concatenate([node, np.take_along_axis(top, pick, 1).ravel()[good.ravel()]])
            if not len(row):
                break
            opened[row, node] = True
            many = begin[node + 1] - begin[node]
            ends = np.cumsum(many)
            next_row = np.repeat(row, many)
            next_node = flat[np.arange(ends[-1]) + np.repeat(begin[node] - (ends - many), many)]
            cell = np.unique((next_row * n + next_node)[seen[next_row, next_node] == -9])
            for part in np.array_split(cell, len(cell) * v.shape[1] // (8 * CELLS) + 1):
                r, c = part // n, part % n
                seen[r, c] = np.einsum("ij,ij->i", q[r], v[c])
        row, node = np.nonzero(seen >= threshold)
        found.append((asked[row + a], node))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[y for _, y in found]])


# --- tables ------------------------------------------------------------------------------------


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): v has the float32 values of the vector of length 1."""
    full = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND size(e) > 0")
    full = full.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0))
    length = full.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    full = full.where(F.size("e") == (length.n if length else 0)).groupBy("vec_id").agg(F.min("e").alias("e"))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            v = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "v"])

    return full.mapInArrow(tidy(run), "vec_id long, v binary")


def _array(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def centres(vectors: DataFrame, n: int, overlap: int, threshold: float, shard: int = SHARD) -> np.ndarray:
    """Vectors at random (the least hashes), CENTRES at most, none within twice the search radius of one before."""
    k = min(CENTRES, max(1, -(-n * overlap // shard)))
    rows = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(k).collect()
    return apart(np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float32).reshape(len(rows), -1), threshold)


def apart(v: np.ndarray, threshold: float) -> np.ndarray:
    """The vectors that aren't within twice the search radius of one kept before."""
    most = 1 - 2 * (2 - 2 * threshold)
    keep = np.zeros(len(v), bool)
    for a in range(0, len(v), 512):
        block = v[a : a + 512]
        free = ~((block @ v[:a][keep[:a]].T) > most).any(1) if keep[:a].any() else np.ones(len(block), bool)
        s = block @ block.T > most
        for i in range(len(block)):
            keep[a + i] = free[i] and not (s[i, :i] & keep[a : a + i]).any()
    return v[keep]


def assigned(vectors: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """(shard, home, vec_id, v): each vector with the nearest of the centres. They are looked up by way of groups of centres: all in the groups of the nearest 2 * overlap group leaders."""
    leaders = c[: int(np.ceil(np.sqrt(len(c))))]
    group = (c @ leaders.T).argmax(1)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(leaders) + 1))

    def run(batches):
        for batch in batches:
            v = _array(batch.column(1)) if batch.num_rows else np.zeros((0, c.shape[1]), np.float32)
            score = np.full((len(v), overlap), -9, np.float32)
            best = np.full((len(v), overlap), -1, np.int64)
            some = min(2 * overlap, len(leaders))
            s = v @ leaders.T
            top = np.argpartition(-s, some - 1, axis=1)[:, :some] if len(v) else np.zeros((0, some), int)
            for g in range(len(leaders)):
                rows = np.flatnonzero((top == g).any(1))
                own = order[edges[g] : edges[g + 1]]
                for part in np.array_split(rows, len(rows) * len(own) // CELLS + 1):
                    if len(part) and len(own):
                        values = np.concatenate([score[part], v[part] @ c[own].T], axis=1)
                        which = np.concatenate([best[part], np.broadcast_to(own, (len(part), len(own)))], axis=1)
                        pick = np.argsort(-values, axis=1, kind="stable")[:, :overlap]
                        score[part], best[part] = np.take_along_axis(values, pick, 1), np.take_along_axis(which, pick, 1)
            row, k = np.nonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(best[row, k]), pa.array(k == 0), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["shard", "home", "vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(tidy(run), "shard long, home boolean, vec_id long, v binary")


def _nearer(level: int, threshold: float):
    """Divides one chunk of a large shard."""

    def nearer(key, rows, centre):
        c = apart(_array(centre.column("v").combine_chunks().flatten()), threshold) if centre.num_rows else np.zeros((0, 0))
        if len(c) < 2:  # nothing divides it but its chunks
            c, best = c, np.full((rows.num_rows, 1), key[1].as_py())
        else:
            best = np.argsort(-(_array(rows.column("v")) @ c.T), axis=1, kind="stable")[:, :2]
        with np.errstate(over="ignore"):
            new = (np.int64(key[0].as_py()) * np.int64(1_000_003) + best.astype(np.int64) + 1) * np.int64(7919) + np.int64(level)
        at = np.repeat(np.arange(rows.num_rows), best.shape[1])
        home = np.array(rows.column("home").combine_chunks().to_numpy(zero_copy_only=False), bool)[at] & (np.tile(np.arange(best.shape[1]), rows.num_rows) == 0)
        part = rows.take(pa.array(at))
        return pa.table({"shard": new.reshape(-1), "home": home, "vec_id": part.column("vec_id"), "v": part.column("v")})

    return nearer


def divided(shards: DataFrame, threshold: float, shard: int = SHARD, large: int = LARGE, branches: int = BRANCHES) -> DataFrame:
    """shards (a written table), those of more than large * shard vectors divided by centres of their own, of which each vector goes to the nearest two; a vector at home in it is at home in the nearest."""
    for level in range(LEVELS):
        big = shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > large * shard)
        big = written(big.withColumns({"chunks": F.ceil(F.col("n") / shard).cast("int"), "k": F.least(F.lit(branches), F.ceil(2 * F.col("n") / shard)).cast("int")}), "big")
        if not big.count():
            return shards
        h = F.xxhash64("vec_id", F.lit(level))
        own = shards.join(F.broadcast(big) if big.count() <= CENTRES else big, "shard").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
        # About twice as many as are wanted, so that hardly ever one is missing; then the first by hash.
        some = own.where(F.pmod(h, "n") < 2 * F.col("k")).groupBy("shard").agg(F.slice(F.sort_array(F.collect_list(F.struct(h.alias("h"), "v"))), 1, branches).alias("c"), F.first("chunks").alias("chunks"))
        some = written(some, "centres").select("shard", "c.v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        parts = own.select("shard", "chunk", "home", "vec_id", "v").groupBy("shard", "chunk").cogroup(some.groupBy("shard", "chunk")).applyInArrow(_nearer(level, threshold), "shard long, home boolean, vec_id long, v binary")
        parts = parts.groupBy("shard", "vec_id").agg(F.max("home").alias("home"), F.first("v").alias("v")).select("shard", "home", "vec_id", "v")
        shards = written(shards.join(big.select("shard"), "shard", "left_anti").union(parts), "shards", shards)
    return shards


def adjacency(shards: DataFrame) -> DataFrame:
    """(vec_id, near): the united lists of all shards, both ways. A list is no longer than the shards of its vector are together."""

    def run(table):
        ids, raw = table.column("vec_id").to_pylist(), table.column("v").to_pylist()
        order = np.argsort(ids, kind="stable")
        keys = np.array(ids, np.int64)[order]
        lists = graph(np.frombuffer(b"".join(raw), np.float32).reshape(len(ids), -1)[order])
        a, b = np.repeat(keys, [len(x) for x in lists]), keys[np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)]
        return pa.table({"vec_id": np.concatenate([a, b]), "other": np.concatenate([b, a])})

    edges = shards.select("shard", "vec_id", "v").groupBy("shard").applyInArrow(run, "vec_id long, other long")
    return edges.groupBy("vec_id").agg(F.collect_set("other").alias("near"))


def _exact(v: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of v[a] and w[b] in double precision."""
    parts = zip(np.array_split(a, len(a) // 100_000 + 1), np.array_split(b, len(b) // 100_000 + 1), strict=True)
    return np.concatenate([np.einsum("ij,ij->i", v[x].astype(float), w[y].astype(float)) for x, y in parts])


def found_links(shards: DataFrame, near: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(a, b), both ways, of distinct vectors that searches in the queries' homes met."""

    def run(table):
        table = table.sort_by("vec_id").combine_chunks()
        keys = np.array(table.column("vec_id"))
        v = _array(table.column("v"))
        near_by = table.column("near").combine_chunks()
        flat, offsets = np.array(near_by.flatten(), np.int64), np.cumsum([0] + [len(x) if x is not None else 0 for x in near_by.to_pylist()])
        at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
        here = keys[at] == flat
        lists = [at[a:b][here[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)]
        asked = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
        a, b = search(v, lists, threshold - 1e-5, beam, asked)
        a, b = a[a != b], b[a != b]
        ok = _exact(v, v, a, b) >= threshold
        a, b = keys[a[ok]], keys[b[ok]]
        return pa.table({"a": np.concatenate([a, b]), "b": np.concatenate([b, a])})

    full = shards.join(near, "vec_id", "left").select("shard", "home", "vec_id", "v", "near")
    return full.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def beyond(shards: DataFrame, near: DataFrame, links: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The links (a written table) with all that the united lists lead to outside of the homes: what is near b, for each b that a is linked with, and not in a's home is compared with a, until nothing new is met."""
    places = shards.groupBy("vec_id").agg(F.collect_set("shard").alias("shards"), F.max(F.when(F.col("home"), F.col("shard"))).alias("home"))
    places = written(places, "places")
    lists = near.select(F.col("vec_id").alias("b"), F.explode("near").alias("c")).join(places.select(F.col("vec_id").alias("c"), "shards"), "c")
    lists = written(lists, "lists")
    home = places.select(F.col("vec_id").alias("a"), F.col("home"))

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                ok = _exact(_array(batch.column(1)), _array(batch.column(3)), at, at) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(2).filter(pa.array(ok))], ["a", "b"])

    fresh, known = links, links
    while True:
        from_home = fresh.join(home, "a")
        ways = from_home.select("home", "b").distinct().join(lists, "b").where(~F.array_contains("shards", F.col("home"))).select("home", "b", "c").distinct()
        asked = from_home.join(ways, ["home", "b"]).select("a", F.col("c").alias("b")).where("a <> b").distinct().join(known, ["a", "b"], "left_anti")
        v = vectors.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
        new = asked.join(v[0], "a").join(v[1], "b").select("a", "va", "b", "vb").mapInArrow(tidy(close), "a long, b long")
        new = written(new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().join(known, ["a", "b"], "left_anti"), "fresh")
        if not new.count():
            return known
        fresh, known = new, known.union(new)


def audit(vectors: DataFrame, links: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> float:
    """The share of the links of some queries, found by a scan of all vectors, that links has too; 1 if there is none. Queries: so many at random, and as many of those with links."""
    least = lambda df: df.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(audited)
    ids = least(vectors.select("vec_id")).union(least(links.select(F.col("a").alias("vec_id")).distinct())).distinct()
    rows = vectors.join(F.broadcast(ids), "vec_id").collect()
    if not rows:
        return 1.0
    ids = np.array([r.vec_id for r in rows])
    q = np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float32).reshape(len(rows), -1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v, other = _array(batch.column(1)), np.array(batch.column(0))
                k, i = np.nonzero(q @ v.T >= threshold - 1e-5)
                ok = (_exact(q, v, k, i) >= threshold) & (ids[k] != other[i])
                yield pa.RecordBatch.from_arrays([pa.array(ids[k[ok]]), pa.array(other[i[ok]])], ["a", "b"])

    truth = vectors.select("vec_id", "v").mapInArrow(tidy(run), "a long, b long").distinct()
    n, met = truth.join(links.select("a", "b", F.lit(1).alias("met")), ["a", "b"], "left").agg(F.count("*"), F.count("met")).first()
    return met / n if n else 1.0


def links_of(vectors: DataFrame, threshold: float, overlap: int, beam: int, shard: int) -> DataFrame:
    """(a, b), both ways: the links that one search finds among distinct vectors (a written table)."""
    n = vectors.count()
    shards = written(assigned(vectors, centres(vectors, n, overlap, threshold, shard), overlap), "shards")
    shards = divided(shards, threshold, shard)
    near = written(adjacency(shards), "graph")
    return beyond(shards, near, written(found_links(shards, near, threshold, beam), "links"), vectors, threshold)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL, shard: int = SHARD) -> DataFrame:
    """(vec_id, class_id, links): a row for each vector."""
    everyone = written(prepared(embeddings).withColumn("h", F.unhex(F.md5("v"))), "vectors")
    same = written(everyone.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "same")
    vectors = written(everyone.join(same.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "v"), "distinct")
    if vectors.isEmpty():
        return embeddings.sparkSession.createDataFrame([], "vec_id long, class_id long, links long")
    best, links = -1.0, None
    for _ in range(TRIES):
        found = links_of(vectors, threshold, overlap, beam, shard)
        got = audit(vectors, found, threshold)
        if got > best:
            best, links = got, found
        if best >= recall:
            break
        overlap, beam = overlap * 2, beam * 2
    else:
        warnings.warn(f"the audit finds a recall of {best:.3f}, below {recall}", stacklevel=2)
    # A link to a vector that several rows have counts for each of them.
    counts = links.join(same.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    of_rep = same.join(counts, "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = of_rep.select("h", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return everyone.select("vec_id", "h").join(of_rep, "h").select("vec_id", "class_id", "links")


def sql(table: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """All pairs in DuckDB's SQL: what a search without misses returns. For tables of thousands of vectors."""
    return f"""
WITH RECURSIVE f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {table} WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
k AS (SELECT len(e) AS n FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
v AS (SELECT vec_id, min(e) AS e FROM f, k WHERE len(e) = k.n GROUP BY 1),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {threshold}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, (SELECT min(r.b) FROM r WHERE r.a = v.vec_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS links FROM v"""
