import duckdb
import numpy as np
import pytest

from symscape.llm import vectors
from tests.llm import made as made_rows


def made(n=1500, groups=60, seed=2, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = [base]
    for g in range(groups):
        rows.append(base[g] + 0.04 * rng.standard_normal((1 + g % 25, dim)))
    rows += [base[:5], base[:5] * 3, base[7] + 0.03 * rng.standard_normal((400, dim))]
    return np.concatenate(rows).astype(np.float32)


def brute(v, threshold):
    """Class and number of links of each row, by all pairs."""
    v = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = v @ v.T >= threshold
    np.fill_diagonal(close, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(close, root[None, :], len(v)).min(1))
        new = new[new]
        if (new == root).all():
            return root, close.sum(1)
        root = new


@pytest.mark.parametrize("shard", [2000, 300, 60])
def test_classes_and_links_against_all_pairs(spark, shard):
    """With shards of 60 most groups lie in several, and large shards are divided."""
    v = made()
    df = spark.createDataFrame([(i, x.tolist(), "extra") for i, x in enumerate(v)], "vec_id long, embedding array<float>, v string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, shard=shard).collect()}
    assert sorted(got) == list(range(len(v)))
    (root, links), (_, most), (_, least) = (brute(v, vectors.THRESHOLD + x) for x in (0, 1e-6, -1e-6))
    assert all(got[i].links <= least[i] for i in got)
    assert sum(got[i].links for i in got) >= 0.95 * most.sum() > 100_000
    assert np.mean([got[i].class_id == root[i] for i in got]) >= 0.99


def test_large_shards_are_divided(spark):
    v = made(600, 20)
    rows = [(0, True, i, (x / np.linalg.norm(x)).astype(np.float32).tobytes()) for i, x in enumerate(v)]
    shards = vectors.divided(vectors.written(spark.createDataFrame(rows, "shard long, home boolean, vec_id long, v binary"), "shards"), 0.95, shard=50)
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    homes = shards.where("home").groupBy("vec_id").count().collect()
    assert max(sizes) <= 3 * 50 or len(sizes) > 5
    assert len(homes) == len(v) and all(r["count"] == 1 for r in homes)


def test_links_beyond_the_home_are_met(spark):
    """Two shards that share one vector: its neighbours in the other are met through the united lists."""
    angles = np.array([0.0, 0.1, 0.2, 0.3])
    v = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    place = [(0, True, 0), (0, True, 1), (0, False, 2), (1, True, 2), (1, True, 3), (1, False, 1)]
    shards = spark.createDataFrame([(s, h, i, v[i].tobytes()) for s, h, i in place], "shard long, home boolean, vec_id long, v binary")
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "vec_id long, v binary")
    near = vectors.adjacency(shards)
    links = vectors.written(vectors.found_links(shards, near, 0.95, 8), "links")
    got = {(r.a, r.b) for r in vectors.beyond(shards, near, links, table, 0.95).collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if a != b and np.cos(angles[a] - angles[b]) >= 0.95}
    assert (0, 3) not in {(r.a, r.b) for r in links.collect()}


def test_audit_counts_what_is_missing(spark):
    v = made(300, 30)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "vec_id long, v binary")
    close = v.astype(float) @ v.astype(float).T >= 0.95
    pairs = [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True) if i != j]
    all_links = spark.createDataFrame(pairs, "a long, b long")
    assert vectors.audit(table, all_links, 0.95, 2000) == 1
    assert vectors.audit(table, all_links.where("a % 2 = 0"), 0.95, 2000) == pytest.approx(sum(a % 2 == 0 for a, _ in pairs) / len(pairs))


def test_below_the_recall_the_best_result_counts_with_a_warning(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made(60, 10)[:120])], "vec_id long, embedding array<float>")
    with pytest.warns(UserWarning, match="recall"):
        got = vectors.near_duplicates(df, recall=2.0)
    assert got.count() == 120


def test_pruning_by_hand():
    v = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]], np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = vectors.pruned(v, np.array([0]), np.array([[3, 2, 1]]), 3)
    assert kept[0].tolist() == [1, 3]  # 2 is nearer to 1 than to 0; 3 is not, by ALPHA
    assert vectors.pruned(v, np.array([0]), np.array([[3, 2, 1]]), 3, alpha=5)[0].tolist() == [1, 2, 3]


def test_edges(spark):
    one = [1.0, 0.0]
    rows = [(1, one, 0), (2, one, 1), (2, one, 1), (3, [2.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (None, one, 1), (9, [1.0, 0.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [0.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.class_id, r.links) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 10: (10, 1), 11: (10, 1)}
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.near_duplicates(df.where("vec_id = 10")).collect()] == [(10, 10, 0)]
    with duckdb.connect() as db:
        db.register("embeddings", df.where("vec_id <> 7 AND vec_id <> 8").toArrow())
        assert {r[0]: (r[1], r[2]) for r in db.sql(vectors.sql()).fetchall()} == got


def test_sql_on_a_table_with_links(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made(150, 40)[:320])], "vec_id long, embedding array<float>")
    with duckdb.connect() as db:
        db.register("embeddings", df.toArrow())
        want = db.sql(vectors.sql())
        got = vectors.near_duplicates(df)
        assert made_rows.rows(got.select(*want.columns)) == made_rows.rows_of(want.fetchall())
        assert got.where("links > 0").count() > 50
