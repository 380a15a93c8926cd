import random

from symscape.operators import graph


def test_closure_writes_each_pair_once(spark, monkeypatch):
    rng = random.Random(8)
    n, sizes = 40, []
    edges = {(k, k + 1) for k in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(4)} | {(50, 51), (51, 52), (52, 50), (60, 60)}
    keep = graph.written

    def counted(df, *more):
        out = keep(df, *more)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    found = [tuple(r) for r in graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert len(found) == len(set(found)) and set(found) == want
    assert sum(sizes) == len(want) and len(sizes) <= 8
