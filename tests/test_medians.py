import random
import statistics
from collections import defaultdict

from symscape.operators import stats


def test_medians_are_exact(spark):
    rng = random.Random(2)
    rows = []
    for key, n, draw in (("a", 5000, rng.random), ("b", 4001, lambda: rng.choice([0, 1, 1, 2])), ("c", 2, rng.random), ("d", 1, lambda: -3.5), (None, 300, lambda: rng.gauss(0, 9)), ("e", 1000, lambda: 7), ("f", 3000, lambda: rng.choice([1e300, -1e300, 0.5])), ("g", 999, lambda: rng.randrange(10))):
        rows += [(key, float(draw())) for _ in range(n)]
    rows += [("a", None), ("none", None)]
    rng.shuffle(rows)
    want = defaultdict(list)
    for k, x in rows:
        if x is not None:
            want[k].append(x)
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: (r.median, r.n) for r in stats.medians(df, ["k"], "x").collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in want.items()}
    spread = {r.k: (r.n, r.median, r.mad) for r in stats.median_mad(df.where("k <> 'f' OR k IS NULL"), ["k"], "x").collect()}
    for k, v in want.items():
        if k != "f":
            m = statistics.median(v)
            assert spread[k] == (len(v), round(m, 6), round(statistics.median(abs(x - m) for x in v), 6))
    assert stats.medians(df.limit(0), ["k"], "x").count() == 0
