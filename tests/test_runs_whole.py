import random

from symscape.operators import support


def runs(places):
    out = [(None, 1)] if None in places else []
    for p in sorted({x for x in places if x is not None}):
        if out and out[-1][0] is not None and p == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def test_runs_with_repeated_rows_gaps_and_nulls(spark):
    rng = random.Random(6)
    places = {k: [rng.choice([None, *range(-span, span)]) if rng.random() < 0.9 else rng.randrange(-2, 2) for _ in range(n)] for k, n, span in (("a", 40, 40), ("b", 60, 20), ("c", 5, 9), (None, 30, 30), ("e", 300, 90))}
    places |= {"d": [3], "f": [None], "g": [5, 5, 5], "h": [None, None, 1, 1, 2, 4, 4, 5, 5, 9, 9]}
    rows = [(k, 1, p) for k, v in places.items() for p in v] + [("d", 2, 4), ("d", 2, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, p int").repartition(5)
    got = support.contiguous_runs(df, ["k", "j"], "p")
    assert got.dtypes == [("k", "string"), ("j", "int"), ("first", "bigint"), ("n", "bigint")]
    want = [(k, 1, first, n) for k, v in places.items() for first, n in runs(v)] + [("d", 2, 3, 2)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_runs_take_one_sort_and_no_table_in_memory(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS p")
    plan = support.contiguous_runs(df, ["k"], "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Exchange ") == 1 and "Aggregate" not in plan
