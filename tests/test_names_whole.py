from symscape.queries import QUERIES


def test_every_name_is_looked_up_among_all_other_rows(spark, tmp_path):
    rows = [(1, "t", "green apple"), (3, "t", "green apples"), (2, "t", "same name"), (4, "t", "same name"), (6, "t", "lonely zzz"), (8, "u", "green apple")]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.type, r.name): r.best for r in QUERIES["name_similarity"](spark, str(tmp_path)).collect()}
    assert got == {("t", "green apple"): "green apples", ("t", "green apples"): "green apple", ("t", "same name"): "same name"}
