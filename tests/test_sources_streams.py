"""Logs in several files, streams of sources, packing in batches, and small functions that other tests don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from symscape.functions import text
from symscape.plans import experiments
from symscape.sources import repository
from symscape.streaming import incremental


def test_runs_keep_the_order_of_files_and_lines(spark, tmp_path):
    for n, rows in (("a", [("c1", 1), ("c2", 2)]), ("b", [("c1", 3)])):
        (tmp_path / f"{n}.jsonl").write_text("\n\n".join(json.dumps({"cell_id": c, "reads": r}) for c, r in rows) + "\n")
    runs = experiments.read_runs(spark, str(tmp_path))
    assert [r.reads for r in runs.orderBy("place").collect()] == [1, 2, 3]
    assert {(r.cell_id, r.reads) for r in experiments.latest_cells(runs).collect()} == {("c1", 3), ("c2", 2)}
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        experiments.read_runs(spark, str(tmp_path)).collect()


def test_changed_files_replace_their_declarations(spark, tmp_path):
    def put(n, files):
        rows = [(p, c.encode(), n) for p, c in files.items()]
        df = repository.files_of(spark.createDataFrame(rows, "path string, raw binary, seen int")).join(spark.createDataFrame([(p, n) for p in files], "path string, seen int"), "path")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    def run(schema):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.changed_files(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return {(r.file, r.name) for r in incremental.current(spark, str(tmp_path / "out")).collect()}

    schema = put(1, {"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"})
    assert run(schema) == {("a.py", "f"), ("b.py", "g")}
    put(2, {"a.py": "def h(): pass\ndef i(): pass\n"})
    assert run(schema) == {("a.py", "h"), ("a.py", "i"), ("b.py", "g")}


def test_small_functions(spark):
    df = spark.createDataFrame([("Map<A,  B>, C", "java.io.IOException, a.B ,,")], "t string, c string")
    r = df.select(text.tight_type(F.col("t")).alias("t"), text.base_type(F.col("t")).alias("b"), text.parsed_throws(F.col("c")).alias("x"), text.without_exception_suffix(F.lit("Exception")).alias("e"), text.without_exception_suffix(F.lit("IOError")).alias("f")).first()
    assert (r.t, r.b, r.x, r.e, r.f) == ("Map<A,B>,C", "Map", ["IOException", "B"], "Exception", "IO")
