import json
import statistics

from symscape.functions import paths, text
from symscape.operators import names
from symscape.plans import experiments
from symscape.schemas import RUNS
from symscape.sources import scanners
from symscape.streaming import incremental
from pyspark.sql import functions as F


def runs(spark):
    columns = [f.strip().split(" ")[0] for f in RUNS.split(", ")]
    rows = []
    for k in range(12):
        for cond in ("A", "B"):
            rows.append({"cell_id": f"{k}{cond}", "pair_id": str(k), "condition": cond, "kind": "reuse", "model": "m", "effort": "e", "experiment_id": "x", "wave_id": "w" if k or cond == "A" else "v", "runner_status": "ok" if k != 3 else "timeout", "schema_version": 3, "acceptance_verdict": "pass" if k % 2 else "fail", "reads": k, "turns": 2 * k + (cond == "A"), "reused": ["r"] if k > 5 else []})
    rows.append(rows[0] | {"reads": 100})
    return spark.createDataFrame([tuple(r.get(c) for c in columns) + (i,) for i, r in enumerate(rows)], RUNS + ", place long"), rows


def test_summary_and_matched(spark):
    df, rows = runs(spark)
    got = {r.condition: r for r in experiments.summary(df).collect()}
    values = [100, *[k for k in range(1, 12) if k != 3]]
    m = statistics.median(values)
    assert got["A"].valid == 11 and got["A"].invalid == 1 and got["A"].metrics["reads"]["median"] == m and got["A"].metrics["reads"]["mad"] == statistics.median(abs(v - m) for v in values)
    assert got["A"].accepted_n == 11 and got["A"].accepted_percent == round(100 * 5 / 11, 4) and got["A"].reused_percent == round(100 * 6 / 11, 4)
    pairs = {r.pair_id: r for r in experiments.matched(df).collect()}
    assert pairs["0"].reason == "other wave" and pairs["3"].reason == "infrastructure" and pairs["5"].reason is None and pairs["5"].deltas.turns == 1


def test_transcripts(spark):
    use = lambda name, **i: {"type": "tool_use", "name": name, "id": "1", "input": i}
    lines = ["noise", json.dumps({"type": "assistant", "message": {"content": [use("Read", file_path="a"), use("Grep"), use("Bash", command="rg x"), use("Bash", command="cat y")]}}), json.dumps({"type": "assistant", "message": {"content": [use("Edit", file_path="a"), use("Read", file_path="a")]}}), json.dumps({"type": "result", "num_turns": 7, "usage": {"input_tokens": 5, "cache_read_input_tokens": 6, "output_tokens": 3}})]
    got = experiments.transcript_metrics(spark.createDataFrame([("r", i, v) for i, v in enumerate(lines)] + [("empty", 0, "x")], "run string, place long, value string"))
    by = {r.run: r for r in got.collect()}
    assert (by["r"].reads, by["r"].searches, by["r"].edits, by["r"].files_read, by["r"].turns, by["r"].tokens_in, by["r"].tokens_out) == (3, 2, 1, 1, 7, 11, 3)
    assert by["empty"].reads == 0


def test_privacy(spark):
    files = spark.createDataFrame([("private/x", b"plain"), ("a/b/private", b"has SECRET\xff word"), ("ok.txt", b"\xffnothing")], "path string, raw binary")
    assert {r.path for r in experiments.private_paths(files, ["private/"]).collect()} == {"private/x", "a/b/private"}
    terms = spark.createDataFrame([(1, "secret"), (2, "absent"), (3, "")], "entry long, term string")
    assert [(r.path, r.entry) for r in experiments.denied_payloads(files, terms).collect()] == [("a/b/private", 1)]
    assert {(r.path, r.entry) for r in names.contained_terms(spark.createDataFrame([("p", "AB cd")], "path string, t string"), "path", "t", spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "b c")], "entry long, term string"), "entry", "term", term_bytes=1).collect()} == {("p", 1), ("p", 2), ("p", 3)}


def test_factoring_is_lossless():
    for case in ([], ["a"], ["test_a", "test_b", "test_c", "x"], ["abc"] * 5, ["pre{x", "pre{y", "pre{z"], [f"test_name_{i}" for i in range(20)]):
        assert names.unfactored(names.factored(case)) == case or "{" in "".join(case)
    assert len(names.factored(["test_alpha", "test_beta", "test_gamma"])) == 1


def test_paths(spark):
    cases = {"a/test_x.py": ("python", True, True), "Makefile": ("make", False, True), "x.PY": (None, False, False), "src/.git/a.py": ("python", False, False), "My.Tests/a.cs": ("csharp", True, True), "a/FooIT.java": ("java", True, True), "a/latest.py": ("python", False, True), ".hidden.py": ("python", False, True), "dist/a.js": ("javascript", False, False), "spec/a.rb": ("ruby", True, True)}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.language(F.col("p")).alias("l"), paths.test_path(F.col("p")).alias("t"), paths.scanned(F.col("p")).alias("s"))
    assert {r.p: (r.l, r.t, r.s) for r in df.collect()} == cases


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = 'a = "x // y" // z\n/* b "c */ d # e\n\'\'\'f\ng\'\'\' h'
    assert one(text.without_comments_and_strings(F.lit(s))).split() == ["a", "=", '"s"', "d", '"s"', "h"]
    assert [one(text.line_count(F.lit(x))) for x in ("", "a", "a\n", "a\r\nb", "a b\x0cc")] == [len(x.splitlines()) for x in ("", "a", "a\n", "a\r\nb", "a b\x0cc")]
    assert one(text.identifiers(F.lit("a_1 éb 9x _y, z² x-y"))) == ["a_1", "_y", "x", "y"]
    assert one(text.base_type(F.lit("Map<K, V>"))) == "Map" and one(text.parsed_throws(F.lit("a.B, C "))) == ["B", "C"]


def test_split_top():
    assert scanners.split_top("a, Map<b, c>, f(d, e)") == ["a", " Map<b, c>", " f(d, e)"] and scanners.split_top("") == []


def test_streams(spark, tmp_path):
    events = [(1, "2024-01-01 10:00:00", "view", 1.0), (2, "2024-01-01 11:00:00", "view", 2.0), (1, "2024-01-02 10:00:00", "click", 4.0)]
    src = str(tmp_path / "in")
    batch = lambda rows: spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").selectExpr("user_id", "timestamp(ts) AS ts", "event_type", "value")
    batch(events).write.parquet(src)
    stream = spark.readStream.schema(batch(events).schema).parquet(src)
    target = str(tmp_path / "out")
    run = lambda: incremental.newest(stream, ["user_id"], ["ts"], target, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert {(r.user_id, r.event_type) for r in incremental.current(spark, target).collect()} == {(1, "click"), (2, "view")}
    batch([(2, "2024-01-03 00:00:00", "purchase", 1.0), (1, "2023-01-01 00:00:00", "old", 1.0)]).write.mode("append").parquet(src)
    run()
    assert {(r.user_id, r.event_type) for r in incremental.current(spark, target).collect()} == {(1, "click"), (2, "purchase")}
    counts = incremental.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 5
