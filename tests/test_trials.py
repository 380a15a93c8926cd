"""Trials by hand: each rule against plain Python or a case made for it."""

import difflib
import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from symscape.plans import trials


def test_identities_are_of_canonical_json(spark):
    rows = [Row(name="é \"x\"\n", codes=[1, 2], more={"b": "1", "a": "ü"}, none=None, flag=True, inner=Row(z=1, a="q")), Row(name=None, codes=[], more={}, none="n", flag=False, inner=Row(z=None, a=None))]
    df = spark.createDataFrame(rows, "name string, codes array<int>, more map<string,string>, none string, flag boolean, inner struct<z:int,a:string>")
    got = [r.i for r in df.select(trials.identity(df, "task", df.columns).alias("i")).collect()]
    for r, i in zip(rows, got, strict=True):
        raw = json.dumps(r.asDict(recursive=True), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        assert i == "task-" + hashlib.sha256(raw.encode()).hexdigest()[:20]


def test_experiments_have_a_seed_of_their_own(spark):
    df = spark.createDataFrame([("m", 40, None), ("m", 40, 7), ("n", 40, None)], "model string, max_turns int, order_seed long")
    got = trials.experiments(df, ["model", "max_turns"]).orderBy("model", F.col("order_seed").desc()).collect()
    for r in got:
        if r.order_seed != 7:
            raw = json.dumps({"max_turns": 40, "model": r.model}, sort_keys=True, separators=(",", ":"))
            assert int(r.order_seed) == int(hashlib.sha256(raw.encode()).hexdigest()[:16], 16)
    assert len({r.experiment_id for r in got}) == 3 and all(r.experiment_id.startswith("experiment-") for r in got)


def test_reading_and_choosing_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": "m", "tasks": [{"id": "a", "kind": "fix"}, {"id": "b", "kind": "reuse"}]}))
    (tmp_path / "u.json").write_text(json.dumps({"model": "m", "tasks": [{"id": "a", "kinds": "fix"}]}))
    schema = "model string, tasks array<struct<id:string,kind:string>>"
    tasks = trials.read_tasks(spark, str(tmp_path / "t.json"), schema)
    assert [(r.place, r.id, r.kind, r.config_model) for r in tasks.collect()] == [(0, "a", "fix", "m"), (1, "b", "reuse", "m")]
    with pytest.raises(ValueError, match="kinds"):
        trials.read_tasks(spark, str(tmp_path / "u.json"), schema)
    assert [r.id for r in trials.selection(tasks, ["A", "B"], 2, ["b"]).collect()] == ["b"]
    for bad in (([], 1, None), (["A", "A"], 1, None), (["X"], 1, None), (["A"], 0, None), (["A"], 1, ["z"])):
        with pytest.raises(ValueError, match="conditions|tasks"):
            trials.selection(tasks, *bad)


def old_reuse(before, after, expected):
    lines = lambda t: [x.strip() for x in t.splitlines() if x.strip() and x.strip()[0] not in "#·-»?" and "(" in x]
    name = lambda x: x.split("(")[0].strip().lstrip("-").split(",")[-1]
    new = [x for x in lines(after) if x not in lines(before)]
    reused, twice = set(), set()
    for t in expected:
        short = t.split(".")[-1].lower()
        calls = [c.strip().split(".")[-1].lower() for x in new if " > " in x for c in x.split(" > ", 1)[1].split(",")]
        if any(short in c for c in calls):
            reused.add(t)
        else:
            alike = [name(x) for x in new if difflib.SequenceMatcher(None, name(x).lower(), short).ratio() >= 0.6 and name(x).lower() != short]
            twice.update(alike[:1])
    return sorted(reused), sorted(twice)


def test_reuse(spark):
    cases = [
        ("f(a)\n", "f(a)\ng(b) > Owner.parseDate, other\n", ["Util.parseDate", "formatDate"]),
        ("", "parseDates(x):int\nparse_date(y)\n", ["parseDate"]),
        ("# head(\n- old(x)\n", "? t()\n a,b,parseDat(x) > q\n", ["x.ParseDate", "zzz"]),
        ("f(a)", "f(a)", ["f"]),
        ("", "n(a) > x.y > z, deep.Name\n", ["name", "y > z"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "run int, before string, after string, expected array<string>")
    got = {r.run: (r.reused, r.duplicated) for r in trials.reuse(df).collect()}
    assert got == {i: tuple(old_reuse(*c)) for i, c in enumerate(cases)}


def test_lines_of_maps(spark):
    body = "# head(x)\n a,b,run(int):int > Owner.f, g\n- p(x)\n = C(1)\nrun(str)\n"
    df = spark.createDataFrame([(body,)], "b string")
    r = df.select(trials.signature_lines(F.col("b")).alias("l"), trials.line_of(F.col("b"), F.lit("run")).alias("r"), trials.line_of(F.col("b"), F.lit("no")).alias("n"), trials.chain(F.lit("a(x) > f , g.h > i")).alias("c"), trials.chain(F.lit("a(x)")).alias("e")).first()
    assert r.l == ["a,b,run(int):int > Owner.f, g", "= C(1)", "run(str)"] and r.r == r.l[0] and r.n is None
    assert r.c == ["f", "g.h > i"] and r.e == []


def test_diffs_and_scope(spark):
    diff = "diff --git a/x b/x\n--- a/src/x.py\n+++ b/src/x.py\n@@ -1 +1,2 @@\n-old helper\n+call new_helper(a.b)\n++plus\n+++ b/tests/test_x.py\n+assert helper2()\n"
    added = trials.added_lines(spark.createDataFrame([(1, diff), (2, ""), (3, None)], "run int, diff string"))
    assert [(r.run, r.path, r.line) for r in added.orderBy("place").collect()] == [(1, "src/x.py", "call new_helper(a.b)"), (1, "src/x.py", "+plus"), (1, "tests/test_x.py", "assert helper2()")]
    runs = spark.createDataFrame([(1, ["new_helper", "a.b"]), (1, ["helper"]), (2, ["x"]), (3, []), (4, None)], "run int, expected array<string>")
    got = [(r.run, r.scope_ok) for r in trials.scope_kept(runs, added).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, False), (2, False), (3, None), (4, None)], key=str)


def test_protocol_and_transcript_errors(spark):
    good = {"type": "result", "num_turns": 3, "usage": {"input_tokens": 1, "output_tokens": 0}, "result": "x", "is_error": False, "subtype": "success"}
    cases = [
        (good, None, None), (good | {"num_turns": True}, None, "terminal result has no valid num_turns"), (good | {"num_turns": -1}, None, "terminal result has no valid num_turns"), (good | {"num_turns": 1.5}, None, "terminal result has no valid num_turns"),
        (good | {"usage": 3}, None, "terminal result has no usage object"), (good | {"usage": {"input_tokens": 1}}, None, "terminal usage has no valid output_tokens"), (good | {"usage": good["usage"] | {"cache_read_input_tokens": None}}, None, "terminal usage has invalid cache_read_input_tokens"),
        (good | {"is_error": 1}, "success", "terminal result has invalid is_error"), (good | {"result": 5}, None, "terminal result has no answer text"), (good | {"is_error": True}, "success", None), (good | {"is_error": True, "subtype": ""}, "x", None),
        (good | {"subtype": "error_during"}, "error_during", None), (good | {"subtype": "error_max_turns", "is_error": True}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, *_) in enumerate(cases)], "i int, j string").select("i", F.parse_json("j").alias("e"))
    got = {r.i: (r.t, r.p) for r in df.select("i", trials.transcript_error(F.col("e")).alias("t"), trials.protocol_error(F.col("e"), F.lit(True)).alias("p")).collect()}
    for i, (_, t, p) in enumerate(cases):
        assert got[i][0] == t and got[i][1] == p, i


def test_tool_results_meet_their_commands(spark):
    use = lambda i, cmd, name="Bash": {"type": "assistant", "message": {"content": [{"type": "text", "text": "t"}, {"type": "tool_use", "name": name, "id": i, "input": {"command": cmd}}]}}
    given = lambda i, content: {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content}]}}
    lines = [use("1", "git commit -m x"), given("1", [{"type": "text", "text": "one"}, {"content": [{"text": "two"}]}]), use("2", "ls"), given("2", "no"), use("3", "git commit", "Read"), given("3", "no"), {"type": "user", "message": {"content": "plain"}}, given("1", "again")]
    df = spark.createDataFrame([(1, k, json.dumps(x)) for k, x in enumerate(lines)] + [(1, 99, "{broken")], "run int, place int, value string")
    got = [(r.place, r.text) for r in trials.tool_results(df, r"\bgit\b.*\bcommit\b").orderBy("place").collect()]
    assert got == [(1, "one\ntwo"), (7, "again")]


def test_ledgers(spark):
    head, other = "a" * 40, "b" * 40
    fid = lambda k: f"hr1-{k:020x}"
    entry = lambda h, *items, **more: json.dumps({"schema_version": 1, "head": h, "findings": [{"id": fid(k), "check": c} for k, c in items]} | more)
    runs = {
        1: ([entry(head, (1, "dup"), (1, "dup")), "", entry(other)], None), 2: ([entry(head), entry(head)], "duplicate review capture"), 3: ([entry(head, (1, "dup")), entry(other, (1, "api"))], "inconsistent review capture"),
        4: (["{no"], "invalid review capture"), 5: ([entry("xyz")], "invalid review capture"), 6: ([entry(head, (1, "other"))], "invalid review capture"), 7: ([entry(head, extra=1)], "invalid review capture"), 8: ([entry(head, schema_version=2)], "invalid review capture"),
    }
    df = spark.createDataFrame([(r, k, x) for r, (lines, _) in runs.items() for k, x in enumerate(lines)], "run int, place int, value string")
    got = trials.ledger(df).collect()
    assert {r.run: r.broken for r in got} == {r: b for r, (_, b) in runs.items()}
    assert {(r.head, r.id, r.check) for r in got if r.run == 1} == {(head, fid(1), "dup"), (other, None, None)}


def test_reasons_by_version(spark):
    base = {"schema_version": 3, "runner_status": "ok", "runner_mode": "host", "acceptance_status": "ok", "acceptance_verdict": "pass", "acceptance_infra_reason": None, "condition": "A", "review_findings": None}
    cases = [
        ({}, None), ({"runner_status": "timeout"}, "runner:timeout"), ({"acceptance_verdict": None}, "acceptance:ok"), ({"acceptance_verdict": None, "acceptance_infra_reason": "unexpected_exit:9"}, "acceptance:unexpected_exit:9"),
        ({"condition": "AR"}, "review:missing"), ({"condition": "AR", "review_findings": Row(status="ok")}, None), ({"condition": "AR", "runner_mode": "dry-run"}, None), ({"runner_mode": "dry-run", "acceptance_status": "skipped_dry_run", "acceptance_verdict": None}, None),
        ({"schema_version": None, "runner_status": None, "acceptance_status": None}, None), ({"schema_version": 1, "acceptance_status": "nonzero"}, None), ({"schema_version": 2, "runner_status": None}, "runner:missing"), ({"schema_version": 2, "acceptance_status": "timeout"}, "acceptance:timeout"),
    ]
    kinds = "schema_version int, runner_status string, runner_mode string, acceptance_status string, acceptance_verdict string, acceptance_infra_reason string, condition string, review_findings struct<status:string>, i int"
    df = spark.createDataFrame([Row(**(base | c), i=i) for i, (c, _) in enumerate(cases)], kinds)
    got = {r.i: r.x for r in df.select("i", trials.infra_reason(df).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    rows = trials.terminal_cells(df.withColumn("run", F.col("i")), spark.createDataFrame([(0, True), (5, False)], "run int, intact boolean")).where("terminal").collect()
    assert {r.i for r in rows} == {0, 8, 9}


def test_group_key_and_labels(spark):
    df = spark.createDataFrame([("A", "fix", None, "", 0, "c" * 12, "v1", "t", 3, "x"), ("B", None, "m", "low", 500, None, None, None, 1, None)], "condition string, kind string, model string, effort string, requested_budget int, corpus_revision string, tool_version string, tool_revision string, schema_version int, task string")
    a, b = trials.group_key(df).orderBy("condition").collect()
    assert (a.g_model, a.g_effort, a.g_budget, a.g_corpus, a.g_tool, a.g_runner) == ("—", "—", "full", "c" * 8, "v1/t/s3", "legacy")
    assert (b.g_model, b.g_budget, b.g_tool, b.g_experiment) == ("m", "500", "legacy", "legacy")
    assert {r.task_label for r in trials.labelled(df, True).collect()} == {"task-001", "task-unknown"} and {r.task_label for r in trials.labelled(df, False).collect()} == {"x", "None"}
    v = spark.createDataFrame([("1",), ("true",), ('"3"',), ("2.5",), ("null",)], "j string").select(trials.number(F.parse_json("j")).alias("n"))
    assert [r.n for r in v.collect()] == [1.0, None, None, 2.5, None]


def test_setup_failures_are_tried_again(spark):
    df = spark.createDataFrame([("c1", 1)], "cell_id string, place int")
    failed = trials.setup_failures(df, F.lit("x" * 9000))
    r = failed.first()
    assert r.runner_status == "setup_error" and len(r.runner_error) == 4000
    assert trials.completed_blocks(spark.createDataFrame([(1, "c1")], "block_index int, cell_id string"), failed).count() == 0
