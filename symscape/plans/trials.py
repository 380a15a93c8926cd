"""Trials of agents on tasks: identities, schedules, what a transcript and a diff say, verdicts, resuming and the circuit breaker.

Rows are columns of tables; a column that a table lacks counts as null, as older logs have fewer. Nothing here runs an agent."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symscape.functions import paths, text
from symscape.operators import names, stats

VERSION, LAST_CHARACTERS, SIMILAR = 3, 4000, 0.6
CONDITIONS = ("A", "B", "AR")
TOTALS = ("hook_events", "baseline_count", "final_count", "resolved_count", "persisting_count", "new_final_count")
STATUSES = ("ok", "incomplete", "error", "not_run", "not_applicable")
MEASUREMENT = "struct<status:string,hook_events:int,baseline_count:int,final_count:int,resolved_count:int,persisting_count:int,new_final_count:int>"
#: Outcomes that end a session without being failures of its surroundings.
OWN_OUTCOMES = ("error_max_turns",)
_LEDGER_ID, _HEAD = "^hr[1-9][0-9]*-[0-9a-f]{20}$", "^[0-9a-f]{40,64}$"


def have(df: DataFrame, **columns: str) -> DataFrame:
    """df with null columns of these types where it has none of the name."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


# --- identities


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with keys in order, no blanks, ASCII alone."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(text.json_string(k), F.lit(":"), canonical_json(value[k], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    else:
        out = text.json_string(value) if isinstance(kind, T.StringType) else value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def identity(df: DataFrame, prefix: str, columns: list[str]) -> Column:
    """prefix and 20 digits of the sha256 of the columns' canonical JSON."""
    kind = T.StructType([df.schema[c] for c in columns])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonical_json(F.struct(*columns), kind), 256), 1, 20))


def experiments(configs: DataFrame, columns: list[str]) -> DataFrame:
    """configs with order_seed, unless a row has one, and experiment_id; both follow from what the columns say."""
    seed = F.conv(F.substring(identity(configs, "seed", columns), 6, 16), 16, 10).cast("decimal(20,0)")
    own = F.col("order_seed").cast("decimal(20,0)") if "order_seed" in configs.columns else F.lit(None).cast("decimal(20,0)")
    out = configs.withColumn("order_seed", F.coalesce(own, seed))
    return out.withColumn("experiment_id", identity(out, "experiment", [*columns, "order_seed"]))


def revisions(tasks: DataFrame, fields: list[str], judged: list[str]) -> DataFrame:
    """tasks with task_revision, of all fields, judge_config_revision, of those that judges look at, and adhoc_revision."""
    whole = canonical_json(F.struct(*fields), T.StructType([tasks.schema[c] for c in fields]))
    return tasks.withColumns({"task_revision": identity(tasks, "task", fields), "judge_config_revision": identity(tasks, "judge", judged), "adhoc_revision": F.concat(F.lit("adhoc-"), F.substring(F.sha2(whole, 256), 1, 12))})


def cells(schedule: DataFrame) -> DataFrame:
    """schedule (experiment_id, task, task_revision, judge_config_revision, rep, max_turns, effort, condition) with pair_id, the same for all conditions, and cell_id."""
    common = ["experiment_id", "task", "task_revision", "judge_config_revision", "rep", "max_turns", "effort"]
    return schedule.withColumns({"pair_id": identity(schedule, "pair", common), "cell_id": identity(schedule, "cell", [*common, "condition"])})


def short_identity(value: Column) -> Column:
    """Twelve characters after the first dash, or from the start."""
    return F.substring(F.when(value.contains("-"), F.regexp_replace(value, "(?s)^[^-]*-", "")).otherwise(value), 1, 12)


# --- schedules


def schedule(tasks: DataFrame, order: str, conditions: list[str], reps: int, seed: int) -> DataFrame:
    """tasks (in this order) with rep, block_index, order_index, condition_order and condition: a permutation of the conditions by the seed, rotated by one from block to block."""
    base = list(conditions)
    random.Random(seed).shuffle(base)
    n = len(base)
    place = F.row_number().over(Window.orderBy(order)) - 1  # tasks are few: what an experiment lists
    blocks = tasks.withColumn("__k", place).select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("block_index", (F.col("__k") * reps + F.col("rep")).cast("long")).drop("__k")
    turned = F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.element_at(F.array(*[F.lit(c) for c in base]), ((i + F.col("block_index")) % n + 1).cast("int")))
    return blocks.withColumn("condition_order", turned).select("*", F.posexplode("condition_order").alias("order_index", "condition"))


def selection(tasks: DataFrame, conditions: list[str], reps: int, only: list[str] | None = None) -> DataFrame:
    """The tasks asked for; an error where the matrix makes no sense."""
    unknown = [c for c in conditions if c not in CONDITIONS]
    if not conditions or unknown or len(set(conditions)) < len(conditions) or reps <= 0:
        raise ValueError(f"conditions must be distinct ones of {CONDITIONS}, and repetitions positive; got {conditions}, {reps}")
    if only is None:
        return tasks
    chosen = tasks.where(F.col("id").isin(*only))
    missing = sorted(set(only) - {r.id for r in chosen.select("id").collect()})
    if missing or not only:
        raise ValueError(f"no such tasks: {missing}")
    return chosen


def read_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tasks of a file {"tasks": [...]}, with its other fields beside each; fields that the schema hasn't are an error."""
    whole = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    known = {f.name for f in whole.schema.fields}, {f.name for f in whole.schema["tasks"].dataType.elementType.fields}
    there = spark.read.option("multiLine", "true").json(path)
    tasks = there.schema["tasks"].dataType.elementType if "tasks" in there.columns else T.StructType()
    extra = sorted(({*there.columns} - known[0]) | ({f.name for f in getattr(tasks, "fields", [])} - known[1]))
    if extra:
        raise ValueError(f"unknown fields: {extra}")
    rest = [F.col(c).alias(f"config_{c}") for c in whole.columns if c != "tasks"]
    return whole.select(*rest, F.posexplode("tasks").alias("place", "t")).select("place", "t.*", *[f"config_{c}" for c in whole.columns if c != "tasks"])


def violations(tasks: DataFrame) -> DataFrame:
    """(id, problem) for each rule that a task (id, kind, prompt, accept_cmd, effort, max_turns, manual_only, semantic_judge, accept_pass_codes, accept_fail_codes, expect_answer) breaks; no row for a valid set."""
    tasks = have(tasks, effort="string", max_turns="int", manual_only="boolean", semantic_judge="boolean", accept_pass_codes="array<int>", accept_fail_codes="array<int>", expect_reuse="array<string>", expect_answer="array<string>", expect_in_new_code="array<string>")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    codes = {c: F.coalesce(c, F.array().cast("array<int>")) for c in ("accept_pass_codes", "accept_fail_codes")}
    rules = {
        "unsafe id": ~F.coalesce(F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)),
        "unknown kind": ~F.coalesce(F.col("kind").isin("reuse", "navigate", "fix"), F.lit(False)),
        "prompt is empty": blank("prompt"),
        "accept_cmd is empty": blank("accept_cmd"),
        "max_turns must be positive": F.col("max_turns") <= 0,
        "unknown effort": ~F.col("effort").isin("low", "medium", "high"),
        "manual_only and semantic_judge conflict": F.col("manual_only") & F.col("semantic_judge"),
        "codes must be unique": (F.size(F.array_distinct(codes["accept_pass_codes"])) < F.size(codes["accept_pass_codes"])) | (F.size(F.array_distinct(codes["accept_fail_codes"])) < F.size(codes["accept_fail_codes"])),
        "accept_pass_codes is empty": F.size("accept_pass_codes") == 0,
        "codes must be disjoint": F.arrays_overlap(codes["accept_pass_codes"], codes["accept_fail_codes"]),
        "unknown placeholder": F.regexp_replace(F.regexp_replace("accept_cmd", r"\{\{|\}\}", ""), r"\{(ws|sha)\}", "").rlike(r"[{}]"),
        **{f"{c} has an empty string": F.exists(c, lambda x: F.coalesce(x, F.lit("")) == "") for c in ("expect_reuse", "expect_answer", "expect_in_new_code")},
    }
    own = tasks.select("id", F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]), lambda x: x.isNotNull())).alias("problem"))
    twice = tasks.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return own.union(twice)


# --- transcripts


def _type(v: Column, path: str) -> Column:
    """The kind of the value at a path of a variant, null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_int(v: Column, path: str) -> Column:
    return F.coalesce((_type(v, path) == "BIGINT") & (F.try_variant_get(v, path, "bigint") >= 0), F.lit(False))


def terminal_results(lines: DataFrame) -> DataFrame:
    """(run, event): the last event of kind result of each transcript (run, place, value), as a variant; lines that are no JSON are passed over."""
    events = lines.select("run", "place", F.try_parse_json("value").alias("event"))
    last = events.where(F.try_variant_get("event", "$.type", "string") == "result")
    return last.groupBy("run").agg(F.max_by(F.to_json("event"), "place").alias("event")).select("run", F.parse_json("event").alias("event"))


def transcript_error(event: Column) -> Column:
    """What a terminal event says went wrong around a session; null for sessions that ended, even at their limit of turns."""
    kind = F.coalesce(F.try_variant_get(event, "$.subtype", "string"), F.lit(""))
    said = F.coalesce(F.nullif(kind, F.lit("")), F.nullif(F.try_variant_get(event, "$.result", "string"), F.lit("")), F.lit("runner result error"))
    bad = F.coalesce(F.try_variant_get(event, "$.is_error", "boolean"), F.lit(False)) | kind.startswith("error")
    return F.when(~kind.isin(*OWN_OUTCOMES) & bad, said)


def protocol_error(event: Column, answer_needed: Column) -> Column:
    """The first rule that a terminal event breaks, null for one that measurements can rely on."""
    usage = lambda k: f"$.usage.{k}"
    there = lambda p: _type(event, p).isNotNull()
    kind = lambda p, k: F.coalesce(_type(event, p) == k, F.lit(False))
    rules = [
        (~_is_int(event, "$.num_turns"), "terminal result has no valid num_turns"),
        (~F.coalesce(_type(event, "$.usage").startswith("OBJECT"), F.lit(False)), "terminal result has no usage object"),
        *[(~_is_int(event, usage(k)), f"terminal usage has no valid {k}") for k in ("input_tokens", "output_tokens")],
        *[(there(usage(k)) & ~_is_int(event, usage(k)), f"terminal usage has invalid {k}") for k in ("cache_creation_input_tokens", "cache_read_input_tokens")],
        (there("$.is_error") & ~kind("$.is_error", "BOOLEAN"), "terminal result has invalid is_error"),
        (there("$.subtype") & ~kind("$.subtype", "STRING"), "terminal result has invalid subtype"),
        (answer_needed & ~kind("$.result", "STRING"), "terminal result has no answer text"),
        (there("$.result") & ~kind("$.result", "STRING"), "terminal result has invalid answer text"),
    ]
    return F.coalesce(*[F.when(cond, F.lit(rule)) for cond, rule in rules])


def with_terminal_status(outcomes: DataFrame, results: DataFrame, terminal_needed: bool = True, answer_needed: bool = False) -> DataFrame:
    """outcomes (run, status, ok, timed_out, returncode, error) with status and error as the terminal events (run, event) have them."""
    both = outcomes.join(results, "run", "left")
    status = F.when((F.col("status") == "ok") & ~F.col("ok"), F.when(F.col("timed_out"), "timeout").when(F.coalesce("returncode", F.lit(0)) != 0, "nonzero").otherwise("error")).otherwise(F.col("status"))
    limit = F.coalesce(F.try_variant_get("event", "$.subtype", "string").isin(*OWN_OUTCOMES), F.lit(False))
    missing = F.col("ok") & F.col("event").isNull() & F.lit(terminal_needed)
    failed = F.when(F.col("ok") & F.col("event").isNotNull(), transcript_error(F.col("event")))
    broken = F.when(F.col("ok") & F.col("event").isNotNull(), protocol_error(F.col("event"), F.lit(answer_needed) & ~limit))
    new = F.when(missing, "invalid_transcript").when(failed.isNotNull(), "result_error").when(broken.isNotNull(), "invalid_transcript").otherwise(status)
    why = F.when(missing, "missing terminal stream-json result").otherwise(F.coalesce(failed, broken, F.col("error")))
    return both.withColumns({"status": new, "error": why}).drop("event")


def resolved_models(lines: DataFrame) -> DataFrame:
    """(run, model): the first model that an event of a transcript names."""
    v = F.try_parse_json("value")
    name = F.coalesce(*[F.nullif(F.trim(F.when(_type(v, p) == "STRING", F.try_variant_get(v, p, "string"))), F.lit("")) for p in ("$.model", "$.message.model")])
    return lines.select("run", "place", name.alias("model")).where("model IS NOT NULL").groupBy("run").agg(F.min_by("model", "place").alias("model"))


def content_text(block: Column, depth: int = 4) -> Column:
    """The text of a content value: a string, an object's text or content, or a list of such, line by line."""
    plain = F.when(_type(block, "$") == "STRING", F.try_variant_get(block, "$", "string"))
    if not depth:
        return F.coalesce(plain, F.lit(""))
    own = F.when(_type(block, "$.text") == "STRING", F.try_variant_get(block, "$.text", "string"))
    within = F.when(_type(block, "$").startswith("OBJECT"), content_text(F.try_variant_get(block, "$.content", "variant"), depth - 1))
    many = F.when(_type(block, "$").startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(block, "$", "array<variant>"), lambda x: content_text(x, depth - 1)), "\n"))
    return F.coalesce(plain, own, within, many, F.lit(""))


def tool_results(lines: DataFrame, commands: str) -> DataFrame:
    """(run, place, id, text) of tool results whose shell command matches: results and commands of a transcript meet by the tool's id."""
    events = lines.select("run", "place", F.try_parse_json("value").alias("e"))
    blocks = events.select("run", "place", F.try_variant_get("e", "$.type", "string").alias("kind"), F.explode(F.try_variant_get("e", "$.message.content", "array<variant>")).alias("b"))
    get = lambda p: F.try_variant_get("b", p, "string")
    asked = blocks.where((F.col("kind") == "assistant") & (get("$.type") == "tool_use") & (get("$.name") == "Bash")).select("run", get("$.id").alias("id"), get("$.input.command").alias("command")).where(F.col("command").rlike(commands)).select("run", "id").distinct()
    given = blocks.where((F.col("kind") == "user") & (get("$.type") == "tool_result")).select("run", "place", get("$.tool_use_id").alias("id"), content_text(F.try_variant_get("b", "$.content", "variant")).alias("text"))
    return given.join(asked, ["run", "id"], "left_semi").select("run", "place", "id", "text")


def acted_on(events: DataFrame) -> DataFrame:
    """(run): runs in which a review (with the files that it names, if any) is followed by an edit of one of them and later by a commit. events: (run, place, kind, path, files)."""
    part = lambda k: events.where(F.col("kind") == k)
    commits = part("commit").groupBy("run").agg(F.max("place").alias("last"))
    edits = part("edit").join(commits, "run").where("place < last").groupBy("run", "path").agg(F.max("place").alias("edited"))
    both = part("review").select("run", "place", "files").join(edits, "run").where("place < edited")
    named = F.col("files").isNull() | (F.size("files") == 0) | F.exists("files", lambda f: F.endswith(F.col("path"), f))
    return both.where(named).select("run").distinct()


# --- verdicts


def classified(returncode: Column, status: Column, passes: Column, fails: Column) -> tuple[Column, Column]:
    """(verdict, reason): pass or fail by the declared codes; the reason where the process says nothing about the work."""
    ran = status.isin("ok", "nonzero")
    verdict = F.when(ran, F.when(F.array_contains(passes, returncode), "pass").when(F.array_contains(fails, returncode), "fail"))
    reason = F.when(~ran, status).when(verdict.isNull(), F.concat(F.lit("unexpected_exit:"), F.coalesce(returncode.cast("string"), F.lit("None"))))
    return verdict, reason


def semantic_result(dry: Column, runner_ok: Column, verdict: Column, manual_only: Column, semantic_judge: Column, answer_ok: Column, scope_ok: Column) -> Column:
    passed = (verdict == "pass") & F.coalesce(answer_ok, F.lit(True)) & F.coalesce(scope_ok, F.lit(True))
    seen = F.coalesce(runner_ok & verdict.isin("pass", "fail"), F.lit(False))
    return F.when(dry, "not_judged").when(~seen, "infra_error").when(manual_only, "pending_manual").when(~semantic_judge, "not_judged").when(passed, "pass").otherwise("fail")


def added_lines(diffs: DataFrame, tests_only: bool = False) -> DataFrame:
    """(run, place, path, line): the lines that unified diffs (run, diff) add, with the file that they are in."""
    lines = diffs.select("run", F.posexplode(F.split("diff", r"\r\n|[\n\r]")).alias("place", "raw"))
    file = F.last(F.when(F.col("raw").startswith("+++ b/"), F.substring("raw", 7, 1 << 20)), ignorenulls=True).over(Window.partitionBy("run").orderBy("place"))
    added = lines.withColumn("path", file).where(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"))
    if tests_only:
        added = added.where(F.coalesce(paths.test_path(F.col("path")), F.lit(False)))
    return added.select("run", "place", "path", F.substring("raw", 2, 1 << 20).alias("line"))


def scope_kept(runs: DataFrame, added: DataFrame) -> DataFrame:
    """(run, scope_ok) of runs (run, expected): whether every expected name stands as a whole word in the added lines; null where none is expected."""
    whole = added.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("code"))
    both = runs.join(whole, "run", "left")
    word = lambda n: F.regexp_like(F.coalesce("code", F.lit("")), F.concat(F.lit(r"\b"), F.regexp_replace(n, r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"\b")))
    return both.select("run", F.when(F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0, F.forall("expected", word)).alias("scope_ok"))


def signature_lines(body: Column) -> Column:
    """The lines of a map that show a declaration, trimmed."""
    lines = F.transform(F.split(body, text.LINE_END), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~F.substring(x, 1, 1).isin(*"#·-»?") & x.contains("("))


def function_name(line: Column) -> Column:
    """What stands before the bracket: the last of names in a row."""
    return F.element_at(F.split(F.ltrim(F.trim(F.element_at(F.split(line, r"\("), 1)), F.lit("-")), ","), -1)


def chain(line: Column) -> Column:
    """The calls after the first ' > ' of a line."""
    return F.when(line.contains(" > "), F.transform(F.split(F.regexp_replace(line, "(?s)^.*? > ", ""), ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))


def line_of(body: Column, name: Column) -> Column:
    """The first line that shows a declaration of this name."""
    return F.try_element_at(F.filter(signature_lines(body), lambda x: function_name(x) == name), F.lit(1))


def reuse(runs: DataFrame) -> DataFrame:
    """(run, reused, duplicated) of runs (run, before, after, expected): expected declarations that a new line of the map calls; else the first new function of a similar name."""
    last = lambda x: F.lower(F.element_at(F.split(x, r"\."), -1))
    new = F.filter(signature_lines(F.col("after")), lambda x: ~F.array_contains(signature_lines(F.col("before")), x))
    targets = runs.select("run", F.explode(F.array_distinct("expected")).alias("target")).withColumn("short", last(F.col("target")))
    lines = runs.select("run", F.posexplode(new).alias("place", "line"))
    calls = lines.select("run", F.explode(chain(F.col("line"))).alias("call")).select("run", last(F.col("call")).alias("call")).distinct()
    reused = targets.join(calls, "run").where(F.contains(F.col("call"), F.col("short"))).select("run", "target").distinct()
    named = lines.select("run", "place", function_name(F.col("line")).alias("name"))
    pairs = targets.join(reused, ["run", "target"], "left_anti").join(named, "run").where(F.lower("name") != F.col("short")).where(names.long_enough(F.col("name"), F.col("short"), SIMILAR))
    close = pairs.withColumn("ratio", names.similarity("name", "short")).where(F.col("ratio") >= SIMILAR)
    first = close.groupBy("run", "target").agg(F.min_by("name", "place").alias("name"))
    side = lambda df, c, out: df.groupBy("run").agg(F.array_sort(F.collect_set(c)).alias(out))
    none = F.array().cast("array<string>")
    out = runs.select("run").join(side(reused, "target", "reused"), "run", "left").join(side(first, "name", "duplicated"), "run", "left")
    return out.select("run", F.coalesce("reused", none).alias("reused"), F.coalesce("duplicated", none).alias("duplicated"))


# --- evidence


def evidence(outputs: DataFrame) -> DataFrame:
    """outputs (…, name, content) with size, sha256, and of the content its last characters and whether they are not all."""
    n = F.length("content")
    return outputs.withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2(F.encode("content", "UTF-8"), 256), "excerpt": F.when(n <= LAST_CHARACTERS, F.col("content")).otherwise(F.substring("content", -LAST_CHARACTERS, LAST_CHARACTERS)), "truncated": n > LAST_CHARACTERS})


def intact(claims: DataFrame, files: DataFrame, streams: int = 4) -> DataFrame:
    """(run, intact) of claims (run, stream, name, size, sha256) about files (name, raw): whether a run has so many streams and all are there as they were."""
    known = files.select("name", F.octet_length("raw").cast("long").alias("is_size"), F.sha2("raw", 256).alias("is_hash"))
    plain = (F.coalesce("name", F.lit("")) != "") & ~F.col("name").contains("/") & F.col("sha256").rlike("^[0-9a-f]{64}$")
    ok = F.coalesce(plain & (F.col("size") == F.col("is_size")) & (F.col("sha256") == F.col("is_hash")), F.lit(False))
    return claims.join(known, "name", "left").groupBy("run").agg((F.bool_and(ok) & (F.countDistinct("stream") >= streams)).alias("intact"))


# --- which cells count


def infra_reason(df: DataFrame) -> Column:
    """Why a row says nothing about its condition, by the rules of its version; null for rows that count. df must have() the columns."""
    legacy = F.coalesce(F.col("schema_version"), F.lit(1)) == 1
    default = F.when(legacy, "ok").otherwise("missing")
    runner, acceptance = F.coalesce("runner_status", default), F.coalesce("acceptance_status", default)
    dry = F.coalesce(F.col("runner_mode") == "dry-run", F.lit(False))
    review = F.coalesce(F.col("review_findings.status"), F.lit("missing"))
    now = (F.when(dry & (F.coalesce("acceptance_status", F.lit("")) == "skipped_dry_run"), F.lit(None).cast("string"))
           .when(~F.coalesce(F.col("acceptance_verdict").isin("pass", "fail"), F.lit(False)), F.concat(F.lit("acceptance:"), F.coalesce(F.nullif("acceptance_infra_reason", F.lit("")), F.nullif("acceptance_status", F.lit("")), F.lit("missing"))))
           .when(F.coalesce(F.col("condition") == "AR", F.lit(False)) & ~dry & (review != "ok"), F.concat(F.lit("review:"), review)))
    before = F.when(~acceptance.isin("ok", "nonzero"), F.concat(F.lit("acceptance:"), acceptance))
    return F.when(runner != "ok", F.concat(F.lit("runner:"), runner)).when(F.coalesce(F.col("schema_version") == VERSION, F.lit(False)), now).otherwise(before)


def full_rows(rows: DataFrame) -> DataFrame:
    return have(rows, schema_version="int", runner_status="string", runner_mode="string", acceptance_status="string", acceptance_verdict="string", acceptance_infra_reason="string", condition="string", review_findings=MEASUREMENT, wave_id="string", resolved_model="string")


def terminal_cells(rows: DataFrame, evidence_of: DataFrame | None = None) -> DataFrame:
    """rows with terminal: fully observed, a rejection included; with evidence (run, intact) only where it is intact."""
    rows = full_rows(rows)
    out = rows.withColumn("terminal", infra_reason(rows).isNull())
    if evidence_of is None:
        return out
    ok = F.col("terminal") & (F.coalesce("intact", F.lit(False)) | ~F.coalesce(F.col("schema_version") == VERSION, F.lit(False)))
    return out.join(evidence_of, "run", "left").withColumn("terminal", ok).drop("intact")


def completed_blocks(scheduled: DataFrame, rows: DataFrame) -> DataFrame:
    """(block_index) of blocks of the schedule (block_index, cell_id) that needn't run again: the newest row of each cell is terminal, all of one wave and one model. rows: (cell_id, place, ...)."""
    newest = stats.latest_by(terminal_cells(rows).where("cell_id IS NOT NULL").select("cell_id", "place", "terminal", "wave_id", "resolved_model", "schema_version"), ["cell_id"], ["place"])
    both = scheduled.select("block_index", "cell_id").distinct().join(newest, "cell_id", "left")
    per = both.groupBy("block_index").agg(
        F.bool_and(F.coalesce("terminal", F.lit(False))).alias("whole"), F.bool_or(F.coalesce(F.col("schema_version") == VERSION, F.lit(False))).alias("new"), F.bool_and(F.coalesce("wave_id", F.lit("")) != "").alias("waved"),
        F.countDistinct("wave_id").alias("waves"), F.countDistinct("resolved_model").alias("models"), F.bool_and(F.col("resolved_model").isNotNull()).alias("all_models"),
    )
    one_wave = ~F.col("new") | F.col("waved") & (F.col("waves") == 1)
    one_model = (F.col("models") == 0) | (F.col("models") == 1) & F.col("all_models")
    return per.where(F.col("whole") & one_wave & one_model).select("block_index")


def circuit_breaker(rows: DataFrame, keys: list[str], place: str, condition: str, failed: Column, limit: int = 2) -> DataFrame:
    """rows with streak, the failures in a row up to each, in the whole run or in its condition, whichever are more, and opened: whether the breaker was open before. A success ends both streaks."""
    run = Window.partitionBy(*keys).orderBy(place)
    part = Window.partitionBy(*keys, condition).orderBy(place)
    marked = rows.withColumn("__bad", F.coalesce(failed, F.lit(False)).cast("int"))
    marked = marked.withColumns({"__a": F.sum(1 - F.col("__bad")).over(run), "__b": F.sum(1 - F.col("__bad")).over(part)})
    streak = F.greatest(F.sum("__bad").over(Window.partitionBy(*keys, "__a").orderBy(place)), F.sum("__bad").over(Window.partitionBy(*keys, condition, "__b").orderBy(place)))
    out = marked.withColumn("streak", F.when(F.col("__bad") == 1, streak).otherwise(0).cast("long"))
    before = F.max("streak").over(run.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("opened", F.coalesce(before >= limit, F.lit(False))).drop("__bad", "__a", "__b")


def setup_failures(rows: DataFrame, error: Column) -> DataFrame:
    """Scheduled cells whose preparation failed, as rows that a later run tries again."""
    return rows.withColumns({"runner_status": F.lit("setup_error"), "runner_error": F.substring(error, 1, LAST_CHARACTERS), "acceptance_status": F.lit("not_run"), "acceptance_verdict": F.lit(None).cast("string"), "schema_version": F.lit(VERSION), "semantic_result": F.lit("infra_error")})


# --- reviews of what was done


def ledger(lines: DataFrame) -> DataFrame:
    """(run, head, id, check, broken) of review ledgers (run, place, value); broken is why a run's ledger can't be trusted, else null. A run without findings has a row of null id for each head."""
    v = F.try_parse_json("value")
    items = F.try_variant_get(v, "$.findings", "array<variant>")
    rows = lines.where("trim(value) <> ''").select("run", "place", v.alias("v"), F.try_variant_get(v, "$.head", "string").alias("head"), items.alias("items"))
    good = F.coalesce((_type(F.col("v"), "$.schema_version") == "BIGINT") & (F.try_variant_get("v", "$.schema_version", "int") == 1) & F.col("head").rlike(_HEAD) & F.col("items").isNotNull() & (F.size(F.try_variant_get("v", "$", "map<string,variant>")) == 3), F.lit(False))
    item = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    fine = F.forall("items", lambda x: F.coalesce(item(x, "id").rlike(_LEDGER_ID) & item(x, "check").isin("dup", "recover", "dead", "orphan", "api", "place") & (F.size(F.try_variant_get(x, "$", "map<string,variant>")) == 2), F.lit(False)))
    rows = rows.withColumn("ok", good & F.coalesce(fine, F.lit(False)))
    flat = rows.select("run", "place", "head", "ok", F.explode_outer("items").alias("x")).select("run", "place", "head", "ok", item(F.col("x"), "id").alias("id"), item(F.col("x"), "check").alias("check"))
    checks = flat.where("id IS NOT NULL").groupBy("run", "id").agg(F.countDistinct("check").alias("n")).groupBy("run").agg(F.max("n").alias("checks"))
    heads = rows.groupBy("run", "head").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok")).groupBy("run").agg(F.max("n").alias("heads"), F.bool_and("ok").alias("ok"))
    broken = F.when(~F.col("ok"), "invalid review capture").when(F.col("heads") > 1, "duplicate review capture").when(F.col("checks") > 1, "inconsistent review capture")
    return flat.drop("ok", "place").distinct().join(heads.join(checks, "run", "left").select("run", broken.alias("broken")), "run")


def final_states(runs: DataFrame, commits: DataFrame, captured: DataFrame, final: DataFrame) -> DataFrame:
    """(run, status, hook_events, baseline_count, final_count, resolved_count, persisting_count, new_final_count) of runs (run, condition): findings that hooks reported at the agent's commits (run, head), against those of its final state (run, id, check)."""
    seen = captured.select("run", "head").where("head IS NOT NULL").distinct().withColumn("seen", F.lit(1))
    cover = commits.distinct().join(seen, ["run", "head"], "left").groupBy("run").agg(F.count("*").alias("commits"), F.count("seen").alias("hook_events"))
    broken = captured.groupBy("run").agg(F.max("broken").alias("broken"))
    base = captured.where("id IS NOT NULL").join(commits, ["run", "head"], "left_semi").select("run", "id", F.lit(1).alias("a")).distinct()
    both = base.join(final.select("run", "id", F.lit(1).alias("b")).distinct(), ["run", "id"], "full_outer").groupBy("run").agg(F.count("a").cast("int").alias("baseline_count"), F.count("b").cast("int").alias("final_count"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).cast("int").alias("resolved_count"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int").alias("persisting_count"), F.count_if(F.col("a").isNull()).cast("int").alias("new_final_count"))
    twice = final.groupBy("run", "id").agg(F.countDistinct("check").alias("n")).groupBy("run").agg((F.max("n") > 1).alias("unlike"))
    rows = runs.join(cover, "run", "left").join(broken, "run", "left").join(both, "run", "left").join(twice, "run", "left")
    status = F.when(F.col("condition") != "AR", "not_applicable").when(F.col("broken").isNotNull() | (F.coalesce("hook_events", F.lit(0)) < F.coalesce("commits", F.lit(0))), "incomplete").when(F.coalesce("unlike", F.lit(False)), "error").otherwise("ok")
    out = rows.withColumn("status", status)
    counted = lambda c: F.when(F.col("status") == "ok", F.coalesce(c, F.lit(0))).cast("int").alias(c)
    hooks = F.when(F.col("status").isin("ok", "error") | (F.col("status") == "incomplete") & F.col("broken").isNull(), F.coalesce("hook_events", F.lit(0))).cast("int").alias("hook_events")
    return out.select("run", "status", hooks, *[counted(c) for c in TOTALS[1:]])


def eligible(rows: DataFrame) -> Column:
    """Whether a row's measurement counts in totals: a paid run of the condition that reviews, of sound counts."""
    r = lambda c: F.col(f"review_findings.{c}")
    sound = F.lit(True)
    for c in TOTALS:
        sound = sound & (r(c) >= 0)
    sums = (r("baseline_count") == r("resolved_count") + r("persisting_count")) & (r("final_count") == r("persisting_count") + r("new_final_count"))
    return F.coalesce((F.col("condition") == "AR") & ~F.coalesce(F.col("runner_mode") == "dry-run", F.lit(False)) & (r("status") == "ok") & infra_reason(rows).isNull() & sound & sums, F.lit(False))


def review_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells, eligible, excluded, statuses, totals): the paid cells of the reviewing condition by group; totals only over eligible ones, null where there is none."""
    rows = full_rows(rows).where("condition = 'AR' AND NOT coalesce(runner_mode = 'dry-run', false)")
    rows = rows.withColumn("__ok", eligible(rows))
    status = F.col("review_findings.status")
    known = F.coalesce(status.isin(*STATUSES), F.lit(False))
    counts = [F.count_if(status == s).alias(f"status_{s}") for s in STATUSES] + [F.count_if(~known).alias("status_other")]
    sums = [F.sum(F.when(F.col("__ok"), F.col(f"review_findings.{c}"))).alias(c) for c in TOTALS]
    return rows.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if("__ok").alias("eligible"), F.count_if(~F.col("__ok")).alias("excluded"), *counts, *sums)


# --- reports


def group_key(rows: DataFrame) -> DataFrame:
    """rows with the ten parts by which reports group: condition, kind, model, effort, budget, corpus, config, tool, runner, experiment."""
    rows = have(rows, **dict.fromkeys("kind model effort requested_budget corpus_revision config_revision tool_version tool_revision runner_mode experiment_id condition".split(), "string"), schema_version="int")
    dash = lambda c, n=None: F.substring(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—")), 1, n or 1 << 20)
    tool = F.when(F.coalesce("tool_revision", F.lit("")) != "", F.concat_ws("/", F.coalesce("tool_version", F.lit("None")), "tool_revision", F.concat(F.lit("s"), F.col("schema_version").cast("string")))).otherwise("legacy")
    or_legacy = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("legacy"))
    budget = F.coalesce(F.nullif(F.nullif(F.col("requested_budget").cast("string"), F.lit("")), F.lit("0")), F.lit("full"))
    return rows.withColumns({"g_condition": F.col("condition"), "g_kind": F.col("kind"), "g_model": dash("model"), "g_effort": dash("effort"), "g_budget": budget, "g_corpus": dash("corpus_revision", 8), "g_config": dash("config_revision", 12), "g_tool": tool, "g_runner": or_legacy("runner_mode"), "g_experiment": or_legacy("experiment_id")})


def anonymous_labels(rows: DataFrame) -> DataFrame:
    """(task, label): opaque labels in the order of the names, the same for all rows of a report."""
    listed = rows.where("task IS NOT NULL").select("task").distinct()
    return listed.withColumn("label", F.format_string("task-%03d", F.row_number().over(Window.orderBy("task"))))


def labelled(rows: DataFrame, anonymous: bool) -> DataFrame:
    """rows with task_label: the task, or its opaque label."""
    if not anonymous:
        return rows.withColumn("task_label", F.coalesce("task", F.lit("None")))
    return rows.join(F.broadcast(anonymous_labels(rows)), "task", "left").withColumn("task_label", F.coalesce("label", F.lit("task-unknown"))).drop("label")


def number(value: Column) -> Column:
    """A variant as a double where it is a number, not a boolean or a text."""
    kind = F.schema_of_variant(value)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))


def shown_median(median: Column, mad: Column, n: Column, decimals: int = 1, signed: bool = False) -> Column:
    """median ± deviation (n=..) as reports print it; a dash where there is no value."""
    shown = lambda c: F.format_number(F.bround(c, decimals), decimals)
    sign = F.when(F.lit(signed) & (median > 0), "+").otherwise("")
    return F.when(n > 0, F.concat(sign, shown(median), F.lit(" ± "), shown(mad), F.lit(" (n="), n.cast("string"), F.lit(")"))).otherwise("—")
