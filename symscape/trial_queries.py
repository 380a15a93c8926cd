"""The operators on trials bound to the tables: users are runs, events are rows of a log, parts are tasks, documents are outputs."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.operators import stats
from symscape.plans import trials
from symscape.queries import query, table


def _json(**fields: str) -> str:
    """SQL that makes canonical JSON; the fields' SQL gives text that needs no escape, or a number in brackets."""
    parts = [f"""'"{k}":' || """ + (v[1:-1] if v.startswith("(") else f"""'"' || {v} || '"'""") for k, v in sorted(fields.items())]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _digest(prefix: str, json: str, n: int = 20) -> str:
    return f"'{prefix}-' || substr(sha256({json}), 1, {n})"


_TASK = {"p_brand": "p_brand", "p_name": "p_name", "p_size": "(p_size)"}
_CELL = {"experiment_id": "'x-1'", "task": "p_name", "task_revision": "task_revision", "judge_config_revision": "judge_config_revision", "rep": "('1')", "max_turns": "(p_size)", "effort": "('null')"}


@query(f"""WITH t AS (SELECT *, {_digest("task", _json(**_TASK))} AS task_revision, {_digest("judge", _json(p_size="(p_size)"))} AS judge_config_revision, {_digest("adhoc", _json(**_TASK), 12)} AS adhoc_revision FROM part)
SELECT p_partkey, task_revision, judge_config_revision, adhoc_revision, {_digest("pair", _json(**_CELL))} AS pair_id, {_digest("cell", _json(**_CELL, condition="p_type"))} AS cell_id FROM t""")
def trial_identities(spark, d):
    """Revisions of tasks, and the identities of pairs and cells."""
    t = trials.revisions(table(spark, d, "part"), list(_TASK), ["p_size"])
    t = t.select("p_partkey", "task_revision", "judge_config_revision", "adhoc_revision", F.lit("x-1").alias("experiment_id"), F.col("p_name").alias("task"), F.lit(1).alias("rep"), F.col("p_size").alias("max_turns"), F.lit(None).cast("string").alias("effort"), F.col("p_type").alias("condition"))
    return trials.cells(t).select("p_partkey", "task_revision", "judge_config_revision", "adhoc_revision", "pair_id", "cell_id")


@query(f"SELECT n_nationkey, {_digest('seed', _json(n_name='n_name'))} AS seed_identity FROM nation")
def trial_seeds(spark, d):
    """What an experiment's seed is made of; the seed itself is 16 digits of it as a number."""
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", trials.identity(nation, "seed", ["n_name"]).alias("seed_identity"))


def _permuted(seed: int) -> list[str]:
    base = ["A", "AR", "B"]
    random.Random(seed).shuffle(base)
    return base


@query(f"""WITH b AS (SELECT n_name, rep, (row_number() OVER (ORDER BY n_nationkey, rep)) - 1 AS block FROM nation, (SELECT unnest(range(0, 2)) AS rep))
SELECT n_name, CAST(rep AS INTEGER) AS rep, CAST(block AS BIGINT) AS block_index, CAST(k AS INTEGER) AS order_index, {_permuted(7)}[1 + (k + block) % 3] AS condition FROM b, (SELECT unnest(range(0, 3)) AS k)""")
def counterbalanced_schedule(spark, d):
    """Nations as tasks, each twice, under a permutation of the conditions that turns from block to block."""
    return trials.schedule(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_nationkey", ["A", "AR", "B"], 2, 7).select("n_name", "rep", "block_index", "order_index", "condition")


@query("""WITH t AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'bad id' ELSE p_brand || p_partkey END AS id, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'fix' END AS kind, CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS prompt, CASE WHEN p_size % 13 = 0 THEN 'run {wx}' ELSE 'run {ws} {{x}}' END AS cmd FROM part), u AS (SELECT *, replace(id, '#', '') AS i FROM t)
SELECT i AS id, 'unsafe id' AS problem FROM u WHERE i = 'bad id' UNION ALL SELECT i, 'unknown kind' FROM u WHERE kind = 'other' UNION ALL SELECT i, 'prompt is empty' FROM u WHERE prompt = ' ' UNION ALL SELECT i, 'unknown placeholder' FROM u WHERE cmd = 'run {wx}'
UNION ALL SELECT i, 'max_turns must be positive' FROM u WHERE p_size - 3 <= 0 UNION ALL SELECT i, 'codes must be disjoint' FROM u WHERE p_size = 4 UNION ALL SELECT i, 'duplicate id' FROM u GROUP BY i HAVING count(*) > 1""")
def trial_config_violations(spark, d):
    size = F.col("p_size")
    tasks = table(spark, d, "part").select(
        F.when(size % 7 == 0, "bad id").otherwise(F.replace(F.concat("p_brand", F.col("p_partkey").cast("string")), F.lit("#"))).alias("id"), F.when(size % 5 == 0, "other").otherwise("fix").alias("kind"), F.when(size % 11 == 0, " ").otherwise(F.col("p_name")).alias("prompt"),
        F.when(size % 13 == 0, "run {wx}").otherwise("run {ws} {{x}}").alias("accept_cmd"), (size - 3).cast("int").alias("max_turns"), F.array(F.lit(0), size.cast("int")).alias("accept_pass_codes"), F.array(F.lit(4)).alias("accept_fail_codes"),
    )
    return trials.violations(tasks)


_FAILED = "event_id % 3 <> 0"


@query(f"""WITH b AS (SELECT user_id, event_id, event_type, CAST({_FAILED} AS INT) AS bad FROM events WHERE user_id IS NOT NULL), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS a, sum(1 - bad) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS c FROM b),
s AS (SELECT *, CASE WHEN bad = 1 THEN greatest(sum(bad) OVER (PARTITION BY user_id, a ORDER BY event_id), sum(bad) OVER (PARTITION BY user_id, event_type, c ORDER BY event_id)) ELSE 0 END AS streak FROM g)
SELECT user_id, event_id, CAST(streak AS BIGINT) AS streak, coalesce(max(streak) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 4, false) AS opened FROM s""")
def circuit_breaker(spark, d):
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", "event_id", "event_type")
    return trials.circuit_breaker(e, ["user_id"], "event_id", "event_type", F.expr(_FAILED), 4).select("user_id", "event_id", "streak", "opened")


_BAD = "event_id % 9 = 0"


@query(f"""WITH l AS (SELECT user_id, event_type, event_id, NOT ({_BAD}) AS ok, CASE WHEN event_id % 31 = 0 THEN 'w2' ELSE 'w1' END AS wave FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id AS block_index FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) JOIN l USING (user_id) GROUP BY user_id HAVING count(*) = 2 AND bool_and(ok) AND count(DISTINCT wave) = 1""")
def completed_blocks(spark, d):
    """Each user is a block of two cells; only blocks whose newest rows are both sound and of one wave needn't run again."""
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    cell = F.concat_ws("-", "user_id", "event_type")
    planned = e.select(F.col("user_id").alias("block_index")).distinct().select("block_index", F.explode(F.array(*[F.concat_ws("-", "block_index", F.lit(c)) for c in ("view", "click")])).alias("cell_id"))
    rows = e.where("event_type IN ('view', 'click')").select(cell.alias("cell_id"), F.col("event_id").alias("place"), F.lit(3).alias("schema_version"), F.when(F.expr(_BAD), "timeout").otherwise("ok").alias("runner_status"), F.lit("pass").alias("acceptance_verdict"), F.when(F.col("event_id") % 31 == 0, "w2").otherwise("w1").alias("wave_id"), F.lit("m").alias("resolved_model"))
    return trials.completed_blocks(planned, rows)


@query("""WITH e AS (SELECT event_id, event_id % 5 AS code, CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'nonzero' ELSE 'ok' END AS status, event_id % 11 = 0 AS dry, event_id % 13 = 0 AS manual, event_id % 4 <> 0 AS judged, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM events),
v AS (SELECT *, CASE WHEN status = 'timeout' THEN NULL WHEN code IN (0, 2) THEN 'pass' WHEN code = 1 THEN 'fail' END AS verdict FROM e)
SELECT event_id, verdict, CASE WHEN status = 'timeout' THEN 'timeout' WHEN verdict IS NULL THEN 'unexpected_exit:' || code END AS reason,
CASE WHEN dry THEN 'not_judged' WHEN status = 'timeout' OR verdict IS NULL THEN 'infra_error' WHEN manual THEN 'pending_manual' WHEN NOT judged THEN 'not_judged' WHEN verdict = 'pass' AND coalesce(answer, true) THEN 'pass' ELSE 'fail' END AS semantic FROM v""")
def trial_verdicts(spark, d):
    k = F.col("event_id")
    status = F.when(k % 7 == 0, "timeout").when(k % 7 == 1, "nonzero").otherwise("ok")
    verdict, reason = trials.classified((k % 5).cast("int"), status, F.array(F.lit(0), F.lit(2)), F.array(F.lit(1)))
    e = table(spark, d, "events").select("event_id", status.alias("status"), verdict.alias("verdict"), reason.alias("reason"))
    answer = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return e.select("event_id", "verdict", "reason", trials.semantic_result(k % 11 == 0, F.col("status") != "timeout", F.col("verdict"), k % 13 == 0, k % 4 != 0, answer, F.lit(None).cast("boolean")).alias("semantic"))


_DIFF = "string_agg('+++ b/' || CASE turn % 3 WHEN 0 THEN 'tests/' ELSE 'src/' END || role || turn || '.py' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+' || replace(coalesce(text, ''), chr(10), chr(10) || '-'), chr(10) ORDER BY turn, role)"


@query(f"""WITH d AS (SELECT conv_id, {_DIFF} AS diff FROM conversations GROUP BY 1), l AS (SELECT conv_id, unnest(string_split_regex(diff, '\\r\\n|[\\n\\r]')) AS raw, generate_subscripts(string_split_regex(diff, '\\r\\n|[\\n\\r]'), 1) AS place FROM d),
f AS (SELECT *, last_value(CASE WHEN starts_with(raw, '+++ b/') THEN substr(raw, 7) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM l)
SELECT conv_id AS run, path, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(raw) - 1) AS BIGINT) AS characters FROM f WHERE starts_with(raw, '+') AND NOT starts_with(raw, '+++') AND starts_with(path, 'tests/') GROUP BY 1, 2""")
def added_lines(spark, d):
    """Turns as files of a diff; lines that it adds to test files."""
    c = table(spark, d, "conversations")
    part = F.concat(F.lit("+++ b/"), F.when(F.col("turn") % 3 == 0, "tests/").otherwise("src/"), "role", F.col("turn").cast("string"), F.lit(".py\n@@ -0,0 +1 @@\n+"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n-")))
    diffs = c.groupBy(F.col("conv_id").alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", part.alias("p")))), lambda x: x["p"]), "\n").alias("diff"))
    return trials.added_lines(diffs, tests_only=True).groupBy("run", "path").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, md5(right(text, 4000)) AS excerpt, length(text) > 4000 AS truncated FROM documents WHERE text IS NOT NULL")
def output_evidence(spark, d):
    out = trials.evidence(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("content")))
    return out.select("doc_id", "size", "sha256", F.md5("excerpt").alias("excerpt"), "truncated")


@query("SELECT source AS run, bool_and(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AND count(DISTINCT doc_id) >= 2 AS intact FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1, doc_id // 50")
def output_intact(spark, d):
    """What logs claim of the documents, some claims wrong, against the documents: those of a source among fifty are the streams of a run that needs two."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", F.encode("text", "UTF-8").alias("raw"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    run = F.struct("source", F.floor(F.col("doc_id") / 50).alias("k"))
    claims = docs.select(run.alias("run"), F.col("name").alias("stream"), "name", (F.octet_length("raw") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("size"), F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.sha2("raw", 256)).alias("sha256"))
    return trials.intact(claims, docs.select("name", "raw"), streams=2).select("run.source", "intact").withColumnRenamed("source", "run")


@query("SELECT p_type AS task, 'task-' || printf('%03d', dense_rank() OVER (ORDER BY p_type)) AS label FROM (SELECT DISTINCT p_type FROM part)")
def anonymous_labels(spark, d):
    return trials.anonymous_labels(table(spark, d, "part").select(F.col("p_type").alias("task")))


@query("SELECT p_partkey, substr(CASE WHEN contains(n, '-') THEN substr(n, strpos(n, '-') + 1) ELSE n END, 1, 12) AS short FROM (SELECT p_partkey, replace(p_name, ' ', '-') || p_type AS n FROM part)")
def short_identities(spark, d):
    return table(spark, d, "part").select("p_partkey", trials.short_identity(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), "p_type")).alias("short"))


@query("""WITH l AS (SELECT page_id, list_filter(list_transform(string_split_regex(html, '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[#·»?-]') AND contains(x, '(')) AS l FROM pages)
SELECT page_id, CAST(len(l) AS BIGINT) AS lines, coalesce(array_to_string(list_transform(l, lambda x: list_last(string_split(ltrim(trim(string_split(x, '(')[1]), '-'), ','))), chr(10)), '') AS names FROM l""")
def signature_lines(spark, d):
    lines = trials.signature_lines(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(lines).cast("long").alias("lines"), F.array_join(F.transform(lines, trials.function_name), "\n").alias("names"))


@query("""WITH e AS (SELECT user_id AS run, event_id AS place, event_type, event_id % 4 AS path, event_id % 3 AS f FROM events WHERE user_id IS NOT NULL), c AS (SELECT run, max(place) AS last FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT DISTINCT r.run FROM e r JOIN e x ON x.run = r.run AND x.event_type = 'click' AND x.place > r.place JOIN c ON c.run = r.run AND x.place < c.last WHERE r.event_type = 'view' AND (r.f = 0 OR x.path = r.f)""")
def acted_on_reviews(spark, d):
    """Views as reviews of some files or none, clicks as edits, purchases as commits."""
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    kind = F.when(F.col("event_type") == "view", "review").when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "commit")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".py"))
    files = F.when(F.col("event_id") % 3 != 0, F.array(name(F.col("event_id") % 3)))
    return trials.acted_on(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), kind.alias("kind"), F.concat(F.lit("src/"), name(F.col("event_id") % 4)).alias("path"), files.alias("files")))


_LINE = """'{"type":"' || CASE WHEN role = 'assistant' THEN 'result' ELSE role END || '","num_turns":' || CASE WHEN turn % 5 = 0 THEN '"x"' ELSE CAST(turn AS VARCHAR) END || ',"is_error":' || CASE WHEN conv_id % 6 = 0 THEN 'true' ELSE 'false' END || ',"subtype":"' || CASE WHEN conv_id % 12 = 0 THEN 'error_max_turns' ELSE 'done' END || '","result":"ok","usage":{"input_tokens":1,"output_tokens":' || CASE WHEN conv_id % 7 = 0 THEN 'true' ELSE '2' END || '},"model":" ' || CASE WHEN turn > 0 THEN 'm' || turn ELSE '' END || '"}'"""


@query("""WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1), m AS (SELECT conv_id, arg_min('m' || turn, turn) AS model FROM conversations WHERE turn > 0 GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id AS run, CASE WHEN l.turn IS NULL THEN 'invalid_transcript' WHEN c.conv_id % 12 <> 0 AND c.conv_id % 6 = 0 THEN 'result_error' WHEN l.turn % 5 = 0 OR c.conv_id % 7 = 0 THEN 'invalid_transcript' ELSE 'ok' END AS status,
CASE WHEN l.turn IS NULL THEN 'missing terminal stream-json result' WHEN c.conv_id % 12 <> 0 AND c.conv_id % 6 = 0 THEN 'done' WHEN l.turn % 5 = 0 THEN 'terminal result has no valid num_turns' WHEN c.conv_id % 7 = 0 THEN 'terminal usage has no valid output_tokens' END AS error, m.model FROM c LEFT JOIN l USING (conv_id) LEFT JOIN m USING (conv_id)""")
def terminal_statuses(spark, d):
    """Turns as events of a transcript, those of the assistant as results; what the last result says about the run, and the first model named."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_LINE.replace("AS VARCHAR", "AS STRING")).alias("value")).select(F.col("conv_id").alias("run"), F.col("turn").alias("place"), "value")
    runs = lines.select("run").distinct().select("run", F.lit("ok").alias("status"), F.lit(True).alias("ok"), F.lit(False).alias("timed_out"), F.lit(0).alias("returncode"), F.lit(None).cast("string").alias("error"))
    return trials.with_terminal_status(runs, trials.terminal_results(lines)).join(trials.resolved_models(lines), "run", "left").select("run", "status", "error", "model")


def _measured(spark, d) -> DataFrame:
    """Events as paid and dry cells with measurements, some unsound."""
    k = F.col("event_id")
    status = F.when(k % 7 == 0, "incomplete").when(k % 11 == 0, "odd").otherwise("ok")
    m = F.struct(status.alias("status"), F.lit(2).alias("hook_events"), (k % 5 + k % 3).cast("int").alias("baseline_count"), (k % 3 + k % 4 + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("final_count"), (k % 5).cast("int").alias("resolved_count"), (k % 3).cast("int").alias("persisting_count"), (k % 4).cast("int").alias("new_final_count"))
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(k % 2 == 0, "AR").otherwise("A").alias("condition"), F.when(k % 17 == 0, "dry-run").otherwise("host").alias("runner_mode"), F.lit(3).alias("schema_version"), F.lit("ok").alias("runner_status"), F.when(k % 19 == 0, "none").otherwise("pass").alias("acceptance_verdict"), m.alias("review_findings"))


@query("""WITH e AS (SELECT event_type AS kind, event_id AS k, CASE WHEN event_id % 7 = 0 THEN 'incomplete' WHEN event_id % 11 = 0 THEN 'odd' ELSE 'ok' END AS status FROM events WHERE event_id % 2 = 0 AND event_id % 17 <> 0), s AS (SELECT *, status = 'ok' AND k % 19 <> 0 AND k % 13 <> 0 AS good FROM e)
SELECT kind, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (good) AS BIGINT) AS eligible, CAST(count(*) FILTER (NOT good) AS BIGINT) AS excluded, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS status_ok, CAST(count(*) FILTER (status = 'incomplete') AS BIGINT) AS status_incomplete, CAST(count(*) FILTER (status = 'odd') AS BIGINT) AS status_other,
CAST(sum(2) FILTER (good) AS BIGINT) AS hook_events, CAST(sum(k % 5 + k % 3) FILTER (good) AS BIGINT) AS baseline_count, CAST(sum(k % 3 + k % 4) FILTER (good) AS BIGINT) AS final_count FROM s GROUP BY kind""")
def review_totals(spark, d):
    return trials.review_totals(_measured(spark, d), ["kind"]).select("kind", "cells", "eligible", "excluded", "status_ok", "status_incomplete", "status_other", "hook_events", "baseline_count", "final_count")


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS id FROM lineitem WHERE l_linenumber = 1), f AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS id FROM lineitem WHERE l_linenumber = 2), j AS (SELECT run, b.id AS a, f.id AS c FROM b FULL JOIN f USING (run, id)),
n AS (SELECT run, count(a) AS a, count(c) AS c, count(*) FILTER (a IS NOT NULL AND c IS NULL) AS gone, count(*) FILTER (a IS NOT NULL AND c IS NOT NULL) AS stay, count(*) FILTER (a IS NULL) AS new FROM j GROUP BY 1)
SELECT s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN 'not_applicable' WHEN s_suppkey % 7 = 0 THEN 'incomplete' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN coalesce(CAST(a AS INTEGER), 0) END AS baseline_count, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN coalesce(CAST(c AS INTEGER), 0) END AS final_count,
CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN coalesce(CAST(gone AS INTEGER), 0) END AS resolved_count, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN coalesce(CAST(stay AS INTEGER), 0) END AS persisting_count, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN coalesce(CAST(new AS INTEGER), 0) END AS new_final_count FROM supplier LEFT JOIN n ON run = s_suppkey""")
def review_final_states(spark, d):
    """Suppliers as runs, first lines of orders as findings of their only commit, second ones as what is left at the end; every seventh has a commit more that nothing was captured for."""
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").cast("string").alias("id"), F.lit("dup").alias("check"), "l_linenumber")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"))
    head = lambda c: F.lit(c * 40).alias("head")
    captured = line.where("l_linenumber = 1").select("run", head("a"), "id", "check").union(s.select("run", head("a"), F.lit(None).cast("string"), F.lit(None).cast("string"))).distinct().withColumn("broken", F.lit(None).cast("string"))
    commits = s.select("run", head("a")).union(s.where("run % 7 = 0").select("run", head("b")))
    runs = s.select("run", F.when(F.col("run") % 5 == 0, "A").otherwise("AR").alias("condition"))
    return trials.final_states(runs, commits, captured, line.where("l_linenumber = 2").select("run", "id", "check")).drop("hook_events")


@query("""WITH e AS (SELECT *, 1000 + event_id % 3 AS n FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, median(n) AS m, count(*) AS k FROM e GROUP BY 1)
SELECT event_type, printf('%,.0f', CAST(any_value(m) AS DOUBLE)) || ' ± ' || printf('%.0f', CAST(median(abs(n - m)) AS DOUBLE)) || ' (n=' || any_value(k) || ')' AS shown FROM e JOIN m USING (event_type) GROUP BY 1""")
def shown_medians(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select("event_type", (1000 + F.col("event_id") % 3).alias("n"))
    return stats.median_mad(e, ["event_type"], "n").select("event_type", trials.shown_median(F.col("median"), F.col("mad"), F.col("n"), 0).alias("shown"))
