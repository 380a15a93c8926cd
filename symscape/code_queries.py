"""The code operators bound to sources made from the table supplier: a module for each, whose function calls the next one's and that of twice its number.

The old snapshot has all suppliers; in the new one those with debts have an argument more, and those of nation 7 are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.operators import code, graph, review
from symscape.plans import experiments, maps
from symscape.queries import query, table
from symscape.sources import repository

#: Calls of the made sources, for all suppliers.
_CALLS = """SELECT s_suppkey AS k, s_suppkey + 1 AS t FROM supplier WHERE s_suppkey % 10 <> 0 UNION SELECT s_suppkey, s_suppkey * 2 FROM supplier WHERE s_suppkey % 10 <> 0"""
_KNOWN = f"SELECT k, t FROM ({_CALLS}) WHERE t IN (SELECT s_suppkey FROM supplier)"


def sources(spark, d, snapshot: str = "old") -> DataFrame:
    """(snapshot, path, lang, raw, text)."""
    s = table(spark, d, "supplier").where("s_nationkey <> 7" if snapshot == "new" else "true")
    name = lambda k: F.concat(F.lit("supply_"), k.cast("string"))
    k = F.col("s_suppkey")
    extra = F.when(F.lit(snapshot == "new") & (F.col("s_acctbal") < 0), ", debt: int").otherwise("")
    calls = F.when(k % 10 != 0, F.concat(F.lit("    "), name(k + 1), F.lit("(n)\n    "), name(k * 2), F.lit("(n)\n"))).otherwise("")
    body = F.concat(F.lit("def "), name(k), F.lit("(n: int"), extra, F.lit(") -> int:\n"), calls, F.lit("    return n\n"))
    path = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py"))
    return repository.files_of(s.select(path.alias("path"), body.cast("binary").alias("raw")), snapshot)


def facts(spark, d, *snapshots: str) -> DataFrame:
    both = None
    for s in snapshots or ("old",):
        both = sources(spark, d, s) if both is None else both.unionByName(sources(spark, d, s))
    return graph.written(code.with_facts(repository.symbols(both)), "facts")


def _names(df: DataFrame, f: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(f.select("snapshot", F.col("sym").alias(c), F.col("name").alias(f"{c}_name")), ["snapshot", c])
    return df


@query("SELECT 'supply_' || s_suppkey AS name, 'n' || s_nationkey || '/m' || s_suppkey || '.py' AS file, 'supply_' || s_suppkey || '(int):int' AS signature, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 4 END AS INTEGER) AS size FROM supplier")
def code_symbols(spark, d):
    return repository.symbols(sources(spark, d)).select("name", "file", "signature", "size")


@query(f"SELECT 'supply_' || k AS caller, 'supply_' || t AS target FROM ({_KNOWN})")
def code_calls(spark, d):
    f = facts(spark, d)
    return _names(code.edges(f), f, "caller", "target").select(F.col("caller_name").alias("caller"), F.col("target_name").alias("target"))


@query(f"""WITH RECURSIVE e AS ({_KNOWN}), r AS (SELECT k, t FROM e UNION SELECT r.k, e.t FROM r JOIN e ON r.t = e.k)
SELECT 'supply_' || k AS caller, 'supply_' || t AS target FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.k = e.k AND o.t <> e.t AND (o.t, e.t) IN (SELECT (k, t) FROM r) AND (e.t, o.t) NOT IN (SELECT (k, t) FROM r))""")
def code_displayed_calls(spark, d):
    f = facts(spark, d)
    return _names(code.displayed_edges(f, graph.written(code.edges(f), "calls")), f, "caller", "target").select(F.col("caller_name").alias("caller"), F.col("target_name").alias("target"))


@query(f"SELECT 'supply_' || s_suppkey AS name FROM supplier WHERE s_suppkey NOT IN (SELECT t FROM ({_CALLS}))")
def code_zero_usage(spark, d):
    return code.zero_usage(facts(spark, d), repository.tokens(sources(spark, d))).select("name")


@query(f"SELECT 'supply_' || t AS name, CAST(count(DISTINCT k) AS BIGINT) AS files FROM ({_KNOWN}) GROUP BY t")
def code_fan_in(spark, d):
    f = facts(spark, d)
    return _names(code.fan_in(f, code.edges(f)), f, "sym").select(F.col("sym_name").alias("name"), "files")


_BODY = "'def supply_' || s_suppkey || '(n: int) -> int:' || chr(10) || CASE WHEN s_suppkey % 10 <> 0 THEN '    supply_' || (s_suppkey + 1) || '(n)' || chr(10) || '    supply_' || (s_suppkey * 2) || '(n)' || chr(10) ELSE '' END || '    return n' || chr(10)"


@query(f"SELECT 'old' AS snapshot, substr(md5(unhex(string_agg(hex('n' || s_nationkey || '/m' || s_suppkey || '.py') || md5({_BODY}), '' ORDER BY 'n' || s_nationkey, 'm' || s_suppkey || '.py'))), 1, 12) AS state FROM supplier")
def code_state(spark, d):
    return code.state_hash(sources(spark, d))


_TOOL = """'{"type":"' || CASE WHEN turn % 7 = 0 THEN 'result' ELSE 'assistant' END || '","num_turns":' || turn || ',"usage":{"input_tokens":' || turn || ',"output_tokens":2,"cache_read_input_tokens":3},"message":{"content":[{"type":"tool_use","id":"x","name":"' || CASE turn % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' ELSE 'Grep' END || '","input":{"file_path":"f' || turn % 8 || '","command":"' || CASE WHEN turn % 8 = 1 THEN 'cat x' ELSE 'rg y | head' END || '"}}]}}'"""


@query("""WITH t AS (SELECT *, turn % 7 = 0 AS result FROM conversations), l AS (SELECT conv_id, max(turn) AS turn FROM t WHERE result GROUP BY 1)
SELECT conv_id AS run, CAST(count(*) FILTER (NOT result AND (t.turn % 4 = 0 OR t.turn % 8 = 1)) AS BIGINT) AS reads, CAST(count(*) FILTER (NOT result AND (t.turn % 4 = 3 OR t.turn % 8 = 5)) AS BIGINT) AS searches, CAST(count(*) FILTER (NOT result AND t.turn % 4 = 2) AS BIGINT) AS edits, CAST(count(DISTINCT t.turn % 8) FILTER (NOT result AND t.turn % 4 = 0) AS BIGINT) AS files_read,
CAST(coalesce(any_value(l.turn), 0) AS INTEGER) AS turns, CAST(coalesce(any_value(l.turn + 3), 0) AS BIGINT) AS tokens_in, CAST(CASE WHEN any_value(l.turn) IS NULL THEN 0 ELSE 2 END AS BIGINT) AS tokens_out FROM t LEFT JOIN l USING (conv_id) GROUP BY 1""")
def transcript_metrics(spark, d):
    """Turns as events of a transcript: tools that the assistant uses, and results that state what a run took."""
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("place"), F.expr(_TOOL).alias("value"))
    return experiments.transcript_metrics(lines)


@query("SELECT 'supply_' || s_suppkey AS name, CASE WHEN s_nationkey = 7 THEN 'removed' ELSE 'changed' END AS change FROM supplier WHERE s_nationkey = 7 OR s_acctbal < 0")
def code_api_changes(spark, d):
    return review.api_changes(facts(spark, d, "old", "new")).select("name", "change")


@query()
def code_review(spark, d):
    f = facts(spark, d, "old", "new")
    tokens = repository.tokens(sources(spark, d, "old").unionByName(sources(spark, d, "new")))
    return review.review(f, graph.written(code.edges(f), "calls"), graph.written(tokens, "tokens"))


@query()
def code_map(spark, d):
    f = facts(spark, d)
    return maps.build(sources(spark, d), f, graph.written(code.edges(f), "calls"), repository.tokens(sources(spark, d)))


@query()
def code_map_under_budget(spark, d):
    f = facts(spark, d)
    return maps.build(sources(spark, d), f, graph.written(code.edges(f), "calls"), repository.tokens(sources(spark, d)), budget=400)


def _runs(spark, d) -> DataFrame:
    """events as a log: users are pairs, the kinds of events conditions."""
    from symscape.schemas import RUNS

    e = table(spark, d, "events").where("event_type IN ('view', 'purchase')")
    made = {"cell_id": F.concat_ws("-", "user_id", "event_type"), "pair_id": F.col("user_id").cast("string"), "condition": F.when(F.col("event_type") == "view", "B").otherwise("A"), "reads": F.floor("value").cast("int"), "turns": (F.col("event_id") % 20).cast("int"), "runner_status": F.when(F.col("event_id") % 9 == 0, "timeout").otherwise("ok"), "wave_id": F.lit("w")}
    columns = [(f.strip().split(" ")[0], f.strip().split(" ", 1)[1]) for f in RUNS.split(", ")]
    return e.select(*[(made[c] if c in made else F.lit(None)).cast(t).alias(c) for c, t in columns], F.col("event_id").alias("place"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, floor(value) AS reads, event_id % 9 = 0 AS bad FROM events WHERE event_type IN ('view', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
v AS (SELECT event_type, median(reads) AS m, count(reads) AS n FROM r WHERE NOT bad GROUP BY 1)
SELECT CASE r.event_type WHEN 'view' THEN 'B' ELSE 'A' END AS condition, CAST(count(*) FILTER (NOT bad) AS BIGINT) AS valid, CAST(count(*) FILTER (bad) AS BIGINT) AS invalid, round(any_value(m), 6) AS reads_median, round(median(abs(reads - m)) FILTER (NOT bad), 6) AS reads_mad FROM r LEFT JOIN v USING (event_type) GROUP BY 1""")
def experiment_summary(spark, d):
    m = lambda x: F.round(F.col("metrics")["reads"][x], 6).alias(f"reads_{x}")
    return experiments.summary(_runs(spark, d)).select("condition", "valid", "invalid", m("median"), m("mad"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, floor(value) AS reads, event_id % 9 = 0 AS bad FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT CAST(t.user_id AS VARCHAR) AS pair_id, CASE WHEN c.user_id IS NULL THEN 'no control' WHEN t.bad OR c.bad THEN 'infrastructure' END AS reason, CASE WHEN c.user_id IS NOT NULL AND NOT t.bad AND NOT c.bad THEN CAST(t.reads - c.reads AS DOUBLE) END AS reads FROM (SELECT * FROM r WHERE event_type = 'purchase') t LEFT JOIN (SELECT * FROM r WHERE event_type = 'view') c USING (user_id)""")
def experiment_pairs(spark, d):
    return experiments.matched(_runs(spark, d)).select("pair_id", "reason", F.col("deltas.reads").alias("reads"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, d):
    from symscape.streaming.incremental import event_windows as windows

    return windows(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
