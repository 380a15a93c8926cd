"""Reports over experiment logs: newest attempts, grouped percentages and medians, matched pairs, transcripts, payload scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symscape.operators import names, stats
from symscape.schemas import RUNS

GROUP = ("condition", "kind", "model", "effort", "experiment_id")
METRICS = ("reads", "files_read", "searches", "edits", "turns", "tokens_in", "tokens_out", "runner_duration_seconds")
CONTROL, SCHEMA_VERSION = "B", 3


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines with the fixed schema and their place, which orders them by file name and within each file; blank lines are skipped and a broken one ends the read."""
    rows = spark.read.schema(RUNS).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))


def latest_cells(runs: DataFrame) -> DataFrame:
    """The last attempt of each cell in the order of place; rows without a cell are told apart by task, condition, repetition and settings."""
    key = F.coalesce("cell_id", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("task", "condition", "rep", "model", "effort", "kind", "experiment_id")]))
    return runs.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("place")))).where("k = 1").drop("k")


def infra_reason() -> Column:
    """Why a row says nothing about its condition; null for valid rows."""
    runner = F.when(~F.coalesce("runner_status", F.lit("ok")).isin("ok", "completed"), F.concat(F.lit("runner:"), "runner_status"))
    return F.coalesce(runner, F.when(F.col("acceptance_status") == "infra", F.lit("acceptance:infra")))


def _accepted() -> tuple[Column, Column]:
    new = F.coalesce("schema_version", F.lit(0)) == SCHEMA_VERSION
    applies = ~F.coalesce("manual_only", F.lit(False)) & F.when(new, F.coalesce("acceptance_verdict", F.lit("")).isin("pass", "fail")).otherwise(F.col("accepted").isNotNull())
    return F.when(new, F.col("acceptance_verdict") == "pass").otherwise(F.col("accepted")), applies


def summary(runs: DataFrame) -> DataFrame:
    """A row for each group: valid and invalid cells, percentages with their own denominators, median and median absolute deviation of all metrics."""
    keys = list(GROUP)
    cells = latest_cells(runs).withColumns({c: F.coalesce(F.col(c), F.lit("—")) for c in keys}).withColumn("reason", infra_reason())
    ok, applies = _accepted()
    reuse = ~F.coalesce("manual_only", F.lit(False)) & F.coalesce("reuse_judged", F.col("kind") == "reuse", F.lit(False))
    flags = {"accepted": (ok, applies), "scope_ok": (F.col("scope_ok"), F.col("scope_ok").isNotNull()), "answer_ok": (F.col("answer_ok"), F.col("answer_ok").isNotNull()), "reused": (F.size("reused") > 0, reuse), "duplicated": (F.size("duplicated") > 0, reuse)}
    held = {k: F.when(a & v.isNotNull() & F.col("reason").isNull(), F.when(v, 100.0).otherwise(0.0)) for k, (v, a) in flags.items()}
    counts = cells.groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count("reason").alias("invalid"), *[x for k, h in held.items() for x in (F.round(F.avg(h), 4).alias(f"{k}_percent"), F.count(h).alias(f"{k}_n"))])
    # Metrics as rows: one plan for all of them, however many there are.
    long = cells.where("reason IS NULL").select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS])).alias("m")).select(*keys, "m.*").where("x IS NOT NULL")
    spread = stats.median_mad(long, [*keys, "metric"], "x", 12)
    metrics = spread.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("median", "mad", "n"))))).alias("metrics"))
    return counts.join(metrics, keys, "left")


def matched(runs: DataFrame, control: str = CONTROL) -> DataFrame:
    """(pair_id, treatment, reason, deltas): each treatment minus its pair's control, or why they can't be compared."""
    cells = latest_cells(runs).where("pair_id IS NOT NULL").withColumn("reason", infra_reason())
    side = lambda df, p: df.select("pair_id", F.col("condition").alias(f"{p}_condition"), F.col("reason").alias(f"{p}_reason"), F.col("wave_id").alias(f"{p}_wave"), F.coalesce("resolved_model", "model").alias(f"{p}_model"), *[F.col(m).cast("double").alias(f"{p}_{m}") for m in METRICS])
    both = side(cells.where(F.col("condition") != control), "t").join(side(cells.where(F.col("condition") == control), "c"), "pair_id", "left")
    reason = F.when(F.col("c_condition").isNull(), "no control").when(F.col("t_reason").isNotNull() | F.col("c_reason").isNotNull(), "infrastructure").when(~F.col("t_wave").eqNullSafe(F.col("c_wave")), "other wave").when(~F.col("t_model").eqNullSafe(F.col("c_model")), "other model")
    deltas = F.when(reason.isNull(), F.struct(*[(F.col(f"t_{m}") - F.col(f"c_{m}")).alias(m) for m in METRICS]))
    return both.select("pair_id", F.col("t_condition").alias("treatment"), reason.alias("reason"), deltas.alias("deltas"))




def transcript_metrics(lines: DataFrame) -> DataFrame:
    """(run, reads, searches, edits, files_read, turns, tokens_in, tokens_out) of transcripts (run, place, value), one JSON object a line; other lines are ignored."""
    block = "array<struct<type: string, name: string, id: string, input: struct<command: string, file_path: string>>>"
    events = lines.select("run", "place", F.from_json("value", "type string, message struct<content: string>, num_turns int, result string, usage struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>").alias("e")).where("e.type IS NOT NULL")
    uses = events.where("e.type = 'assistant'").select("run", F.explode(F.from_json("e.message.content", block)).alias("b")).where("b.type = 'tool_use'").select("run", F.col("b.name").alias("tool"), F.col("b.input.file_path").alias("path"), F.coalesce("b.input.command", F.lit("")).alias("command"))
    shell = F.col("tool") == "Bash"
    search = F.col("tool").isin("Grep", "Glob") | shell & F.col("command").rlike(r"\b(ag|fd|find|grep|rg)\b")
    read = (F.col("tool") == "Read") | shell & ~search & F.col("command").rlike(r"\b(cat|head|less|more|sed -n|tail)\b")
    tools = uses.groupBy("run").agg(F.count_if(read).alias("reads"), F.count_if(search).alias("searches"), F.count_if(F.col("tool").isin("Edit", "Write", "NotebookEdit")).alias("edits"), F.countDistinct(F.when(F.col("tool") == "Read", F.col("path"))).alias("files_read"))
    last = events.where("e.type = 'result'").groupBy("run").agg(F.max_by("e", "place").alias("e"))
    n = lambda c: F.coalesce(F.col(f"e.usage.{c}"), F.lit(0))
    total = last.select("run", F.coalesce("e.num_turns", F.lit(0)).alias("turns"), (n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")).alias("tokens_in"), n("output_tokens").alias("tokens_out"))
    return lines.select("run").distinct().join(tools, "run", "left").join(total, "run", "left").na.fill(0)


def private_paths(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows of files (path, ...) below one of the directories, anywhere in the path."""
    clean = F.ltrim(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^[./]+", ""))
    hit = F.lit(False)
    for p in prefixes:
        p = p.strip("/")
        hit = hit | F.concat(F.lit("/"), clean, F.lit("/")).contains(f"/{p}/")
    return files.where(hit)


def denied_payloads(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, entry) wherever a file (path, raw) holds a term (entry, term), whatever the case; bytes are compared one by one."""
    plain = files.select("path", F.decode("raw", "ISO-8859-1").alias("payload"))
    return names.contained_terms(plain, "path", "payload", terms.select("entry", F.decode(F.encode("term", "UTF-8"), "ISO-8859-1").alias("term")), "entry", "term")
