"""Maps within the documents that agents read: which documents, the block in them, what it costs, what its last line says, and how two maps differ."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symscape.functions import text
from symscape.plans.maps import END, START

#: Documents that are taken where they exist, and folders of rules that get a file of ours; the first is made where there is none.
FILES = tuple("CLAUDE.md .clinerules .cursorrules .github/copilot-instructions.md .roorules .rules .windsurfrules AGENT.md AGENTS.md CONVENTIONS.md GEMINI.md QWEN.md".split())
FOLDERS = {".clinerules": "map.md", ".continue/rules": "map.md", ".cursor/rules": "map.mdc", ".github/instructions": "map.instructions.md", ".junie": "guidelines.md", ".kiro/steering": "map.md", ".roo/rules": "map.md", ".windsurf/rules": "map.md"}
#: Front matter of new rule files: whole ends of paths count before suffixes.
SEEDS = {".continue/rules/map.md": "---\nname: project map\nalwaysApply: true\n---\n", ".mdc": "---\ndescription: project map\nalwaysApply: true\n---\n", ".instructions.md": "---\napplyTo: '**'\n---\n"}
NOTE = "Project map: files, signatures, fields and calls. Read it before searching the sources; line 2 explains its signs."
COACHING = " Before adding tests or helpers look under `? tests`; settle the findings of a review before finishing."


def candidates(spark: SparkSession) -> DataFrame:
    """(target, folder) of all documents that may carry the map, there or not; folder is that of a rule file, null for a document of its own."""
    rows = [(f, None) for f in FILES] + [(f"{d}/{n}", d) for d, n in FOLDERS.items()]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, target string, folder string")


def targets(listing: DataFrame) -> DataFrame:
    """(root, target) of the documents to carry the map in each root of a listing (root, path, is_folder); the first candidate where there is none."""
    known = F.broadcast(candidates(listing.sparkSession))
    files = listing.where("NOT is_folder").join(known.where("folder IS NULL"), F.col("path") == F.col("target"))
    folders = listing.where("is_folder").join(known.where("folder IS NOT NULL"), F.col("path") == F.col("folder"))
    found = files.select("root", "target", "place").union(folders.select("root", "target", "place")).distinct()
    roots = listing.select("root").distinct().join(found, "root", "left")
    return roots.select("root", F.coalesce("target", F.lit(FILES[0])).alias("target"), F.coalesce("place", F.lit(0)).alias("place"))


def resolved(spark: SparkSession, wanted: list[str], stored: bool) -> list[str]:
    """The documents that are meant: exact paths, or, if they aren't stored ones, names that just one candidate has."""
    names = [r.target for r in candidates(spark).orderBy("place").collect()]
    out: list[str] = []
    for w in wanted:
        fit = [n for n in names if n == w] or [n for n in names if not stored and n.rsplit("/", 1)[-1] == w]
        if len(fit) != 1:
            raise ValueError(f"{'invalid stored' if stored else 'ambiguous' if fit else 'unknown'} target: {w}; candidates: {', '.join(names)}")
        out += [n for n in fit if n not in out]
    return sorted(out)


def seed(path: Column) -> Column:
    """What a new file at a path begins with."""
    out = F.lit("")
    for end, front in reversed(SEEDS.items()):
        out = F.when(F.endswith(F.concat(F.lit("/"), path), F.lit(("/" if "/" in end else "") + end)), front).otherwise(out)
    return out


def block(body: Column, coaching: bool = True) -> Column:
    return F.concat(F.lit(f"{START}\n{NOTE}{COACHING if coaching else ''}\n\n```\n"), F.rtrim(body, F.lit(" \t\r\n")), F.lit(f"\n```\n{END}"))


def cost(body: Column, coaching: bool = True) -> Column:
    """struct(digest, wrapper, coaching, whole) in tokens; the parts always sum to the whole."""
    bare = F.rtrim(body, F.lit(" \t\r\n"))
    digest, plain, whole = (text.token_estimate(x) for x in (F.concat(bare, F.lit("\n")), block(bare, False), block(bare, coaching)))
    return F.struct(digest.alias("digest"), (plain - digest).alias("wrapper"), (whole - plain).alias("coaching"), whole.alias("whole"))


def _span(existing: Column) -> tuple[Column, Column]:
    """Where the block begins and ends, counted from 1; 0 where there is none. The end is looked for behind the beginning."""
    a = F.locate(START, existing)
    b = F.when(a > 0, F.position(F.lit(END), existing, a + len(START))).otherwise(0)
    return F.when(b > 0, a).otherwise(0), F.when(b > 0, b + len(END)).otherwise(0)


def with_block(existing: Column, path: Column, body: Column) -> Column:
    """A document, null if it is new, with the map in its block, or behind its text."""
    old = F.coalesce(existing, seed(path))
    a, b = _span(old)
    front = F.rtrim(old, F.lit("\n"))
    return F.when(b > 0, F.concat(F.substring(old, F.lit(1), a - 1), block(body), F.substring(old, b, F.lit(1 << 30)))).otherwise(F.concat(front, F.when(F.trim(F.replace(old, F.lit("\n"))) == "", "").otherwise("\n\n"), block(body), F.lit("\n")))


def loaded(existing: Column) -> Column:
    """struct(digest, wrapper, coaching, whole) in tokens of the block that a document has; nulls where there is none. Coaching counts where today's sentence stands in it."""
    a, b = _span(existing)
    whole = F.when(b > 0, F.substring(existing, a, b - a))
    body = F.nullif(F.regexp_extract(whole, r"(?s)```\n(.*?)\n```", 1), F.lit(""))
    total, digest = text.token_estimate(whole), text.token_estimate(body)
    extra = F.when(F.contains(whole, F.lit(COACHING)), total - text.token_estimate(F.replace(whole, F.lit(COACHING)))).otherwise(0)
    ok = body.isNotNull()
    return F.struct(F.when(ok, digest).alias("digest"), F.when(ok, total - digest - extra).alias("wrapper"), F.when(ok, extra).alias("coaching"), F.when(ok, total).alias("whole"))


def settings(body: Column) -> Column:
    """struct(langs, targets, budget, state) that the last line of a map states; nulls for what it doesn't. Only the last line counts, as facts may hold the same words."""
    last = F.element_at(F.filter(F.split(body, text.LINE_END), lambda x: F.trim(x) != ""), -1)
    get = lambda p: F.when(last.rlike(r"^· [\d,]+ LOC(?: ·|$)"), F.nullif(F.regexp_extract(last, p, 1), F.lit("")))
    return F.struct(F.array_sort(F.split(get(r"· langs ([\w,]+)"), ",")).alias("langs"), F.transform(F.split(get(r"· targets ([^·\n]+)"), ","), lambda x: F.trim(x)).alias("targets"), get(r"· budget (\d+)").cast("int").alias("budget"), get(r"· state (\w{12})").alias("state"))


def facts_of(body: Column) -> Column:
    """The lines of a map without its title, its legend and its last line."""
    lines = F.split(F.regexp_replace(body, r"\n+$", ""), "\n")
    return F.filter(F.slice(lines, 3, 1 << 30), lambda x: ~x.rlike(r"^· [\d,]+ LOC(?: ·|$)"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unified(old: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
    each = zip(old, new, name, strict=True)
    return pd.Series([None if a is None or b is None else list(difflib.unified_diff(list(a), list(b), fromfile=n, tofile="worktree", lineterm="")) for a, b, n in each], dtype=object)


def difference(old: Column, new: Column, revision: Column) -> Column:
    """How two maps' facts differ, as lines of a unified diff; none for equal ones."""
    return _unified(facts_of(old), facts_of(new), revision)


def too_large(body: Column, threshold: int = 25_000, managed: bool = False) -> Column:
    """Whether a map, or the block with it, is above the size to warn at."""
    return (cost(body)["whole"] if managed else text.token_estimate(body)) > threshold
