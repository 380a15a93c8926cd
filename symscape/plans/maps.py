"""A compact text map of a corpus, whole or under a token budget.

All facts are joined in Spark, once; text is put together by one grouped step for each snapshot, whose input has a row for each
declaration. Levels of what a budget leaves out need no further jobs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symscape.functions import paths, text
from symscape.operators import code
from symscape.plans import budget as select
from symscape.schemas import CALLABLE_KINDS, TYPE_KINDS

#: Order of what competes for room at equal rank.
CATEGORIES = ("chain", "method", "constant", "test", "private", "type")
LETTERS = {k: k[0].upper() for k in TYPE_KINDS}
LEGEND = "K(..) type by letter  :supers  ←implementors  ✓ tested  ×0 no reference  > calls  = constants  - private  ? tests"
MOST_IMPLEMENTORS = 6


def facts_of_lines(facts: DataFrame, calls: DataFrame, tokens: DataFrame) -> DataFrame:
    """facts with tested, zero, called_from, implementors and chain (descriptions of the displayed calls, in order)."""
    shown = code.displayed_edges(facts, calls)
    names = code.described(facts).select("snapshot", F.col("sym").alias("target"), "description")
    chain = shown.join(names, ["snapshot", "target"]).groupBy("snapshot", F.col("caller").alias("sym")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]).alias("chain"))
    tested = code.tested(facts, calls).withColumn("tested", F.lit(True))
    zero = code.zero_usage(facts, tokens).withColumn("zero", F.lit(True))
    fan = code.fan_in(facts, calls).withColumnRenamed("files", "called_from")
    out = facts.join(chain, ["snapshot", "sym"], "left").join(tested, ["snapshot", "sym"], "left").join(zero, ["snapshot", "name"], "left").join(fan, ["snapshot", "sym"], "left")
    return out.join(code.implementors(facts), ["snapshot", "lang", "name"], "left")


def _list(sign: str, c: Column) -> Column:
    return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(sign), F.array_join(c, ","))).otherwise("")


def lines(full: DataFrame) -> DataFrame:
    """(snapshot, path, ordinal, category, tier, essential, head, chain, called_from): head is a declaration's line, chain what follows it where there is room."""
    letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    arguments = F.when(F.col("kind").isin(*TYPE_KINDS), F.concat(F.lit("("), F.try_element_at(letter, F.col("kind")), F.when(F.size("params") > 0, F.concat(F.lit("{"), F.array_join("params", ","), F.lit("}"))).otherwise(""), F.lit(")"))).otherwise(text.api_signature(F.col("params"), F.when(F.coalesce("returns", F.lit("")).isin("void", "None", "Unit"), F.lit("")).otherwise(F.col("returns"))))
    few = F.when(F.size("implementors") > MOST_IMPLEMENTORS, F.concat(F.lit(" ←"), F.size("implementors").cast("string"))).otherwise(_list(" ←", F.col("implementors")))
    marks = F.concat(F.when(F.col("tested"), " ✓").otherwise(""), F.when(F.col("zero") & F.col("prod"), " ×0").otherwise(""))
    raised = _list(" !", F.transform("raises", text.without_exception_suffix))
    head = F.concat("name", arguments, _list(" @", code.decorator_notes()), _list(" :", F.col("supers")), _list(" sealed:", F.col("permits")), few, raised, marks)
    test = F.col("suite") | F.col("test_case")
    category = F.when(test, "test").when(F.col("kind") == "const", "constant").when(F.col("visibility") == "priv", "private").when(F.col("kind").isin(*CALLABLE_KINDS, "ctor"), "method").otherwise("type")
    line = F.when(test, F.concat(F.lit("? "), "name")).when(F.col("kind") == "const", F.concat(F.lit("= "), "signature")).when(F.col("visibility") == "priv", F.concat(F.lit("- "), "name")).when(F.coalesce("container", F.lit("")) != "", F.concat("container", F.lit("."), head)).otherwise(head)
    shown = full.where("(prod OR suite OR test_case) AND kind <> 'reexport'")
    called = F.coalesce("called_from", F.lit(0))
    tier = F.when(category == "method", F.when(called > 0, 1).otherwise(2)).when(category.isin("constant", "test"), 2).when(category == "private", F.when(F.coalesce("zero", F.lit(False)), 4).otherwise(3)).otherwise(0)
    essential = (category == "type") | F.col("invoked") & F.col("kind").isin(*CALLABLE_KINDS)
    return shown.select("snapshot", F.col("file").alias("path"), "ordinal", category.alias("category"), tier.alias("tier"), essential.alias("essential"), line.alias("head"), F.when(category == "method", _list(" > ", F.col("chain"))).otherwise("").alias("chain"), called.alias("called_from"), F.coalesce("tested", F.lit(False)).alias("tested"))


def bundles(rows: DataFrame) -> DataFrame:
    """The units that a budget keeps or drops, in the order in which they are tried: by tier, then in turn from all files."""
    base = rows.withColumn("n", F.length("head") + 1)
    chains = base.where("chain <> ''").select("snapshot", "path", "ordinal", F.lit("chain").alias("category"), F.when(F.col("tested") | (F.col("called_from") > 0), 0).otherwise(2).alias("tier"), F.lit(False).alias("essential"), F.length("chain").alias("n"), "called_from")
    every = base.select("snapshot", "path", "ordinal", "category", "tier", "essential", "n", "called_from").unionByName(chains)
    order = F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORIES) for x in (c, k)])
    w = Window.partitionBy("snapshot", "tier", "path").orderBy(F.desc("called_from"), "n", F.element_at(order, F.col("category")), "ordinal")
    return every.withColumn("turn", F.row_number().over(w))


def corpus_size(files: DataFrame) -> DataFrame:
    return files.groupBy("snapshot").agg(F.sum(text.line_count(F.col("text"))).alias("loc"), F.sum(text.token_estimate(F.col("text"))).alias("input"))


def _footer(loc: int, given: int, state: str, body: str, budget: int | None) -> str:
    """The last line states the size of the whole output, itself included."""
    out = 0
    for _ in range(8):
        line = f"· {loc} LOC · input {given} · output {out} tokens · state {state}" + (f" · budget {budget}" if budget else "")
        now = (len(body) + len(line) + 3) // 4
        if now == out:
            break
        out = max(out, now)
    return line


def _by_file(rows: pd.DataFrame) -> list[tuple[str, list[tuple]]]:
    """(path, (ordinal, category, essential, head, chain) in order) for each file, in order."""
    listed: dict[str, list[tuple]] = {}
    for r in rows.sort_values("ordinal").itertuples():
        listed.setdefault(r.path, []).append((r.ordinal, r.category, r.essential, r.head, r.chain))
    return sorted(listed.items(), key=lambda x: x[0].split("/"))


def _shown(files: list[tuple[str, list[tuple]]]) -> Callable[[set[tuple[str, int, str]]], list[tuple[str, list[tuple]]]]:
    """keep -> the files, in order, that have something essential or kept, so that a trial doesn't go through all files."""
    place = {path: k for k, (path, _) in enumerate(files)}
    always = {k for k, (_, own) in enumerate(files) if any(essential for _, _, essential, _, _ in own)}
    return lambda keep: [files[k] for k in sorted(always | {place[path] for path, _, _ in keep})]


def _put_together(files: list[tuple[str, list[tuple]]], keep: set[tuple[str, int, str]] | None) -> str:
    parts: list[str] = []
    for path, own in files:
        kept = [head + (chain if keep is None or (path, k, "chain") in keep else "") for k, category, essential, head, chain in own if keep is None or essential or (path, k, category) in keep]
        if kept:
            parts += [path + ":", *[" " + x for x in kept]]
    return "\n".join(["# map", LEGEND, *parts, ""])


def build(files: DataFrame, facts: DataFrame, calls: DataFrame, tokens: DataFrame, budget: int | None = None) -> DataFrame:
    """(snapshot, text, tokens, kept, dropped, over, stats): the map of each snapshot. Under a budget what is essential stays, and the rest is admitted by its rank as long as the whole map fits; stats is the decision as JSON."""
    if budget is not None and budget < 0:
        raise ValueError("a budget isn't negative")
    rows = lines(facts_of_lines(facts, calls, tokens))
    units = bundles(rows)
    meta = corpus_size(files).join(code.state_hash(files), "snapshot")
    a = rows.select("snapshot", "path", "ordinal", "category", "essential", "head", "chain", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("turn"))
    b = units.select("snapshot", "path", "ordinal", "category", "essential", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("chain"), "tier", "turn")

    def one(table: pd.DataFrame) -> pd.DataFrame:
        mine, tried = table[table["head"].notna()], table[table["head"].isna()]
        snapshot, loc, given, state = (table[c].iloc[0] for c in ("snapshot", "loc", "input", "state"))
        by_file = _by_file(mine)
        category = dict(zip(zip(mine.path, mine.ordinal, strict=True), mine.category, strict=True))
        tried = tried.sort_values(["tier", "turn", "path", "ordinal"])
        order = [(r.path, r.ordinal, r.category) for r in tried.itertuples() if not r.essential]
        name = lambda f: f"{f[2]}:{f[0]}#{f[1]}"
        known = {name((r.path, r.ordinal, r.category)): (r.category, f"tier {r.tier}") for r in tried.itertuples()}
        floor_names = {name((r.path, r.ordinal, r.category)) for r in tried.itertuples() if r.essential}

        shown = _shown(by_file)

        def whole(keep) -> str:
            body = _put_together(by_file if keep is None else shown(keep), keep)
            return body + _footer(int(loc), int(given), state, body, budget)

        full = whole(None)
        if not budget or select.tokens(full) <= budget:
            text, stats = full, select.statistics(budget, full, full, whole(set()), "full", known, set(known), stop="full-fits" if budget else "unlimited")
        else:
            floor = whole(set())
            if select.tokens(floor) > budget:  # nothing whole fits: the smallest is given as it is
                text = (full, floor)[select.smallest([full, floor])]
                stats = select.statistics(budget, full, text, floor, "minimum", known, set(known) if text is full else floor_names, stop="minimum")
            else:
                # A chain needs the line that it stands on.
                found = select.search(floor, order, lambda f: {f, (*f[:2], category[f[:2]])}, lambda keep: whole(set(keep)), budget)
                text = found.text
                stats = select.statistics(budget, full, text, floor, f"adaptive:{len(found.kept)}/{len(order)}", known, floor_names | {name(f) for f in found.kept}, found)
        size = select.tokens(text)
        return pd.DataFrame([(snapshot, text, size, len(stats["retained_bundles"]), len(stats["dropped_bundles"]), bool(budget and size > budget), json.dumps(stats, sort_keys=True))], columns=["snapshot", "text", "tokens", "kept", "dropped", "over", "stats"])

    return a.unionByName(b).join(meta, "snapshot").groupBy("snapshot").applyInPandas(one, "snapshot string, text string, tokens long, kept long, dropped long, over boolean, stats string")


def landmarks(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(snapshot, file, name, rank, omitted): the three first public production declarations of each file by calls, size and fan-in."""
    fan = code.fan_in(facts, calls)
    shown = facts.where("prod AND visibility = 'pub'").join(fan, ["snapshot", "sym"], "left")
    first = F.when(F.col("invoked") | F.col("name").isin("main", "cli"), 0).otherwise(1)
    w = Window.partitionBy("snapshot", "file")
    order = [first, -F.size("calls"), -F.col("size"), -F.coalesce("files", F.lit(0)), F.when(F.col("kind").isin(*CALLABLE_KINDS), 0).otherwise(1), F.col("line"), F.col("name")]
    return shown.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(w) - 3, F.lit(0))).where("rank <= 3").select("snapshot", "file", "name", "rank", "omitted")


# --- the map within a document

START, END = "<!-- map:start -->", "<!-- map:end -->"


def embedded(existing: str, body: str) -> str:
    """existing with the map between its markers, or appended after a blank line."""
    block = f"{START}\n```\n{body.rstrip()}\n```\n{END}"
    a = existing.find(START)
    b = existing.find(END, a + len(START)) if a >= 0 else -1
    if b >= 0:
        return existing[:a] + block + existing[b + len(END) :]
    return ("" if existing.isspace() or not existing else existing.rstrip("\n") + "\n\n") + block + "\n"


def stripped(existing: str) -> str:
    a = existing.find(START)
    b = existing.find(END, a + len(START)) if a >= 0 else -1
    return existing if b < 0 else existing[:a].rstrip("\n") + ("\n" if existing[:a].strip() else "") + existing[b + len(END) :].lstrip("\n")


def embedded_map(existing: Column) -> Column:
    """The first fenced text within the markers; empty where there is none."""
    return F.regexp_extract(existing, rf"(?s){START}.*?```[^\n]*\n(.*?)\n```.*?{END}", 1)


def map_metadata(body: Column) -> Column:
    """struct(loc, state, budget) of a map's last line that isn't blank; nulls where it is no footer."""
    last = F.element_at(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), -1)
    get = lambda p: F.when(last.rlike(r"^· [\d,]+ LOC"), F.nullif(F.regexp_extract(last, p, 1), F.lit("")))
    return F.struct(get(r"^· ([\d,]+) LOC").cast("long").alias("loc"), get(r"· state (\w{12})").alias("state"), get(r"· budget (\d+)").cast("int").alias("budget"))


def is_fresh(files: DataFrame, maps: DataFrame) -> DataFrame:
    """(snapshot, fresh) for maps (snapshot, text): whether the state that the map states is that of the files."""
    return code.state_hash(files).join(maps.select("snapshot", map_metadata(F.col("text"))["state"].alias("stated")), "snapshot", "left").select("snapshot", F.coalesce(F.col("state") == F.col("stated"), F.lit(False)).alias("fresh"))
