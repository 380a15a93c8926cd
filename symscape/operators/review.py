"""What changed between two snapshots of a corpus, as advisory findings (id, check, kind, subject, path, detail).

facts holds both snapshots, 'old' and 'new'; calls and tokens likewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symscape.functions import paths, text
from symscape.operators import code, names, stats, support
from symscape.schemas import CALLABLE_KINDS, TYPE_KINDS

CHECKS = tuple("dup recover dead orphan api place".split())
COMMON_NAMES = "main toString equals hashCode close run setUp tearDown __init__ __str__ __repr__ get set build".split()
SIMILAR, SHORTEST, MOST_DUPLICATES, LEAST_MASS, MOST_NAMES = 0.7, 5, 10, 3, 8


def _owner() -> Column:
    return F.coalesce("container", F.lit("")).alias("owner")


def _made(df: DataFrame, check: str, kind: Column, subject: Column, path: Column, detail: Column, discriminator: Column) -> DataFrame:
    found = df.select(F.lit(check).alias("check"), kind.alias("kind"), subject.alias("subject"), path.alias("path"), detail.alias("detail"), discriminator.alias("d"))
    return found.select(text.finding_id(F.col("check"), F.col("kind"), F.col("subject"), F.col("path"), F.col("d")).alias("id"), "check", "kind", "subject", "path", "detail")


def _identity(prefix: str = "") -> Column:
    c = lambda x: F.col(prefix + x)
    return F.concat_ws("|", c("lang"), c("file"), c("owner"), c("name"), c("kind"))


def of(facts: DataFrame, snapshot: str) -> DataFrame:
    return facts.where(F.col("snapshot") == snapshot).withColumn("owner", _owner())


def api(facts: DataFrame) -> DataFrame:
    """(snapshot, lang, file, owner, name, surface): the distinct public shapes of each name, in order."""
    shown = facts.where(F.col("prod") & (F.col("visibility") == "pub") & F.col("kind").isin(*TYPE_KINDS, *CALLABLE_KINDS, "ctor", "const"))
    plain = F.when((F.col("kind") == "ctor") | F.coalesce("returns", F.lit("")).isin("void", "Unit", "None"), "").otherwise(F.coalesce("returns", F.lit("")))
    short = F.transform("raises", text.without_exception_suffix)
    atom = F.struct("kind", "params", "param_names", plain.alias("returns"), "fields", "supers", "permits", code.decorator_notes().alias("decorators"), short.alias("raises"), F.when(F.col("kind") == "const", F.col("signature")).otherwise("").alias("value"))
    return shown.withColumn("owner", _owner()).groupBy("snapshot", "lang", "file", "owner", "name").agg(F.sort_array(F.collect_set(atom)).alias("surface"))


def added_callables(facts: DataFrame) -> DataFrame:
    """Public production functions and methods whose language, owner and name the old interface has not."""
    return _public(of(facts, "new")).join(api(facts).where("snapshot = 'old'").select("lang", "owner", "name"), ["lang", "owner", "name"], "left_anti")


def _public(df: DataFrame) -> DataFrame:
    return df.where(F.col("prod") & F.col("kind").isin(*CALLABLE_KINDS) & (F.col("visibility") == "pub"))


def duplicates(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """New callables named much like one of another file that they don't call; the MOST_DUPLICATES most alike."""
    key = ["lang", "file", "owner", "name"]
    fit = lambda df: df.where((F.length("name") >= SHORTEST) & ~F.col("name").isin(*COMMON_NAMES))
    columns = [*key, "kind", "sym", "params", "container", "order"]
    a = fit(added_callables(facts)).select(*columns)
    b = fit(_public(of(facts, "old"))).select(*[F.col(c).alias(f"o_{c}") for c in columns])
    # Distinct names are compared, not declarations, and those of like length alone.
    alike = names.similar_pairs(a.select("lang", "name"), b.select(F.col("o_lang").alias("lang"), F.col("o_name").alias("name")), ["lang"], SIMILAR)
    alike = alike.withColumnsRenamed({"lang": "o_lang", "other": "o_name"})
    rated = a.join(alike.withColumn("lang", F.col("o_lang")), ["lang", "name"]).join(b, ["o_lang", "o_name"]).where("file <> o_file")
    new_names = of(facts, "new").select(F.col("sym").alias("target"), F.col("lang").alias("t_lang"), F.col("owner").alias("t_owner"), F.col("name").alias("t_name"))
    called = calls.where("snapshot = 'new'").join(new_names, "target").select(F.col("caller").alias("sym"), F.col("t_lang").alias("o_lang"), F.col("t_owner").alias("o_owner"), F.col("t_name").alias("o_name"))
    # One that calls any existing callable of another file, alike or not, is no duplicate.
    existing = b.select("o_lang", "o_owner", "o_name", "o_file")
    delegating = a.select("sym", "file").join(called, "sym").join(existing, ["o_lang", "o_owner", "o_name"]).where("file <> o_file").select("sym").distinct()
    rated = rated.join(delegating, "sym", "left_anti")
    best = rated.withColumn("k", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("ratio"), "o_lang", "o_file", "o_owner", "o_name", "o_order"))).where("k = 1")
    top = best.orderBy(F.desc("ratio"), *key, "order").limit(MOST_DUPLICATES)
    detail = F.concat(F.lit("dup: "), text.described(F.col("container"), F.col("name"), F.col("params"), F.col("file")), F.lit(" is "), F.round(F.col("ratio") * 100).cast("int").cast("string"), F.lit("% name-similar to existing "), text.described(F.col("o_container"), F.col("o_name"), F.col("o_params"), F.col("o_file")), F.lit(" and does not call it"))
    return _made(top, "dup", F.col("kind"), F.col("name"), F.col("file"), detail, F.concat_ws("|", F.lit("added"), _identity(), F.lit("existing"), _identity("o_")))


def test_edges(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(snapshot, file, cls, t_lang, t_file, t_owner, t_name, t_kind): what the functions and methods of each test file and class call, once by key."""
    tests = facts.where("test_path AND lang <> 'make' AND kind IN ('fn', 'method', 'ctor')").select("snapshot", F.col("sym").alias("caller"), "file", F.coalesce("container", F.lit("")).alias("cls"))
    target = facts.select("snapshot", F.col("sym").alias("target"), F.col("lang").alias("t_lang"), F.col("file").alias("t_file"), F.coalesce("container", F.lit("")).alias("t_owner"), F.col("name").alias("t_name"), F.col("kind").alias("t_kind"))
    both = calls.join(tests, ["snapshot", "caller"]).join(target, ["snapshot", "target"])
    return both.groupBy("snapshot", "file", "cls", "t_lang", "t_file", "t_owner", "t_name").agg(F.min("t_kind").alias("t_kind"))


def covered_again(edges: DataFrame) -> DataFrame:
    """Targets that a test class newly calls though another class did already; each once, at the first class."""
    t = ["t_lang", "t_file", "t_owner", "t_name"]
    old, new = edges.where("snapshot = 'old'"), edges.where("snapshot = 'new'")
    fresh = new.join(old.select("file", "cls", *t), ["file", "cls", *t], "left_anti")
    by = old.where("cls <> ''").groupBy(*t).agg(F.sort_array(F.collect_list(F.struct("file", "cls"))).alias("by"))
    others = F.filter(F.transform("by", lambda x: x["cls"]), lambda c: c != F.col("cls"))
    hit = fresh.join(by, t).withColumn("others", F.array_distinct(F.slice(others, 1, 2))).where(F.size("others") > 0)
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy(*t).orderBy("file", "cls"))).where("k = 1")
    who = F.when(F.col("cls") != "", F.col("cls")).otherwise(F.col("file"))
    detail = F.concat(F.lit("recover: "), who, F.lit(" now exercises "), F.col("t_name"), F.lit(", already covered by "), F.array_join("others", ", "))
    return _made(first, "recover", F.lit("coverage"), who, F.col("file"), detail, F.concat_ws("|", F.lit("target"), *t, "t_kind", F.lit("test-container"), "cls"))


def dead_arrivals(facts: DataFrame, tokens: DataFrame) -> DataFrame:
    """New public production declarations that nothing refers to and no test mentions."""
    new = of(facts, "new")
    zero = code.zero_usage(facts, tokens).where("snapshot = 'new'").select("name")
    make = new.where("lang = 'make'").select("file").distinct()
    mentioned = tokens.where((F.col("snapshot") == "new") & F.col("seen") & paths.test_path(F.col("file"))).join(make, "file", "left_anti").select(F.col("token").alias("name")).distinct()
    fresh = new.where("prod AND visibility = 'pub' AND kind IN ('fn', 'method', 'class')").join(of(facts, "old").select("lang", "name").distinct(), ["lang", "name"], "left_anti")
    dead = fresh.join(zero, "name", "left_semi").join(mentioned, "name", "left_anti")
    detail = F.concat(F.lit("dead: new public "), F.col("kind"), F.lit(" "), text.described(F.col("container"), F.col("name"), F.col("params"), F.col("file")), F.lit(" has no observed project reference"))
    return _made(dead, "dead", F.col("kind"), F.col("name"), F.col("file"), detail, _identity())


def orphans(facts: DataFrame, edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Test references of old whose target has left production while the same test file still mentions its name; not where the test class is gone."""
    new = of(facts, "new")
    alive = new.where("prod").select(F.col("lang").alias("t_lang"), F.col("name").alias("t_name")).distinct()
    classes = new.where("kind = 'class' AND test_path AND lang <> 'make'").select("file", F.col("name").alias("cls")).distinct()
    old = edges.where("snapshot = 'old'")
    old = old.where("cls = ''").unionByName(old.where("cls <> ''").join(classes, ["file", "cls"], "left_semi").select(*old.columns))
    still = tokens.where("snapshot = 'new' AND seen").select("file", F.col("token").alias("t_name")).distinct()
    lost = old.join(alive, ["t_lang", "t_name"], "left_anti").join(still, ["file", "t_name"], "left_semi")
    who = F.when(F.col("cls") != "", F.col("cls")).otherwise(F.col("file"))
    detail = F.concat(F.lit("orphan: "), who, F.lit(" still references "), F.col("t_name"), F.lit(", which no longer exists in production"))
    return _made(lost, "orphan", F.lit("test-reference"), who, F.col("file"), detail, F.concat_ws("|", F.lit("target"), "t_lang", "t_file", "t_owner", "t_name", "t_kind", F.lit("test-container"), "cls"))


def api_changes(facts: DataFrame) -> DataFrame:
    """(lang, file, owner, name, change): added, removed and changed keys of the public interface."""
    surface = api(facts)
    return stats.changes(surface.where("snapshot = 'old'"), surface.where("snapshot = 'new'"), ["lang", "file", "owner", "name"], "surface")


def api_drift(facts: DataFrame) -> DataFrame:
    """One finding for all changes of the interface, if there is any; its id tells change sets apart. Of the changes themselves just the first MOST_NAMES of each sort are gathered."""
    surface, keys = api(facts), ["lang", "file", "owner", "name"]
    side = lambda s: surface.where(F.col("snapshot") == s).select(*keys, F.col("surface").alias(s))
    both = side("old").join(side("new"), keys, "full_outer").where("NOT (old <=> new)").withColumn("change", F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "−").otherwise("~"))
    shown = F.when(F.col("change") == "~", F.concat("name", F.lit(": "), support.delta(F.col("old"), F.col("new")))).otherwise(F.col("name"))
    each = both.select("change", F.when(F.col("change") == "~", F.struct(shown.alias("x"), *[F.lit("").alias(f"k{i}") for i in range(4)])).otherwise(F.struct(F.lit("").alias("x"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])).alias("k"), shown.alias("shown"), *[F.xxhash64(*keys, F.to_json("old"), F.to_json("new"), F.lit(i)).alias(f"h{i}") for i in range(2)])
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("change").orderBy("k"))).where(F.col("n") <= MOST_NAMES)
    named = first.groupBy("change").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]), ", ").alias("names"))
    sums = each.groupBy("change").agg(F.count("*").alias("n"), *[F.bit_xor(f"h{i}").alias(f"h{i}") for i in range(2)])
    more = F.when(F.col("n") > MOST_NAMES, F.concat(F.lit(" +"), F.col("n") - MOST_NAMES, F.lit(" more"))).otherwise("")
    part = F.concat("change", F.col("n").cast("string"), F.lit(" ("), "names", more, F.lit(")"))
    order = F.when(F.col("change") == "+", 0).when(F.col("change") == "−", 1).otherwise(2)
    h = F.concat_ws(".", F.col("n").cast("string"), F.hex("h0"), F.hex("h1"))
    whole = sums.join(named, "change").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("p"), h.alias("h")))).alias("r")).where(F.size("r") > 0)
    detail = F.concat(F.lit("api: "), F.array_join(F.transform("r", lambda x: x["p"]), " "))
    return _made(whole, "api", F.lit("surface"), F.lit("surface"), F.lit(None).cast("string"), detail, F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"])), ","))


def misplaced(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """New top-level declarations whose calls and family sit for two thirds in one other directory."""
    new = of(facts, "new").withColumn("family", F.struct("lang", "kind", "supers", code.decorator_notes().alias("notes")))
    top = new.where("container IS NULL AND prod")
    added = top.where((F.col("visibility") == "pub") & F.col("kind").isin(*TYPE_KINDS, "fn")).join(of(facts, "old").select("lang", "name").distinct(), ["lang", "name"], "left_anti")
    target = new.select(F.col("sym").alias("target"), F.col("dir").alias("to"))
    by_calls = calls.where("snapshot = 'new'").join(target, "target").select(F.col("caller").alias("sym"), "to").join(added.select("sym"), "sym", "left_semi")
    related = (F.size("family.supers") > 0) | (F.size("family.notes") > 0)
    kin = top.where(related).select("family", F.col("sym").alias("other"), F.col("dir").alias("to"))
    by_kin = added.where(related).select("sym", "family").join(kin, "family").where("sym <> other").select("sym", "to")
    place = stats.dominant(by_calls.unionByName(by_kin), ["sym"], "to", LEAST_MASS)
    far = added.join(place, "sym").where("to <> dir")
    detail = F.concat(F.lit("place: "), F.col("name"), F.lit(" lives in "), F.col("dir"), F.lit("/ but its calls and nearest type family sit in "), F.col("to"), F.lit("/"))
    return _made(far, "place", F.col("kind"), F.col("name"), F.col("file"), detail, _identity())


def review(facts: DataFrame, calls: DataFrame, tokens: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """All findings of the checks asked for."""
    edges = test_edges(facts, calls)
    made = {"dup": lambda: duplicates(facts, calls), "recover": lambda: covered_again(edges), "dead": lambda: dead_arrivals(facts, tokens), "orphan": lambda: orphans(facts, edges, tokens), "api": lambda: api_drift(facts), "place": lambda: misplaced(facts, calls)}
    return stats.union_all([made[c]() for c in CHECKS if c in checks])


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("check", "kind", F.coalesce("path", F.lit("")), "subject", "id", "detail")


def report(findings: DataFrame, revision: str) -> DataFrame:
    """(text, data): the report in words and as JSON; an empty text without findings."""
    rows = F.sort_array(F.collect_list(F.struct("check", "kind", F.coalesce("path", F.lit("")).alias("p"), "subject", "id", "detail", "path")))
    head = F.lit(f"Review against {revision}:\n")
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["detail"])), "\n")
    data = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(revision).alias("revision"), F.size("r").alias("count"), F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["check"].alias("check"), x["kind"].alias("kind"), x["subject"].alias("subject"), x["path"].alias("path"), x["detail"].alias("detail"))).alias("findings")), {"ignoreNullFields": "false"})
    return findings.agg(rows.alias("r")).select(F.when(F.size("r") > 0, F.concat(head, lines)).otherwise("").alias("text"), data.alias("data"))


def resolved_persisting_new(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, state) of two sets of findings."""
    both = before.select("id", F.lit(1).alias("a")).distinct().join(after.select("id", F.lit(1).alias("b")).distinct(), "id", "full_outer")
    return both.select("id", F.when(F.col("b").isNull(), "resolved").when(F.col("a").isNull(), "new").otherwise("persisting").alias("state"))
