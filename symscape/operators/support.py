"""What the map shows beside declarations: test support, groups of like types, members that belong together, labels and deltas of interfaces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symscape.functions import paths, text
from symscape.operators import code, names
from symscape.schemas import CALLABLE_KINDS, TYPE_KINDS

_FIXTURES = "before beforeall beforeclass beforeeach beforemethod beforesuite beforetest classrule fixture onetimesetup registerextension rule setupfixture testfixture".split()
MOST_VARIANTS = 3


# --- test support


def fixtures(facts: DataFrame) -> Column:
    """Whether a declaration is setup that tests reuse by its name."""
    return F.col("kind").isin(*CALLABLE_KINDS) & (F.col("lang") != "make") & F.col("test_path") & F.exists(code.bases(), lambda b: b.isin(*_FIXTURES))


def references(facts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(snapshot, name, file, others): for each name declared on a test path, how many other test files mention it. Tokens are joined by name, so only declared ones are shuffled."""
    make = facts.where("lang = 'make'").select("snapshot", "file").distinct()
    seen = tokens.where(paths.test_path(F.col("file"))).join(make, ["snapshot", "file"], "left_anti").select("snapshot", "file", F.col("token").alias("name")).distinct()
    declared = facts.where("test_path").select("snapshot", "name", "file").distinct()
    files = seen.join(declared.select("snapshot", "name").distinct(), ["snapshot", "name"], "left_semi").groupBy("snapshot", "name").agg(F.count("*").alias("files"))
    own = declared.join(seen.withColumn("own", F.lit(1)), ["snapshot", "name", "file"], "left")
    return own.join(files, ["snapshot", "name"], "left").select("snapshot", "name", "file", (F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("others"))


def support(facts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(snapshot, sym, why): helper classes, fixtures and shared functions of tests.

    A class counts if neither its file nor its name is a test's and another test file mentions it, any class if two do; a fixture by its
    declaration; a module function that is no test like a class, with the beginning `test` for its name."""
    both = facts.where("test_path AND lang <> 'make'").join(references(facts, tokens), ["snapshot", "name", "file"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
    plain_file = ~paths.test_name(paths.stem(F.col("file")))
    plain_name = ~F.col("name").rlike("(Test|Tests|Spec|IT)$")
    helper = (F.col("kind") == "class") & (plain_file & plain_name & (F.col("others") >= 1) | ~(plain_file & plain_name) & (F.col("others") >= 2))
    shared = (F.col("kind") == "fn") & F.col("container").isNull() & ~F.col("test_case") & ((F.col("others") >= 2) | plain_file & ~F.lower("name").startswith("test") & (F.col("others") >= 1))
    why = F.when(helper, "class").when(fixtures(facts), "fixture").when(shared, "function")
    return both.select("snapshot", "sym", why.alias("why")).where("why IS NOT NULL")


def case_labels(facts: DataFrame) -> DataFrame:
    """(snapshot, file, container, name, label) of test cases, once each: with their owner where a file has the name more than once."""
    cases = facts.where("test_case").select("snapshot", "file", F.coalesce("container", F.lit("")).alias("container"), "name").distinct()
    n = F.count("*").over(Window.partitionBy("snapshot", "file", "name"))
    return cases.withColumn("label", F.when((F.col("container") != "") & (n > 1), F.concat_ws(".", "container", "name")).otherwise(F.col("name")))


def contiguous_runs(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, first, n): runs of neighbouring places, whole numbers, of each key; repeated rows count once.

    Only begins and ends of runs are kept of the rows in order, and an end stands right after its begin. All steps go through one sort, so
    that no task has a table of its rows or runs in memory."""
    order = Window.partitionBy(*keys).orderBy("__p")
    one = F.struct("__p")  # null only where there is no such row
    p, before, after = F.col("__p"), F.col("__before"), F.col("__after")
    near = lambda row, at: F.coalesce(row["__p"].eqNullSafe(p) | (row["__p"] == at), F.lit(False))
    placed = rows.select(*keys, F.col(place).cast("long").alias("__p")).withColumns({"__before": F.lag(one).over(order), "__after": F.lead(one).over(order)})
    edges = placed.select(*keys, "__p", (before.isNull() | ~near(before, p - 1)).alias("__begins"), (after.isNull() | ~near(after, p + 1)).alias("__ends")).where("__begins OR __ends").drop("__ends")
    following = F.lead(F.struct("__p", "__begins")).over(order)
    last = edges.withColumn("__next", following).where("__begins")
    return last.select(*keys, p.alias("first"), F.coalesce(F.when(~F.col("__next.__begins"), F.col("__next.__p") - p + 1), F.lit(1)).cast("long").alias("n"))


# --- members and groups


def argument_names() -> Column:
    """Names of arguments; the type where one has no name."""
    return F.transform("params", lambda p, k: F.coalesce(F.nullif(F.try_element_at("param_names", k + 1), F.lit("")), p))


def bundle_key() -> Column:
    """What a declaration is, the same in every run."""
    shown = F.coalesce(F.nullif("signature", F.lit("")), F.array_join("params", ","))
    return F.concat_ws("|", "file", "lang", F.coalesce("container", F.lit("")), "kind", "name", shown, F.col("line").cast("string"))


def estimated_size(category: Column, suffix: Column) -> Column:
    """A hint of how long a fact is in the map, which orders equals."""
    shown = F.coalesce(F.nullif("signature", F.lit("")), F.col("name"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x) + 1)
    one, some = lambda *c: F.array(*c), lambda c: F.coalesce(c, F.array().cast("array<string>"))
    parts = F.when(category == "private-names", one("name")).when(category.isin("tested-call-chains", "untested-call-chains", "test-cases"), F.concat(one("name"), some("calls"))).when(category == "const-values", one(shown))
    parts = parts.otherwise(F.concat(one(shown), argument_names(), one(F.coalesce("returns", F.lit(""))), some("raises"), some("decorators"), some("fields"), some("supers"), some("permits")))
    return F.greatest(F.lit(1), F.length(suffix) + total(parts))


def colliding(facts: DataFrame) -> DataFrame:
    """facts with collides: whether another production callable of the same owner has the same name and argument names, so that only types tell them apart."""
    callable_ = F.col("prod") & F.col("kind").isin(*CALLABLE_KINDS, "ctor")
    w = Window.partitionBy("snapshot", "file", F.coalesce("container", F.lit("")), "name", argument_names())
    return facts.withColumn("collides", callable_ & (F.count(F.when(callable_, 1)).over(w) > 1))


@F.pandas_udf(T.StringType())
def _arguments(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else ",".join(names.factored(list(x), dedupe=False)))


def display_signature() -> Column:
    """name(arguments):returns of facts with collides; types only where names collide, and text of template languages as it is."""
    named = argument_names()
    typed = F.transform(named, lambda n, k: F.when(n != F.element_at("params", k + 1), F.concat(n, F.lit(":"), F.element_at("params", k + 1))).otherwise(n))
    back = F.when((F.col("kind") != "ctor") & (F.coalesce("returns", F.lit("")) != "") & ~F.col("returns").isin("void", "Unit", "None"), F.concat(F.lit(":"), "returns")).otherwise("")
    verbatim = F.col("lang").isin("helm", "html") & (F.coalesce("signature", F.lit("")) != "") & ~F.contains("signature", F.lit("("))
    return F.when(verbatim, F.col("signature")).otherwise(F.concat("name", F.lit("("), _arguments(F.when(F.col("collides"), typed).otherwise(named)), F.lit(")"), back))


def as_self(line: Column, own: Column) -> Column:
    """A line with its owner's name, as a whole word, as Self."""
    quoted = F.regexp_replace(own, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.regexp_replace(line, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")), F.lit("Self"))


def ownerless_members(facts: DataFrame) -> DataFrame:
    """Members of owners that no file declares as a type, declarations and definitions of one shape as one row: the most complete, with calls, raises and decorators of all in order."""
    types = facts.where(F.col("kind").isin(*TYPE_KINDS)).select("snapshot", "lang", "file", F.col("name").alias("container")).distinct()
    return code.merged_members(facts.where("coalesce(container, '') <> ''").join(types, ["snapshot", "lang", "file", "container"], "left_anti"))


def type_groups(facts: DataFrame) -> DataFrame:
    """(snapshot, scope, names, syms): types that the map shows on one line, as they have the same kind, components, supertypes, decorators and use. A type that is alone in its file and named like it belongs to its directory, others to their file."""
    top = facts.where(F.col("prod") & F.col("container").isNull() & F.col("kind").isin(*TYPE_KINDS))
    per_file = Window.partitionBy("snapshot", "file")
    every = facts.where(F.col("prod") & F.col("container").isNull()).groupBy("snapshot", "file").agg(F.count("*").alias("facts"))
    interfaces = facts.where("prod AND kind = 'interface'").select("snapshot", "lang", F.col("name").alias("super")).distinct()
    known = top.select("snapshot", "sym", "lang", F.explode("supers").alias("super")).join(interfaces, ["snapshot", "lang", "super"], "left_semi").groupBy("snapshot", "sym").agg(F.collect_set("super").alias("of_interfaces"))
    lone = (F.count("*").over(per_file) == 1) & (F.col("facts") == 1) & (paths.stem(F.col("file")) == F.col("name"))
    twins = F.count("*").over(Window.partitionBy("snapshot", "name")) > 1
    parts = F.when(F.col("kind") == "enum", F.col("params")).when((F.col("kind") == "type") & (F.size("fields") == 0), F.slice("params", 1, 1)).when(F.size("fields") > 0, F.col("fields")).otherwise(F.col("params"))
    shown = F.array_except("supers", F.coalesce("of_interfaces", F.array().cast("array<string>")))
    rows = top.join(every, ["snapshot", "file"]).join(known, ["snapshot", "sym"], "left").withColumns({"scope": F.when(lone, F.col("dir")).otherwise(F.col("file")), "twin": F.when(twins, F.col("file")).otherwise("")})
    shape = F.struct("twin", "lang", "kind", "visibility", parts.alias("parts"), shown.alias("supers"), "permits", (F.size("fields") > 0).alias("named"), code.decorator_notes().alias("notes"), F.col("calls").alias("calls"))
    return rows.groupBy("snapshot", "scope", shape.alias("shape")).agg(F.sort_array(F.collect_list(F.struct("name", "sym"))).alias("m")).select("snapshot", "scope", F.transform("m", lambda x: x["name"]).alias("names"), F.transform("m", lambda x: x["sym"]).alias("syms"))


def shared_lines(members: DataFrame, keys: list[str], member: str, line: str) -> DataFrame:
    """members with shared: whether every member of the group has the line. Counted, not intersected, so a group is never in one row."""
    n = members.groupBy(*keys).agg(F.countDistinct(member).alias("__all"))
    by = members.groupBy(*keys, line).agg(F.countDistinct(member).alias("__has"))
    return members.join(by, [*keys, line]).join(n, keys).withColumn("shared", F.col("__has") == F.col("__all")).drop("__has", "__all")


def private_names(facts: DataFrame, calls: DataFrame, shown: DataFrame) -> DataFrame:
    """(snapshot, sym) of private production declarations that no visible call already names. calls: what declarations call; shown: (snapshot, sym) of callers whose calls the map shows."""
    named = calls.join(shown.select("snapshot", F.col("sym").alias("caller")), ["snapshot", "caller"], "left_semi").select("snapshot", F.col("target").alias("sym")).distinct()
    member = (F.coalesce("container", F.lit("")) != "") & F.col("kind").isin("method", "ctor") & ~F.col("name").isin("__init__", "__repr__")
    top = F.col("container").isNull() & F.col("kind").isin(*TYPE_KINDS, "fn")
    private = facts.where(F.col("prod") & (F.col("visibility") == "priv") & ~F.col("invoked") & (member | top))
    # A declaration of the same place and name as one that is named counts as named too.
    place = ["snapshot", "file", "lang", "owner", "name"]
    at = lambda df: df.withColumn("owner", F.coalesce("container", F.lit("")))
    seen = at(facts.join(named, ["snapshot", "sym"], "left_semi")).select(*place).distinct()
    return at(private).join(seen, place, "left_anti").select("snapshot", "sym")


# --- labels and deltas of interfaces


def _values(c: Column, sign: str = "") -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit(sign), x)), ","), F.lit("]"))


def shape_label(a: Column) -> Column:
    """A whole shape of an interface in short."""
    parts = F.when(F.size(a["fields"]) > 0, a["fields"]).otherwise(a["params"])
    some = lambda sign, c, by: F.when(F.size(c) > 0, F.concat(F.lit(sign), F.array_join(c, by))).otherwise("")
    kind = F.when(a["kind"].isin(*CALLABLE_KINDS, "ctor"), F.concat(a["kind"], F.lit(" "), text.api_signature(a["params"], a["returns"])))
    kind = kind.otherwise(F.concat(a["kind"], F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(""), some(":", a["supers"], ","), some(" sealed:", a["permits"], "|")))
    notes = F.when(F.size(a["decorators"]) > 0, F.concat(F.lit(" "), F.array_join(F.transform(a["decorators"], lambda x: F.concat(F.lit("@"), x)), " "))).otherwise("")
    return F.when(a["kind"] == "const", F.coalesce(F.nullif(a["value"], F.lit("")), F.lit("const"))).otherwise(F.concat(kind, notes, some(" !", a["raises"], ",")))


def delta(old: Column, new: Column) -> Column:
    """What changed between two surfaces of one name, lists of shapes: each part of a single shape that differs, or the first MOST_VARIANTS shapes of both sides."""

    def variants(s: Column) -> Column:
        more = F.when(F.size(s) > MOST_VARIANTS, F.concat(F.lit(" | +"), (F.size(s) - MOST_VARIANTS).cast("string"))).otherwise("")
        return F.concat(F.lit("["), F.array_join(F.transform(F.slice(s, 1, MOST_VARIANTS), shape_label), " | "), more, F.lit("]"))

    a, b = F.try_element_at(old, F.lit(1)), F.try_element_at(new, F.lit(1))
    arrow = lambda x, y: F.concat(x, F.lit("→"), y)
    differ = lambda c: ~a[c].eqNullSafe(b[c])
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    parts = [
        F.when(differ("kind"), arrow(a["kind"], b["kind"])),
        F.when(differ("params") | differ("returns"), arrow(text.api_signature(a["params"], a["returns"]), text.api_signature(b["params"], b["returns"]))),
        F.when(differ("param_names"), F.concat(F.lit("args "), arrow(_values(a["param_names"]), _values(b["param_names"])))),
        *[F.when(differ(c), F.concat(F.lit(f"{c} "), arrow(_values(a[c], sign), _values(b[c], sign)))) for c, sign in (("fields", ""), ("supers", ""), ("permits", ""), ("decorators", "@"), ("raises", ""))],
        F.when(differ("value"), F.concat(F.lit("value "), arrow(some(a["value"]), some(b["value"])))),
    ]
    return F.when((F.size(old) != 1) | (F.size(new) != 1), F.concat(F.lit("variants "), arrow(variants(old), variants(new)))).otherwise(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " "))
