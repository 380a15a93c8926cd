"""The code operators bound to made declarations: a class for each supplier, with members, overloads, receivers, bindings, an interface for each nation, and tests.

Class C<k> of nation n lies in n<n>/C<k>.java and extends I<n>. Its method run<k> calls run of the next class by its name, run of the class
of twice its number by a variable bound to it, its own private help, and dup, which every fourth class has twice. Every third class has a
test. In the new snapshot the classes of nation 7 are gone, those with debts have an argument more in run, and every tenth, if it has a
neighbour before it, a new method fresh<k> that nothing mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.operators import code, graph, review, support
from symscape.plans import maps
from symscape.queries import query, table
from symscape.schemas import SYMBOLS

_S = "SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS b FROM supplier"
_FIELDS = [(f.strip().split(" ")[0], f.strip().split(" ", 1)[1]) for f in SYMBOLS.replace("map<string,string>", "map<string;string>").split(",")]


def _name(letter: str, k="k"):
    return F.concat(F.lit(letter), (F.col(k) if isinstance(k, str) else k).cast("string"))


def _rows(df: DataFrame, snapshot: str, ordinal: int, **columns) -> DataFrame:
    """Rows of SYMBOLS: what isn't given is empty."""
    default = {"snapshot": F.lit(snapshot), "ordinal": F.lit(ordinal), "line": F.lit(10 * ordinal + 1), "lang": F.lit("java"), "visibility": F.lit("pub"), "size": F.lit(3), "signature": F.lit("")}
    empty = lambda t: F.array().cast("array<string>") if t.startswith("array") else F.create_map().cast("map<string,string>") if t.startswith("map") else F.lit(None).cast(t)
    columns["sym"] = F.concat(columns["file"], F.lit(f"#{ordinal}"))
    return df.select(*[F.coalesce(columns[c], empty(t.replace(";", ","))).alias(c) if c in columns and t.startswith(("array", "map")) else columns.get(c, default.get(c, empty(t.replace(";", ",")))).cast(t.replace(";", ",")).alias(c) for c, t in _FIELDS])


def symbols(spark, d, snapshot: str = "old") -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("b"))
    here = s.where("n <> 7") if snapshot == "new" else s
    k, new = F.col("k"), snapshot == "new"
    cls, file = _name("C"), F.concat(_name("n", "n"), F.lit("/C"), k.cast("string"), F.lit(".java"))
    test, member = F.concat(_name("n", "n"), F.lit("/test/C"), k.cast("string"), F.lit("Test.java")), {"kind": F.lit("method"), "file": file, "container": cls}
    call = lambda x: F.concat(F.lit("C"), x.cast("string"), F.lit(".run"), x.cast("string"))
    debt = F.when(F.lit(new) & (F.col("b") < 0), F.array(F.lit("int"), F.lit("long"))).otherwise(F.array(F.lit("int")))
    parts = [
        _rows(s.select("n").distinct(), snapshot, 0, name=_name("I", "n"), kind=F.lit("interface"), file=F.concat(_name("n", "n"), F.lit("/I"), F.col("n").cast("string"), F.lit(".java"))),
        _rows(here, snapshot, 0, name=cls, kind=F.lit("class"), file=file, supers=F.array(_name("I", "n"))),
        _rows(here, snapshot, 1, name=_name("run"), params=debt, calls=F.array(call(k + 1), F.concat(F.lit("v.run"), (k * 2).cast("string")), F.lit("this.help"), F.lit("dup")), bindings=F.create_map(F.lit("v"), F.concat(F.lit("C"), (k * 2).cast("string"), F.lit("<T>"))), **member),
        _rows(here, snapshot, 2, name=F.lit("help"), visibility=F.lit("priv"), calls=F.array(F.lit("a.b")), **member),
        _rows(here, snapshot, 3, name=F.lit("dup"), params=F.array(F.lit("int")), **member),
        _rows(here.where("k % 4 = 0"), snapshot, 4, name=F.lit("dup"), params=F.array(F.lit("String")), **member),
        _rows(here.where("k % 3 = 0"), snapshot, 0, name=F.concat(cls, F.lit("Test")), kind=F.lit("class"), file=test),
        _rows(here.where("k % 3 = 0"), snapshot, 1, name=F.lit("testRun"), kind=F.lit("method"), container=F.concat(cls, F.lit("Test")), file=test, decorators=F.array(F.lit("Test")), calls=F.array(call(k))),
    ]
    if new:
        parts.append(_rows(here.where("k % 10 = 0"), snapshot, 5, name=_name("fresh"), **member))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facts(spark, d, *snapshots: str) -> DataFrame:
    out = None
    for s in snapshots or ("old",):
        one = symbols(spark, d, s)
        out = one if out is None else out.unionByName(one)
    return graph.written(code.with_facts(out), "facts")


def tokens(f: DataFrame) -> DataFrame:
    """Every file mentions what it declares once, and the last parts of what it calls."""
    said = f.select("snapshot", "file", F.explode(F.concat(F.array("name"), F.transform("calls", lambda c: F.element_at(F.split(c, r"\."), -1)))).alias("token"))
    return said.groupBy("snapshot", "file", "token").agg(F.count("*").alias("n"), F.lit(True).alias("seen"))


def _known(df: DataFrame, f: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(f.select("snapshot", F.col("sym").alias(c), F.concat_ws(".", "container", "name").alias(f"{c}_is")), ["snapshot", c])
    return df.select(*[F.col(f"{c}_is").alias(c) for c in columns])


_RUN = "'C' || k || '.run' || k"
_EDGES = f"""SELECT a.k, {_RUN.replace("k", "a.k")} AS caller, {_RUN.replace("k", "b.k")} AS target FROM s a JOIN s b ON b.k = a.k + 1 OR b.k = a.k * 2
UNION SELECT k, {_RUN}, 'C' || k || '.help' FROM s UNION SELECT k, {_RUN}, 'C' || k || '.dup' FROM s WHERE k % 4 <> 0 UNION SELECT k, 'C' || k || 'Test.testRun', {_RUN} FROM s WHERE k % 3 = 0"""


@query(f"WITH s AS ({_S}) SELECT caller, target FROM ({_EDGES})")
def member_calls(spark, d):
    """By type name, by a bound variable, on the own object, and bare; overloads are ambiguous."""
    f = facts(spark, d)
    return _known(code.edges(f), f, "caller", "target")


@query(f"WITH s AS ({_S}) SELECT {_RUN} AS sym FROM s WHERE k % 3 = 0")
def member_tested(spark, d):
    f = facts(spark, d)
    return _known(code.tested(f, code.edges(f)), f, "sym")


@query(f"WITH s AS ({_S}) SELECT 'I' || n AS name, string_agg('C' || k, ',' ORDER BY CAST(k AS VARCHAR) || '.java') AS implementors FROM s GROUP BY n")
def member_implementors(spark, d):
    return code.implementors(facts(spark, d)).select("name", F.array_join("implementors", ",").alias("implementors"))


@query(f"WITH s AS ({_S}), w AS (SELECT b.k FROM s a JOIN s b ON (b.k = a.k + 1 OR b.k = a.k * 2) AND a.k <> b.k UNION SELECT k FROM s WHERE k % 3 = 0) SELECT 'C' || k AS sym FROM s WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT DISTINCT 'I' || n FROM s")
def member_cold_types(spark, d):
    """Types whose members nothing outside calls."""
    f = facts(spark, d)
    return _known(code.cold_types(f, code.edges(f)), f, "sym")


@query(f"WITH s AS ({_S}) SELECT {_RUN} AS description, 1 AS x FROM s WHERE false UNION ALL SELECT 'run' || k, 1 FROM s UNION ALL SELECT 'C' || k, 1 FROM s UNION ALL SELECT DISTINCT 'I' || n, 1 FROM s UNION ALL SELECT 'C' || k || '.help', 1 FROM s UNION ALL SELECT 'C' || k || '.dup', 1 FROM s UNION ALL SELECT 'C' || k || '.dup', 1 FROM s WHERE k % 4 = 0")
def member_descriptions(spark, d):
    """The shortest names that tell targets apart."""
    return code.described(facts(spark, d)).select("description", F.lit(1).alias("x"))


@query(f"WITH s AS ({_S}) SELECT 'C' || k AS owner, name, CAST(n AS BIGINT) AS rows, vis AS visibility FROM (SELECT k, 'run' || k AS name, 2 AS n, 'pub' AS vis FROM s UNION ALL SELECT k, 'help', 2, 'priv' FROM s UNION ALL SELECT k, 'dup', 2, 'pub' FROM s UNION ALL SELECT k, 'dup', 2, 'pub' FROM s WHERE k % 4 = 0)")
def member_merge(spark, d):
    """Declarations and definitions of one member are one row: here all rows twice, as header and source of one file."""
    f = facts(spark, d)
    return code.merged_members(f.unionByName(f.withColumn("sym", F.concat("sym", F.lit("x"))))).select(F.col("container").alias("owner"), "name", "rows", "visibility")


@query(f"WITH s AS ({_S}) SELECT 'C' || k || 'Test' AS cls, 'run' || k AS target FROM s WHERE k % 3 = 0")
def member_test_edges(spark, d):
    f = facts(spark, d)
    return review.test_edges(f, code.edges(f)).select("cls", F.col("t_name").alias("target"))


@query(f"WITH s AS ({_S}) SELECT 'n' || n AS scope, string_agg('C' || k, ',' ORDER BY 'C' || k) AS names FROM s GROUP BY n UNION ALL SELECT DISTINCT 'n' || n, 'I' || n FROM s")
def member_type_groups(spark, d):
    """Types of one shape share a line; here all classes of a nation, and its interface."""
    return support.type_groups(facts(spark, d)).select("scope", F.array_join("names", ",").alias("names"))


@query(f"WITH s AS ({_S}) SELECT 'C' || k AS owner, 'dup' AS name, k % 4 = 0 AS collides FROM s UNION ALL SELECT 'C' || k, 'dup', true FROM s WHERE k % 4 = 0")
def member_collisions(spark, d):
    """Names of arguments are the same where a class has dup twice, so that types must be shown."""
    f = facts(spark, d).withColumn("param_names", F.when(F.size("params") > 0, F.array(F.lit("x"))).otherwise(F.col("param_names")))
    return support.colliding(f).where("name = 'dup'").select(F.col("container").alias("owner"), "name", "collides")


@query(f"WITH s AS ({_S}) SELECT 'C' || k AS owner, CASE WHEN k % 4 = 0 THEN 'dup(x:int)' ELSE 'dup(x)' END AS shown FROM s UNION ALL SELECT 'C' || k, 'dup(x:String)' FROM s WHERE k % 4 = 0")
def member_signatures(spark, d):
    f = facts(spark, d).withColumn("param_names", F.when(F.size("params") > 0, F.array(F.lit("x"))).otherwise(F.col("param_names")))
    return support.colliding(f).where("name = 'dup'").select(F.col("container").alias("owner"), support.display_signature().alias("shown"))


@query(f"WITH s AS ({_S}), l AS (SELECT n, k, 'help' AS line FROM s UNION SELECT n, k, 'dup' FROM s UNION SELECT n, k, 'run' || k % 2 FROM s) SELECT 'C' || l.k AS member, line, count(*) OVER (PARTITION BY l.n, line) = (SELECT count(*) FROM s WHERE s.n = l.n) AS shared FROM l")
def member_shared_lines(spark, d):
    """Lines that all classes of a nation have; the run methods fall in two sorts."""
    f = facts(spark, d).where("kind = 'method' AND prod")
    line = F.when(F.col("name").startswith("run"), F.concat(F.lit("run"), (F.substring("name", 4, 20).cast("long") % 2).cast("string"))).otherwise(F.col("name"))
    rows = f.select("dir", F.col("container").alias("member"), line.alias("line")).distinct()
    return support.shared_lines(rows, ["dir"], "member", "line").select("member", "line", "shared")


@query(f"WITH s AS ({_S}) SELECT 'C' || k || '.help' AS sym FROM s WHERE k % 5 <> 0")
def member_private_names(spark, d):
    """Private names, but for those that a shown caller names: here the run methods of every fifth class."""
    f = facts(spark, d)
    shown = f.where("name LIKE 'run%' AND cast(substring(name, 4, 20) AS long) % 5 = 0")
    return _known(support.private_names(f, code.edges(f), shown.select("snapshot", "sym")), f, "sym")


@query(f"WITH s AS ({_S}) SELECT 'n' || n || '/C' || k || '.java' AS file, CAST(1 AS BIGINT) AS rank, 'run' || k AS name FROM s UNION ALL SELECT 'n' || n || '/C' || k || '.java', 2, 'dup' FROM s UNION ALL SELECT 'n' || n || '/C' || k || '.java', 3, CASE WHEN k % 4 = 0 THEN 'dup' ELSE 'C' || k END FROM s UNION ALL SELECT DISTINCT 'n' || n || '/I' || n || '.java', 1, 'I' || n FROM s")
def member_landmarks(spark, d):
    """The first three of each file by calls, size and fan-in."""
    f = facts(spark, d)
    return maps.landmarks(f, code.edges(f)).select("file", F.col("rank").cast("long").alias("rank"), "name")


# --- two snapshots


@query(f"WITH s AS ({_S} WHERE s_nationkey <> 7) SELECT 'dead' AS \"check\", 'fresh' || k AS subject, 'n' || n || '/C' || k || '.java' AS path FROM s WHERE k % 10 = 0")
def member_review_dead(spark, d):
    f = facts(spark, d, "old", "new")
    return review.dead_arrivals(f, tokens(f)).select("check", "subject", "path")


@query(f"""WITH s AS ({_S}), g AS (SELECT * FROM s WHERE n <> 7), gone AS (SELECT count(*) * 2 + count(*) AS c FROM s WHERE n = 7), names AS (SELECT 1)
SELECT 'api' AS "check", (SELECT count(*) FROM g WHERE k % 10 = 0) AS added, (SELECT count(*) * 3 FROM s WHERE n = 7) AS removed, (SELECT count(*) FROM g WHERE b < 0) AS changed""")
def member_review_api(spark, d):
    """The numbers that the one finding on the interface states."""
    f = facts(spark, d, "old", "new")
    number = lambda sign: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("detail", rf"{sign}(\d+) \(", 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))
    return review.api_drift(f).select("check", number(r"\+").alias("added"), number("−").alias("removed"), number("~").alias("changed"))


@query(f"WITH s AS ({_S}) SELECT id, CASE WHEN n = 7 THEN 'resolved' WHEN fresh THEN 'new' ELSE 'persisting' END AS state FROM (SELECT 'C' || k AS id, n, false AS fresh FROM s UNION ALL SELECT 'C' || k || '.fresh' || k, n, true FROM s WHERE k % 10 = 0 AND n <> 7)")
def member_states(spark, d):
    """Classes and fresh methods as findings of two reviews."""
    f = facts(spark, d, "old", "new").where("(kind = 'class' OR name LIKE 'fresh%') AND prod").select("snapshot", F.concat_ws(".", "container", "name").alias("id"))
    return review.resolved_persisting_new(f.where("snapshot = 'old'"), f.where("snapshot = 'new'"))
