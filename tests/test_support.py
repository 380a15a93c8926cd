"""Test support, wrapped names, labels of interfaces, and the search under a budget, by hand and against brute force."""

import difflib
import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from symscape import member_queries
from symscape.operators import code, names, support
from symscape.plans import budget, maps

LISTS = "params param_names fields supers permits decorators raises".split()
SHAPE = "array<struct<kind:string,returns:string,value:string," + ",".join(f"{c}:array<string>" for c in LISTS) + ">>"


def shape(**more):
    return tuple(({"kind": "fn", "returns": "", "value": ""} | {c: [] for c in LISTS} | more).values())


def test_labels_and_deltas(spark):
    cases = [
        ([shape(params=["int"], returns="int")], [shape(params=["int", "str"])], "(int):int→(int,str)"),
        ([shape(params=["a"], param_names=["x"], raises=["E"])], [shape(params=["a"], param_names=["y"], decorators=["GET"])], "args [x]→[y] decorators []→[@GET] raises [E]→[]"),
        ([shape(kind="class", fields=["a"], supers=["B"])], [shape(kind="record", fields=["a", "b"], supers=["B"], permits=["P"])], "class→record fields [a]→[a,b] permits []→[P]"),
        ([shape(kind="const", value="A=1")], [shape(kind="const", value="")], "value A=1→-"),
        ([shape(params=["a"])], [shape(params=["a"]), shape(kind="const", value=""), shape(kind="enum", params=["X"]), shape(kind="class", supers=["S"], permits=["P", "Q"], decorators=["D"], raises=["E"])], "variants [fn (a)]→[fn (a) | const | enum{X} | +1]"),
        ([shape(kind="class", supers=["S"], permits=["P", "Q"], decorators=["D"], raises=["E"])], [], "variants [class:S sealed:P|Q @D !E]→[]"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {SHAPE}, b {SHAPE}")
    got = {r.i: r.d for r in df.select("i", support.delta(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab_A.x", min_size=1, max_size=8), max_size=12), st.booleans())
def test_factored_names_come_back(listed, marked):
    listed = [n + "×0" * (marked and k % 2) for k, n in enumerate(listed)]
    short = names.factored(listed)
    assert [x for item in short for x in names.unfactored([item])] == listed
    assert len(",".join(short).encode()) <= len(",".join(listed).encode())


def test_prefixes_suffixes_and_marks():
    assert names.factored(["load_user", "load_order", "load_item"]) == ["load_{user,order,item}"]
    assert names.factored(["userService", "orderService", "itemService"]) == ["{user,order,item}Service"]
    assert names.factored(["load_user×0", "load_order×0", "load_item"]) == ["load_{user,order}×0", "load_item"]
    assert names.factored(["a_x", "other", "a_y"]) == ["a_x", "other", "a_y"]  # never across another name
    assert names.factored(["p.a", "p.a"], dedupe=True) == ["p.a"]


def test_wrapped_lines():
    lines = names.wrapped("- ", [f"name{k}{'x' * k}" for k in range(20)], width=40)
    assert all(len(x) <= 41 for x in lines) and lines[0].startswith("- ") and all(x.startswith("  ") for x in lines[1:]) and all(x.endswith(",") for x in lines[:-1])
    assert "".join(x.strip() if k else x[2:].strip() for k, x in enumerate(lines)).split(",") == [f"name{k}{'x' * k}" for k in range(20)]
    assert names.wrapped("- ", []) == [] and names.wrapped("file: ", ["a" * 200, "b"], 120, " ")[1] == " b"


def test_similar_pairs_lose_none(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcAB_é") for _ in range(rng.randint(1, 14))) for _ in range(120)})
    df = spark.createDataFrame([("g", w) for w in words], "t string, name string")
    for least in (0.5, 0.7, 0.9):
        got = {(r.name, r.other) for r in names.similar_pairs(df, df, ["t"], least).collect()}
        want = {(a, b) for a, b in itertools.product(words, words) if difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= least}
        assert got == want


def facts(spark, rows):
    base = {"lang": "python", "kind": "fn", "container": None, "decorators": [], "test_path": True, "test_case": False, "snapshot": "s"}
    columns = "lang kind container decorators test_path test_case snapshot file name sym".split()
    full = [base | r | {"sym": f"{r['file']}#{r['name']}"} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], "lang string, kind string, container string, decorators array<string>, test_path boolean, test_case boolean, snapshot string, file string, name string, sym string")


def test_support(spark):
    rows = [
        {"name": "Driver", "kind": "class", "file": "tests/helpers.py"}, {"name": "Alone", "kind": "class", "file": "tests/helpers.py"}, {"name": "BaseTest", "kind": "class", "file": "tests/base_test.py"}, {"name": "RareTest", "kind": "class", "file": "tests/base_test.py"},
        {"name": "db", "file": "tests/conftest.py", "decorators": ["pytest.fixture(scope='x')"]}, {"name": "make", "file": "tests/helpers.py"}, {"name": "once", "file": "tests/a_test.py"}, {"name": "twice", "file": "tests/a_test.py"}, {"name": "test_x", "file": "tests/a_test.py", "test_case": True},
        {"name": "nobody", "file": "tests/helpers.py"}, {"name": "prod", "file": "src/x.py", "test_path": False}, {"name": "Mk", "kind": "class", "lang": "make", "file": "tests/Makefile"},
    ]
    said = {"tests/a_test.py": "Driver BaseTest make twice RareTest Mk prod test_x", "tests/b_test.py": "BaseTest twice once test_x", "tests/c_test.py": "twice BaseTest Alone2 test_x", "tests/helpers.py": "Driver Alone make nobody", "src/y.py": "Alone nobody once", "tests/Makefile": "Alone nobody"}
    tokens = spark.createDataFrame([("s", f, t) for f, ts in said.items() for t in ts.split()], "snapshot string, file string, token string")
    f = facts(spark, rows)
    got = {r.sym.split("#")[1]: r.why for r in support.support(f, tokens).collect()}
    assert got == {"Driver": "class", "BaseTest": "class", "db": "fixture", "make": "function", "twice": "function"}
    others = {r.name: r.others for r in support.references(f, tokens).collect()}
    assert others["Driver"] == 1 and others["twice"] == 2 and others["Alone"] == 0 and others["once"] == 1


def test_case_labels(spark):
    rows = [{"name": "t", "container": c, "file": "tests/x.py", "test_case": True, "kind": "method"} for c in ("A", "B", None)] + [{"name": "u", "container": "A", "file": "tests/x.py", "test_case": True}, {"name": "t", "container": "A", "file": "tests/y.py", "test_case": True}]
    got = {(r.file[-4], r.container, r.name): r.label for r in support.case_labels(facts(spark, rows)).collect()}
    assert got == {("x", "A", "t"): "A.t", ("x", "B", "t"): "B.t", ("x", "", "t"): "t", ("x", "A", "u"): "u", ("y", "A", "t"): "t"}


def test_keys_sizes_and_self(spark):
    df = spark.createDataFrame([Row(file="f", lang="l", container=None, kind="fn", name="n", signature="", params=["int", "str"], param_names=["a"], returns="R", calls=["c1", "c22"], raises=["E"], decorators=[], fields=[], supers=[], permits=[], line=3)], "file string, lang string, container string, kind string, name string, signature string, params array<string>, param_names array<string>, returns string, calls array<string>, raises array<string>, decorators array<string>, fields array<string>, supers array<string>, permits array<string>, line int")
    size = lambda c, s="": support.estimated_size(F.lit(c), F.lit(s))
    r = df.select(support.bundle_key().alias("k"), support.argument_names().alias("a"), size("private-names").alias("p"), size("tested-call-chains").alias("t"), size("public-methods", "xx").alias("m"), support.as_self(F.lit("Foo.Bar(Foo):FooBar"), F.lit("Foo")).alias("s")).first()
    assert r.k == "f|l||fn|n|int,str|3" and r.a == ["a", "str"] and (r.p, r.t) == (2, 2 + 3 + 4) and r.m == 2 + 2 + 2 + 4 + 2 + 2 and r.s == "Self.Bar(Self):FooBar"


def test_ownerless_members(spark):
    f = member_queries.symbols(spark, "/root/testdata/sf0.001").where("kind = 'method'")
    f = code.with_facts(f.unionByName(f.withColumn("sym", F.concat("sym", F.lit("b")))))
    got = support.ownerless_members(f).where("name = 'help'").collect()
    assert got and all(r.rows == 2 and r.visibility == "priv" for r in got)


# --- the search under a budget


def made(rng, n):
    sizes = [rng.randint(1, 60) for _ in range(n)]
    needs = [frozenset({k, rng.randrange(k + 1)}) if rng.random() < 0.3 else frozenset({k}) for k in range(n)]
    return sizes, needs, lambda names: "x" * (40 + sum(sizes[k] for k in names))


def test_search_fits_and_leaves_nothing_that_fits():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 30)
        sizes, needs, render = made(rng, n)
        limit = rng.randint(10, 10 + sum(sizes) // 4 + 1)
        found = budget.search(render(frozenset()), list(range(n)), lambda k: needs[k], render, limit, most=400, repair=150)
        assert budget.tokens(found.text) <= limit and found.text == render(found.kept)
        if found.stop == "exhausted":
            assert all(needs[k] <= found.kept or budget.tokens(render(found.kept | needs[k])) > limit for k in range(n))
        first = next((k for k in range(n) if budget.tokens(render(needs[k])) <= limit), None)
        assert first is None or found.stop == "saturated" and not found.kept or needs[first] <= found.kept


def test_search_keeps_to_its_trials():
    rng = random.Random(6)
    sizes, needs, render = made(rng, 500)
    calls = []
    found = budget.search(render(frozenset()), list(range(500)), lambda k: needs[k], lambda x: calls.append(1) or render(x), 300)
    assert len(calls) == found.trials <= budget.TRIALS and budget.tokens(found.text) <= 300
    many = budget.search("", list(range(400)), lambda k: {k}, lambda x: "ab" * len(x), 210)
    assert many.kept >= set(range(400)) and many.trials < 20  # runs double: far fewer trials than facts
    assert budget.search("abc", [], lambda k: {k}, str, 99).stop == "no-candidates"


def test_a_later_fact_makes_an_earlier_one_fit():
    """Factoring isn't additive: with 2 there, 0 costs nothing."""
    cost = lambda names: 8 + (4 if 2 in names else 20 if 0 in names else 0) + 4 * (1 in names)
    found = budget.search("x" * 8, [0, 1, 2], lambda k: {k}, lambda x: "x" * cost(x), 5)
    assert found.kept == {0, 1, 2}


def test_statistics():
    facts_ = {"a": ("method", "r1"), "b": ("method", ""), "c": ("test", "r2")}
    found = budget.Search("x" * 40, frozenset({"a"}), 3, True, "trial-limit", 2)
    s = budget.statistics(20, "x" * 400, "x" * 40, "x" * 8, "d", facts_, {"a", "zz"}, found)
    assert s["retained_bundles"] == ["a"] and s["dropped_categories"] == {"method": 1, "test": 1} and s["retained_reasons"] == {"r1": 1} and s["utilization"] == 0.5 and s["fits"] and s["search_truncated"]
    assert budget.statistics(None, "", "", "", "full", facts_, set(facts_))["utilization"] is None and budget.smallest(["aaaaa", "b", "cc"]) == 1


@pytest.mark.parametrize("limit", [0, 60, 120, 250, 600, 100_000])
def test_maps_under_any_budget(spark, limit):
    f = member_queries.facts(spark, "/root/testdata/sf0.001").where("file LIKE 'n1%'")
    tokens = member_queries.tokens(f)
    files = spark.createDataFrame([("old", "a.java", "java", b"x", "x\n")], "snapshot string, path string, lang string, raw binary, text string")
    r = maps.build(files, f, code.edges(f), tokens, budget=limit or None).first()
    s = json.loads(r.stats)
    assert r.tokens == budget.tokens(r.text) == s["selected_tokens"] and s["skeleton_tokens"] <= s["full_tokens"]
    assert r.over == (bool(limit) and r.tokens > limit) and (not r.over or s["effective_detail"] == "minimum")
    assert r.kept + r.dropped == len(s["retained_bundles"]) + len(s["dropped_bundles"]) and s["fits"] == (not r.over)
    if limit in (0, 100_000):
        assert not r.dropped and s["effective_detail"] == "full"


def test_a_negative_budget_is_an_error(spark):
    with pytest.raises(ValueError, match="negative"):
        maps.build(None, None, None, None, budget=-1)
