import difflib

import pytest
from pyspark.sql import functions as F

from symscape.plans import documents as docs
from symscape.plans import maps

MAP = "# map\nlegend\na.py:\n f(x)\n g()\n· 1,204 LOC · input 9 · output 8 tokens · state abcdef012345 · langs python,go · targets CLAUDE.md, .rules · budget 500\n"
tokens = lambda s: (len(s) + 3) // 4


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


def test_targets(spark):
    listing = [("a", "AGENTS.md", False), ("a", "src/CLAUDE.md", False), ("a", ".cursor/rules", True), ("a", ".roo/rules", False), ("b", "x.py", False), ("c", ".clinerules", True), ("c", "CLAUDE.md", True)]
    got = {(r.root, r.target) for r in docs.targets(spark.createDataFrame(listing, "root string, path string, is_folder boolean")).collect()}
    assert got == {("a", "AGENTS.md"), ("a", ".cursor/rules/map.mdc"), ("b", "CLAUDE.md"), ("c", ".clinerules/map.md")}
    assert docs.candidates(spark).count() == 20


def test_resolved(spark):
    assert docs.resolved(spark, ["AGENTS.md", "map.mdc", "AGENTS.md"], stored=False) == [".cursor/rules/map.mdc", "AGENTS.md"]
    for wanted, stored, why in ((["map.md"], False, "ambiguous"), (["zzz"], False, "unknown"), (["map.mdc"], True, "invalid stored")):
        with pytest.raises(ValueError, match=why):
            docs.resolved(spark, wanted, stored)


@pytest.mark.parametrize(("path", "begins"), [("r/.continue/rules/map.md", "---\nname"), (".continue/rules/map.md", "---\nname"), (".roo/rules/map.md", ""), ("a.mdc", "---\ndescription"), ("x/y.instructions.md", "---\napplyTo"), ("CLAUDE.md", "")])
def test_seeds(spark, path, begins):
    got = one(spark, docs.seed(F.col("p")), p=path)
    assert got.startswith(begins) and bool(got) == bool(begins)


@pytest.mark.parametrize("coaching", [True, False])
def test_cost_sums(spark, coaching):
    for body in (MAP, MAP + "\n\n \n", "x", ""):
        r = one(spark, docs.cost(F.col("b"), coaching), b=body)
        assert r.digest + r.wrapper + r.coaching == r.whole == tokens(one(spark, docs.block(F.col("b"), coaching), b=body)) and (r.coaching > 0) == coaching and r.digest == tokens(body.rstrip() + "\n")


def test_blocks(spark):
    put = lambda existing, path="CLAUDE.md", body=MAP: one(spark, docs.with_block(F.col("e"), F.col("p"), F.col("b")), e=existing, p=path, b=body)
    first = put("# doc\n\ntext\n\n")
    assert first.startswith("# doc\n\ntext\n\n" + maps.START) and first.endswith(maps.END + "\n") and put(first) == first
    changed = put(f"{maps.END} before " + first + "behind", body="new\n")
    assert changed.startswith(f"{maps.END} before # doc") and changed.endswith(maps.END + "\nbehind") and "new\n```" in changed and "f(x)" not in changed
    assert put(None, "a/b.mdc").startswith("---\ndescription") and put(None).startswith(maps.START) and put(" \n").count(maps.START) == 1
    r = one(spark, docs.loaded(F.col("e")), e=first)
    cost = one(spark, docs.cost(F.col("b")), b=MAP)
    assert (r.whole, r.coaching) == (cost.whole, cost.coaching) and r.digest == tokens(MAP.rstrip()) and r.digest + r.wrapper + r.coaching == r.whole
    assert one(spark, docs.loaded(F.col("e")), e="none " + maps.START).whole is None
    assert one(spark, maps.embedded_map(F.col("e")), e=first) == MAP.rstrip()


def test_settings(spark):
    r = one(spark, docs.settings(F.col("b")), b=MAP)
    assert (r.langs, r.targets, r.budget, r.state) == (["go", "python"], ["CLAUDE.md", ".rules"], 500, "abcdef012345")
    r = one(spark, docs.settings(F.col("b")), b="· 1 LOC · budget 5\n X=1 · budget 9\n")
    assert (r.langs, r.targets, r.budget, r.state) == (None, None, None, None)


def test_differences(spark):
    new = MAP.replace(" g()", " g(y)\n h()").replace("1,204", "9")
    got = one(spark, docs.difference(F.col("a"), F.col("b"), F.lit("HEAD")), a=MAP, b=new)
    assert got == list(difflib.unified_diff(["a.py:", " f(x)", " g()"], ["a.py:", " f(x)", " g(y)", " h()"], fromfile="HEAD", tofile="worktree", lineterm=""))
    assert one(spark, docs.difference(F.col("a"), F.col("b"), F.lit("HEAD")), a=MAP, b=MAP.replace("1,204", "7")) == []
    assert one(spark, docs.too_large(F.col("a"), 10), a=MAP) and not one(spark, docs.too_large(F.col("a"), managed=True), a=MAP)
