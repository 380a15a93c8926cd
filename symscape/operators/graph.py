"""Reachability, transitive reduction and path tries over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.storage import drop, written


def closure(edges: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(src, dst): dst can be reached from src over edges (src, dst). With through (node), src and all nodes between must be in it.

    Rounds double the length of the paths known, so that a path of n edges takes log2(n) rounds, on graphs with cycles too. A round goes on
    from the pairs that the one before found alone: the first half of a shortest path that is still missing is among them."""
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    if through is not None:
        known = known.join(through.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    known = last = written(known, "closure")
    while True:
        longer = last.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        last = written(longer.distinct().join(known, ["src", "dst"], "left_anti"), "closure")
        if not last.count():
            drop(last)
            return known
        known = known.union(last)


def transitive_reduction(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """edges (src, dst, ...) without those to a node that another node of the same src reaches and that doesn't reach that one back.

    For each src either its targets meet each other, or each meets what it reaches, whichever makes fewer rows: a node with many targets
    would else have the square of their number, one with few targets the whole graph below them."""
    both = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "targets")
    below = reach.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"))
    sizes = both.join(below, "dst", "left").groupBy("src").agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("k > 1")
    paired = F.col("n") > F.col("k").cast("double") * (F.col("k") - 1)
    few = both.join(sizes.where(paired).select("src"), "src", "left_semi")
    pair = few.alias("t").join(few.alias("o"), "src").where("t.dst <> o.dst").select("src", F.col("t.dst").alias("dst"), F.col("o.dst").alias("other"))
    pair = pair.join(reach.select(F.col("src").alias("other"), "dst"), ["other", "dst"], "left_semi").select("src", "dst", "other")
    many = both.join(sizes.where(~paired).select("src"), "src", "left_semi").withColumnRenamed("dst", "other")
    met = many.join(reach.select(F.col("src").alias("other"), "dst"), "other").where("dst <> other").join(both, ["src", "dst"], "left_semi").select("src", "dst", "other")
    back = reach.select(F.col("src").alias("dst"), F.col("dst").alias("other"))
    implied = pair.union(met).join(back, ["dst", "other"], "left_anti").select("src", "dst").distinct()
    return edges.join(implied, ["src", "dst"], "left_anti")


def path_prefixes(df: DataFrame, path: str) -> DataFrame:
    """(prefix, depth, below, children): every directory prefix of the paths, the number of paths under it and of distinct next parts."""
    parts = F.split(F.col(path), "/")
    rows = df.where(F.col(path).isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("prefix"), k.cast("long").alias("depth"), F.try_element_at(parts, k + 1).alias("next")))).alias("p"))
    return rows.groupBy("p.prefix", "p.depth").agg(F.count("*").alias("below"), F.countDistinct("p.next").alias("children"))


def compressed_trie(df: DataFrame, path: str) -> DataFrame:
    """(node, label, depth): the prefixes that have payload or not just one child, each with the label from the nearest such prefix above."""
    nodes = path_prefixes(df, path)
    ends = df.groupBy(F.col(path).alias("prefix")).agg(F.count("*").alias("payload"))
    kept = nodes.join(ends, "prefix", "left").where((F.col("children") != 1) | F.col("payload").isNotNull()).select("prefix", "depth")
    parts = F.split("prefix", "/")
    above = kept.select("prefix", "depth", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int") - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("up"), k.alias("k")))).alias("u"))
    near = above.join(kept.select(F.col("prefix").alias("up_prefix")).union(df.sparkSession.createDataFrame([("",)], "up_prefix string")).distinct(), F.col("u.up") == F.col("up_prefix")).groupBy("prefix", "depth").agg(F.max("u.k").alias("k"))
    return near.select(F.col("prefix").alias("node"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("depth").cast("int")), "/").alias("label"), "depth")
