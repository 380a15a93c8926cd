"""Generic aggregations, rankings and set operations over any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order, which must be total. One shuffle; no row is sorted that another of its key beats on the map side."""
    return _extreme(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order, which must be total."""
    return _extreme(df, keys, order, F.min_by)


def _extreme(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return one.select(*keys, "__row.*").select(*df.columns)


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank, and how many rows of the group are left out. Each task keeps n rows of a group before they are shuffled; numbers of rows come from an aggregation of their own."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)
    totals = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return ranked.alias("r").join(totals.alias("t"), _same("r", "t", keys)).select("r.*", F.greatest(F.col("t.__n") - n, F.lit(0)).alias("omitted"))


def round_robin(df: DataFrame, tier: Column, group: Column, order: list[Column]) -> DataFrame:
    """Rows in breadth-first order within tiers: all groups' first, then all second rows. Adds tier, turn."""
    w = Window.partitionBy("tier", "__group").orderBy(*order)
    return df.withColumns({"tier": tier, "__group": group}).withColumn("turn", F.row_number().over(w).cast("long")).drop("__group")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): exact medians of the values that aren't null, as doubles; for a few large groups.

    A sketch tells between which two values the middle lies; all below are only counted, and just the distinct values between, with their
    numbers, are put in order. So no task holds a group, however large or uneven."""
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    near = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__x", F.array(F.lit(0.49), F.lit(0.51)), F.lit(1000)).alias("q"))
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    both = known.alias("a").join(near.alias("b"), on).where(F.col("__x") <= F.col("q")[1])
    counts = both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.when(F.col("__x") >= F.col("q")[0], F.col("__x")).alias("__v")).agg(F.count("*").alias("__c"), F.first("n").alias("n"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__upto", upto)
    # The middle places, from 0: (n - 1) / 2 and n / 2, rounded down.
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return placed.groupBy(*keys).agg(((low + high) / 2).alias("median"), F.first("n").alias("n"))


def median_mad(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Exact median and median absolute deviation of the values that aren't null, with their number."""
    centre = medians(df, keys, value)
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    on = reduce(lambda x, y: x & y, [F.col(f"k.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], F.lit(True))
    apart = known.alias("k").join(centre.alias("c"), on).select(*[F.col(f"k.{k}").alias(k) for k in keys], F.abs(F.col("__x") - F.col("median")).alias("__d"))
    spread = medians(apart, keys, "__d").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("median").alias("mad"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return centre.join(spread, same).select(*keys, "n", F.round("median", digits).alias("median"), F.round("mad", digits).alias("mad"))


def percent(flag: Column, applies: Column, digits: int = 4) -> tuple[Column, Column]:
    """(percentage of the rows that it applies to, their number); null and 0 where there are none."""
    held = F.when(applies & flag.isNotNull(), F.when(flag, 100.0).otherwise(0.0))
    return F.round(F.avg(held), digits), F.count(held)


def matched_deltas(df: DataFrame, pair: str, arm: str, value: str, treatment: str, control: str, digits: int = 6) -> DataFrame:
    """For each pair the treatment's mean minus the control's where both exist, else the reason why there is none."""
    means = df.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.avg(F.when(F.col(arm) == treatment, F.col(value))).alias("t"), F.avg(F.when(F.col(arm) == control, F.col(value))).alias("c"))
    reason = F.when(F.col("t").isNull() & F.col("c").isNull(), "neither").when(F.col("t").isNull(), f"no {treatment}").when(F.col("c").isNull(), f"no {control}")
    return means.select(pair, F.round(F.col("t") - F.col("c"), digits).alias("delta"), reason.alias("reason"))


def followed(df: DataFrame, key: str, order: list[str], kind: str, steps: list[str]) -> DataFrame:
    """The keys that have all steps in this order, other rows between them or not, with the place (in the order, from 1) of the earliest last step."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(kind).alias("__kind"))))
    kinds = df.where(F.col(key).isNotNull() & F.col(kind).isin(*steps)).groupBy(key).agg(rows.alias("r"))
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("at"), F.lit(0).alias("place"))
    wanted = F.array(*[F.lit(s) for s in steps])

    def step(s: Column, r: Column) -> Column:
        place = s["place"] + 1
        hit = (s["done"] < len(steps)) & (r["__kind"] == F.try_element_at(wanted, s["done"] + 1))
        return F.struct(F.when(hit, s["done"] + 1).otherwise(s["done"]).alias("done"), F.when(hit, place).otherwise(s["at"]).alias("at"), place.alias("place"))

    out = kinds.select(key, F.aggregate("r", zero, step).alias("s")).where(F.col("s.done") == len(steps))
    return out.select(key, F.col("s.at").cast("long").alias("place"))


def dominant(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Per key the value that holds two thirds of at least `least` rows, and more than any other; keys without one are left out."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))), 1, 2).alias("top"))
    n, second = -F.col("top")[0]["m"], F.when(F.size("top") > 1, -F.try_element_at("top", F.lit(2))["m"]).otherwise(0)
    return top.where((F.col("total") >= least) & (n * 3 >= F.col("total") * 2) & (n > second)).select(*keys, F.col("top")[0]["v"].alias(value), n.alias("n"), "total")


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed or changed keys of two tables with one row for each key. One join."""
    o, n = old.select(*keys, F.col(value).alias("__o"), F.lit(True).alias("__in_o")), new.select(*keys, F.col(value).alias("__n"), F.lit(True).alias("__in_n"))
    both = o.join(n, keys, "full_outer")
    change = F.when(F.col("__in_o").isNull(), "added").when(F.col("__in_n").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def unique_lookup(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the value of each key that has just one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(value).alias(name)).where("__n = 1").drop("__n")


def canonical(df: DataFrame, keys: list[str], shape: list[str], better: list[Column], value: str, name: str) -> DataFrame:
    """(keys, name): where all rows of a key have one shape, the value of the best row (the first, by value, of equals)."""
    best = F.max_by(F.struct(F.col(value)), F.struct(*better))
    one = df.groupBy(*keys).agg(F.countDistinct(F.struct(*shape)).alias("__shapes"), best.alias("__best"))
    return one.where("__shapes = 1").select(*keys, F.col(f"__best.{value}").alias(name))


def prefix_within(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The rows of each group, in order, as long as their sizes, none below 0, together stay within the budget. Adds used.

    A group is first cut down in parts: what comes too late in a part of it comes too late in the whole, so that the last step has few rows of even the largest group."""
    part = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    few = df.withColumn("__part", F.spark_partition_id()).withColumn("__own", F.sum(size).over(part)).where(F.col("__own") <= budget).drop("__part", "__own")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return few.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ordered_hash(df: DataFrame, keys: list[str], order: list[str], parts: list[Column], digits: int = 12) -> DataFrame:
    """A hash of all rows of a group in order: the md5 of the rows' md5 digests, cut to so many digits. Rows are hashed before they are gathered."""
    each = F.md5(F.concat_ws("\x1f", *parts))
    rows = F.sort_array(F.collect_list(F.struct(*order, each.alias("__h"))))
    return df.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.substring(F.md5(F.array_join(F.transform("r", lambda x: x["__h"]), "")), 1, digits).alias("state"))
