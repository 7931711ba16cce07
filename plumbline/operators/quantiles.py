"""Quantiles of groups of any size: mergeable sketches, and exact values found inside a sketch's bracket.

A KLL sketch has a few kilobytes whatever its group holds; sketches of tasks, files or days merge. The exact
form takes from it, for each quantile, two values that very likely enclose it, counts the rows below and
keeps the few between them. These are numbered by a global order over many tasks, so that no task holds
a group, and the rows at the wanted ranks give the quantile. Where a bracket turns out not to hold its
ranks (the sketch is random), the same is done with all rows of the group.

Nulls and NaN do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.profile import placed
from plumbline.tables import durable

#: Size of a sketch, and the part of a group by which its ranks may be off on either side.
K, SLACK = 400, 0.01
#: Distinct values whose counts one task adds up.
BLOCK = 1 << 16


def _keyed(frame: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    x = F.col(value).cast("double")
    return frame.select(F.struct(*keys, F.lit(0).alias("__all")).alias("key"), x.alias("x")).filter(x.isNotNull() & ~F.isnan(x))


def sketches(frame: DataFrame, value: str, *keys: str, k: int = K) -> DataFrame:
    """(keys, sketch, n): a sketch of each group, to be kept and merged."""
    rows = _keyed(frame, value, keys)
    return rows.groupBy("key").agg(F.kll_sketch_agg_double("x", k).alias("sketch"), F.count("*").alias("n")).select(*(F.col(f"key.{c}").alias(c) for c in keys), "sketch", "n")


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, sketch, n) of several tables of sketches together."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketched(held: DataFrame, probabilities: list[float], *keys: str) -> DataFrame:
    """(keys, n, quantiles): about the quantiles of sketches, an array in the order of `probabilities`."""
    return held.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, probabilities))).alias("quantiles"))


def _between(lower: Column, upper: Column, position: Column) -> Column:
    """Linear interpolation between neighbouring ranks."""
    floor, ceil = F.floor(position), F.ceil(position)
    return F.when((floor == ceil) | (lower == upper), lower).otherwise((ceil - position) * lower + (position - floor) * upper)


def exact(frame: DataFrame, value: str, probabilities: list[float], *keys: str, k: int = K, slack: float = SLACK) -> DataFrame:
    """(keys, n, quantiles): exact quantiles with linear interpolation, equal to Spark's percentile, for groups of any size."""
    rows = durable(_keyed(frame, value, keys))
    groups = rows.groupBy("key").agg(F.kll_sketch_agg_double("x", k).alias("sketch"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    edge = lambda p, otherwise: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) if 0 < p < 1 else F.col(otherwise)
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("position"), edge(p - slack, "least").alias("low"), edge(p + slack, "most").alias("high")) for i, p in enumerate(probabilities)))
    wanted = durable(groups.select("key", "n", "least", "most", F.explode(brackets).alias("b")).select("key", "n", "least", "most", "b.*"))

    def found(asked: DataFrame) -> DataFrame:
        """(key, i, lower, upper) of those brackets that hold both ranks."""
        inside = rows.join(asked, "key").filter(F.col("x") <= F.col("high"))
        below = inside.groupBy("key", "i").agg(F.count_if(F.col("x") < F.col("low")).alias("below"))
        held = inside.filter(F.col("x") >= F.col("low")).select(F.struct("key", "i").alias("slot"), "x", "position")
        # equal values count once, with their number, before they are put in order
        ranked = placed(held.groupBy("slot", "position", "x").agg(F.count("*").alias("times")), "slot", "x")
        return _at_ranks(ranked, below)

    first = durable(found(wanted))
    missed = wanted.join(first, ["key", "i"], "left_anti").withColumns({"low": F.col("least"), "high": F.col("most")})
    both = first.unionByName(found(missed)) if not missed.isEmpty() else first
    joined = wanted.join(both, ["key", "i"]).withColumn("q", _between(F.col("lower"), F.col("upper"), F.col("position")))
    done = joined.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    return done.select(*(F.col(f"key.{c}").alias(c) for c in keys), "n", F.col("q.q").alias("quantiles"))


def _at_ranks(ranked: DataFrame, below: DataFrame) -> DataFrame:
    """(key, i, lower, upper): the values at the two ranks around each position; `ranked` has each distinct value of a slot with its times and place.

    Ranks are running sums over a slot, taken in blocks of places: sums of whole blocks first, then within a block.
    """
    block = (F.col("__place") / BLOCK).cast("long")
    rows = durable(ranked.withColumn("block", block))
    sums = rows.groupBy("slot", "block").agg(F.sum("times").alias("size"))
    order = Window.partitionBy("slot").orderBy("block")
    starts = sums.withColumn("start", F.sum("size").over(order) - F.col("size")).select("slot", "block", "start")
    within = Window.partitionBy("slot", "block").orderBy("x")
    until = rows.join(starts, ["slot", "block"]).withColumn("until", F.col("start") + F.sum("times").over(within)).select("slot.*", "position", "x", "times", "until")
    placed_ = until.join(below, ["key", "i"]).withColumns({"first": F.col("below") + F.col("until") - F.col("times"), "last": F.col("below") + F.col("until") - 1})
    has = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("x")))
    return placed_.groupBy("key", "i").agg(has(F.floor("position")).alias("lower"), has(F.ceil("position")).alias("upper")).filter("lower is not null and upper is not null")


def robust_scale(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median, mad, n) as profile.robust_scale gives them, for groups of any size."""
    centre = durable(exact(frame, value, [0.5], *keys).select(*keys, F.col("quantiles")[0].alias("median"), "n"))
    by = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    named = centre.select(*(F.col(c).alias(f"__{c}") for c in keys), "median")
    apart = frame.join(named, by) if keys else frame.crossJoin(F.broadcast(named))
    spread = exact(apart.select(*keys, F.abs(F.col(value) - F.col("median")).alias("__apart")), "__apart", [0.5], *keys)
    mad = spread.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("quantiles")[0].alias("mad"))
    joined = centre.join(mad, by) if keys else centre.crossJoin(F.broadcast(mad))
    return joined.select(*keys, "median", "mad", "n")


def null_summary(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, std, min, median, p95, p99 and max as profile.null_summary gives them, for groups of any size."""
    moments = frame.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    q = exact(frame, value, [0.5, 0.95, 0.99], *keys).select(*(F.col(c).alias(f"__{c}") for c in keys), "quantiles")
    joined = moments.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left") if keys else moments.crossJoin(F.broadcast(q))
    return joined.select(*keys, "n", "mean", "std", "min", *(F.col("quantiles")[i].alias(name) for i, name in enumerate(("median", "p95", "p99"))), "max")
