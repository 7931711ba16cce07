"""Profiles: distributions, digests, robust statistics and column diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import LEVELS, change_level, relative_change, worst
from plumbline.operators.drift import indexed
from plumbline.tables import durable


#: Rows of a digest's group.
GROUP_ROWS = 1 << 16


def distribution(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n"))


def digest(frame: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): an order-insensitive hash of a table of any size.

    Rows are hashed and dealt to groups by a prefix of the hash that grows with the number of rows, so that a
    group has at most about GROUP_ROWS of them; a group's digest is that of its sorted hashes. Groups are
    joined 256 at a time in the same way until one is left.
    """
    hashed = frame.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256).alias("h"))
    size, total = 2, hashed.count()
    while total > GROUP_ROWS * 16**size:
        size += 2
    level = hashed.groupBy(F.substring("h", 1, size).alias("g")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ","), 256)
    for left in range(size - 2, 0, -2):
        level = level.groupBy(F.substring("g", 1, left).alias("p")).agg(F.sum("n").alias("n"), joined.alias("d")).withColumnRenamed("p", "g")
    return level.agg(F.sum("n").alias("n"), joined.alias("digest"))


def dimension_stats(frame: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, pos, mean, std, n) of each dimension, with the population's std."""
    return frame.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))


def mean_vector(stats: DataFrame, *keys: str) -> DataFrame:
    """Mean and std arrays from dimension_stats; one row a key, as long as the vectors."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return stats.groupBy(*keys).agg(ordered.alias("s")).select(*keys, F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))


def robust_scale(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median, mad, n), exact; one shuffle for each of the two passes."""
    centre = frame.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    apart = frame.join(centre, list(keys)) if keys else frame.crossJoin(F.broadcast(centre))
    spread = apart.groupBy(*keys, "median", "n").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return spread.select(*keys, "median", "mad", "n")


def threshold_from(scale: DataFrame, k: float = 5.0) -> DataFrame:
    return scale.withColumn("threshold", F.col("median") + k * 1.4826 * F.col("mad"))


def placed(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """`frame` with __place, a row's 0-based place in its group, and __n, the group's rows.

    Places come from global row numbers, so that a group of any size is sorted by many tasks.
    """
    return in_groups(indexed(frame, [key, *order], "__at"), key)


def in_groups(rows: DataFrame, key: str) -> DataFrame:
    """__place and __n of rows with a global number __at. Groups are written first, so that Spark knows whether they are few enough to go to all tasks."""
    groups = durable(rows.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")))
    return rows.join(groups, F.col(key).eqNullSafe(F.col("__key"))).withColumn("__place", F.col("__at") - F.col("__first")).drop("__at", "__key", "__first")


def trimmed(frame: DataFrame, distance: str, key: str, tie: str, trim: float = 0.10, least: int = 8) -> DataFrame:
    """Of each group the max(least, ceil(n (1 - trim))) rows nearest by `distance`, ties by `tie`."""
    keep = F.greatest(F.lit(least), F.ceil(F.round(F.col("__n") * (1 - trim), 9)))
    return placed(frame, key, distance, tie).filter(F.col("__place") < keep).drop("__place", "__n")


def folds(frame: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """A column `fold`: rows of each label dealt evenly over k folds in the order of a seeded hash."""
    dealt = placed(frame.withColumn("__hash", F.xxhash64(F.col(key), F.lit(seed))), label, "__hash", key)
    return dealt.withColumn("fold", F.pmod("__place", F.lit(k)).cast("int")).drop("__hash", "__place", "__n")


def null_summary(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, std, min, median, p95, p99 and max; quantiles interpolate linearly."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    summed = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return summed.select(*keys, "n", "mean", "std", "min", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "max")


def column_diagnostics(reference: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, statistic, reference, live, change, level): how columns moved, in one pass a side."""

    def stats(frame: DataFrame, side: str) -> DataFrame:
        row = frame.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
        parts = ", ".join(f"'{c}', '{n}', {c}_{n}" for c in columns for n in ("mean", "std"))
        return row.selectExpr(f"stack({2 * len(columns)}, {parts}) as (column_name, statistic, {side})")

    both = stats(reference, "reference").join(stats(live, "live"), ["column_name", "statistic"])
    change = relative_change(F.col("live"), F.col("reference"))
    return both.withColumn("change", change).withColumn("level", change_level(F.col("change")))


def set_change(reference: DataFrame, live: DataFrame, column: str) -> DataFrame:
    """(level): HIGH if the distinct values differ, LOW if equal, NOT_AVAILABLE if both are empty."""
    old, new = (f.select(F.col(column).alias("v")).filter("v is not null").distinct() for f in (reference, live))
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), "v", "full_outer")
    return both.agg(F.when(F.count("*") == 0, "NOT_AVAILABLE").when(F.count_if(F.col("o").isNull() | F.col("n").isNull()) > 0, "HIGH").otherwise("LOW").alias("level"))


def window_levels(reference: DataFrame, members: DataFrame, groups: dict[str, list[str]], sets: tuple[str, ...] = (), level: str = "MEDIUM") -> DataFrame:
    """(window_no, names, levels) of the windows of `members` against `reference`, a row of a few numbers that goes to all tasks.

    A group of columns has the worst level of the changes of their means, a set column `level` if its distinct
    values differ, and NOT_AVAILABLE if it has none on both sides.
    """
    columns = [c for group in groups.values() for c in group]
    means = [F.avg(c).alias(f"mean_{c}") for c in columns]
    held = [F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"set_{c}") for c in sets]
    base = reference.agg(*means, *held).toDF(*(f"ref_{name}" for name in [f"mean_{c}" for c in columns] + [f"set_{c}" for c in sets]))
    both = members.groupBy("window_no").agg(*means, *held).crossJoin(F.broadcast(base))
    moved = lambda c: change_level(relative_change(F.col(f"mean_{c}"), F.col(f"ref_mean_{c}")))
    found = [F.when(F.coalesce(*(F.col(f"mean_{c}") for c in group)).isNull(), "NOT_AVAILABLE").otherwise(worst(F.array(*map(moved, group)), LEVELS)) for group in groups.values()]
    differs = lambda c: F.when((F.size(f"set_{c}") == 0) & (F.size(f"ref_set_{c}") == 0), "NOT_AVAILABLE").when(F.col(f"set_{c}") != F.col(f"ref_set_{c}"), level).otherwise("LOW")
    return both.select("window_no", F.array(*map(F.lit, [*groups, *sets])).alias("names"), F.array(*found, *map(differs, sets)).alias("levels"))
