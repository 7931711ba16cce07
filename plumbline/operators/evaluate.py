"""Evaluation of detections against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, FPR and FNR from tp, fp, fn and tn; 0 where undefined, to 4 places."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(2 * tp, 2 * tp + fp + fn),
            "accuracy": _share(tp + tn, tp + fp + fn + tn),
            "fpr": _share(fp, fp + tn),
            "fnr": _share(fn, fn + tp),
        }
    )


def confusion(judged: DataFrame, flagged: str, truth: str, *keys: str) -> DataFrame:
    f, t = F.coalesce(F.col(flagged), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    return judged.groupBy(*keys).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"))


def set_counts(universe: DataFrame, detected: DataFrame, attacks: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn and tn of id sets within a full universe."""
    marked = universe.select(key).distinct().join(detected.select(key).distinct().withColumn("d", F.lit(True)), key, "left").join(attacks.select(key).distinct().withColumn("a", F.lit(True)), key, "left")
    return confusion(marked, "d", "a")


def per_scenario(universe: DataFrame, detected: DataFrame, attacks: DataFrame, key: str, scenario: str) -> DataFrame:
    """Rates of each scenario. Detections of another scenario's attacks count neither for nor against it."""
    flags = universe.select(key).distinct().join(detected.select(key).distinct().withColumn("d", F.lit(True)), key, "left")
    totals = flags.join(attacks.select(key).distinct().withColumn("a", F.lit(True)), key, "left").agg(F.count_if(F.col("d").isNotNull() & F.col("a").isNull()).alias("fp"), F.count_if(F.col("d").isNull() & F.col("a").isNull()).alias("tn"))
    hits = attacks.select(scenario, key).distinct().join(flags, key).groupBy(scenario).agg(F.count("d").alias("tp"), F.count_if(F.col("d").isNull()).alias("fn"))
    return rates(hits.crossJoin(F.broadcast(totals)))


def group_attribution(flagged_groups: DataFrame, true_groups: DataFrame) -> DataFrame:
    """Rates of each group_type from the (group_type, group_id) that were flagged and that truly are bad; no tn."""
    both = flagged_groups.select("group_type", "group_id").distinct().withColumn("d", F.lit(True)).join(true_groups.select("group_type", "group_id").distinct().withColumn("a", F.lit(True)), ["group_type", "group_id"], "full_outer")
    return rates(confusion(both, "d", "a", "group_type"))


def clean_control(flags: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(detector, false_positives, fpr, verdict) on clean samples; below 0.05 is ACCEPTABLE. `flags` has an array flags."""
    n = universe.agg(F.count_distinct(key).alias("n"))
    per = flags.select(key, F.explode("flags").alias("detector")).groupBy("detector").agg(F.count_distinct(key).alias("false_positives"))
    rate = F.round(F.col("false_positives") / F.col("n"), 4)
    return per.crossJoin(F.broadcast(n)).select("detector", "false_positives", rate.alias("fpr"), F.when(rate < 0.05, "ACCEPTABLE").otherwise("NEEDS_REVIEW").alias("verdict"))


def event_rates(truth: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """(corruption, events, detected, rate): an event counts once however many rows it has.

    `truth` has the key, corruption and event_id (the source's id for a duplicate).
    """
    marked = truth.join(flagged.select(key).distinct().withColumn("d", F.lit(True)), key, "left")
    events = marked.groupBy("corruption", "event_id").agg(F.max(F.coalesce("d", F.lit(False))).alias("hit"))
    return events.groupBy("corruption").agg(F.count("*").alias("events"), F.count_if("hit").alias("detected")).withColumn("rate", _share(F.col("detected"), F.col("events")))


def check_precision(truth: DataFrame, flags: DataFrame, key: str, targets: dict[str, str]) -> DataFrame:
    """(check, tp, fp, precision, fpr): which flags of each check a corruption justifies.

    `truth` has the key, corruption and is_source (whether a duplicate was made of the sample), `flags` the key and a check a row,
    `targets` the corruption that each check looks for. The source of a duplicate is one as well, so it counts neither
    as a false positive nor, for its check, among the clean samples.
    """
    wanted = F.create_map(*(F.lit(x) for pair in targets.items() for x in pair))
    known = truth.select(key, F.coalesce("corruption", F.lit("")).alias("corruption"), F.coalesce("is_source", F.lit(False)).alias("is_source"))
    asked = known.select("*", F.explode(F.map_keys(wanted)).alias("check")).withColumn("just", (F.col("corruption") == wanted[F.col("check")]) | ((wanted[F.col("check")] == "duplicate") & F.col("is_source")))
    marked = asked.join(flags.select(key, "check").distinct().withColumn("d", F.lit(True)), [key, "check"], "left")
    counted = marked.groupBy("check").agg(F.count_if(F.col("d") & F.col("just")).alias("tp"), F.count_if(F.col("d") & ~F.col("just")).alias("fp"), F.count_if(~F.col("just")).alias("clean"))
    return counted.select("check", "tp", "fp", _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _share(F.col("fp"), F.col("clean")).alias("fpr"))


def inventory(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(item, expected, actual, matches) of counted items (item, n) against expectations (item, expected); what is missing counts 0."""
    both = expected.join(counts, "item", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return both.select("item", "expected", "actual", (F.col("expected") == F.col("actual")).alias("matches"))


def both_directions(windows: DataFrame) -> DataFrame:
    """(proved): whether the windows (kind, alert) of kind normal raise no alert and those of kind shifted all do."""
    expected = F.col("alert") == (F.col("kind") == "shifted")
    return windows.agg((F.coalesce(F.bool_and(expected), F.lit(False)) & (F.count_distinct("kind") == 2)).alias("proved"))
