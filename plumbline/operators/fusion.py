"""Merging the flags of several detectors into one record per sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import by_rank, chain, rank
from plumbline.functions.vectors import noisy_or


def merge(flags: dict[str, DataFrame], key: str, severity: dict[str, str]) -> DataFrame:
    """(key, flags, n_flags, confidence, severity, disposition) of samples that any detector flagged.

    Detectors are tables of flagged ids. Confidence grows by 0.15 a further flag from 0.60 to 0.95;
    severity is the worst of the detectors', one step up when two or more agree; all go to review.
    """
    named = reduce(DataFrame.unionByName, (frame.select(key).distinct().withColumns({"flag": F.lit(name), "place": rank(F.lit(severity[name]))}) for name, frame in flags.items()))
    summed = named.groupBy(key).agg(F.array_sort(F.collect_list("flag")).alias("flags"), F.count("*").cast("int").alias("n_flags"), F.max("place").alias("place"))
    worst = F.least(F.col("place") + F.when(F.col("n_flags") >= 2, 1).otherwise(0), F.lit(4))
    return summed.select(key, "flags", "n_flags", F.round(F.least(0.60 + 0.15 * (F.col("n_flags") - 1), F.lit(0.95)), 2).alias("confidence"), by_rank(worst).alias("severity"), F.lit("REVIEW").alias("disposition"))


def fuse(flags: DataFrame, key: str, group_severity: DataFrame | None = None) -> DataFrame:
    """(key, detectors, confidence, severity, disposition) from rows (key, detector, confidence, severity).

    Confidences join by noisy or. A trigger is HIGH at least, and CRITICAL from 0.88; two detectors, or a
    HIGH group that the sample belongs to, make HIGH at least. QUARANTINE takes a trigger, HIGH and 0.90.
    `group_severity` has (key, group_place), the greatest severity rank of a sample's groups.
    """
    each = flags.groupBy(key).agg(F.array_sort(F.collect_set("detector")).alias("detectors"), noisy_or(F.collect_list(F.col("confidence").cast("double"))).alias("confidence"), F.max(rank(F.col("severity"))).alias("place"))
    each = each.join(group_severity, key, "left") if group_severity is not None else each.withColumn("group_place", F.lit(None).cast("int"))
    trigger, several = F.array_contains("detectors", "trigger"), F.size("detectors") >= 2
    raised = chain((trigger & (F.col("confidence") >= 0.88), F.lit(4)), (trigger | several | (F.coalesce("group_place", F.lit(-1)) >= 3), F.greatest(F.col("place"), F.lit(3))), otherwise=F.col("place"))
    done = each.withColumn("place", raised)
    decided = F.when(trigger & (F.col("place") >= 3) & (F.col("confidence") >= 0.90), "QUARANTINE").otherwise("REVIEW")
    return done.select(key, "detectors", "confidence", by_rank(F.col("place")).alias("severity"), decided.alias("disposition"))


def group_places(provenance: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, group_place, group_findings): the greatest severity rank of the flagged groups that a sample belongs to, and their number.

    `provenance` has the key and a column <type>_id for each type of group, `groups` group_type, group_id and severity. Each
    type is a key of one equi-join, so a sample meets at most one group of each type.
    """
    types = [c.removesuffix("_id") for c in provenance.columns if c.endswith("_id") and c != key]
    belongs = F.explode(F.array(*(F.struct(F.lit(t).alias("group_type"), F.col(f"{t}_id").cast("string").alias("group_id")) for t in types))).alias("g")
    members = provenance.select(key, belongs).select(key, "g.*").filter("group_id is not null")
    worst = groups.groupBy("group_type", F.col("group_id").cast("string").alias("group_id")).agg(F.max(rank(F.col("severity"))).alias("place"))
    return members.join(worst, ["group_type", "group_id"]).groupBy(key).agg(F.max("place").alias("group_place"), F.count("*").alias("group_findings"))


def run_summary(merged: DataFrame) -> DataFrame:
    """(kind, name, n): flagged samples by detector and by severity."""
    checks = merged.select(F.explode("flags").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("check").alias("kind"), "name", "n")
    return checks.unionByName(merged.groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("n")).select(F.lit("severity").alias("kind"), "name", "n"))
