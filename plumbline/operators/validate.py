"""Row and referential validation: each check lists its violations, nothing stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_hash, is_signature


def violations(**checks: Column) -> Column:
    """Names of the checks that a row breaks; a check whose result is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), name) for name, good in checks.items())))


def coverage(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(side, n): samples without a label, and labels without a sample."""
    missing = samples.select(key).join(labels.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing_label").alias("side"), "n")
    unknown = labels.select(key).join(samples.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_sample").alias("side"), "n")
    return missing.unionByName(unknown)


def require_coverage(samples: DataFrame, labels: DataFrame, key: str) -> None:
    """Fail closed: every sample has a label and every label a sample."""
    broken = {row["side"]: row["n"] for row in coverage(samples, labels, key).collect() if row["n"]}
    if broken:
        raise ValueError(f"labels and samples differ: {broken}")


def orphans(child: DataFrame, parent: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """(relation, n): rows of `child` whose non-null key is not in `parent`."""
    keys = parent.select(F.col(on[1]).alias(on[0])).distinct()
    return child.filter(F.col(on[0]).isNotNull()).join(keys, on[0], "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(paired, left_only, right_only) of the distinct keys of two tables."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("paired"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def finding_violations() -> Column:
    """Violations of the nine fields of a finding row."""
    text = lambda name: F.length(F.trim(F.col(name))) > 0
    number = F.col("confidence").try_cast("double")
    required = {f"{name}_required": text(name) for name in ("assetID", "moduleName", "reason", "evidenceHash", "confidence", "severity", "disposition", "timestamp", "signature")}
    return violations(
        **required,
        confidence_range=(number >= 0) & (number <= 1),
        severity_unknown=F.col("severity").isin("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"),
        disposition_unknown=F.col("disposition").isin("ACCEPT", "REVIEW", "QUARANTINE"),
        evidence_hash_form=is_hash(F.col("evidenceHash")),
        signature_form=is_signature(F.col("signature")),
    )


def guard_range(name: str, value: float, low: float, high: float) -> None:
    """Refuse a parameter that is no number from `low` to `high`."""
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}, not from {low} to {high}")


def guard_vectors(frame: DataFrame, key: str, vector: str, least: int = 2) -> None:
    """One pass of input guards over a vector table; raises with all that is wrong."""
    v = F.col(vector)
    row = frame.agg(
        F.count("*").alias("n"),
        F.count_distinct(key).alias("ids"),
        F.min(F.size(v)).alias("low"),
        F.max(F.size(v)).alias("high"),
        F.count_if(v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
    ).first()
    wrong = [text for broken, text in ((row["n"] < least, f"{row['n']} rows, at least {least} needed"), (row["ids"] != row["n"], "ids repeat"), (row["low"] != row["high"], "dimensions differ"), (row["bad"], f"{row['bad']} rows hold no finite numbers")) if broken]
    if wrong:
        raise ValueError("; ".join(wrong))
