"""Table roll-ups behind overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import by_rank, rank


def threats_by_module(findings: DataFrame, module: str, severity: str) -> DataFrame:
    return findings.groupBy(module).agg(F.count("*").alias("n"), by_rank(F.max(rank(F.col(severity)))).alias("max_severity"))


def overview(findings: DataFrame) -> DataFrame:
    """One row of counts: all, grave, quarantined and of drift, alerts of the data and model modules, and what the ledger holds, if `findings` has ledger_status."""
    grave = F.col("severity").isin("HIGH", "CRITICAL")
    committed = F.count_if(F.col("ledger_status") == "COMMITTED") if "ledger_status" in findings.columns else F.lit(0).cast("long")
    return findings.agg(
        F.count("*").alias("total"),
        F.count_if(grave).alias("grave"),
        F.count_if(F.col("disposition") == "QUARANTINE").alias("quarantined"),
        F.count_distinct("asset_id").alias("assets"),
        F.count_if(F.col("module_name") == "DistributionShift").alias("drift_events"),
        F.count_if(F.col("module_name").isin("DataIntegrity", "ModelIntegrity") & grave).alias("integrity_alerts"),
        committed.alias("committed"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("disposition") != "ACCEPT").cast("double"), F.count("*")), F.lit(0.0)), 4).alias("anomaly_rate"),
    )


def activity_series(events: DataFrame, ts: str, module: str, as_of: str, buckets: int, seconds: int) -> DataFrame:
    """(bucket, module, n): `buckets` equal spans that end at `as_of`, empty ones with 0 for each module that occurs at all."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000
    placed = events.withColumn("bucket", (F.lit(buckets - 1) - F.floor(age / seconds)).cast("int")).filter((age >= 0) & (F.col("bucket") >= 0))
    counted = placed.groupBy("bucket", module).agg(F.count("*").alias("n"))
    spine = events.select(module).distinct().select(module, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return spine.join(counted, ["bucket", module], "left").select("bucket", module, F.coalesce("n", F.lit(0)).alias("n"))


def contributor_counts(contributors: DataFrame, assets: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind, n): assets of each contributor and kind, contributors without assets included, and those without contributor as `unassigned` if there are any."""
    named = assets.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("unassigned")))
    counted = named.groupBy(key, kind).agg(F.count("*").alias("n"))
    idle = contributors.select(F.col(key).cast("string").alias(key)).distinct().join(counted, key, "left_anti").select(key, F.lit("none").alias(kind), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(idle)


def module_trust(findings: DataFrame) -> DataFrame:
    """(module_name, n, status, disposition) of the three scanning modules, with or without findings.

    Findings on data and windows that are not STABLE make a WARNING; models FAIL by HIGH and CRITICAL ones.
    """
    counted = findings.groupBy("module_name").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("grave"))
    modules = findings.sparkSession.createDataFrame([("DataIntegrity",), ("ModelIntegrity",), ("DistributionShift",)], "module_name string")
    known = modules.join(counted, "module_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when((F.col("module_name") == "ModelIntegrity") & (F.col("grave") > 0), "FAIL").when(F.col("n") > 0, "WARNING").otherwise("PASS")
    decided = F.when(F.col("status") == "FAIL", "QUARANTINE").when(F.col("status") == "WARNING", "REVIEW").otherwise("ACCEPT")
    return known.withColumn("status", status).select("module_name", "n", "status", decided.alias("disposition"))


def model_summary(findings: DataFrame) -> DataFrame:
    """One row (asset_id, status, risk, n, quarantined): the first quarantined model by time and id, else the first finding; without findings NO_MODEL_SCAN."""
    first = F.min_by("asset_id", F.struct((F.col("disposition") != "QUARANTINE").alias("o"), "ts", "finding_id"))
    summed = findings.agg(first.alias("asset_id"), F.count("*").alias("n"), F.count_if(F.col("disposition") == "QUARANTINE").alias("quarantined"))
    status = F.when(F.col("quarantined") > 0, "QUARANTINE_RECOMMENDED").when(F.col("n") > 0, "REVIEW").otherwise("NO_MODEL_SCAN")
    risk = F.when(F.col("quarantined") > 0, "CRITICAL").when(F.col("n") > 0, "UNKNOWN").otherwise("NOT_ASSESSED")
    return summed.select("asset_id", status.alias("status"), risk.alias("risk"), "n", "quarantined")


def drift_series(windows: DataFrame) -> DataFrame:
    """(window_id, drift, threshold, confidence, status, anomaly) of checked windows (window_id, mmd, threshold, confidence, assessment)."""
    drift = F.round(F.coalesce("mmd", F.lit(0.0)), 6)
    anomaly = drift > F.col("threshold")
    status = F.coalesce("assessment", F.when(anomaly, "ALERT").otherwise("OK"))
    return windows.select("window_id", drift.alias("drift"), "threshold", F.coalesce("confidence", F.when(F.col("assessment") == "STABLE", 0.95).otherwise(0.85)).alias("confidence"), status.alias("status"), F.coalesce(anomaly, F.lit(False)).alias("anomaly"))


def first_flags(samples: DataFrame, flags: str) -> DataFrame:
    """(kind, n): samples by their first flag, unflagged ones as clean; null flags stay null."""
    kind = F.when(F.col(flags).isNull(), F.lit(None)).when(F.size(flags) == 0, "clean").otherwise(F.try_element_at(flags, F.lit(1)))
    return samples.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def recent(frame: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows: a top-k report."""
    return frame.orderBy(F.desc(at), key).limit(n)
