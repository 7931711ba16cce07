"""Risk of groups: which contributors, sources, batches or collections hold more findings than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import chain, finding_type

# Sentences of group findings, which they must have alike.
MISLABELLED = "Systematic mislabelling anomaly: dominant confusion %s (%d/%d label anomalies)"
LABEL_RATE = "Elevated label anomaly rate: %d anomalies (%.1f%% vs %.1f%% baseline)"
DUPLICATES = "Near-duplicate concentration: %d duplicate pairs in group"
TRIGGERS = "Trigger pattern concentration: %d trigger detections in group"
OUTLIERS = "OOD concentration: %d OOD samples in group"
AGGREGATE = "Elevated aggregate anomaly rate (%.1f%% vs %.1f%% baseline, z=%.1f)"
SYSTEMATIC = "Elevated systematic annotation anomaly"
ELEVATED = "Elevated integrity risk"


def unpivoted(provenance: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(key, group_type, group_id), a row for each dimension that a sample has."""
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dimensions)
    return provenance.selectExpr(f"`{key}`", f"stack({len(dimensions)}, {pairs}) as (group_type, group_id)").filter("group_id is not null")


def risk(findings: DataFrame, provenance: DataFrame, key: str, dimensions: list[str], least_size: int = 5, least_affected: int = 3) -> DataFrame:
    """Per group: size, affected, n_findings, types, fraction, z, confidence, severity and flagged.

    `findings` has the key, anomaly_type, original_label and predicted_label. The baseline is the share
    of affected samples over all of `provenance`, a row of two numbers.
    """
    kinds = findings.groupBy(key).agg(F.count("*").alias("k"), F.max((finding_type(F.col("anomaly_type")) == "trigger_anomaly").cast("int")).alias("trigger"))
    samples = provenance.join(kinds, key, "left")
    base = samples.agg(F.count("*").alias("all_samples"), (F.count("k") / F.count("*")).alias("p"))
    members = unpivoted(samples.withColumn("k", F.coalesce("k", F.lit(0))), key, dimensions).join(kinds, key, "left")
    summed = members.groupBy("group_type", "group_id").agg(F.count("*").alias("size"), F.count("k").alias("affected"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_findings"), F.coalesce(F.max("trigger"), F.lit(0)).alias("has_trigger"))
    scored = summed.crossJoin(F.broadcast(base)).withColumn("f", F.col("affected") / F.col("size"))
    se = F.when(F.col("p") >= 1, 0.001).otherwise(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("size")))
    z = F.when((F.col("size") < least_size) | (F.col("p") <= 0), 0.0).otherwise((F.col("f") - F.col("p")) / se)
    scored = scored.withColumn("zz", z)
    flagged = (F.col("size") >= least_size) & (F.col("affected") >= least_affected) & ((F.col("f") >= 0.10) | (F.col("zz") >= 2.5))
    confidence = F.least(F.greatest(0.65 + F.least(F.lit(0.30), 0.05 * F.greatest(F.lit(0.0), F.col("zz"))), F.lit(0.60)), F.lit(0.95))
    severity = chain((~flagged, "LOW"), ((F.col("f") >= 0.25) | (F.col("has_trigger") == 1), "HIGH"), (F.col("f") >= 0.15, "MEDIUM"), otherwise="LOW")
    return scored.select("group_type", "group_id", "size", "affected", "n_findings", F.round("f", 4).alias("fraction"), F.round("zz", 2).alias("z"), F.round(confidence, 2).alias("confidence"), severity.alias("severity"), flagged.alias("flagged"))


def type_counts(findings: DataFrame, provenance: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(group_type, group_id, types): a map of kinds of findings to counts."""
    kinds = findings.select(key, finding_type(F.col("anomaly_type")).alias("kind"))
    counted = unpivoted(provenance, key, dimensions).join(kinds, key).groupBy("group_type", "group_id", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("group_type", "group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("types"))


def dominant_confusion(findings: DataFrame, provenance: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(group_type, group_id, confusion, n): the commonest pair of different labels among a group's label findings, the first by name of equals."""
    wrong = (finding_type(F.col("anomaly_type")) == "label_anomaly") & (F.col("original_label") != F.col("predicted_label")) & (F.col("original_label") != "") & (F.col("predicted_label") != "")
    pairs = findings.filter(wrong).select(key, F.concat("original_label", F.lit(" -> "), "predicted_label").alias("confusion"))
    counted = unpivoted(provenance, key, dimensions).join(pairs, key).groupBy("group_type", "group_id", "confusion").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "confusion", "n"))
    return counted.groupBy("group_type", "group_id").agg(best.alias("b")).select("group_type", "group_id", "b.confusion", "b.n")


def findings(found: DataFrame, provenance: DataFrame, key: str, dimensions: list[str], evidence: str, most: int = 10) -> DataFrame:
    """Findings on the flagged groups: id, sizes, fraction, z, types, confidence, severity, disposition, finding, reason, dominant confusion and the first `most` evidence ids.

    `found` is as in risk, with a column `evidence`. The evidence ids are a top-k report, cut in each task before the shuffle.
    """
    groups = ["group_type", "group_id"]
    flagged = risk(found, provenance, key, dimensions).filter("flagged")
    types, pairs = type_counts(found, provenance, key, dimensions), dominant_confusion(found, provenance, key, dimensions)
    refs = unpivoted(provenance, key, dimensions).join(found.filter(F.col(evidence).isNotNull()).select(key, F.col(evidence).alias("__e")), key)
    refs = refs.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(key, "__e"))).filter(F.col("__n") <= most)
    refs = refs.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__e"))), lambda x: x["__e"]).alias("evidence_refs"))
    base = found.select(key).distinct().join(provenance.select(key).distinct(), key).agg(F.count("*").alias("__k")).withColumn("__p", F.col("__k") / F.lit(max(1, provenance.count())))
    joined = flagged.join(types, groups, "left").join(pairs.withColumnRenamed("n", "__times"), groups, "left").join(refs, groups, "left").crossJoin(F.broadcast(base))
    n = lambda kind: F.coalesce(F.try_element_at("types", F.lit(kind)), F.lit(0))
    share, percent = F.col("affected") / F.col("size") * 100, F.col("__p") * 100
    label = chain(
        (F.col("__times") >= 3, F.format_string(MISLABELLED, "confusion", "__times", "affected")),
        (n("label_anomaly") >= 3, F.format_string(LABEL_RATE, n("label_anomaly"), share, percent)),
        otherwise=F.lit(None).cast("string"),
    )
    parts = F.array_compact(
        F.array(
            label,
            F.when(n("duplicate_anomaly") >= 3, F.format_string(DUPLICATES, n("duplicate_anomaly"))),
            F.when(n("trigger_anomaly") > 0, F.format_string(TRIGGERS, n("trigger_anomaly"))),
            F.when(n("ood_anomaly") >= 3, F.format_string(OUTLIERS, n("ood_anomaly"))),
        )
    )
    reason = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.format_string(AGGREGATE, share, percent, "z"))
    return joined.select(
        F.concat(F.lit("group_"), "group_type", F.lit("_"), "group_id").alias("finding_id"),
        *groups,
        F.col("affected").alias("affected_samples"),
        F.col("size").alias("total_samples"),
        F.col("fraction").alias("affected_fraction"),
        F.array_sort(F.map_keys("types")).alias("finding_types"),
        "confidence",
        "severity",
        F.lit("REVIEW").alias("disposition"),
        F.when(n("label_anomaly") > 0, SYSTEMATIC).otherwise(ELEVATED).alias("finding"),
        reason.alias("reason"),
        F.when(F.col("confusion").isNotNull(), F.format_string("%s (%dx)", "confusion", "__times")).alias("dominant_confusion"),
        F.col("z").alias("z_score"),
        F.coalesce("evidence_refs", F.array().cast("array<string>")).alias("evidence_refs"),
    )


def missing_dimensions(provenance: DataFrame, dimensions: list[str]) -> DataFrame:
    """(limitation): a text for each dimension that some sample lacks."""
    counts = provenance.agg(*(F.count_if(F.col(d).isNull()).alias(d) for d in dimensions))
    pairs = ", ".join(f"'{d}', `{d}`" for d in dimensions)
    return counts.selectExpr(f"stack({len(dimensions)}, {pairs}) as (dimension, n)").filter("n > 0").select(F.format_string("%s unknown for %d samples", "dimension", "n").alias("limitation"))
