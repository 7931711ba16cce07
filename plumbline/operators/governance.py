"""Overall verdicts, coverage of capabilities and attack classes, and unassessed checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import chain

# Capabilities with the extent of their support.
CAPABILITIES = (
    ("Label Anomaly & Flip Detection", "PARTIALLY_SUPPORTED"),
    ("Near-Duplicate Flooding Detection", "PARTIALLY_SUPPORTED"),
    ("Out-of-Distribution Insertion Detection", "PARTIALLY_SUPPORTED"),
    ("Training Data Trigger Patch Detection", "PARTIALLY_SUPPORTED"),
    ("Model Trojan & Backdoor Inversion", "PARTIALLY_SUPPORTED"),
    ("Model Substitution & Tamper Detection", "SUPPORTED"),
    ("Inference Output Sealing & Provenance", "SUPPORTED"),
    ("Inference Replay Detection", "SUPPORTED"),
    ("Distribution Shift & Drift Monitoring", "SUPPORTED"),
    ("Contributor & Provenance Risk Aggregation", "PARTIALLY_SUPPORTED"),
)
# Of each category the words of the capabilities' names that its findings bear on.
CATEGORY_WORDS = {
    "DATA_INTEGRITY": ("Label", "Duplicate", "Distribution"),
    "COVERAGE": ("Label", "Duplicate", "Distribution"),
    "MODEL_INTEGRITY": ("Model",),
    "INFERENCE_PROVENANCE": ("Inference", "Replay"),
    "OUTPUT_TAMPERING": ("Inference", "Replay"),
    "DISTRIBUTION_SHIFT": ("Distribution Shift",),
}
# Attack classes, the extent of their support, and the words of a reason that tell them.
ATTACKS = (
    ("LABEL_FLIPPING", "PARTIALLY_SUPPORTED", ("flip",)),
    ("SYSTEMATIC_MISLABELING", "PARTIALLY_SUPPORTED", ()),
    ("DUPLICATE_FLOODING", "PARTIALLY_SUPPORTED", ("duplicate",)),
    ("OUT_OF_DISTRIBUTION_INSERTION", "PARTIALLY_SUPPORTED", ("ood",)),
    ("TRIGGER_INJECTION", "PARTIALLY_SUPPORTED", ("trigger",)),
    ("BACKDOOR_BEHAVIOUR", "PARTIALLY_SUPPORTED", ("trojan",)),
    ("MODEL_SUBSTITUTION", "SUPPORTED", ()),
    ("MODEL_MODIFICATION", "SUPPORTED", ()),
    ("INFERENCE_TAMPERING", "SUPPORTED", ("tamper", "seal")),
    ("INFERENCE_REPLAY", "SUPPORTED", ()),
    ("DISTRIBUTION_SHIFT", "SUPPORTED", ("shift",)),
    ("CONTRIBUTOR_RISK_AGGREGATION", "PARTIALLY_SUPPORTED", ()),
    ("ADVERSARIAL_EVASION_PATCH", "UNSUPPORTED", ()),
    ("MODEL_EXTRACTION_STEALING", "UNSUPPORTED", ()),
)


def _place() -> F.Column:
    """What a finding counts as in the overall verdict."""
    grave = (F.col("disposition") == "QUARANTINE") | (F.col("status") == "FAIL") | (F.col("severity") == "CRITICAL")
    return chain((grave, "critical"), (F.col("status") == "WARNING", "warning"), (F.col("status") == "REVIEW", "review"), (F.col("status") == "NOT_ASSESSED", "not_assessed"), otherwise="pass")


def overall(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, counts by place, overall_status, disposition) of each assessment.

    Anything critical fails it, a warning or a review makes it REVIEW, what was not assessed limits a pass.
    Without any finding and without keys the one row is NOT_ASSESSED and to be reviewed.
    """
    places = ("critical", "warning", "review", "pass", "not_assessed")
    summed = findings.withColumn("__place", _place()).groupBy(*keys).agg(*(F.count_if(F.col("__place") == p).alias(p) for p in places))
    c = {p: F.col(p) > 0 for p in places}
    empty = ~(c["critical"] | c["warning"] | c["review"] | c["pass"] | c["not_assessed"])
    status = chain((empty, "NOT_ASSESSED"), (c["critical"], "FAIL"), (c["review"] | c["warning"], "REVIEW"), (c["not_assessed"], "PASS_WITH_LIMITATIONS"), otherwise="PASS")
    decided = chain((empty, "REVIEW"), (c["critical"], "QUARANTINE"), (c["review"] | c["warning"], "REVIEW"), otherwise="ACCEPT")
    return summed.withColumns({"overall_status": status, "disposition": decided})


def verdict_basis(findings: DataFrame, *keys: str, most: int = 15) -> DataFrame:
    """(keys, basis): texts of the first `most` findings behind a verdict, by id. A top-k report; only k rows a task and key are shuffled."""
    text = chain(
        (F.col("__place") == "critical", F.format_string("CRITICAL integrity failure on %s: %s", "asset_id", "title")),
        (F.col("__place") == "warning", F.format_string("Warning on %s: %s", "asset_id", "title")),
        (F.col("__place") == "review", F.format_string("Review required on %s: %s", "asset_id", "title")),
        (F.col("__place") == "not_assessed", F.format_string("Unassessed check: %s", "title")),
        otherwise=F.lit(None).cast("string"),
    )
    named = findings.withColumn("__place", _place()).select(*keys, "finding_id", text.alias("text")).filter("text is not null")
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("finding_id", "text"))).filter(F.col("__n") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "text"))), lambda x: x["text"]).alias("basis"))


def capability_findings(findings: DataFrame) -> DataFrame:
    """(capability, finding_id): a row for each finding and each capability that it bears on."""
    named = {category: [c for c, _ in CAPABILITIES if any(word in c for word in words)] for category, words in CATEGORY_WORDS.items()}
    hits = chain(*((F.col("category") == category, F.array(*map(F.lit, found))) for category, found in named.items()), otherwise=F.array().cast("array<string>"))
    return findings.select(F.explode(hits).alias("capability"), "finding_id")


def attack_findings(findings: DataFrame, text: str = "reason") -> DataFrame:
    """(attack, finding_id): a row for each finding and each attack class of which its text speaks."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lower, w)), F.lit(attack)) for attack, _, words in ATTACKS if words)))
    return findings.select(F.explode(hits).alias("attack"), "finding_id")


def coverage(findings: DataFrame) -> DataFrame:
    """(kind, name, support_status, n, finding_ids): all capabilities and attack classes; the at most 100 first ids of each are a report."""
    spark = findings.sparkSession
    known = [("capability", c, s) for c, s in CAPABILITIES] + [("attack", a, s) for a, s, _ in ATTACKS]
    rules = spark.createDataFrame(known, "kind string, name string, support_status string")
    links = capability_findings(findings).toDF("name", "finding_id").withColumn("kind", F.lit("capability")).unionByName(attack_findings(findings).toDF("name", "finding_id").withColumn("kind", F.lit("attack")))
    counted = links.groupBy("kind", "name").agg(F.count("*").alias("n"))
    first = links.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "name").orderBy("finding_id"))).filter("__n <= 100").groupBy("kind", "name").agg(F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))
    joined = rules.join(counted, ["kind", "name"], "left").join(first, ["kind", "name"], "left")
    return joined.select("kind", "name", "support_status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"))


def unassessed(skipped: DataFrame) -> DataFrame:
    """Findings for capabilities that were not assessed, so that none is taken for passed; `skipped` has category, capability, reason and required_access."""
    return skipped.select(
        F.concat(F.lit("find-unassessed-"), F.substring(F.sha2(F.concat_ws("|", "category", "capability"), 256), 1, 8)).alias("finding_id"),
        "category",
        F.lit("SYSTEM_ENVIRONMENT").alias("asset_id"),
        F.lit("NOT_ASSESSED").alias("status"),
        F.lit("LOW").alias("severity"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit("UNKNOWN").alias("interpretation"),
        F.concat(F.lit("Assessment Not Performed: "), "capability").alias("title"),
        "reason",
        F.lit("REVIEW").alias("disposition"),
        F.lit("ROUTINE").alias("priority"),
        F.array(F.concat(F.lit("Requires "), "required_access", F.lit(" to perform assessment."))).alias("limitations"),
    )


def open_recommendations(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("disposition").isin("REVIEW", "QUARANTINE")).select("finding_id", "asset_id", "disposition", "priority")
