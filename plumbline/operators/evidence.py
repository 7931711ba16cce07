"""Evidence documents of flagged samples, and the form that an assurance report must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_value
from plumbline.operators.validate import violations

# The fields and vocabularies of a report.
REPORT_FIELDS = ("schema_version", "assessment_id", "assessment_timestamp", "system", "assets", "access_profile", "checks", "findings", "overall_assessment", "coverage", "limitations", "recommendations", "audit", "reproducibility")
FINDING_FIELDS = ("finding_id", "category", "asset_id", "status", "severity", "confidence", "title", "description", "evidence", "recommendation")
CATEGORIES = ("DATA_INTEGRITY", "MODEL_INTEGRITY", "INFERENCE_PROVENANCE", "OUTPUT_TAMPERING", "DISTRIBUTION_SHIFT", "AUDIT", "CONFIGURATION", "COVERAGE")
STATUSES = ("PASS", "INFO", "REVIEW", "WARNING", "FAIL", "NOT_ASSESSED")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
OVERALL = ("PASS", "PASS_WITH_LIMITATIONS", "REVIEW", "FAIL", "NOT_ASSESSED")


def documents(records: DataFrame, key: str, context: Column, dataset: Column, timestamp: str, limitations: tuple[str, ...] = (), run_id: str | None = None) -> DataFrame:
    """(key, evidence_hash, payload): one JSON text a flagged sample, with its keys in order, and its SHA-256.

    `records` has the key, flags, n_flags, confidence, severity, disposition and reason; `context` and `dataset`
    are structs, with their fields in order, of the checks' settings and of what was checked.
    """
    run = F.struct(F.lit("offline").alias("mode"), *([] if run_id is None else [F.lit(run_id).alias("run_id")]), F.lit(timestamp).alias("timestamp"))
    document = F.struct(
        F.lit("FLAGGED_FOR_REVIEW").alias("assessment"),
        F.struct("flags", F.col(key).cast("string").alias("image_id"), "n_flags").alias("asset"),
        context.alias("check_context"),
        dataset.alias("dataset"),
        F.struct("confidence", "disposition", "reason", "severity").alias("finding_fields"),
        F.array(*map(F.lit, limitations)).cast("array<string>").alias("limitations"),
        F.lit("DataIntegrity").alias("module"),
        run.alias("run"),
    )
    payload = F.to_json(document, {"ignoreNullFields": "false"})
    return records.select(key, payload.alias("payload")).select(key, F.sha2("payload", 256).alias("evidence_hash"), "payload")


def report_violations(report: Column) -> Column:
    """All that is wrong with a report in JSON, as (finding, violation): names of checks that it breaks, and the number of the finding that does, null for the report itself."""
    field = lambda path: F.get_json_object(report, f"$.{path}")
    overall, audit = field("overall_assessment"), field("audit")
    whole = violations(
        **{f"{name}_missing": field(name).isNotNull() for name in REPORT_FIELDS},
        schema_version_form=field("schema_version").isNull() | field("schema_version").rlike(r"^\d+\.\d+(\.\d+)?$"),
        overall_status_unknown=overall.isNull() | field("overall_assessment.overall_status").isin(*OVERALL),
        overall_disposition_unknown=overall.isNull() | field("overall_assessment.disposition").isin(*DISPOSITIONS),
        chain_valid_missing=audit.isNull() | field("audit.chain_valid").isNotNull(),
        events_form=audit.isNull() | F.json_array_length(field("audit.events")).isNotNull(),
    )

    def of_finding(f: Column) -> Column:
        confidence, decided = f["confidence"], F.get_json_object(f["recommendation"], "$.disposition")
        value = F.get_json_object(confidence, "$.value")
        is_object = confidence.isNull() | confidence.startswith("{")
        number = value.try_cast("double")
        return violations(
            **{f"{name}_missing": f[name].isNotNull() for name in FINDING_FIELDS},
            **{f"{name}_unknown": f[name].isNull() | f[name].isin(*words) for name, words in (("category", CATEGORIES), ("status", STATUSES), ("severity", SEVERITIES))},
            confidence_form=is_object,
            confidence_value=confidence.isNull() | ~is_object | (value == "UNKNOWN") | number.isNotNull(),
            confidence_range=number.isNull() | ((number >= 0) & (number <= 1)),
            recommendation_unknown=F.coalesce(~f["recommendation"].startswith("{"), F.lit(True)) | decided.isin(*DISPOSITIONS),
        )

    named = lambda at, names: F.transform(names, lambda name: F.struct(at.cast("int").alias("finding"), name.alias("violation")))
    listed = F.coalesce(F.from_json(field("findings"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    return F.concat(named(F.lit(None), whole), F.flatten(F.transform(listed, lambda f, i: named(i, of_finding(f)))))


def with_report_digest(reports: DataFrame, report: str) -> DataFrame:
    """`reports` (report, digest) with digest_ok: whether the text's SHA-256 is the digest that was stored beside it; false where either is missing."""
    return reports.withColumn("digest_ok", F.coalesce(F.sha2(F.col(report), 256) == F.lower("digest"), F.lit(False)))


def _hashed(rows: DataFrame, key: str, document: Column) -> DataFrame:
    """(key, evidence_hash, payload): each row's document in canonical JSON, and its SHA-256."""
    plain = rows.select(key, document.alias("document"))
    written = plain.select(key, canonical_value(F.col("document"), plain.schema["document"].dataType).alias("payload"))
    return written.select(key, F.sha2("payload", 256).alias("evidence_hash"), "payload")


def _field(frame: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in frame.columns else F.lit(None)).cast(kind).alias(name)


def window_documents(checked: DataFrame, key: str, reference: Column, live: Column, calibration: Column, diagnostics: Column, seed: int, permutations: int = 0, reference_count: int | None = None, version: str = "1", limitations: tuple[str, ...] = (), coverage: str = "", run_id: str | None = None) -> DataFrame:
    """(key, evidence_hash, payload) of checked windows (drift.checked): what was compared, the test, its threshold, the diagnostics and what was decided.

    `reference`, `live`, `calibration` and `diagnostics` are structs of columns of `checked`.
    """
    mmd = F.struct(
        F.col("mmd").cast("double").alias("value"),
        F.lit("rbf").alias("kernel"),
        F.struct(F.col("sigma").cast("double").alias("bandwidth")).alias("kernel_parameters"),
        _field(checked, "p_value", "double"),
        F.lit(permutations).alias("permutation_count"),
        F.lit(seed).alias("seed"),
        F.lit(reference_count).cast("long").alias("reference_count"),
        _field(checked, "n", "long").alias("live_count"),
    )
    decided = F.struct(*(_field(checked, name, kind) for name, kind in (("confidence", "double"), ("severity", "string"), ("disposition", "string"), ("reason", "string"))))
    document = F.struct(
        F.lit("DistributionShift").alias("module"),
        F.lit(version).alias("module_version"),
        F.lit("drift-evidence/v1").alias("schema"),
        reference.alias("reference"),
        live.alias("live_window"),
        mmd.alias("mmd"),
        calibration.alias("threshold"),
        diagnostics.alias("diagnostics"),
        F.col("assessment"),
        decided.alias("finding_fields"),
        F.array(*map(F.lit, limitations)).cast("array<string>").alias("limitations"),
        F.lit(coverage).alias("coverage_statement"),
        *([] if run_id is None else [F.struct(F.lit(run_id).alias("run_id")).alias("run")]),
    )
    return _hashed(checked, key, document)


def model_documents(verdicts: DataFrame, calibration: DataFrame, anomalies: DataFrame, deficits: DataFrame, coverage: str = "") -> DataFrame:
    """(model_id, evidence_hash, payload) of models that have all of their parts.

    `verdicts` has model_id, max_anomaly_index, flagged, flagged_class and strip_agrees, `calibration` model_id, tier, chosen_channel_order,
    calibration_accuracy and access_path, `anomalies` (model_id, class, anomaly_index) and `deficits` (model_id, class, entropy_deficit)
    a row for each class, by which they are put in order; the top class has the greatest deficit, the smallest of equals.
    """
    by_class = lambda rows, value, name: rows.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("class", F.col(value).cast("double").alias("x"))))["x"].alias(name))
    top = deficits.groupBy("model_id").agg(F.min(F.struct((-F.col("entropy_deficit")).alias("d"), "class"))["class"].alias("top_class"))
    joined = verdicts.join(calibration, "model_id").join(by_class(anomalies, "anomaly_index", "indices"), "model_id").join(by_class(deficits, "entropy_deficit", "deficits"), "model_id").join(top, "model_id")
    document = F.struct(
        F.col("model_id"),
        F.struct("tier", "chosen_channel_order", F.col("calibration_accuracy").cast("double").alias("calibration_accuracy"), "access_path").alias("calibration"),
        F.struct(F.col("indices").alias("per_class_anomaly_index"), F.col("max_anomaly_index").cast("double").alias("max_anomaly_index"), "flagged", "flagged_class").alias("neural_cleanse_mad"),
        F.struct(F.col("deficits").alias("per_class_entropy_deficit"), "top_class").alias("strip"),
        F.col("strip_agrees").alias("strip_agreement"),
        F.lit(coverage).alias("coverage_statement"),
    )
    return _hashed(joined, "model_id", document)
