import hashlib
import json

from pyspark.sql import functions as F

from plumbline.operators import evidence


def same(row, document):
    text = json.dumps(document, sort_keys=True, separators=(",", ":"))
    assert row["payload"] == text and row["evidence_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_documents_of_windows(spark):
    checked = spark.createDataFrame([("w1", 20, 0.25, 1.5, None, "UNEXPLAINED_SHIFT", 0.7, "HIGH", "REVIEW", 0.1, "d1"), ("w2", 7, None, 1.5, None, "INSUFFICIENT_EVIDENCE", 0.2, "LOW", "REVIEW", 0.1, "é")], "window_id string, n long, mmd double, sigma double, p_value double, assessment string, confidence double, severity string, disposition string, threshold double, digest string")
    calibration = F.struct(F.lit("cal-1").alias("calibration_id"), F.col("threshold").alias("value"), F.lit(0.99).alias("quantile"))
    got = {r["window_id"]: r for r in evidence.window_documents(checked, "window_id", F.struct(F.lit(50).alias("image_count")), F.struct("window_id", "digest"), calibration, F.struct(F.lit(None).cast("string").alias("metadata_diagnostics")), 42, 100, 50, "2", ("no proof of intent",), "windows only", "run-9").collect()}
    for name, n, mmd, assessment, confidence, severity, digest in (("w1", 20, 0.25, "UNEXPLAINED_SHIFT", 0.7, "HIGH", "d1"), ("w2", 7, None, "INSUFFICIENT_EVIDENCE", 0.2, "LOW", "é")):
        same(got[name], {
            "module": "DistributionShift", "module_version": "2", "schema": "drift-evidence/v1", "reference": {"image_count": 50}, "live_window": {"window_id": name, "digest": digest},
            "mmd": {"value": mmd, "kernel": "rbf", "kernel_parameters": {"bandwidth": 1.5}, "p_value": None, "permutation_count": 100, "seed": 42, "reference_count": 50, "live_count": n},
            "threshold": {"calibration_id": "cal-1", "value": 0.1, "quantile": 0.99}, "diagnostics": {"metadata_diagnostics": None}, "assessment": assessment,
            "finding_fields": {"confidence": confidence, "severity": severity, "disposition": "REVIEW", "reason": None}, "limitations": ["no proof of intent"], "coverage_statement": "windows only", "run": {"run_id": "run-9"},
        })


def test_documents_of_models(spark):
    verdicts = spark.createDataFrame([("m1", 3.5, True, 2, False), ("m2", 1.0, False, None, None)], "model_id string, max_anomaly_index double, flagged boolean, flagged_class int, strip_agrees boolean")
    calibration = spark.createDataFrame([("m1", "A", "BGR", 0.99, "white")], "model_id string, tier string, chosen_channel_order string, calibration_accuracy double, access_path string")
    anomalies = spark.createDataFrame([("m1", 2, 3.5), ("m1", 0, 0.5), ("m1", 1, 1e-7), ("m2", 0, 1.0)], "model_id string, class int, anomaly_index double")
    deficits = spark.createDataFrame([("m1", 1, 0.3), ("m1", 2, 0.3), ("m1", 0, -0.1)], "model_id string, class int, entropy_deficit double")
    (row,) = evidence.model_documents(verdicts, calibration, anomalies, deficits, "heuristics").collect()
    same(row, {
        "model_id": "m1", "calibration": {"tier": "A", "chosen_channel_order": "BGR", "calibration_accuracy": 0.99, "access_path": "white"},
        "neural_cleanse_mad": {"per_class_anomaly_index": [0.5, 1e-07, 3.5], "max_anomaly_index": 3.5, "flagged": True, "flagged_class": 2},
        "strip": {"per_class_entropy_deficit": [-0.1, 0.3, 0.3], "top_class": 1}, "strip_agreement": False, "coverage_statement": "heuristics",
    })
