"""Findings of all modules in one schema, and the looks at them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import data_status, disposition, drift_status, interpretation, model_status, worst
from plumbline.functions.text import found_in, short_id

# Titles and reasons, which findings must have alike.
DATA_TITLE = "Data Integrity Anomaly: "
DATA_REASON = "Data integrity anomaly flagged."
MODEL_TITLE = "Model Integrity Assessment: "
MODEL_REASON = "Model integrity behavioral assessment."
SEAL_GOOD = "Inference Output Authenticity Verified: "
SEAL_BAD = "Inference Tampering Detected: "
SEAL_GOOD_REASON = "Cryptographic seal %s verified. Model digest, input tensor hash, config, and output binding are authentic."
SEAL_BAD_REASON = "Integrity violation on inference record "
SEAL_CONTENT = "RFC-8785 canonical content hash mismatch (payload modified post-signing)"
SEAL_SIGNATURE = "Ed25519 signature invalid or signer key mismatch"
WINDOW_TITLE = "Distribution Shift Assessment: %s (%s)"
WINDOW_NONE = "MMD statistic (%.6f) is within calibrated reference variation (threshold %.6f)."
WINDOW_OPERATIONAL = "Statistically significant distribution shift detected (MMD %.6f > %.6f), correlated with operational lighting/sensor change."
WINDOW_UNEXPLAINED = "Statistically significant distribution shift detected (MMD %.6f > %.6f) without clear operational sensor explanation."
WINDOW_UNKNOWN = "Insufficient samples or calibration metadata to assess distribution drift."
SEAL_DIGEST = "Model digest substitution detected: %s != expected %s"

#: Dispositions from the mildest to the gravest.
DECISIONS = ("ACCEPT", "REVIEW", "QUARANTINE")

COLUMNS = ("finding_id", "category", "asset_id", "status", "severity", "confidence", "interpretation", "title", "reason", "ts", "module_name", "evidence_hash", "signature", "disposition", "priority")


def _given(raw: DataFrame, *names: str, otherwise: Column | str | float | None = None) -> Column:
    """The first of the named columns that `raw` has and that isn't null, else the default."""
    default = otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double" if isinstance(otherwise, float) else "string")
    return F.coalesce(*(F.col(name) for name in names if name in raw.columns), default)


def _text(raw: DataFrame, *names: str, otherwise: Column | str | None = None) -> Column:
    """The same for texts, of which empty ones do not count."""
    return F.coalesce(*(F.nullif(F.col(name).cast("string"), F.lit("")) for name in names if name in raw.columns), otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("string"))


def _canonical(rows: DataFrame, prefix: str, category: str, module: str, key: str = "asset_id") -> DataFrame:
    """`rows` has all of COLUMNS but those that follow from the others; `key` names a finding."""
    ruled = rows.withColumn("__rule", disposition(F.col("status"), F.col("severity")))
    own = "own_disposition" in rows.columns
    decided = worst(F.array_compact(F.array("__rule.disposition", "own_disposition")), DECISIONS) if own else F.col("__rule.disposition")
    return ruled.select(
        short_id(prefix, F.col(key)).alias("finding_id"),
        F.lit(category).alias("category"),
        "asset_id",
        "status",
        "severity",
        F.round("confidence", 4).alias("confidence"),
        interpretation(F.col("confidence")).alias("interpretation"),
        "title",
        "reason",
        "ts",
        F.lit(module).alias("module_name"),
        "evidence_hash",
        "signature",
        decided.alias("disposition"),
        (F.when(decided == "QUARANTINE", "URGENT").otherwise(F.col("__rule.priority")) if own else F.col("__rule.priority")).alias("priority"),
        *([F.col("own_disposition"), F.col("__rule.disposition").alias("ruled_disposition")] if own else []),
    )


def from_data(raw: DataFrame, now: str | None = None) -> DataFrame:
    """Findings on samples, from (assetID, image_id or sample_id, reason, evidenceHash, timestamp, confidence, severity, disposition, signature), each of which may be missing.

    A row without an asset is named by a hash of its reason and evidence; one without a time has `now`, so that equal
    rows give equal findings. Where the module decided itself, its own_disposition and the ruled_disposition are kept and the graver one counts.
    """
    spare = F.concat(F.lit("image-"), F.substring(F.sha2(F.concat_ws("|", _text(raw, "reason", otherwise=""), _text(raw, "evidenceHash", otherwise="")), 256), 1, 8))
    rows = raw.select(
        _text(raw, "assetID", "image_id", "sample_id", otherwise=spare).alias("asset_id"),
        _given(raw, "severity", otherwise="MEDIUM").alias("severity"),
        _given(raw, "disposition", otherwise="REVIEW").alias("own"),
        _given(raw, "confidence", otherwise=0.65).cast("double").alias("confidence"),
        _given(raw, "reason", otherwise=DATA_REASON).alias("reason"),
        _text(raw, "timestamp", otherwise=now).alias("ts"),
        _text(raw, "evidenceHash", "evidence_hash", otherwise="").alias("evidence_hash"),
        _given(raw, "signature").alias("signature"),
        *([F.when(F.col("disposition").isin(*DECISIONS), F.col("disposition")).alias("own_disposition")] if "disposition" in raw.columns else []),
    )
    named = rows.withColumns({"status": data_status(F.col("severity"), F.col("own")), "title": F.concat(F.lit(DATA_TITLE), "asset_id")})
    return _canonical(named, "find-di-", "DATA_INTEGRITY", "DataIntegrity")


def from_models(raw: DataFrame, now: str | None = None) -> DataFrame:
    """Findings on models, from the same fields as from_data."""
    spare = F.concat(F.lit("model-"), F.substring(F.sha2(F.concat_ws("|", _text(raw, "reason", otherwise=""), _text(raw, "evidenceHash", otherwise="")), 256), 1, 8))
    rows = raw.select(
        _text(raw, "assetID", otherwise=spare).alias("asset_id"),
        _given(raw, "severity", otherwise="LOW").alias("severity"),
        _given(raw, "confidence", otherwise=0.50).cast("double").alias("confidence"),
        _given(raw, "reason", otherwise=MODEL_REASON).alias("reason"),
        _text(raw, "timestamp", otherwise=now).alias("ts"),
        _given(raw, "evidenceHash", otherwise="").alias("evidence_hash"),
        _given(raw, "signature").alias("signature"),
    )
    named = rows.withColumns({"status": model_status(F.col("severity")), "title": F.concat(F.lit(MODEL_TITLE), "asset_id")})
    return _canonical(named, "find-mi-", "MODEL_INTEGRITY", "ModelIntegrity")


def from_seals(verified: DataFrame, expected_digest: str | None = None, now: str | None = None) -> DataFrame:
    """Findings on sealed inference records, from (sealID, modelDigest, contentHash, signature, timestamp, contentHashMatches, signatureValid, verdict).

    A record passes if its verdict is VALID and its model digest the expected one, where that is given.
    """
    bound = F.lit(True) if expected_digest is None else F.coalesce(_given(verified, "modelDigest", otherwise="unknown-model-digest") == expected_digest, F.lit(False))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in verified.columns else F.lit(False)
    good = bound & (_given(verified, "verdict", otherwise="TAMPERED") == "VALID")
    seal = _text(verified, "sealID", otherwise="unknown-seal")
    causes = F.array_join(
        F.array_compact(
            F.array(
                F.when(~flag("contentHashMatches"), SEAL_CONTENT),
                F.when(~flag("signatureValid"), SEAL_SIGNATURE),
                F.when(~bound, F.format_string(SEAL_DIGEST, _given(verified, "modelDigest", otherwise="unknown-model-digest"), F.lit(expected_digest))),
            )
        ),
        "; ",
    )
    rows = verified.select(
        seal.alias("asset_id"),
        F.when(good, "PASS").otherwise("FAIL").alias("status"),
        F.when(good, "LOW").otherwise("CRITICAL").alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.when(good, SEAL_GOOD).otherwise(SEAL_BAD), seal).alias("title"),
        F.when(good, F.format_string(SEAL_GOOD_REASON, seal)).otherwise(F.concat(F.lit(SEAL_BAD_REASON), seal, F.lit(": "), causes)).alias("reason"),
        _text(verified, "timestamp", otherwise=now).alias("ts"),
        _given(verified, "contentHash").alias("evidence_hash"),
        _given(verified, "signature").alias("signature"),
    )
    return _canonical(rows, "find-inf-", "INFERENCE_PROVENANCE", "InferenceProvenance")


def from_drift(windows: DataFrame, now: str | None = None) -> DataFrame:
    """Findings on windows, from (window_id, assessment, mmd, threshold, confidence, evidenceHash, timestamp, signature)."""
    window = _text(windows, "window_id", otherwise="unknown-window")
    assessment = _given(windows, "assessment", otherwise="NO_SIGNIFICANT_SHIFT")
    numbers = (_given(windows, "mmd", otherwise=0.0), _given(windows, "threshold", otherwise=0.01))
    reason = (
        F.when(assessment == "NO_SIGNIFICANT_SHIFT", F.format_string(WINDOW_NONE, *numbers))
        .when(assessment == "OPERATIONAL_SHIFT_LIKELY", F.format_string(WINDOW_OPERATIONAL, *numbers))
        .when(assessment == "UNEXPLAINED_SHIFT", F.format_string(WINDOW_UNEXPLAINED, *numbers))
        .otherwise(WINDOW_UNKNOWN)
    )
    state = drift_status(assessment)
    rows = windows.select(
        window.alias("asset_id"),
        state["status"].alias("status"),
        state["severity"].alias("severity"),
        _given(windows, "confidence", otherwise=F.when(state["status"] == "PASS", 0.90).otherwise(0.75)).cast("double").alias("confidence"),
        F.format_string(WINDOW_TITLE, window, assessment).alias("title"),
        reason.alias("reason"),
        _text(windows, "timestamp", otherwise=now).alias("ts"),
        _text(windows, "evidenceHash", "evidence_hash", otherwise="").alias("evidence_hash"),
        _given(windows, "signature").alias("signature"),
    )
    return _canonical(rows, "find-drift-", "DISTRIBUTION_SHIFT", "DistributionShift")


def from_replays(replays: DataFrame, now: str | None = None) -> DataFrame:
    """A finding for every replay, from (sealID, nonce, use, timestamp, contentHash, signature): records whose nonce an earlier one has used (chain.replays)."""
    seal, use = _text(replays, "sealID", otherwise="unknown-seal"), F.col("use").cast("string")
    rows = replays.select(
        seal.alias("asset_id"),
        F.lit("FAIL").alias("status"),
        F.lit("HIGH").alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit("Inference Replay: "), seal).alias("title"),
        F.concat(F.lit("Use "), use, F.lit(" of nonce "), F.coalesce(F.col("nonce").cast("string"), F.lit("")), F.lit(".")).alias("reason"),
        _text(replays, "timestamp", otherwise=now).alias("ts"),
        _given(replays, "contentHash").alias("evidence_hash"),
        _given(replays, "signature").alias("signature"),
        F.concat_ws("|", seal, use).alias("key"),
    )
    return _canonical(rows, "find-replay-", "INFERENCE_PROVENANCE", "InferenceProvenance", "key")


def union(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def search(findings: DataFrame, text: str | None = None, severity: str | None = None, contributor: str | None = None, columns: tuple[str, ...] = ("finding_id", "asset_id", "title", "reason", "module_name", "severity", "disposition"), **equal: str) -> DataFrame:
    """Findings that hold the text in any of the columns, in either case, and have the other values."""
    out = findings.filter(found_in(text, *columns)) if text else findings
    out = out.filter(F.col("severity") == severity) if severity else out
    for name, wanted in equal.items():
        out = out.filter(F.col(name) == wanted)
    return out.filter(F.coalesce(F.col("contributor_id"), F.lit("unassigned")) == contributor) if contributor else out


def lookup(findings: DataFrame, value: str) -> DataFrame:
    """The first finding that has the value as its id, its asset or its evidence hash."""
    hit = F.when(F.col("finding_id") == value, 0).when(F.col("asset_id") == value, 1).when(F.col("evidence_hash") == value, 2)
    return findings.withColumn("__hit", hit).filter("__hit is not null").orderBy("__hit", "finding_id").limit(1).drop("__hit")


def with_contributor(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """`findings` with contributor_id: that of the asset whose upload, dataset or model id is theirs, in this order, else `unassigned`.

    `assets` has upload_id, dataset_id, model_id and contributor_id. Three keys make three rows of one
    equi-join, not one join on alternatives.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.col(c).cast("string").alias("asset_id")) for i, c in enumerate(("upload_id", "dataset_id", "model_id"))))).alias("k")
    first = assets.select(keys, "contributor_id").filter("k.asset_id is not null").groupBy("k.asset_id").agg(F.min(F.struct("k.turn", "contributor_id")).alias("m")).select("asset_id", F.col("m.contributor_id").alias("contributor_id"))
    return findings.join(first, "asset_id", "left").withColumn("contributor_id", F.coalesce("contributor_id", F.lit("unassigned")))


def distinct_limitations(reports: DataFrame, column: str = "limitations") -> DataFrame:
    """(limitation): every text that occurs in an array of limitations, once."""
    return reports.select(F.explode(column).alias("limitation")).filter("limitation is not null").distinct()


def journal(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Ledger entries (tx_id, evidence_hash, ledger_key, finding_id, asset_id, contributor_id) with what they lack taken from their finding.

    An entry's finding is one with its evidence hash or, without such, one whose asset is its ledger key; the
    first by id. Two equi-joins on keys that are unique on the findings' side.
    """
    first = lambda key: findings.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct("finding_id", "asset_id", "contributor_id")).alias("__f"))
    by_hash, by_asset = first("evidence_hash"), first("asset_id")
    joined = entries.join(by_hash.withColumnRenamed("__f", "__a"), F.col("evidence_hash") == F.col("__key"), "left").drop("__key")
    joined = joined.join(by_asset.withColumnRenamed("__f", "__b"), F.col("ledger_key") == F.col("__key"), "left").drop("__key")
    pick = lambda name, *more: F.coalesce(F.col(name), F.col(f"__a.{name}"), F.col(f"__b.{name}"), *more).alias(name)
    rest = [c for c in entries.columns if c not in ("finding_id", "asset_id", "contributor_id")]
    return joined.select(*rest, pick("finding_id"), pick("asset_id", F.col("ledger_key")), pick("contributor_id"))


def with_job(quarantined: DataFrame, jobs: DataFrame, key: str = "test_id") -> DataFrame:
    """Quarantine rows with the dataset and the model that they lack, from the job of their test."""
    fields = ["dataset_id", "dataset_name", "model_id", "model_name"]
    found = jobs.dropDuplicates([key]).select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return quarantined.join(found, key, "left").withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}).drop(*(f"__{f}" for f in fields))


def attribution_conflicts(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """(job_id, contributor_id, conflict) of jobs (job_id, dataset_id, model_id, contributor_id): assets of different contributors, or of another one than the job names.

    `assets` has asset_id and contributor_id; `unassigned` counts as none.
    """
    known = assets.select("asset_id", F.nullif("contributor_id", F.lit("unassigned")).alias("owner")).dropDuplicates(["asset_id"])
    owner = lambda name: known.select(F.col("asset_id").alias(name), F.col("owner").alias(f"__{name}"))
    joined = jobs.join(owner("dataset_id"), "dataset_id", "left").join(owner("model_id"), "model_id", "left")
    a, b, named = F.col("__dataset_id"), F.col("__model_id"), F.nullif(F.col("contributor_id"), F.lit("unassigned"))
    conflict = F.when(a != b, "assets of different contributors").when(named != F.coalesce(a, b), "not the contributor of the assets")
    return joined.select("job_id", F.coalesce(named, a, b, F.lit("unassigned")).alias("contributor_id"), conflict.alias("conflict"))
