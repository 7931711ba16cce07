"""Decision rules on columns: severities, confidences, statuses, dispositions and drift levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of findings.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATUSES = ("PASS", "INFO", "REVIEW", "WARNING", "FAIL", "NOT_ASSESSED")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
LEVELS = ("NOT_AVAILABLE", "LOW", "MEDIUM", "HIGH")

# Words that tell the kind of a finding, in the order in which they count.
FINDING_WORDS = (("label_anomaly", ("label", "flip")), ("duplicate_anomaly", ("duplicate",)), ("ood_anomaly", ("ood", "distribution")), ("trigger_anomaly", ("trigger", "backdoor")))
# Words of a reason that tell what was found.
REASON_WORDS = (("duplicate", ("duplicate",)), ("label_flip", ("mislabeled", "flip")), ("ood", ("outlier", "mahalanobis", "ood")), ("trigger", ("trigger",)))

# What speaks for a confidence and what limits it.
BASIS = {
    "trigger": "High residual cross-correlation in trigger patch detector.",
    "duplicate": "Pairwise standardized cosine similarity (exceeding threshold).",
    "ood": "Class-conditional trimmed Mahalanobis distance exceeded robust threshold.",
    "label_flip": "Cleanlab confident learning out-of-sample prediction inconsistency.",
}
LIMITATIONS = {
    "duplicate": "Detects embedding near-duplicates only; does not establish semantic equivalence across photographic angles.",
    "ood": "Sensitivity degrades if reference dataset itself is heavily poisoned.",
    "label_flip": "Accuracy bounded by auxiliary classifier performance.",
}


def rank(value: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Place in an ordered vocabulary, -1 for a word outside it."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), value) - 1, F.lit(-1)).cast("int")


def by_rank(place: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    return F.get(F.array(*map(F.lit, order)), place)


def worst(values: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """The worst word of an array."""
    return by_rank(F.array_max(F.transform(values, lambda v: rank(v, order))), order)


def chain(*cases: tuple[Column, str | Column], otherwise) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, case: F.when(case[0], lit(case[1])).otherwise(rest), reversed(cases), lit(otherwise))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(word) for word in words))


def interpretation(confidence: Column) -> Column:
    """HIGH from 0.80, MEDIUM from 0.50, LOW below; UNKNOWN if it is no number."""
    number = F.expr("cast(null as double)") if confidence is None else confidence.try_cast("double")
    return chain((number.isNull(), "UNKNOWN"), (number >= 0.80, "HIGH"), (number >= 0.50, "MEDIUM"), otherwise="LOW")


def data_confidence(flags: Column) -> Column:
    """(basis, limitations) of a finding on data, from its flags."""
    pick = lambda table: F.array_compact(F.array(*(F.when(F.array_contains(flags, flag), F.lit(text)) for flag, text in table.items())))
    basis = pick(BASIS)
    return F.struct(F.when(F.size(basis) > 0, basis).otherwise(F.array(F.lit("Data integrity detector flagged statistical anomaly in feature space."))).alias("basis"), pick(LIMITATIONS).alias("limitations"))


def model_confidence(index: Column, agrees: Column) -> Column:
    """(basis, limitations) of a finding on a model, from its index and whether the other detector agrees."""
    basis = F.array(
        F.when(index != 0, F.format_string("Neural Cleanse MAD anomaly index: %.2f.", index)),
        F.when(agrees, "Independent STRIP entropy-suppression signal corroborated anomalous class."),
        F.when(~agrees, "STRIP signal conflicted with Neural Cleanse flagged class; confidence dampened."),
    )
    limits = F.array(F.when(~agrees, "Conflicting signals between trigger inversion and entropy suppression."), F.lit("Validated only against patch backdoors; STRIP does not independently scan when MAD misses."))
    return F.struct(F.array_compact(basis).alias("basis"), F.array_compact(limits).alias("limitations"))


def drift_confidence(mmd: Column, p: Column) -> Column:
    """(basis, limitations) of a window's finding."""
    basis = F.array(F.format_string("Maximum Mean Discrepancy (MMD) = %.6f against calibrated reference battery.", mmd), F.when(p.isNotNull(), F.format_string("Permutation test statistical significance p-value = %.4f.", p)))
    return F.struct(F.array_compact(basis).alias("basis"), F.array(F.lit("Shift indicates divergence from reference battery; does not prove adversary intervention.")).alias("limitations"))


def disposition(status: Column, severity: Column) -> Column:
    """(disposition, priority): failures and critical findings are quarantined, doubts reviewed, what was not assessed too."""
    grave = (status == "FAIL") | (severity == "CRITICAL")
    doubtful = status.isin("REVIEW", "WARNING") | severity.isin("HIGH", "MEDIUM")
    decided = chain((grave, "QUARANTINE"), (doubtful | (status == "NOT_ASSESSED"), "REVIEW"), otherwise="ACCEPT")
    return F.struct(decided.alias("disposition"), chain((grave, "URGENT"), (doubtful, "ELEVATED"), otherwise="ROUTINE").alias("priority"))


def data_status(severity: Column, decided: Column) -> Column:
    """Status of a finding on data: only low ones that the module accepts itself pass."""
    return chain((severity == "CRITICAL", "FAIL"), ((severity == "LOW") & (decided == "ACCEPT"), "PASS"), otherwise="REVIEW")


def model_status(severity: Column) -> Column:
    return chain((severity == "CRITICAL", "FAIL"), (severity.isin("HIGH", "MEDIUM"), "REVIEW"), otherwise="PASS")


def drift_status(assessment: Column) -> Column:
    """(status, severity) of a window's assessment."""
    status = chain((assessment == "NO_SIGNIFICANT_SHIFT", "PASS"), (assessment == "OPERATIONAL_SHIFT_LIKELY", "WARNING"), (assessment == "UNEXPLAINED_SHIFT", "REVIEW"), otherwise="NOT_ASSESSED")
    severity = chain((assessment == "OPERATIONAL_SHIFT_LIKELY", "MEDIUM"), (assessment == "UNEXPLAINED_SHIFT", "HIGH"), otherwise="LOW")
    return F.struct(status.alias("status"), severity.alias("severity"))


def relative_change(new: Column, old: Column) -> Column:
    """|new - old| / |old|, null where old is next to 0."""
    return F.when(F.abs(old) >= 1e-12, F.abs(new - old) / F.abs(old))


def change_level(change: Column) -> Column:
    return chain((change.isNull(), "NOT_AVAILABLE"), (change >= 0.20, "HIGH"), (change >= 0.08, "MEDIUM"), otherwise="LOW")


def drift_assessment(significant: Column, measured: Column, declared: Column) -> Column:
    """What a window amounts to, from its test and the levels of measured statistics and of declared metadata.

    A significant shift is operational where any measured level is MEDIUM or more or any declared one is HIGH,
    unexplained where all stayed low, and without known levels there is not enough evidence, as without a test.
    """
    known = F.exists(measured, lambda x: x != "NOT_AVAILABLE") | F.exists(declared, lambda x: x != "NOT_AVAILABLE")
    operational = F.exists(measured, lambda x: x.isin("MEDIUM", "HIGH")) | F.exists(declared, lambda x: x == "HIGH")
    return chain((significant.isNull(), "INSUFFICIENT_EVIDENCE"), (~significant, "NO_SIGNIFICANT_SHIFT"), (~known, "INSUFFICIENT_EVIDENCE"), (operational, "OPERATIONAL_SHIFT_LIKELY"), otherwise="UNEXPLAINED_SHIFT")


def drift_policy(assessment: Column, mmd: Column, threshold: Column, p: Column, insufficient: str = "LOW") -> Column:
    """(confidence, severity, disposition) of a window.

    Below the threshold the confidence is 0.60 and up to 0.30 more with the margin, but 0.55 at most if p is
    below 0.05. Shifts have 0.75 (operational) or 0.80 (unexplained), 0.10 more if p is below 0.05 and 0.10
    less without p. It is never over 0.95, and 0.20 without enough evidence.
    """
    small = F.coalesce(p < 0.05, F.lit(False))
    margin = F.when(threshold > 0, F.least(F.greatest((threshold - mmd) / threshold, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    below = F.round(0.60 + 0.30 * margin, 2)
    shifted = lambda base: F.lit(base) + F.when(p.isNull(), -0.10).when(small, 0.10).otherwise(0.0)
    confidence = chain((assessment == "NO_SIGNIFICANT_SHIFT", F.when(small, F.least(below, F.lit(0.55))).otherwise(below)), (assessment == "OPERATIONAL_SHIFT_LIKELY", shifted(0.75)), (assessment == "UNEXPLAINED_SHIFT", shifted(0.80)), otherwise=F.lit(0.20))
    severity = chain((assessment == "OPERATIONAL_SHIFT_LIKELY", "MEDIUM"), (assessment == "UNEXPLAINED_SHIFT", "HIGH"), (assessment == "NO_SIGNIFICANT_SHIFT", "LOW"), otherwise=insufficient)
    decided = F.when(assessment == "NO_SIGNIFICANT_SHIFT", "ACCEPT").otherwise("REVIEW")
    return F.struct(F.round(F.least(confidence, F.lit(0.95)), 2).alias("confidence"), severity.alias("severity"), decided.alias("disposition"))


def finding_type(text: Column) -> Column:
    """Kind of a finding by the first of FINDING_WORDS that its text holds, else the text."""
    lower = F.lower(text)
    return chain(*((_holds(lower, words), kind) for kind, words in FINDING_WORDS), otherwise=text)


def evidence_tags(reason: Column) -> Column:
    """All that a reason speaks of, by REASON_WORDS."""
    lower = F.lower(reason)
    return F.array_compact(F.array(*(F.when(_holds(lower, words), kind) for kind, words in REASON_WORDS)))
