"""Verdicts on models from per-class scores and query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import chain
from plumbline.functions.vectors import entropy


def mad_index(norms: DataFrame, model: str, class_: str, value: str, threshold: float = 2.0) -> DataFrame:
    """(model, max_index, top_class, flagged): how far the smallest value lies below its model's median.

    The index is max(0, median - x) / (1.4826 MAD), 0 where the MAD is 0, to 4 places; the lowest class of equals.
    """
    w = Window.partitionBy(model)
    spread = norms.withColumn("__m", F.median(value).over(w)).withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__mad", F.median("__d").over(w))
    index = F.when(F.col("__mad") > 0, F.round(F.greatest(F.lit(0.0), F.col("__m") - F.col(value)) / (1.4826 * F.col("__mad")), 4)).otherwise(0.0)
    best = F.min(F.struct((-F.col("i")).alias("m"), F.col(class_).alias("c")))
    summed = spread.withColumn("i", index).groupBy(model).agg(best.alias("b"))
    return summed.select(model, (-F.col("b.m") + 0.0).alias("max_index"), F.col("b.c").alias("top_class"), (-F.col("b.m") > threshold).alias("flagged"))


def entropy_deficit(queries: DataFrame) -> DataFrame:
    """(model_id, class, real, control, deficit) from rows (model_id, class, donor, condition, probs).

    Probabilities are averaged a donor, their entropies a condition; the deficit is control - real, to 4 places.
    """
    keys = ["model_id", "class", "donor", "condition"]
    means = queries.select(*keys, F.posexplode("probs").alias("pos", "p")).groupBy(*keys, "pos").agg(F.avg("p").alias("p"))
    donors = means.groupBy(*keys).agg(entropy(F.array_sort(F.collect_list(F.struct("pos", "p")))["p"]).alias("h"))
    both = donors.groupBy("model_id", "class").agg(F.avg(F.when(F.col("condition") == "real", F.col("h"))).alias("real"), F.avg(F.when(F.col("condition") == "control", F.col("h"))).alias("control"))
    return both.select("model_id", "class", F.round("real", 4).alias("real"), F.round("control", 4).alias("control"), F.round(F.col("control") - F.col("real"), 4).alias("deficit"))


def top_deficit(deficits: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("deficit")).alias("m"), "class"))
    return deficits.groupBy("model_id").agg(best.alias("b")).select("model_id", F.col("b.class").alias("deficit_class"), (-F.col("b.m")).alias("max_deficit"))


def verdicts(mad: DataFrame, deficits: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """(model_id, verdict, severity, confidence) of the models (model_id, max_index, top_class, flagged; model_id, deficit_class).

    Unflagged models are accepted; where both methods name the same class a model is quarantined, else reviewed.
    A model that a table lacks has not been assessed: its verdict is ERROR, without severity and confidence.
    """
    both = mad.join(deficits.withColumn("__d", F.lit(True)), "model_id", "full_outer")
    both = both.withColumn("__c", F.lit(True)) if calibration is None else both.join(calibration.select("model_id").distinct().withColumn("__c", F.lit(True)), "model_id", "full_outer")
    missing = F.col("flagged").isNull() | F.col("__d").isNull() | F.col("__c").isNull()
    agree = F.col("top_class") == F.col("deficit_class")
    verdict = chain((missing, "ERROR"), (~F.col("flagged"), "ACCEPT"), (agree, "QUARANTINE"), otherwise="REVIEW")
    severity = chain((missing, F.lit(None).cast("string")), (~F.col("flagged"), "LOW"), (agree, "CRITICAL"), otherwise="MEDIUM")
    scaled = F.least(F.lit(1.0), F.col("max_index") / 5)
    confidence = F.when(missing, F.lit(None).cast("double")).when(~F.col("flagged"), F.least(F.lit(0.5), F.col("max_index") / 2)).when(agree, F.greatest(scaled, F.lit(0.85))).otherwise(scaled * 0.6)
    return both.select("model_id", verdict.alias("verdict"), severity.alias("severity"), F.round(confidence, 4).alias("confidence"))


def require_assessed(verdicts: DataFrame) -> None:
    """Fail closed: no model lacks one of its results."""
    lacking = [row["model_id"] for row in verdicts.filter("verdict = 'ERROR'").orderBy("model_id").limit(20).collect()]
    if lacking:
        raise ValueError(f"results missing for {', '.join(map(str, lacking))}")


def channel_order(log: DataFrame, models: DataFrame | None = None, least: float = 70.0) -> DataFrame:
    """(model_id, tier, rgb, bgr, classes_rgb, classes_bgr, chosen, status) from a prediction log (model_id, order, predicted, truth, entropy).

    With labels (TIER_A, or the log's column tier) rgb and bgr are percentages of right predictions: the greater
    one is chosen, RGB of equals, and below `least` for both the calibration failed, with equals UNCERTAIN.
    Without labels (TIER_C) they are mean entropies: an order with one predicted class only is no choice,
    else the smaller entropy wins. A model of `models` without log can't be calibrated (TIER_D).
    """
    right, order = (F.col("predicted") == F.col("truth")).cast("double"), F.col("order")
    of = lambda name, f, value: f(F.when(order == name, value))
    summed = log.groupBy("model_id").agg(
        F.count("truth").alias("labelled"),
        (F.max("tier") if "tier" in log.columns else F.lit(None).cast("string")).alias("given"),
        *((of(name, F.avg, right) * 100).alias(f"accuracy_{name}") for name in ("RGB", "BGR")),
        *(of(name, F.avg, F.col("entropy")).alias(f"entropy_{name}") for name in ("RGB", "BGR")),
        *(of(name, F.count_distinct, F.col("predicted")).alias(f"classes_{name}") for name in ("RGB", "BGR")),
    )
    if models is not None:
        summed = models.select("model_id").distinct().join(summed, "model_id", "left")
    c = F.col
    a_rgb, a_bgr, none = F.coalesce(c("accuracy_RGB"), F.lit(-1.0)), F.coalesce(c("accuracy_BGR"), F.lit(-1.0)), c("labelled").isNull()
    by_label = F.coalesce(c("given") != "TIER_C", c("labelled") > 0)
    failed = F.greatest(a_rgb, a_bgr) < least
    several = {name: F.coalesce(c(f"classes_{name}"), F.lit(0)) > 1 for name in ("RGB", "BGR")}
    uncertain = ~several["RGB"] & ~several["BGR"]
    by_entropy = chain((uncertain, "UNCERTAIN"), (~several["BGR"], "RGB"), (~several["RGB"], "BGR"), (c("entropy_BGR") < c("entropy_RGB"), "BGR"), otherwise="RGB")
    chosen = chain((none, "N/A"), (~by_label, by_entropy), (a_bgr > a_rgb, "BGR"), (failed & (a_bgr == a_rgb), "UNCERTAIN"), otherwise="RGB")
    status = chain((none, "CALIBRATION_IMPOSSIBLE"), (by_label & failed, "CALIBRATION_FAILED"), (~by_label & uncertain, "CALIBRATION_UNCERTAIN"), otherwise="OK")
    tier = chain((none, "TIER_D"), (c("given").isNotNull(), c("given")), (by_label, "TIER_A"), otherwise="TIER_C")
    metric = lambda name: F.when(by_label, c(f"accuracy_{name}")).otherwise(c(f"entropy_{name}"))
    return summed.select("model_id", tier.alias("tier"), metric("RGB").alias("rgb"), metric("BGR").alias("bgr"), c("classes_RGB").alias("classes_rgb"), c("classes_BGR").alias("classes_bgr"), chosen.alias("chosen"), status.alias("status"))
