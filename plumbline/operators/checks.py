"""The checks of a labelled vector table as one run: one standardisation, failing checks on record, one row a flagged sample."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import by_rank, rank
from plumbline.functions.vectors import z_scores
from plumbline.operators import duplicates, label_noise, outliers
from plumbline.operators.validate import guard_range, guard_vectors
from plumbline.tables import durable


@dataclass(frozen=True)
class Duplicate:
    similarity_threshold: float = 0.99


@dataclass(frozen=True)
class Ood:
    trim_fraction: float = 0.10
    calibration_splits: int = 5
    seed: int = 42
    mad_k: float = 5.0


@dataclass(frozen=True)
class Policy:
    """Severity of each check's flags, and the least severity of samples with two or more."""

    duplicate: str = "MEDIUM"
    ood: str = "HIGH"
    label_flip: str = "MEDIUM"
    multiple_checks: str = "HIGH"


#: Gates of a joint run are tighter than those of label_noise.find alone.
FLIPS = label_noise.Config(filter_by="both", min_confidence_gap=0.15, min_alt_prob=0.35, min_odds_ratio=1.5, min_centroid_ratio=1.0)


@dataclass(frozen=True)
class Config:
    duplicate: Duplicate = field(default_factory=Duplicate)
    ood: Ood = field(default_factory=Ood)
    label_flip: label_noise.Config = FLIPS
    policy: Policy = field(default_factory=Policy)

    @staticmethod
    def read(given: Mapping[str, Any]) -> "Config":
        """Defaults, with what a JSON object gives for each section; keys that a section does not have are left to others."""
        own = Config()

        def section(name: str):
            values = dict(given.get(name, {}))
            if name == "policy":
                values = {k: v["severity"] if isinstance(v, Mapping) else v for k, v in values.items()}
            held = getattr(own, name)
            return replace(held, **{f.name: type(getattr(held, f.name))(values[f.name]) for f in fields(held) if f.name in values})

        return Config(*(section(f.name) for f in fields(Config)))


@dataclass(frozen=True)
class Result:
    """`flagged` (id, flags, n_flags, reason, confidence, severity, disposition), and by check what kept it from running."""

    flagged: DataFrame
    errors: dict[str, str]
    checks: tuple[str, ...]


def standardised(frame: DataFrame, vector: str) -> DataFrame:
    """`frame` with its vectors in the population's deviations from the mean, by dimension; those without a spread count as one."""
    stats = frame.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    held = F.array_sort(F.collect_list(F.struct("pos", "m", F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")).alias("s"))))
    scale = stats.agg(held["m"].alias("__m"), held["s"].alias("__s"))  # one row, as long as a vector
    return frame.crossJoin(F.broadcast(scale)).withColumn(vector, z_scores(F.col(vector).cast("array<double>"), F.col("__m"), F.col("__s"))).drop("__m", "__s")


def run(samples: DataFrame, key: str, vector: str, label: str, config: Config = Config(), checks: Iterable[str] = ("duplicate", "ood", "label_flip"), reference: outliers.Reference | None = None, threshold: float | None = None, also: DataFrame | None = None) -> Result:
    """Duplicates, outliers and label noise over one standardised table.

    A check whose input it refuses is named in `errors` and the others go on; vectors that no check could take are refused as
    a whole. An outlier reference and threshold that were fitted elsewhere can be given. `also` (id, class) has further true classes of samples.
    """
    guard_vectors(samples, key, vector)
    rows = durable(standardised(samples.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label")), "v"))
    policy, found, errors = config.policy, [], {}

    def outlying() -> DataFrame:
        guard_range("trim_fraction", config.ood.trim_fraction, 0, 0.5)
        fitted = reference or outliers.fit(rows, "id", "v", "label", config.ood.trim_fraction)
        limit = threshold if threshold is not None else outliers.calibrate(rows, "id", "v", "label", config.ood.trim_fraction, config.ood.calibration_splits, config.ood.seed, config.ood.mad_k)
        far = outliers.flag(outliers.score(rows, "id", "v", fitted), limit).filter("is_outlier")
        return far.select("id", F.format_string(f"distance %.2f over {limit:.2f}", "distance").alias("reason"))

    def duplicated() -> DataFrame:
        guard_range("similarity_threshold", config.duplicate.similarity_threshold, -1, 1)
        best = duplicates.best_partner(duplicates.near_pairs(rows, "id", "v", config.duplicate.similarity_threshold))
        return best.select("id", F.format_string(f"near %s by %.3f, at least {config.duplicate.similarity_threshold:.2f}", F.col("partner").cast("string"), "similarity").alias("reason"))

    def flipped() -> DataFrame:
        flips = label_noise.find(rows, "id", "v", "label", config.label_flip, scaled=True, also=also)
        return flips.select("id", F.format_string("given %s, predicted %s (%.2f)", "given_label", "predicted_label", F.col("p_top")).alias("reason"))

    for name, check in (("duplicate", duplicated), ("ood", outlying), ("label_flip", flipped)):
        if name in checks:
            try:
                found.append(durable(check()).select("id", F.lit(name).alias("flag"), "reason", rank(F.lit(getattr(policy, name))).alias("place")))
            except ValueError as error:
                errors[name] = str(error)
    if not found:
        found = [rows.limit(0).select("id", F.lit("").alias("flag"), F.lit("").alias("reason"), F.lit(0).alias("place"))]
    flags = found[0]
    for more in found[1:]:
        flags = flags.unionByName(more)
    order = F.array_position(F.array(*map(F.lit, ("duplicate", "ood", "label_flip"))), F.col("flag"))
    merged = flags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "flag", "reason"))).alias("f"), F.max("place").alias("place"))
    n = F.size("f")
    worst = F.when(n >= 2, F.greatest("place", rank(F.lit(policy.multiple_checks)))).otherwise(F.col("place"))
    done = merged.select("id", F.col("f.flag").alias("flags"), n.alias("n_flags"), F.array_join("f.reason", "; ").alias("reason"), F.round(F.least(F.lit(0.95), 0.60 + 0.15 * (n - 1)), 2).alias("confidence"), by_rank(worst).alias("severity"), F.lit("REVIEW").alias("disposition"))
    return Result(done, errors, tuple(c for c in ("duplicate", "ood", "label_flip") if c in checks))
