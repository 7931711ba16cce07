"""Class-conditional outliers by Mahalanobis distance with Ledoit-Wolf covariances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import squared_distance
from plumbline.operators.profile import folds, robust_scale, threshold_from, trimmed
from plumbline.tables import durable

LEAST_FIT, LEAST_CALIBRATE, LEAST_CLASS = 16, 32, 8


@dataclass(frozen=True)
class Reference:
    """Mean and precision of each class, or of all rows together where a class is too small."""

    classes: dict[str, tuple[np.ndarray, np.ndarray]]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Least distance to any class."""
        each = [np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", rows - m, p, rows - m), 0)) for m, p in self.classes.values()]
        return np.min(each, axis=0)


def shrunk(n: int, s1: np.ndarray, s2: np.ndarray, fourth: float) -> np.ndarray:
    """The Ledoit-Wolf covariance (2004) from n, the centred second moments and the sum of fourth powers of norms."""
    p = len(s1)
    cov = s2 / n
    trace, delta_ = np.trace(cov), (cov**2).sum()
    mu = trace / p
    beta = (fourth / n - delta_) / (p * n)
    delta = (delta_ - 2 * mu * trace + p * mu**2) / p
    beta = min(beta, delta)
    shrinkage = 0.0 if beta == 0 or delta == 0 else beta / delta
    return (1 - shrinkage) * cov + shrinkage * mu * np.eye(p)


def _moments(frame: DataFrame, means: dict[str, np.ndarray]) -> dict[str, tuple[int, np.ndarray, float]]:
    """Count, centred second moments and fourth powers by class: partial sums a batch, one d x d matrix a class and task."""

    def partial(batches):
        sums: dict[str, list] = {}
        for part in batches:
            for label, rows in part.groupby("label"):
                x = np.stack(rows["v"]) - means[label]
                held = sums.setdefault(label, [0, 0.0, 0.0])
                held[0] += len(x)
                held[1] = held[1] + x.T @ x
                held[2] += float(((x**2).sum(1) ** 2).sum())
        yield pd.DataFrame([(k, n, s.ravel().tolist(), f) for k, (n, s, f) in sums.items()], columns=["label", "n", "s", "f"])

    parts = frame.select("label", "v").mapInPandas(partial, "label string, n long, s array<double>, f double")
    whole = parts.select("label", "n", "f", F.posexplode("s").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("x").alias("x"))
    done = whole.groupBy("label").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("s"))
    out = {}
    for row in done.collect():  # one row a class
        d = int(round(len(row["s"]) ** 0.5))
        out[row["label"]] = row["n"], np.array(row["s"]).reshape(d, d), row["f"]
    return out


def _fit_parts(rows: DataFrame, trim: float) -> dict[str, Reference]:
    """A reference for each `part` of rows (part, label, id, v), all parts in the same few passes."""
    sizes: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("part", "label").count().collect():  # one row a part and class
        sizes.setdefault(r["part"], {})[r["label"]] = r["count"]
    for part, own in sizes.items():
        if sum(own.values()) < LEAST_FIT:
            raise ValueError(f"{sum(own.values())} rows, at least {LEAST_FIT} needed")
    pooled = [part for part, own in sizes.items() if min(own.values()) < LEAST_CLASS]
    named = F.when(F.col("part").isin(pooled), F.lit("all")).otherwise(F.col("label")) if pooled else F.col("label")
    rows = rows.withColumn("label", F.concat_ws("\x01", "part", named))
    medians = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.median("x").alias("m"))
    medians = medians.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("centre"))
    kept = durable(trimmed(rows.join(F.broadcast(medians), "label").withColumn("d0", F.sqrt(squared_distance(F.col("v"), F.col("centre")))), "d0", "label", "id", trim).select("label", "v"))
    means = kept.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    means = {r["label"]: np.array([x["m"] for x in sorted(r["s"], key=lambda x: x["pos"])]) for r in means.groupBy("label").agg(F.collect_list(F.struct("pos", "m")).alias("s")).collect()}
    classes: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
    for name, (n, s, f) in _moments(kept, means).items():
        part, _, label = name.partition("\x01")
        classes.setdefault(part, {})[label] = means[name], np.linalg.inv(shrunk(n, means[name], s, f))
    return {part: Reference(own) for part, own in classes.items()}


def _rows(frame: DataFrame, key: str, vector: str, label: str, *more: str) -> DataFrame:
    return frame.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), *more)


def fit(frame: DataFrame, key: str, vector: str, label: str, trim: float = 0.10) -> Reference:
    """A reference from each class's rows nearest its coordinate-wise median; classes under 8 rows pool all."""
    found = _fit_parts(_rows(frame, key, vector, label).withColumn("part", F.lit("0")), trim)
    if not found:
        raise ValueError(f"0 rows, at least {LEAST_FIT} needed")
    return found["0"]


def score(frame: DataFrame, key: str, vector: str, reference: Reference) -> DataFrame:
    """(id, distance) to the nearest class. The reference, a matrix a class, goes to all tasks."""

    def distances(batches):
        for part in batches:
            yield pd.DataFrame({"id": part["id"], "distance": reference.distances(np.stack(part["v"])) if len(part) else []})

    rows = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(distances, f"id {rows.schema['id'].dataType.simpleString()}, distance double")


def calibrate(frame: DataFrame, key: str, vector: str, label: str, trim: float = 0.10, n_splits: int = 5, seed: int = 42, mad_k: float = 5.0) -> float:
    """The threshold median + k 1.4826 MAD of distances that each row has to a reference fitted without its fold."""
    counts = frame.groupBy(label).count().agg(F.sum("count"), F.min("count")).first()
    if (counts[0] or 0) < LEAST_CALIBRATE:
        raise ValueError(f"{counts[0]} rows, at least {LEAST_CALIBRATE} needed")
    k = max(2, min(n_splits, counts[1]))
    dealt = durable(_rows(folds(frame, label, key, k, seed), key, vector, label, "fold"))
    others = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda part: part != F.col("fold")), lambda part: part.cast("string"))).alias("part")
    references = _fit_parts(dealt.select("id", "label", "v", others), trim)

    def distances(batches):
        for part in batches:
            for fold, rows in part.groupby("fold"):
                yield pd.DataFrame({"distance": references[str(fold)].distances(np.stack(rows["v"]))})

    held_out = dealt.select("fold", "v").mapInPandas(distances, "distance double")
    return threshold_from(robust_scale(held_out, "distance"), mad_k).first()["threshold"]


def flag(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("is_outlier", F.col("distance") > threshold)
