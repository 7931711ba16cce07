"""Label noise: out-of-fold class probabilities, neighbourhood evidence and confident learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import given as once, norm, z_scores
from plumbline.operators import neighbours
from plumbline.operators.duplicates import nearest, nearest_both
from plumbline.operators.profile import folds, placed
from plumbline.tables import durable


#: Vectors from this length on are compared by direction, shorter ones by z-scores.
LONG = 64


@dataclass(frozen=True)
class Config:
    """Gates of find()."""

    classifier: str = "knn"
    n_splits: int = 5
    seed: int = 42
    n_neighbors: int = 5
    filter_by: str = "predicted_neq_given"
    min_confidence_gap: float = 0.10
    min_alt_prob: float = 0.20
    min_odds_ratio: float = 1.2
    min_centroid_ratio: float = 0.0
    neighbours: str = "exact"  # or "index", for tables where all pairs are too many


#: How neighbours are found, by the name in Config.
WAYS = {"exact": nearest, "index": neighbours.nearest}


def knn_probabilities(dealt: DataFrame, k: int, way: str = "exact", found: DataFrame | None = None) -> DataFrame:
    """(id, class, p): neighbours of other folds vote with weight 1 / (distance + 1e-5); smoothed over all classes.

    `dealt` has id, label, v and fold; `found` are its neighbours in other folds, where they are known.
    """
    found = WAYS[way](dealt, "id", "v", k, within="fold") if found is None else found
    votes = found.join(dealt.select(F.col("id").alias("neighbour"), F.col("label").alias("class")), "neighbour")
    weights = votes.groupBy("id", "class").agg(F.sum(1 / (F.col("distance") + 1e-5)).alias("w"))
    return _smoothed(dealt, weights.withColumn("raw", F.col("w") / F.sum("w").over(Window.partitionBy("id"))))


def _smoothed(dealt: DataFrame, raw: DataFrame) -> DataFrame:
    """All classes for each id; their number is that of the labels in use."""
    labels = dealt.select(F.col("label").alias("class")).distinct().agg(F.collect_set("class").alias("classes"))
    grid = dealt.select("id").crossJoin(F.broadcast(labels)).select("id", F.explode("classes").alias("class"))
    full = grid.join(raw.select("id", "class", "raw"), ["id", "class"], "left").withColumn("q", F.coalesce("raw", F.lit(0.0)) + 1e-4)
    return full.select("id", "class", (F.col("q") / F.sum("q").over(Window.partitionBy("id"))).alias("p"))


def ridge_probabilities(dealt: DataFrame, k: int) -> DataFrame:
    """(id, class, p): ridge least squares on one-hot labels, fitted without the row's fold, then softmax.

    The sums over rows are taken by Spark, once a fold; a fold's model comes from all sums less its own.
    """
    classes = sorted(r[0] for r in dealt.select("label").distinct().collect())
    place = {c: i for i, c in enumerate(classes)}

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for fold, rows in part.groupby("fold"):
                x = np.hstack([np.stack(rows["v"]), np.ones((len(rows), 1))])
                y = np.zeros((len(rows), len(classes)))
                y[np.arange(len(rows)), [place[c] for c in rows["label"]]] = 1
                sums[fold] = sums.get(fold, 0) + np.hstack([x.T @ x, x.T @ y])
        yield pd.DataFrame([(int(f), s.ravel().tolist(), s.shape[0]) for f, s in sums.items()], columns=["fold", "s", "d"])

    parts = dealt.select("fold", "label", "v").mapInPandas(partial, "fold int, s array<double>, d int")
    whole = parts.select("fold", "d", F.posexplode("s").alias("pos", "x")).groupBy("fold", "d", "pos").agg(F.sum("x").alias("x")).groupBy("fold", "d").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("s"))
    sums = {r["fold"]: np.array(r["s"]).reshape(r["d"], -1) for r in whole.collect()}  # one matrix a fold
    total = sum(sums.values())
    models = {}
    for fold, own in sums.items():
        rest = total - own
        d = len(rest)
        models[fold] = np.linalg.solve(rest[:, :d] + 0.01 * np.eye(d), rest[:, d:])

    def predict(batches):
        for part in batches:
            for fold, rows in part.groupby("fold"):
                raw = np.hstack([np.stack(rows["v"]), np.ones((len(rows), 1))]) @ models[fold]
                raw = np.exp(raw - raw.max(axis=1, keepdims=True))
                p = raw / raw.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), len(classes)), "class": np.tile(classes, len(rows)), "raw": p.ravel()})

    kind = dealt.schema["id"].dataType.simpleString()
    return _smoothed(dealt, dealt.select("id", "fold", "v").mapInPandas(predict, f"id {kind}, class string, raw double"))


def confident_mask(probabilities: DataFrame, labels: DataFrame, filter_by: str) -> DataFrame:
    """(id) of likely label errors, by confident learning (Northcutt, Jiang and Chuang 2021).

    A row counts for class j when p_j reaches the mean p_j of rows given j; of several the most probable
    counts. The joint counts, scaled to the class counts, say how many rows to prune: those of least
    self-confidence in each class (by class), those of greatest margin in each off-diagonal cell (by noise
    rate), or those in both.
    """
    joined = probabilities.join(labels, "id")
    own = joined.filter(F.col("class") == F.col("label")).select("id", F.col("p").alias("self_p"))
    top = probabilities.groupBy("id").agg(F.max(F.struct("p", "class")).alias("t")).select("id", F.col("t.class").alias("predicted"))
    if filter_by == "predicted_neq_given":
        return labels.join(top, "id").filter("predicted <> label").select("id")
    thresholds = joined.filter(F.col("class") == F.col("label")).groupBy("class").agg(F.avg("p").alias("t"))
    confident = joined.join(F.broadcast(thresholds), "class").filter("p >= t").groupBy("id", "label").agg(F.max(F.struct("p", "class")).alias("c")).select("id", "label", F.col("c.class").alias("likely"))
    joint = confident.groupBy("label", "likely").agg(F.count("*").alias("n"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    scaled = joint.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label"))).join(sizes, "label").withColumn("count", F.round(F.col("share") * F.col("size")).cast("long"))
    cells = scaled.filter("label <> likely").select("label", "likely", "count")
    per_class = cells.groupBy("label").agg(F.sum("count").alias("count"))
    # ranks are places in a global order, so that a label with all rows is ranked by many tasks
    ranked = placed(labels.join(own, "id"), "label", "self_p", "id")
    by_class = ranked.join(F.broadcast(per_class), "label").filter(F.col("__place") < F.col("count")).select("id")
    margin = joined.join(own, "id").join(F.broadcast(cells.withColumnRenamed("likely", "class")), ["label", "class"]).select("id", "count", F.struct("label", "class").alias("cell"), (F.col("self_p") - F.col("p")).alias("lead"))
    by_rate = placed(margin, "cell", "lead", "id").filter(F.col("__place") < F.col("count")).select("id").distinct()
    if filter_by == "prune_by_class":
        return by_class
    if filter_by == "prune_by_noise_rate":
        return by_rate
    return by_class.join(by_rate, "id", "left_semi")


def _centroid_ratios(rows: DataFrame, centres: DataFrame, by_direction: bool) -> DataFrame:
    """(id, centroid_ratio): the distance to the own class's centre by that to the nearest other one. Centres are a row for each class."""
    held = centres.select("label", "c").collect()
    labels, points = [r["label"] for r in held], [np.array(r["c"], dtype=float) for r in held]

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            known = [np.zeros(batch.num_rows, bool) for _ in range(2)]
            v, label = np.array(batch["v"].to_pylist(), dtype=float), np.array(batch["label"].to_pylist(), dtype=object)
            given_ = np.array([x is not None for x in label], bool)
            for name, c in zip(labels, points):
                d = np.zeros(len(v))
                for j in range(len(c) if len(v) else 0):  # in the order of the numbers, as a row by itself is added up
                    d += v[:, j] * c[j] if by_direction else (v[:, j] - c[j]) ** 2
                d = 1 - d if by_direction else np.sqrt(np.maximum(d, 0))
                same = given_ & (label == name) if name is not None else np.zeros(len(v), bool)
                apart = given_ & ~same if name is not None else np.zeros(len(v), bool)
                for at, least, rows_ in ((0, own, same), (1, other, apart)):
                    least[rows_] = np.fmin(least[rows_], d[rows_])
                    known[at] |= rows_
            ratio = pa.array((own + 1e-4) / (other + 1e-4), mask=~(known[0] & known[1]))
            yield pa.RecordBatch.from_arrays([batch["id"], ratio], ["id", "centroid_ratio"])

    return rows.select("id", "label", "v").mapInArrow(ratios, f"id {rows.schema['id'].dataType.simpleString()}, centroid_ratio double")


def find(frame: DataFrame, key: str, vector: str, label: str, config: Config = Config(), scaled: bool = False, also: DataFrame | None = None) -> DataFrame:
    """(id, given_label, predicted_label, p_given, p_top, gap, odds, centroid_ratio, given_agree, top_agree, score) of likely flips.

    Vectors that are `scaled` already are taken as they are. Long ones are else compared by direction: their
    class centres are brought to length one and distances to them are one less the cosine. `also` (id, class) names
    further classes that a sample truly shows: a prediction of one of those is no flip.
    """
    rows = frame.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    by_direction = not scaled and (rows.agg(F.max(F.size("v"))).first()[0] or 0) >= LONG
    if by_direction:
        # a length is taken once a vector, not once for each of its numbers
        rows = rows.withColumn("v", once(norm(F.col("v")), lambda size: F.transform("v", lambda x: x / F.when(size > 0, size).otherwise(1.0))))
    elif not scaled:
        stats = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
        held = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
        scale = stats.agg(held["m"].alias("__m"), held["s"].alias("__s"))  # one row, as long as a vector
        rows = rows.crossJoin(F.broadcast(scale)).withColumn("v", z_scores(F.col("v"), F.col("__m"), F.col("__s"))).drop("__m", "__s")
    rows = durable(rows)  # vectors are scaled once, however often they are read
    least = rows.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    dealt = folds(rows, "label", "id", max(2, min(config.n_splits, least)), config.seed)
    k, own, around = config.n_neighbors, None, None
    if config.classifier == "knn" and config.neighbours == "exact":  # both searches in one pass over the pairs
        both = durable(nearest_both(dealt, "id", "v", k, "fold"))
        own, around = both.filter("across = 1").drop("across"), both.filter("across = 0").drop("across")
    p = durable(knn_probabilities(dealt, k, config.neighbours, own) if config.classifier == "knn" else ridge_probabilities(dealt, k))

    labels = rows.select("id", "label")
    given = p.join(labels, "id").filter(F.col("class") == F.col("label")).select("id", F.col("p").alias("p_given"))
    top = p.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("m"), "class")).alias("t")).select("id", F.col("t.class").alias("predicted_label"), (-F.col("t.m")).alias("p_top"))

    centres = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("c"))
    if by_direction:
        long = norm(F.col("c"))
        centres = centres.withColumn("c", F.transform("c", lambda x: x / F.when(long > 1e-12, long).otherwise(1e-12)))
    ratio = _centroid_ratios(rows, centres, by_direction)

    around = (WAYS[config.neighbours](rows, "id", "v", k) if around is None else around).join(rows.select(F.col("id").alias("neighbour"), F.col("label").alias("near")), "neighbour")
    agree = around.join(labels, "id").join(top.select("id", "predicted_label"), "id").groupBy("id").agg(F.avg((F.col("near") == F.col("label")).cast("double")).alias("given_agree"), F.avg((F.col("near") == F.col("predicted_label")).cast("double")).alias("top_agree"))

    all_ = labels.join(given, "id").join(top, "id").join(ratio, "id").join(agree, "id").withColumn("gap", F.col("p_top") - F.col("p_given")).withColumn("odds", F.col("p_top") / (F.col("p_given") + 1e-4))
    score = 0.35 * F.col("gap") + 0.25 * F.least(F.greatest((F.col("centroid_ratio") - 1) / 2, F.lit(0.0)), F.lit(1.0)) + 0.20 * F.col("top_agree") + 0.20 * (1 - F.col("given_agree"))
    gates = (F.col("predicted_label") != F.col("label")) & (F.col("gap") >= config.min_confidence_gap) & (F.col("p_top") >= config.min_alt_prob) & (F.col("odds") >= config.min_odds_ratio) & (F.col("centroid_ratio") >= config.min_centroid_ratio)
    passed = all_.filter(gates).join(confident_mask(p, labels, config.filter_by), "id", "left_semi")
    if also is not None:
        passed = passed.join(also.select(F.col("id"), F.col("class").cast("string").alias("predicted_label")), ["id", "predicted_label"], "left_anti")
    return passed.select("id", F.col("label").alias("given_label"), "predicted_label", "p_given", "p_top", "gap", "odds", "centroid_ratio", "given_agree", "top_agree", score.alias("score"))
