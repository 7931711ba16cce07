"""Toxicity as ordered severity grades, by cumulative-link (proportional odds) regression.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector for all grades, ordered thresholds. The
score adds up the weights of a text's sparse features: its distinct words and their prefixes of PREFIXES
letters, each as often as distinct chunks of non-space text hold it. Grades come from the labels alone: 0
for a text labelled not toxic, 1 for a toxic one, 2 for a toxic one that is also labelled of low quality
(where `labels` has a column quality). A text's severity is the CAUTION quantile of its grade: it is above
0, and the text toxic, when a toxic grade has a probability of more than 1 - CAUTION.

The model is fitted on at most SAMPLE labelled rows, those with the smallest hash of their id (a
documented bound; every other figure here covers all rows). Features are counted by Spark; those whose
count among toxic texts is LEAST_Z or more standard deviations away from what chance gives, on either
side, are kept, the at most FEATURES farthest ones. All texts are scored in full.

Defined results: a null or empty text has no features and thus the base odds; unlabelled, repeated and
very long texts are scored like any other; of several labels of a document the gravest counts; without
labelled rows nothing is toxic; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, mapped, text_of

SAMPLE = 20_000
FEATURES = 20_000
LEAST_COUNT = 5
LEAST_Z = 4.0
PREFIXES = (4, 5, 6)
RIDGE = 1.0
CAUTION = 0.8
GRADES = 3

_WORD = re.compile(r"[^\W\d_]+")


def features_of(chunk: str) -> tuple[str, ...]:
    """Words of a chunk and, marked by a star, their prefixes."""
    out: list[str] = []
    for word in _WORD.findall(chunk):
        out += [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
    return tuple(out)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade) for each score, one row a score."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - score[:, None], -500, 500)))
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(edges, axis=1)


class _Scores(dict):
    """Chunk to its weight."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, chunk: str) -> float:
        if len(self) >= 1 << 20:
            self.clear()
        score = self[chunk] = sum(self.weights.get(feature, 0.0) for feature in features_of(chunk))
        return score


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, toxic documents) over each batch."""
    for rows in batches:
        seen, toxic = Counter(), Counter()
        for text, grade in zip(rows["text"].to_pylist(), rows["grade"].to_pylist()):
            found = {f for chunk in set(text.lower().split()) for f in features_of(chunk)}
            seen.update(found)
            if grade:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], ["feature", "n", "toxic"])


def _design(batches: Iterator[pa.RecordBatch], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        indices, values, grades = [], [], []
        for text, grade in zip(rows["text"].to_pylist(), rows["grade"].to_pylist()):
            found = Counter(known[f] for chunk in set(text.lower().split()) for f in features_of(chunk) if f in known)
            grades.append(grade)
            indices.append(sorted(found))
            values.append([found[i] for i in sorted(found)])
        yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["grade", "indices", "counts"])


def _fit_weights(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the greatest penalised likelihood, by the limited-memory quasi-Newton method."""
    n = len(grades)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        """The thresholds are at[-2] and at[-2] + exp(at[-1]), which keeps them in order."""
        weights, low, gap = at[:-2], at[-2], min(at[-1], 3.0)
        score = np.bincount(rows, values * weights[columns], n)
        a, b = sigmoid(low - score), sigmoid(low + np.exp(gap) - score)
        p = np.choose(grades, [a, b - a, 1 - b]).clip(1e-12)
        da = np.choose(grades, [a * (1 - a), -a * (1 - a), np.zeros(n)]) / p
        db = np.choose(grades, [np.zeros(n), b * (1 - b), -b * (1 - b)]) / p
        by_weight = np.bincount(columns, (da + db)[rows] * values, n_features)
        value = -np.log(p).sum() + RIDGE / 2 * (weights @ weights + (at[-1] - 1) ** 2)
        return value, np.concatenate([by_weight + RIDGE * weights, [-(da + db).sum(), -db.sum() * np.exp(gap) + RIDGE * (at[-1] - 1)]])

    share = float(np.clip(np.mean(grades == 0), 1e-3, 1 - 1e-3))
    at = np.zeros(n_features + 2)
    at[-2:] = np.log(share / (1 - share)), 1.0
    value, gradient = loss(at)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move, used = -gradient, []
        for s, y in reversed(pairs):
            used.append(s @ move / (s @ y))
            move = move - used[-1] * y
        move = move * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(gradient).max())))
        for (s, y), alpha in zip(pairs, reversed(used)):
            move = move + (alpha - y @ move / (s @ y)) * s
        step, slope = 1.0, gradient @ move
        while (new := loss(at + step * move))[0] > value + 1e-4 * step * slope and step > 1e-8:
            step /= 2
        if step <= 1e-8 or np.abs(gradient).max() < 1e-4:
            break
        if (s := step * move) @ (y := new[1] - gradient) > 1e-10:
            pairs = [*pairs[-9:], (s, y)]
        at, (value, gradient) = at + s, new
    return at[:-2], np.array([at[-2], at[-2] + np.exp(min(at[-1], 3.0))])


def graded(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, grade) of at most `sample` labelled documents."""
    heavy = (F.col("quality") == 0) if "quality" in labels.columns else F.lit(False)
    grade = F.when(F.col("toxic") == 0, 0).when(heavy, 2).otherwise(1)
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), grade.alias("grade"))
    return known.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents; `labels` has doc_id, toxic and, for the gravest grade, quality."""
    # at most `sample` ids, each with one number; the labelled texts are written once and read from there
    texts = durable(documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).join(F.broadcast(graded(labels, sample)), "doc_id").select("text", "grade"))
    counted = texts.mapInArrow(_count_features, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total = texts.agg(F.count("*").alias("n"), F.avg((F.col("grade") > 0).cast("int")).alias("share")).first()
    if not total["n"] or not 0 < total["share"] < 1:
        return Model({}, (20.0, 25.0))
    z = F.abs(F.col("toxic") - F.col("n") * total["share"]) / F.sqrt(F.col("n") * (total["share"] * (1 - total["share"])))
    best = counted.filter(F.col("n") >= LEAST_COUNT).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
    known = {row["feature"]: i for i, row in enumerate(best.select("feature").collect())}
    if not known:
        return Model({}, (20.0, 25.0))
    # at most `sample` rows, with the few chosen features of each
    design = texts.mapInArrow(lambda batches: _design(batches, known), "grade int, indices array<int>, counts array<int>").toArrow()
    sizes = np.array([len(x) for x in design["indices"].to_pylist()], dtype=int)
    columns, values = (np.concatenate([np.array(x, dtype=int) for x in design[name].to_pylist()]) for name in ("indices", "counts"))
    weights, thresholds = _fit_weights(np.repeat(np.arange(len(sizes)), sizes), columns, values.astype(float), design["grade"].to_numpy().astype(int), len(known))
    return Model({feature: float(weights[i]) for feature, i in known.items()}, tuple(map(float, thresholds)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scores = _Scores(model.weights)
    for rows in batches:
        raw = np.array([sum(map(scores.__getitem__, set(text.as_py().lower().split()))) for text in rows["text"]], dtype=float)
        p = model.probabilities(raw)
        expected = p @ np.arange(GRADES)
        names = ["doc_id", "severity", "expected_severity", "toxic"]
        severity = (p.cumsum(axis=1)[:, :-1] < CAUTION).sum(axis=1)
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(severity, pa.int32()), pa.array(expected), pa.array(severity > 0)], names)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, severity (the CAUTION quantile of its grade), expected_severity and toxic (severity above 0)."""
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return texts.mapInArrow(lambda batches: _score(batches, model), "doc_id long, severity int, expected_severity double, toxic boolean")


def _keep(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scores = _Scores(model.weights)
    for rows in batches:
        at = rows.schema.get_field_index("text")
        raw = np.array([sum(map(scores.__getitem__, set((text.as_py() or "").lower().split()))) for text in rows.column(at)], dtype=float)
        yield rows.filter(pa.array(model.probabilities(raw)[:, 0] >= CAUTION))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` that are not toxic, with all their columns."""
    return mapped(documents, lambda batches: _keep(batches, model))
