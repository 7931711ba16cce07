"""The kernel two-sample test in linear time, by random Fourier features.

A Gaussian kernel is the mean of cos(w (x - y)) over normal frequencies w. With the cosines and sines of a
fixed set of frequencies as features, a kernel's mean over all pairs of rows is a product of two mean
feature vectors, so a side of the test is one sum that merges over tasks, files and micro-batches, and no
pair of rows is ever formed. Each frequency gives an unbiased value of the statistic; their mean is the
result and their standard error comes with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.drift import _drawn, _numbered, _sample, bandwidth
from plumbline.tables import durable

#: Rows whose features are held at a time, and groups whose sums a task holds before it hands them on.
ROWS, GROUPS = 2_048, 1_024


@dataclass(frozen=True)
class Features:
    """`count` features (two a frequency) of vectors of one dimension; equal parameters give equal features anywhere."""

    sigma: float
    dimension: int
    count: int = 1_024
    seed: int = 42

    def of(self, rows: np.ndarray) -> np.ndarray:
        angles = rows @ _frequencies(self)
        return np.hstack([np.cos(angles), np.sin(angles)]) / np.sqrt(self.count // 2)


@functools.lru_cache(maxsize=4)
def _frequencies(features: Features) -> np.ndarray:
    return np.random.default_rng(features.seed).standard_normal((features.dimension, features.count // 2)) / features.sigma


@dataclass(frozen=True)
class Fitted:
    """A reference's features: what a test needs of it, whatever its size. `n` rows, their mean feature vector."""

    features: Features
    n: int
    mean: tuple[float, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row, to be stored beside a calibration."""
        f = self.features
        return spark.createDataFrame([(f.sigma, f.dimension, f.count, f.seed, self.n, list(self.mean))], "sigma double, dimension int, count int, seed long, n long, mean array<double>")

    @staticmethod
    def read(frame: DataFrame) -> "Fitted":
        row = frame.first()
        return Fitted(Features(row["sigma"], row["dimension"], row["count"], row["seed"]), row["n"], tuple(row["mean"]))


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors that are finite and of the dimension, whether each row has such a vector)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    good = sizes == dimension
    held = column.filter(pa.array(good))
    values = held.flatten()
    rows = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension) if len(values) else np.zeros((0, dimension))
    finite = np.isfinite(rows).all(axis=1)
    good[np.flatnonzero(good)[~finite]] = False
    return rows[finite], good


def partial_sums(frame: DataFrame, by: str, vector: str, features: Features) -> DataFrame:
    """(by, n, bad, sums): sums of features, at least one row a task and group; rows without a fit vector count as bad."""
    kind = frame.schema[by].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys, parts = list(held), list(held.values())
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * features.count, pa.int32()), pa.array(np.concatenate([p[2] for p in parts])))
            return pa.RecordBatch.from_arrays([pa.array(keys, group_kind), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), sums], ["by", "n", "bad", "sums"])

        group_kind = None
        for batch in batches:
            group_kind = batch.schema.field("by").type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, good = _matrix(part["v"], features.dimension)
                codes, keys = pd.factorize(np.array(part["by"].to_pylist(), dtype=object), use_na_sentinel=False)
                counts, used = np.bincount(codes, minlength=len(keys)), np.bincount(codes[good], minlength=len(keys))
                sums = np.zeros((len(keys), features.count))
                np.add.at(sums, codes[good], features.of(rows))
                for key, n, m, own in zip(keys, counts, used, sums):
                    entry = held.setdefault(key, [0, 0, np.zeros(features.count)])
                    entry[0] += int(n)
                    entry[1] += int(n - m)
                    entry[2] += own
                if len(held) >= GROUPS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return frame.select(F.col(by).alias("by"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(add_up, f"by {kind}, n long, bad long, sums array<double>")


def merged(partial: DataFrame) -> DataFrame:
    """(by, n, bad, sums) with one row a group; a group meets at most as many parts as it has rows or tasks."""
    added = F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), F.size(F.first("sums"))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return partial.groupBy("by").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), added.alias("sums"))


def fit(reference: DataFrame, vector: str, features: Features) -> Fitted:
    """A reference of any size in one pass; parts of all tasks are added up by position."""
    parts = durable(partial_sums(reference.withColumn("__all", F.lit(0)), "__all", vector, features))
    row = parts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not row["n"]:
        raise ValueError("the reference has no rows")
    if row["bad"]:
        raise ValueError("reference vectors are not finite or not of one dimension")
    sums = parts.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()  # one number a feature
    return Fitted(features, row["n"], tuple(r["x"] / row["n"] for r in sums))


def fitted(reference: DataFrame, key: str, vector: str, count: int = 1_024, sigma: float | None = None, seed: int = 42, most: int = 512) -> Fitted:
    """The same with the bandwidth of at most `most` reference rows, as window_mmd takes it, and their dimension."""
    sample = _sample(reference, key, vector, seed, most)
    dimension = sample.shape[1] if sample.ndim == 2 else 0
    return fit(reference, vector, Features(sigma or bandwidth(sample), dimension, count, seed))


def window_mmd(reference: Fitted, members: DataFrame, vector: str) -> DataFrame:
    """(window_no, n, mmd, error, sigma) of each window against a fitted reference; `error` is the standard error of mmd.

    Windows with rows that aren't finite or of the reference's dimension have neither.
    """
    mean, half = np.array(reference.mean), reference.features.count // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = rows["n"].to_numpy()
            sums = rows["sums"].flatten().to_numpy().reshape(len(n), -1)
            apart = (sums / n[:, None] - mean) ** 2
            each = (apart[:, :half] + apart[:, half:]) * half
            unfit = rows["bad"].to_numpy() > 0
            values = (pa.array(x, pa.float64(), mask=unfit) for x in (each.mean(axis=1), each.std(axis=1, ddof=1) / np.sqrt(half)))
            yield pa.RecordBatch.from_arrays([rows["by"], rows["n"], *values], ["window_no", "n", "mmd", "error"])

    kind = members.schema["window_no"].dataType.simpleString()
    sums = merged(partial_sums(members, "window_no", vector, reference.features))
    return sums.mapInArrow(compare, f"window_no {kind}, n long, mmd double, error double").withColumn("sigma", F.lit(reference.features.sigma))


def permutation_p(reference: Fitted, rows: DataFrame, members: DataFrame, key: str, vector: str, permutations: int, seed: int = 42) -> DataFrame:
    """(window_no, p_value): how often a random split of a window's and all reference rows is as far apart as the window.

    A split that deals j of the window's m rows to the live side takes m - j reference rows with it, the first of
    `permutations` random draws of m different ones out of all `rows`. The draws, and no more, go to all tasks:
    permutations x m vectors. Windows of one draw's split share its reference rows; each split is uniform.
    """
    size = members.groupBy("window_no").count().agg(F.max("count")).first()[0] or 0
    numbered = _numbered(rows, key, vector)
    if not size or reference.n < size:
        return members.select("window_no").distinct().withColumn("p_value", F.lit(None).cast("double"))
    drawn = sorted((r["draw"], r["place"], r["v"]) for r in _drawn(numbered, reference.n, permutations, size, seed).collect())
    shared = rows.sparkSession.sparkContext.broadcast(np.array([v for _, _, v in drawn]).reshape(permutations, size, -1))
    features, mean, totals = reference.features, np.array(reference.mean), {}

    def total(m: int) -> np.ndarray:
        """The summed features of the first m rows of each draw, once a task for each size of window."""
        if m not in totals:
            totals[m] = np.stack([features.of(draw[:m]).sum(0) for draw in shared.value])
        return totals[m]

    def test(part: pd.DataFrame) -> pd.DataFrame:
        window, vectors, n = part["window_no"].iat[0], part["v"].tolist(), reference.n
        m = len(vectors)
        if any(v is None or len(v) != features.dimension or not np.isfinite(v).all() for v in vectors):
            return pd.DataFrame({"window_no": [window], "p_value": [None]})
        own = features.of(np.stack(sorted(map(tuple, vectors))))
        whole, seen, hits = n * mean + own.sum(0), ((mean - own.mean(0)) ** 2).sum(), 0
        for turn, draw in enumerate(shared.value):
            rng = np.random.default_rng([seed, abs(int(window)), turn])
            j = rng.hypergeometric(m, n, m)
            live = total(m)[turn] - features.of(draw[m - j : m]).sum(0) + own[rng.choice(m, j, replace=False)].sum(0)
            hits += (((whole - live) / n - live / m) ** 2).sum() >= seen
        return pd.DataFrame({"window_no": [window], "p_value": [hits / permutations]})

    plain = members.select("window_no", F.col(vector).cast("array<double>").alias("v"))
    return plain.groupBy("window_no").applyInPandas(test, f"window_no {members.schema['window_no'].dataType.simpleString()}, p_value double")
