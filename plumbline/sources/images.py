"""Image folders as tables, and pluggable batch features."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of image files.
EXTENSIONS = "*.{jpg,jpeg,png,bmp,tif,tiff,JPG,JPEG,PNG,BMP,TIF,TIFF}"

# Weights of red, green and blue in grey, and the gradient from which a pixel counts as an edge.
GREY = np.array([0.299, 0.587, 0.114])
EDGE = 0.08

Featurizer = Callable[[pd.DataFrame], np.ndarray]
_REGISTRY: dict[str, tuple[Featurizer, int]] = {}


def register_backbone(name: str, featurize: Featurizer, dim: int) -> None:
    """Make a batch featuriser known: it takes decoded image rows and gives a (rows, dim) array."""
    _REGISTRY[name] = featurize, dim


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, image_id, size, sha256) of a folder's images; raises if there is none."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", EXTENSIONS).option("recursiveFileLookup", str(recursive).lower())
    found = read.load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("image_id"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if found.isEmpty():
        raise ValueError(f"no images in {folder}")
    return found


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of the images that Spark can decode; pixels are in BGR order."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    return rows.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def rgb(row: pd.Series) -> np.ndarray:
    """Pixels as (height, width, 3) numbers from 0 to 255, in RGB order."""
    raw = np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], row["channels"])
    return np.repeat(raw, 3, axis=2) if raw.shape[2] == 1 else raw[:, :, 2::-1]


@functools.cache
def _box(size: int, target: int) -> np.ndarray:
    """Weights (target, size) of a box filter: each new pixel averages the old ones whose centres its span holds."""
    scale = size / target
    reach = max(scale, 1.0) / 2
    middle = (np.arange(target)[:, None] + 0.5) * scale
    apart = (np.arange(size)[None, :] + 0.5 - middle) / (2 * reach)
    inside = ((apart > -0.5) & (apart <= 0.5)).astype(float)
    return inside / inside.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, side: int) -> np.ndarray:
    """A (side, side, 3) image by box filters along each axis, rounded to whole numbers after each."""
    wide = np.floor(np.einsum("tw,hwc->htc", _box(image.shape[1], side), image.astype(float)) + 0.5)
    return np.floor(np.einsum("th,hwc->twc", _box(image.shape[0], side), wide) + 0.5)


def grid_statistics(rows: pd.DataFrame, side: int = 64, grid: int = 8) -> np.ndarray:
    """734 numbers an image, over a batch at once.

    For each channel and cell of the grid mean, deviation and 90th percentile (576); for each channel mean,
    deviation, 90th and 10th percentile, skewness, kurtosis, mean and 90th percentile of the gradient, maximum (27);
    means and deviations of the grey cells (128); the grey 10th percentile, deviation and share of edges (3).
    """
    if not len(rows):
        return np.zeros((0, 734))
    images = np.stack([resized(rgb(row), side) for _, row in rows.iterrows()]) / 255
    n, cell = len(images), side // grid
    by_cell = lambda x: x.reshape(n, grid, cell, grid, cell, -1).transpose(0, 5, 1, 3, 2, 4).reshape(n, -1, grid, grid, cell * cell)
    cells = by_cell(images)
    local = np.stack([cells.mean(-1), cells.std(-1), np.percentile(cells, 90, axis=-1)], axis=-1)
    flat = images.transpose(0, 3, 1, 2).reshape(n, 3, -1)
    mean, std = flat.mean(-1), flat.std(-1)
    apart = flat - mean[..., None]
    slope = np.hypot(*np.gradient(images, axis=(1, 2))).transpose(0, 3, 1, 2).reshape(n, 3, -1)
    low, high = np.percentile(flat, [10, 90], axis=-1)
    moments = np.stack([mean, std, high, low, (apart**3).mean(-1) / (std**3 + 1e-12), (apart**4).mean(-1) / (std**4 + 1e-12), slope.mean(-1), np.percentile(slope, 90, axis=-1), flat.max(-1)], axis=-1)
    grey = images @ GREY
    grey_cells = by_cell(grey[..., None])
    edges = np.hypot(*np.gradient(grey, axis=(1, 2))) > EDGE
    extras = np.stack([np.percentile(grey.reshape(n, -1), 10, axis=-1), grey.reshape(n, -1).std(-1), edges.reshape(n, -1).mean(-1)], axis=-1)
    return np.hstack([part.reshape(n, -1) for part in (local, moments, grey_cells.mean(-1), grey_cells.std(-1), extras)])


register_backbone("grid_statistics", grid_statistics, 734)


def embeddings(images: DataFrame, backbone: str = "grid_statistics", key: str = "path", post_process: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, embedding) by a registered backbone, in Arrow batches; `post_process` changes a batch's (rows, dim) array as a whole."""
    featurize, dim = _REGISTRY[backbone]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if len(rows):
                values = featurize(rows)
                if values.shape != (len(rows), dim):
                    raise ValueError(f"{backbone} gave {values.shape}, not {(len(rows), dim)}")
                values = values if post_process is None else post_process(values)
                if len(values) != len(rows) or not np.isfinite(values).all():
                    raise ValueError(f"{backbone} gave values that are not finite, or not a row each")
                yield pd.DataFrame({key: rows[key], "embedding": list(values)})

    return images.mapInPandas(batches, f"{key} string, embedding array<double>")


def statistics(images: DataFrame) -> DataFrame:
    """(path, brightness, contrast, r, g, b, edge_density, width, height) of decoded images of two pixels a side or more."""
    fields = ("brightness", "contrast", "r", "g", "b", "edge_density")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for _, row in rows.iterrows():
                if min(row["height"], row["width"]) < 2:
                    continue
                image = rgb(row) / 255
                grey = image @ GREY
                out.append((row["path"], grey.mean(), grey.std(), *image.reshape(-1, 3).mean(0), float((np.hypot(*np.gradient(grey)) > EDGE).mean()), row["width"], row["height"]))
            yield pd.DataFrame(out, columns=["path", *fields, "width", "height"])

    return images.mapInPandas(batches, f"path string, {', '.join(f'{f} double' for f in fields)}, width int, height int")


def set_statistics(statistics: DataFrame, *keys: str) -> DataFrame:
    """(keys, image_count, mean and std of each statistic, widths, heights) of a set of images, or of each set by `keys`."""
    fields = ("brightness", "contrast", "r", "g", "b", "edge_density")
    moments = [f(c).alias(f"{c}_{n}") for c in fields for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return statistics.groupBy(*keys).agg(F.count("*").alias("image_count"), *moments, *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("width", "height")))


def stale(current: DataFrame, cache: DataFrame, backbone: str) -> DataFrame:
    """Rows of `current` (image_id, sha256, ...) that the cache (image_id, sha256, backbone, embedding) does not have as they are now."""
    return current.join(cache.filter(F.col("backbone") == backbone).select("image_id", "sha256"), ["image_id", "sha256"], "left_anti")


def refreshed(current: DataFrame, cache: DataFrame, fresh: DataFrame, backbone: str) -> DataFrame:
    """The cache after an incremental run: what still holds, and the fresh rows (image_id, sha256, embedding)."""
    still = cache.filter(F.col("backbone") == backbone).join(current.select("image_id", "sha256"), ["image_id", "sha256"], "left_semi")
    return still.unionByName(fresh.withColumn("backbone", F.lit(backbone)))
