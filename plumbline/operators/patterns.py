"""Recurring local patterns: segments that many samples of one class share and others lack."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import normalised_correlation
from plumbline.sources.images import GREY

LEAST_STD, LEAST_RESIDUAL_STD = 0.02, 0.008
REGIONS = ("top_left", "top_right", "bottom_left", "bottom_right", "centre")


def residual(patch: np.ndarray) -> np.ndarray:
    """A square patch less its 3 x 3 local means."""
    padded = np.pad(patch, 1, mode="edge")
    n, m = patch.shape
    return patch - sum(padded[i : i + n, j : j + m] for i in range(3) for j in range(3)) / 9


def crops(image: np.ndarray, size: int = 32) -> dict[str, np.ndarray]:
    """Four corners and the centre of a grey image, each of max(16, 15 %) of the shorter side, resampled bilinearly."""
    h, w = image.shape
    span = min(max(16, int(0.15 * min(h, w))), h, w)
    starts = {"top_left": (0, 0), "top_right": (0, w - span), "bottom_left": (h - span, 0), "bottom_right": (h - span, w - span), "centre": ((h - span) // 2, (w - span) // 2)}
    at = (np.arange(size) + 0.5) * span / size - 0.5
    low = np.clip(np.floor(at).astype(int), 0, span - 1)
    high, part = np.minimum(low + 1, span - 1), np.clip(at - low, 0, 1)

    def resample(p: np.ndarray) -> np.ndarray:
        rows = p[low] * (1 - part)[:, None] + p[high] * part[:, None]
        return rows[:, low] * (1 - part) + rows[:, high] * part

    return {name: resample(image[y : y + span, x : x + span]) for name, (y, x) in starts.items()}


def image_segments(images: DataFrame, key: str, class_: str, size: int = 32) -> DataFrame:
    """(id, class, region, vec, rest): five regions of each decoded image (sources.images.decoded with key and class), by crops and residual.

    Regions are numbered in the order of REGIONS; grey values are between 0 and 1, mean-free values are the residual's own.
    """

    def cut(batches):
        for part in batches:
            ids, classes, regions, vecs, rests = [], [], [], [], []
            for sample, label, height, width, channels, data in zip(*(part[c] for c in ("id", "class", "height", "width", "channels", "data"))):
                raw = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
                grey = raw[:, :, 0] / 255 if channels == 1 else raw[:, :, 2::-1] @ GREY / 255
                for number, patch in enumerate(crops(grey, size).values()):
                    ids.append(sample)
                    classes.append(label)
                    regions.append(number)
                    vecs.append(patch.ravel())
                    rests.append(residual(patch).ravel())
            yield pd.DataFrame({"id": ids, "class": classes, "region": regions, "vec": vecs, "rest": rests})

    rows = images.select(F.col(key).alias("id"), F.col(class_).cast("string").alias("class"), "height", "width", "channels", "data")
    return rows.mapInPandas(cut, f"id {rows.schema['id'].dataType.simpleString()}, class string, region int, vec array<double>, rest array<double>")


def segments(samples: DataFrame, key: str, class_: str, vector: str, regions: int) -> DataFrame:
    """(id, class, region, vec, rest): a vector cut into equal regions, each with its residual from 3-wide local means."""
    v = F.col(vector).cast("array<double>")
    width = F.floor(F.size(v) / regions).cast("int")
    cut = samples.select(F.col(key).alias("id"), F.col(class_).cast("string").alias("class"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: F.struct(r.alias("region"), F.slice(v, r * width + 1, width).alias("vec")))).alias("s"))
    flat = cut.select("id", "class", F.col("s.region").alias("region"), F.col("s.vec").alias("vec"))
    local = lambda x, i: x - (F.get(F.col("vec"), F.greatest(i - 1, F.lit(0))) + x + F.get(F.col("vec"), F.least(i + 1, F.size("vec") - 1))) / 3
    return flat.withColumn("rest", F.transform("vec", local))


def _neighbours(parts: DataFrame, threshold: float, tile: int = 2_000) -> DataFrame:
    """(class, region, a, b, score) of similar segments of one class and region, in tiles; a < b."""
    sizes = parts.groupBy("class", "region").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    own = parts.join(F.broadcast(sizes), ["class", "region"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class", "region", "id", "vec", "rest", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = parts.schema["id"].dataType.simpleString()

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack(rows)
        x = x - x.mean(axis=1, keepdims=True)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size < 1e-9, 0, x / np.maximum(size, 1e-9))

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        score = np.maximum(unit(part["vec"]) @ unit(part["vec"]).T, unit(part["rest"]) @ unit(part["rest"]).T)
        ids, block = part["id"].to_numpy(), part["block"].to_numpy()
        good = (score >= threshold) & (ids[:, None] < ids[None, :])
        if part["i"].iat[0] != part["j"].iat[0]:
            good &= block[:, None] != block[None, :]
        a, b = np.nonzero(good)
        return pd.DataFrame({"class": part["class"].iat[0], "region": part["region"].iat[0], "a": ids[a], "b": ids[b], "score": score[a, b]})

    return spread.groupBy("class", "region", "i", "j").applyInPandas(pairs, f"class string, region int, a {kind}, b {kind}, score double")


def find(parts: DataFrame, threshold: float = 0.82, least_cluster: int = 3, least_anomaly: float = 0.05, others: int = 20) -> DataFrame:
    """(class, region, cluster, anomaly, members, confidence) of each class's best recurring pattern.

    Within a class and region, the segment with most neighbours leads a cluster, whose median is the
    template. A flat template is none. Specificity falls by a fifth for each match among up to `others`
    samples of each other class, which are a bounded comparison set by design. anomaly = share of the
    class times specificity; `parts` is (id, class, region, vec, rest).
    """
    near = _neighbours(parts, threshold)
    both = near.select("class", "region", F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(near.select("class", "region", F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    degree = both.groupBy("class", "region", "id").agg(F.count("*").alias("d"))
    lead = degree.groupBy("class", "region").agg(F.min(F.struct((-F.col("d")).alias("d"), "id")).alias("l")).select("class", "region", F.col("l.id").alias("lead"), (1 - F.col("l.d")).alias("cluster")).filter(F.col("cluster") >= least_cluster)
    members = both.join(lead, ["class", "region"]).filter("id = lead").select("class", "region", F.col("other").alias("id"), "score").unionByName(lead.select("class", "region", F.col("lead").alias("id"), F.lit(1.0).alias("score")))
    within = parts.join(members, ["class", "region", "id"])
    middle = lambda c: within.select("class", "region", F.posexplode(c).alias("pos", "x")).groupBy("class", "region", "pos").agg(F.median("x").alias("m")).groupBy("class", "region").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias(f"t_{c}"), F.stddev_pop("m").alias(f"s_{c}"))
    template = middle("vec").join(middle("rest"), ["class", "region"]).filter((F.col("s_vec") >= LEAST_STD) & (F.col("s_rest") >= LEAST_RESIDUAL_STD))
    some = parts.withColumn("r", F.row_number().over(Window.partitionBy("class", "region").orderBy(F.xxhash64("id"), "id"))).filter(F.col("r") <= others).select(F.col("class").alias("of"), "region", "vec", "rest")
    alike = F.greatest(normalised_correlation(F.col("vec"), F.col("t_vec")), normalised_correlation(F.col("rest"), F.col("t_rest"))) >= threshold
    matches = some.join(F.broadcast(template), "region").filter(F.col("of") != F.col("class")).groupBy("class", "region").agg(F.count_if(alike).alias("matches"))
    sizes = parts.groupBy("class", "region").agg(F.count("*").alias("n"))
    of_members = members.groupBy("class", "region").agg(F.array_sort(F.collect_list("id")).alias("members"), F.avg("score").alias("mean_score"))
    scored = template.select("class", "region").join(lead, ["class", "region"]).join(sizes, ["class", "region"]).join(of_members, ["class", "region"]).join(matches, ["class", "region"], "left")
    specific = 1 - F.least(F.lit(1.0), F.coalesce(F.col("matches"), F.lit(0)) / 5)
    scored = scored.withColumn("anomaly", F.col("cluster") / F.col("n") * specific).filter(F.col("anomaly") >= least_anomaly)
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("anomaly"), "region"))).filter("r = 1")
    return best.select("class", "region", "cluster", F.round("anomaly", 4).alias("anomaly"), "members", F.round(F.least(F.lit(0.95), 0.65 + 0.30 * F.col("mean_score")), 4).alias("confidence"))
