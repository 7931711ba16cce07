"""Count windows and kernel two-sample drift tests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import drift_assessment, drift_policy
from plumbline.tables import durable

#: Rows of one side of a tile; a tile is one task's kernel matrix.
TILE_ROWS = 2_000


@dataclass(frozen=True)
class Windows:
    """Windows of `least` rows that start every min(step, least) rows; only whole ones count."""

    size: int
    step: int
    least: int | None = None

    @property
    def rows(self) -> int:
        return self.least or self.size

    @property
    def hop(self) -> int:
        return min(self.step, self.rows)


def indexed(frame: DataFrame, order: list[str], index: str = "row_index") -> DataFrame:
    """A 0-based global index in `order`, without one task seeing all rows: a range partitioning, then offsets.

    The parts are written first: run again with fewer columns they could be cut elsewhere, and the offsets would not be theirs.
    """
    return numbered(durable(in_parts(frame.repartitionByRange(*order), order)), index)


def in_parts(ranges: DataFrame, order: list[str]) -> DataFrame:
    """Sorted ranges with what numbered() needs of them."""
    return ranges.sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())


def numbered(parted: DataFrame, index: str = "row_index") -> DataFrame:
    """The global index of a table of in_parts() that was written. The offsets are one number a partition."""
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    named = parted.withColumn("__part", part).withColumn("__within", within)
    counts = sorted((r["__part"], r["count"]) for r in named.groupBy("__part").count().collect())
    offsets, at = {}, 0
    for number, n in counts:
        offsets[number] = at
        at += n
    if not offsets:
        return parted.withColumn(index, F.lit(0).cast("long")).drop("__id")
    lookup = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    return named.withColumn(index, (lookup[F.col("__part")] + F.col("__within")).cast("long")).drop("__id", "__part", "__within")


def assigned(frame: DataFrame, windows: Windows, index: str = "row_index") -> DataFrame:
    """A row for each complete window that a row belongs to, with the window's number in window_no."""
    total = frame.agg((F.max(index) + 1).alias("__n"))
    i, m, hop = F.col(index), windows.rows, windows.hop
    first = F.greatest(F.lit(0), F.ceil((i - m + 1) / hop)).cast("long")
    last = F.least(F.floor(i / hop).cast("long"), F.floor((F.col("__n") - m) / hop).cast("long"))
    bounded = frame.crossJoin(F.broadcast(total)).withColumn("__first", first).withColumn("__last", last).filter("__first <= __last")
    return bounded.withColumn("window_no", F.explode(F.sequence("__first", "__last"))).drop("__n", "__first", "__last")


def described(members: DataFrame, ts: str, source: str, key: str, *by: str) -> DataFrame:
    """First and last time, sorted distinct sources, row count and a digest of the ids of each window."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.col(key).alias("k")))), lambda x: x["k"].cast("string")), ",")
    return members.groupBy("window_no", *by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n"), F.sha2(ids, 256).alias("digest"))


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def bandwidth(rows: np.ndarray) -> float:
    """Square root of the median squared distance between different rows; 1 if that is 0."""
    if len(rows) < 2:
        return 1.0
    d2 = _d2(rows, rows)[np.triu_indices(len(rows), 1)]
    return float(np.sqrt(np.median(d2))) or 1.0


def _kernel(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-np.minimum(_d2(a, b) / (2 * sigma**2), 700))


def mmd2(reference: np.ndarray, live: np.ndarray, sigma: float) -> float:
    """The biased V-statistic of the kernel two-sample test, at least 0."""
    k = lambda a, b: float(_kernel(a, b, sigma).mean())
    return max(0.0, k(reference, reference) + k(live, live) - 2 * k(reference, live))


def permutation_p(reference: np.ndarray, live: np.ndarray, sigma: float, permutations: int, seed: int) -> tuple[float, float, np.ndarray]:
    """(p, p with the +1 correction, null values), from one kernel matrix of the pooled rows."""
    pooled = np.vstack([reference, live])
    gram = np.exp(-np.minimum(_d2(pooled, pooled) / (2 * sigma**2), 700))
    n, rng = len(reference), np.random.default_rng(seed)

    def value(order: np.ndarray) -> float:
        a, b = order[:n], order[n:]
        return max(0.0, gram[np.ix_(a, a)].mean() + gram[np.ix_(b, b)].mean() - 2 * gram[np.ix_(a, b)].mean())

    seen = value(np.arange(len(pooled)))
    null = np.array([value(rng.permutation(len(pooled))) for _ in range(permutations)])
    hits = int((null >= seen).sum())
    return hits / permutations, (hits + 1) / (permutations + 1), null


def _sample(frame: DataFrame, key: str, vector: str, seed: int, most: int) -> np.ndarray:
    """A bounded sample for the bandwidth: the rows of least seeded hash. All rows while there are no more than `most`."""
    rows = frame.select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k")).orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(most)
    return np.array([r["v"] for r in rows.select("v").collect()])


def _kernel_sums(rows: DataFrame, reference: DataFrame, sigma: float) -> DataFrame:
    """(window_no, live, id, total, pairs): of each of `rows` the kernel's sum with all reference rows, in parts, a tile each.

    Rows that aren't finite or of the reference's dimensions have no parts.
    """
    n_rows, n_reference = (max(1, -(-frame.count() // TILE_ROWS)) for frame in (rows, reference))

    def spread(frame: DataFrame, own: str, n_own: int, other: str, n_other: int, is_row: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("live", "id"), F.lit(n_own)).cast("int").alias(own)
        return frame.select("window_no", "live", "id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), F.lit(is_row).alias("is_row"))

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["is_row"]], part[~part["is_row"]]
        if len(right):
            base = np.stack(right["v"])
            if not np.isfinite(base).all():
                raise ValueError("reference vectors are not finite")
            left = left[[len(v) == base.shape[1] and bool(np.isfinite(v).all()) for v in left["v"]]]
        totals = _kernel(np.stack(left["v"]), base, sigma).sum(1) if len(left) and len(right) else 0.0
        return left[["window_no", "live", "id"]].assign(total=totals, pairs=len(right))

    both = spread(rows, "i", n_rows, "j", n_reference, True).unionByName(spread(reference, "j", n_reference, "i", n_rows, False))
    return both.groupBy("i", "j").applyInPandas(tile, "window_no long, live boolean, id long, total double, pairs long")


def _permuted(base: DataFrame, live: DataFrame, sums: DataFrame, n: int, sigma: float, permutations: int, seed: int) -> DataFrame:
    """(window_no, p_value) over the pooled rows of all the reference and a window, a group for each permutation.

    A permutation deals as many pooled rows as the window has to the live side. Its statistic follows from the
    kernel's sums of those rows with all others, so no group holds the reference.
    """
    by_row = durable(sums.groupBy("window_no", "live", "id").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs")))
    inner = by_row.filter("not live").agg(F.sum("total")).first()[0]
    near = live.join(by_row.filter("live").filter(F.col("pairs") == n).select("id", "total"), "id")
    pool = base.join(by_row.filter("not live").select("id", "total"), "id").select(F.col("id").alias("at"), F.col("v").alias("far"), F.col("total").alias("rest"))

    def deal(batches):
        for part in batches:
            for window, size in zip(part["window_no"], part["n"]):
                for turn in range(permutations):
                    at = np.random.default_rng([seed, abs(int(window)), turn]).choice(n + size, size, replace=False)
                    yield pd.DataFrame({"window_no": window, "turn": turn, "at": np.sort(at)})

    dealt = live.groupBy("window_no").agg(F.count("*").alias("n")).mapInPandas(deal, "window_no long, turn int, at long")
    picks = dealt.join(pool, "at", "left")
    spread = near.select("window_no", "id", "v", "total", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("turn"))

    def test(picked: pd.DataFrame, window: pd.DataFrame) -> pd.DataFrame:
        if not len(window) or len(window) != len(picked):
            return pd.DataFrame({"window_no": [], "hit": []})
        window, size = window.sort_values("id"), len(window)
        rows, across = np.stack(window["v"]), window["total"].to_numpy()
        own = _kernel(rows, rows, sigma)
        far = picked[picked["at"] < n]
        moved = picked["at"][picked["at"] >= n].to_numpy() - n
        reference = np.stack(far["far"]) if len(far) else rows[:0]
        drawn = np.vstack([reference, rows[moved]])
        with_all = far["rest"].sum() + _kernel(reference, rows, sigma).sum() + across[moved].sum() + own[moved].sum()
        whole, inside = inner + 2 * across.sum() + own.sum(), _kernel(drawn, drawn, sigma).sum()
        seen = max(0.0, inner / n**2 + own.sum() / size**2 - 2 * across.sum() / (n * size))
        value = max(0.0, (whole - 2 * with_all + inside) / n**2 + inside / size**2 - 2 * (with_all - inside) / (n * size))
        return pd.DataFrame({"window_no": [window["window_no"].iat[0]], "hit": [float(value >= seen)]})

    tested = picks.groupBy("window_no", "turn").cogroup(spread.groupBy("window_no", "turn")).applyInPandas(test, "window_no long, hit double")
    return tested.groupBy("window_no").agg(F.avg("hit").alias("p_value"))


def inner_sum(reference: DataFrame, vector: str, sigma: float) -> float:
    """The kernel's sum over all pairs of reference rows, to be kept with a calibration and handed to window_mmd."""
    rows = durable(reference.select(F.lit(0).cast("long").alias("window_no"), F.lit(False).alias("live"), F.col(vector).cast("array<double>").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    return _kernel_sums(rows, rows, sigma).agg(F.sum("total")).first()[0] or 0.0


def window_mmd(reference: DataFrame, members: DataFrame, key: str, vector: str, seed: int = 42, most: int = 512, permutations: int = 0, sigma: float | None = None, inner: float | None = None) -> DataFrame:
    """(window_no, n, mmd, sigma, p_value) of each window against all reference rows; `most` bounds the rows that set the bandwidth.

    The kernel's sums are those of all pairs, in tiles of at most about 2 * TILE_ROWS rows; a window by itself is one group and bounded by its size.
    With `inner`, an inner_sum of the same reference and bandwidth, the pairs within the reference are not visited again
    (permutations need each row's own sum and take them anew). fourier.window_mmd is the way for references where all pairs are too many.
    """
    width = sigma or bandwidth(_sample(reference, key, vector, seed, most))
    v = F.col(vector).cast("array<double>").alias("v")
    base = indexed(reference.select(F.lit(0).cast("long").alias("window_no"), F.lit(False).alias("live"), v, F.col(key).alias("k")), ["k"], "id").drop("k")
    live = durable(members.select("window_no", F.lit(True).alias("live"), v).withColumn("id", F.monotonically_increasing_id()))
    n = base.count()

    def within(part: pd.DataFrame) -> pd.DataFrame:
        good = part["v"].map(len).nunique() == 1 and np.isfinite(np.stack(part["v"])).all()
        rows = np.stack(part["v"]) if good else None
        total = sum(_kernel(rows[at : at + TILE_ROWS], rows, width).sum() for at in range(0, len(rows), TILE_ROWS)) if good else None
        return pd.DataFrame([(part["window_no"].iat[0], len(part), total)], columns=["window_no", "n", "own"])

    sums = _kernel_sums(live if inner is not None and not permutations else base.unionByName(live), base, width)
    if permutations:
        sums = durable(sums)
    by_window = durable(sums.groupBy("live", "window_no").agg(F.sum("total").alias("across"), F.sum("pairs").alias("pairs")))
    if inner is None or permutations:
        inner = by_window.filter("not live").agg(F.sum("across")).first()[0]
    own = live.groupBy("window_no").applyInPandas(within, "window_no long, n long, own double")
    joined = own.join(by_window.filter("live").drop("live"), "window_no", "left")
    value = F.greatest(F.lit(0.0), F.lit(inner) / n**2 + F.col("own") / F.col("n") ** 2 - 2 * F.col("across") / (n * F.col("n"))) if n else F.lit(None).cast("double")
    tested = joined.withColumn("mmd", F.when(F.col("pairs") == F.col("n") * n, value))
    if permutations and n:
        tested = tested.join(_permuted(base, live, sums, n, width, permutations, seed), "window_no", "left").withColumn("p_value", F.when(F.col("mmd").isNotNull(), F.col("p_value")))
    else:
        tested = tested.withColumn("p_value", F.lit(None).cast("double"))
    return tested.select("window_no", "n", "mmd", F.lit(width).alias("sigma"), "p_value")


def _digest(frame: DataFrame, key: str, vector: str) -> DataFrame:
    return frame.agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.xxhash64(key, vector).cast("decimal(38,0)"))), 256).alias("digest"))


def _drawn(rows: DataFrame, n: int, draws: int, size: int, seed: int) -> DataFrame:
    """(draw, place, v): for each draw `size` different rows of all `n`, by their numbers; the numbers go to all tasks."""

    def pick(batches):
        for part in batches:
            for draw in part["draw"]:
                at = np.random.default_rng([seed, int(draw)]).choice(n, size, replace=False)
                yield pd.DataFrame({"draw": draw, "place": range(size), "row_index": at})

    numbers = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").mapInPandas(pick, "draw long, place int, row_index long")
    return rows.join(F.broadcast(numbers), "row_index").select("draw", "place", "v")


def _numbered(frame: DataFrame, key: str, vector: str) -> DataFrame:
    return indexed(frame.select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k")), ["k"])


def calibrated(reference: DataFrame, key: str, vector: str, draws: int = 200, split: int = 0, quantile: float = 0.99, seed: int = 42, most: int = 512) -> DataFrame:
    """(calibration_id, threshold, sigma, draws, n, digest): the quantile of the statistic between disjoint random halves, a group a draw.

    The halves are drawn from all rows; `most` bounds only the rows that set the bandwidth.
    """
    rows = _numbered(reference, key, vector)
    total = rows.count()
    if total < 4:
        raise ValueError(f"{total} reference rows, at least 4 needed")
    size, width = split or min(60, total // 2), bandwidth(_sample(reference, key, vector, seed, most))
    if 2 * size > total:
        raise ValueError(f"{total} reference rows, {2 * size} needed for two halves")

    def null(part: pd.DataFrame) -> pd.DataFrame:
        drawn = np.stack(part.sort_values("place")["v"])
        return pd.DataFrame({"value": [mmd2(drawn[:size], drawn[size:], width)]})

    values = _drawn(rows, total, draws, 2 * size, seed).groupBy("draw").applyInPandas(null, "value double")
    named = values.agg(F.percentile("value", quantile).alias("threshold")).crossJoin(_digest(reference, key, vector)).withColumns({"sigma": F.lit(width), "draws": F.lit(draws), "n": F.lit(size)})
    return named.withColumn("calibration_id", F.concat(F.lit("cal-"), F.substring(F.sha2(F.concat_ws("|", "digest", F.lit(seed), F.lit(quantile), "draws", "n"), 256), 1, 12)))


def require_same_reference(calibration: DataFrame, reference: DataFrame, key: str, vector: str) -> None:
    """Refuse a calibration of another reference."""
    own = _digest(reference, key, vector).first()["digest"]
    if calibration.first()["digest"] != own:
        raise ValueError("the calibration belongs to another reference")


def alerts(statistic: Column, threshold: Column) -> Column:
    return statistic > threshold


def checked(described: DataFrame, tested: DataFrame, threshold: float | None, levels: DataFrame | None = None, declared: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """One row a window: its description, test, assessment and policy. The same in batches and in foreachBatch.

    `described` has window_no and what describes it, `tested` is window_mmd's result, `levels` and `declared` have
    (window_no, levels), arrays of levels of measured statistics and of declared metadata. Windows without a
    calibrated threshold, a test or levels have INSUFFICIENT_EVIDENCE, and so has a window of another size than
    the calibration's, as the statistic's bias depends on it. `gap` says what was missing.
    """
    none = F.array().cast("array<string>")
    given = lambda name: F.col(name) if name in tested.columns else F.lit(None).cast("double").alias(name)
    fits = F.lit(True) if size is None else F.col("n") == size
    wrong = F.when(~fits, F.format_string(f"%d rows, calibrated for {size}", F.col("n")))
    unlike = tested.select("window_no", F.when(fits, F.col("mmd")).alias("mmd"), "sigma", given("p_value"), F.coalesce(wrong, F.when(F.col("mmd").isNull(), "no statistic")).alias("gap"))
    joined = described.join(unlike.withColumn("__tested", F.lit(True)), "window_no", "left").withColumn("gap", F.coalesce("gap", F.when(F.col("__tested").isNull(), "no test"), F.lit("no threshold") if threshold is None else F.lit(None))).drop("__tested")
    for name, frame in (("measured", levels), ("declared", declared)):
        joined = joined.withColumn(name, none) if frame is None else joined.join(frame.select("window_no", F.col("levels").alias(name)), "window_no", "left").withColumn(name, F.coalesce(name, none))
    limit = F.lit(threshold).cast("double")
    judged = joined.withColumns({"threshold": limit, "assessment": drift_assessment(alerts(F.col("mmd"), limit), F.col("measured"), F.col("declared"))})
    policy = drift_policy(F.col("assessment"), F.col("mmd"), F.col("threshold"), F.col("p_value"))
    return judged.withColumn("__policy", policy).select("*", "__policy.*").drop("__policy")


def pooled_bandwidth(reference: DataFrame, live: DataFrame, key: str, vector: str, seed: int = 42, most: int = 512) -> float:
    """The bandwidth of reference and live rows together, from a sample of at most `most` of them."""
    both = reference.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v")).unionByName(live.select(F.concat(F.lit("live|"), F.col(key).cast("string")).alias("k"), F.col(vector).alias("v")))
    return bandwidth(_sample(both, "k", "v", seed, most))


def size_matched_null(reference: DataFrame, pool: DataFrame, key: str, vector: str, size: int, draws: int = 500, quantile: float = 0.99, seed: int = 42, most: int = 512) -> DataFrame:
    """(calibration_id, threshold, sigma, draws, n, m, digest, null): the quantile of the statistic of `draws` windows of `size` rows of a pool against all reference rows.

    Each draw takes different rows of the whole pool, and the kernel's sums with the reference are taken in
    tiles as for live windows.
    """
    rows = _numbered(pool, key, vector)
    total = rows.count()
    if total < size:
        raise ValueError(f"{total} pool rows, {size} needed for a window")
    drawn = _drawn(rows, total, draws, size, seed).select(F.col("draw").alias("window_no"), F.concat_ws("-", "draw", "place").alias("k"), "v")
    base = reference.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"))
    tested = window_mmd(base, drawn, "k", "v", seed, most, sigma=bandwidth(_sample(reference, key, vector, seed, most)))
    q = F.percentile("mmd", F.array(*map(F.lit, (0.5, 0.95, 0.99))))
    null = F.struct(F.avg("mmd").alias("mean"), F.stddev_pop("mmd").alias("std"), F.min("mmd").alias("min"), q[0].alias("median"), q[1].alias("p95"), q[2].alias("p99"), F.max("mmd").alias("max"))
    summed = tested.agg(F.percentile("mmd", quantile).alias("threshold"), F.first("sigma").alias("sigma"), null.alias("null"))
    named = summed.crossJoin(_digest(reference, key, vector)).withColumns({"draws": F.lit(draws), "n": F.lit(reference.count()), "m": F.lit(size)})
    return named.withColumn("calibration_id", F.concat(F.lit("threshold-"), F.substring(F.sha2(F.concat_ws("|", "digest", F.lit("size_matched_null"), F.lit(seed), F.lit(quantile), "draws", "n", "m", "sigma"), 256), 1, 12)))
