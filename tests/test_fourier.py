import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, fourier


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, embedding array<double>").repartition(3)


def windows(spark, rows, size):
    return frame(spark, rows).withColumn("window_no", (F.col("id") / size).cast("long"))


@pytest.mark.parametrize("count", [256, 4096])
def test_close_to_all_pairs(spark, count):
    """Each window within five standard errors, which shrink with the root of the features."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (900, 6))
    live = np.vstack([rng.normal(m, 1, (50, 6)) for m in (0, 0.5, 1, 3)])
    fitted = fourier.fitted(frame(spark, base), "id", "embedding", count, sigma=2.0)
    assert fitted.n == 900 and len(fitted.mean) == count
    got = {r["window_no"]: r for r in fourier.window_mmd(fitted, windows(spark, live, 50), "embedding").collect()}
    for window in range(4):
        want = drift.mmd2(base, live[50 * window : 50 * window + 50], 2.0)
        assert abs(got[window]["mmd"] - want) <= 5 * got[window]["error"] and got[window]["n"] == 50
        assert got[window]["error"] <= 2 / count**0.5 and abs(got[window]["mmd"] - want) <= 3 / count**0.5
    assert got[3]["mmd"] > got[2]["mmd"] > got[1]["mmd"] > got[0]["mmd"]


def test_the_error_shrinks_with_the_features(spark):
    rng = np.random.default_rng(4)
    base, live = rng.normal(0, 1, (300, 5)), rng.normal(1, 1, (40, 5))
    want = drift.mmd2(base, live, 1.5)
    apart = {}
    for count in (64, 4096):
        values = [fourier.window_mmd(fourier.fit(frame(spark, base), "embedding", fourier.Features(1.5, 5, count, seed)), windows(spark, live, 40), "embedding").first()["mmd"] for seed in range(4)]
        apart[count] = np.sqrt(np.mean((np.array(values) - want) ** 2))
    assert apart[4096] < apart[64] / 2


def test_sums_merge_and_a_reference_is_kept(spark):
    rng = np.random.default_rng(5)
    base, live = rng.normal(0, 1, (120, 4)), rng.normal(1, 1, (30, 4))
    features = fourier.Features(1.0, 4, 128)
    whole = fourier.fit(frame(spark, base), "embedding", features)
    parts = [fourier.partial_sums(windows(spark, live[at : at + 10], 30), "window_no", "embedding", features) for at in (0, 10, 20)]
    row = fourier.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])).first()
    assert row["n"] == 30 and np.allclose(row["sums"], features.of(live).sum(0)) and np.allclose(whole.mean, features.of(base).mean(0))
    read = fourier.Fitted.read(whole.frame(spark))
    assert read.features == whole.features and np.allclose(read.mean, whole.mean)


def test_rows_that_do_not_fit(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (50, 3))
    fitted = fourier.fitted(frame(spark, base), "id", "embedding", 64)
    live = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, float("nan"), 0.0]), (2, [1.0]), (3, None)], "window_no long, embedding array<double>")
    got = {r["window_no"]: r["mmd"] for r in fourier.window_mmd(fitted, live, "embedding").collect()}
    assert got[0] > 0 and [got[i] for i in (1, 2, 3)] == [None, None, None]
    with pytest.raises(ValueError, match="finite"):
        fourier.fitted(frame(spark, np.vstack([base, [[0, np.inf, 0]]])), "id", "embedding", 64)
    with pytest.raises(ValueError, match="no rows"):
        fourier.fitted(frame(spark, base).limit(0), "id", "embedding", 64)


def test_permutations_without_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (400, 4))
    live = np.vstack([rng.normal(3, 1, (40, 4)), base[::10], rng.normal(0, 1, (40, 4))])
    fitted = fourier.fitted(frame(spark, base), "id", "embedding", 1024, sigma=1.5)
    got = {r["window_no"]: r["p_value"] for r in fourier.permutation_p(fitted, frame(spark, base), windows(spark, live, 40), "id", "embedding", 60).collect()}
    assert got[0] == 0
    for window in range(3):
        exact = drift.permutation_p(base, live[40 * window : 40 * window + 40], 1.5, 200, 1)[0]
        assert abs(got[window] - exact) < 0.2


def test_inner_sum_is_taken_once(spark):
    rng = np.random.default_rng(8)
    base, live = rng.normal(0, 1, (90, 4)), rng.normal(1, 1, (40, 4))
    reference, members = frame(spark, base), windows(spark, live, 20)
    inner = drift.inner_sum(reference, "embedding", 1.5)
    with_, without = (sorted(map(tuple, drift.window_mmd(reference, members, "id", "embedding", sigma=1.5, inner=x).select("window_no", F.round("mmd", 12)).collect())) for x in (inner, None))
    assert with_ == without and with_[0][1] == pytest.approx(drift.mmd2(base, live[:20], 1.5), abs=1e-9)


def test_windows_of_another_size_get_a_row(spark):
    rng = np.random.default_rng(9)
    base, live = rng.normal(0, 1, (90, 4)), rng.normal(4, 1, (50, 4))
    members = windows(spark, live, 20)
    tested = fourier.window_mmd(fourier.fitted(frame(spark, base), "id", "embedding", 256), members, "embedding")
    described = members.groupBy("window_no").agg(F.count("*").alias("size")).unionByName(spark.createDataFrame([(9, 0)], "window_no long, size long"))
    levels = described.select("window_no", F.array(F.lit("LOW")).alias("levels"))
    got = {r["window_no"]: (r["assessment"], r["gap"]) for r in drift.checked(described, tested, 0.1, levels, size=20).collect()}
    assert got == {0: ("UNEXPLAINED_SHIFT", None), 1: ("UNEXPLAINED_SHIFT", None), 2: ("INSUFFICIENT_EVIDENCE", "10 rows, calibrated for 20"), 9: ("INSUFFICIENT_EVIDENCE", "no test")}
    assert {r["gap"] for r in drift.checked(described, tested, None, levels).collect()} == {"no threshold", "no test"}
