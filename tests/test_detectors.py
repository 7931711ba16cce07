"""Detectors on small planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, duplicates, label_noise, outliers, patterns, profile, validate
from plumbline.operators.graph import components

VECTORS = "id long, label string, embedding array<double>"


def frame(spark, rows, labels=None):
    return spark.createDataFrame([(i, labels[i] if labels else "a", [float(x) for x in row]) for i, row in enumerate(rows)], VECTORS)


def blobs(n, d, gap, seed):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 1, (n, d)), rng.normal(gap, 1, (n, d))]), ["day"] * n + ["night"] * n


def test_near_pairs_by_tiles_and_by_projections(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE_ROWS", 30)
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1, (100, 16))
    rows = np.vstack([rows, rows[:10] + rng.normal(0, 1e-3, (10, 16)), np.zeros((1, 16))])
    pairs = {tuple(r)[:2] for r in duplicates.near_pairs(frame(spark, rows), "id", "embedding", 0.99).collect()}
    assert pairs == {(i, 100 + i) for i in range(10)}
    assert {tuple(r)[:2] for r in duplicates.near_pairs_lsh(frame(spark, rows), "id", "embedding", 0.99).collect()} == pairs
    assert duplicates.endpoints(duplicates.near_pairs(frame(spark, rows), "id", "embedding", 0.99)).count() == 20


def test_identical_orthogonal_and_monotone(spark):
    rows = [[1, 0], [2, 0], [0, 1], [1, 0.1]]
    at = lambda t: {(r["id_a"], r["id_b"]): r["similarity"] for r in duplicates.near_pairs(frame(spark, rows), "id", "embedding", t).collect()}
    assert at(0.9)[0, 1] == 1.0 and (0, 2) not in at(0.9) and set(at(0.999)) <= set(at(0.9))


def test_nearest_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE_ROWS", 20)
    rows = np.random.default_rng(2).normal(0, 1, (70, 5))
    d = np.linalg.norm(rows[:, None] - rows[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = duplicates.nearest(frame(spark, rows), "id", "embedding", 3).collect()
    assert {(r["id"], r["rank"]): r["neighbour"] for r in got} == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(np.argsort(d[i])[:3])}


def test_ties_among_neighbours_go_to_the_smaller_id(spark, monkeypatch):
    for rows_a_tile in (2_000, 7):
        monkeypatch.setattr(duplicates, "TILE_ROWS", rows_a_tile)
        got = duplicates.nearest(frame(spark, [[1.0, 2.0]] * 40), "id", "embedding", 3).collect()
        assert {(r["id"], r["rank"]): r["neighbour"] for r in got} == {(i, k + 1): [j for j in range(4) if j != i][k] for i in range(40) for k in range(3)}


def test_places_in_a_hot_group_come_from_many_tasks(spark):
    """A third of the rows and more have one label, some have none; ties go by id."""
    rows = [(i, "hot" if i % 3 else None if i % 5 == 0 else f"l{i % 4}", float(i * 7919 % 50)) for i in range(3_000)]
    made = spark.createDataFrame(rows, "id long, label string, d double").repartition(13)
    near = {}
    for i, label, d in sorted(rows, key=lambda r: (r[2], r[0])):
        near.setdefault(label, []).append(i)
    kept = {i for ids in near.values() for i in ids[: max(8, -int(-round(len(ids) * 0.9, 9) // 1))]}
    assert {r["id"] for r in profile.trimmed(made, "d", "label", "id").collect()} == kept
    dealt = profile.folds(made, "label", "id", 4, 9)
    assert dealt.columns == ["id", "label", "d", "fold"] and dealt.count() == 3_000
    sizes = dealt.groupBy("label", "fold").count().groupBy("label").agg(F.min("count").alias("low"), F.max("count").alias("high"), F.count("*").alias("folds"))
    assert all(r["high"] - r["low"] <= 1 and r["folds"] == 4 for r in sizes.collect())


def test_lsh_finds_pairs_near_the_threshold(spark):
    """Recall over 400 planted pairs with cosines from 0.99 on."""
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base + rng.normal(0, 0.017, base.shape)
    rows = frame(spark, np.vstack([base, near]))
    exact = {tuple(r)[:2] for r in duplicates.near_pairs(rows, "id", "embedding", 0.99).collect()}
    found = {tuple(r)[:2] for r in duplicates.near_pairs_lsh(rows, "id", "embedding", 0.99).collect()}
    assert len(exact) > 100 and found <= exact and len(found) >= 0.95 * len(exact)


def test_only_the_far_row_is_an_outlier(spark):
    rows, labels = blobs(40, 10, 6, 3)
    reference = frame(spark, rows, labels)
    fitted = outliers.fit(reference, "id", "embedding", "label")
    threshold = outliers.calibrate(reference, "id", "embedding", "label")
    fresh, fresh_labels = blobs(5, 10, 6, 4)
    scored = outliers.flag(outliers.score(frame(spark, np.vstack([fresh, np.full((1, 10), 25.0)]), [*fresh_labels, "day"]), "id", "embedding", fitted), threshold).collect()
    far = [r for r in scored if r["id"] == 10][0]
    assert [r["id"] for r in scored if r["is_outlier"]] == [10]
    assert far["distance"] > 5 * max(r["distance"] for r in scored if r["id"] != 10)


def test_trimming_resists_contamination(spark):
    rows, labels = blobs(40, 10, 6, 3)
    clean = outliers.fit(frame(spark, rows, labels), "id", "embedding", "label")
    dirty = outliers.fit(frame(spark, np.vstack([rows, np.full((4, 10), 30.0)]), labels + ["night"] * 4), "id", "embedding", "label")
    assert np.linalg.norm(clean.classes["night"][0] - dirty.classes["night"][0]) < 1


def test_ledoit_wolf_by_hand():
    x = np.random.default_rng(5).normal(0, 1, (30, 4)) @ np.diag([1, 2, 3, 4])
    x -= x.mean(0)
    s = x.T @ x / 30
    mu = np.trace(s) / 4
    delta = ((s - mu * np.eye(4)) ** 2).sum() / 4
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / 30**2 / 4, delta)
    expected = (1 - beta / delta) * s + beta / delta * mu * np.eye(4)
    assert np.allclose(outliers.shrunk(30, x[0], x.T @ x, float(((x**2).sum(1) ** 2).sum())), expected)


@pytest.mark.parametrize("classifier", ["knn", "logreg"])
def test_planted_flips_are_found(spark, classifier):
    rng = np.random.default_rng(6)
    a, b = np.zeros(6), np.zeros(6)
    a[0] = b[1] = 12
    rows, labels = np.vstack([rng.normal(0, 1, (30, 6)) + a, rng.normal(0, 1, (30, 6)) + b]), ["x"] * 30 + ["y"] * 30
    for at in (4, 35, 51):
        labels[at] = "y" if labels[at] == "x" else "x"
    got = label_noise.find(frame(spark, rows, labels), "id", "embedding", "label", label_noise.Config(classifier=classifier)).collect()
    assert {4, 35, 51} <= {r["id"] for r in got} and len(got) <= 4


def test_stamped_pattern_is_found(spark):
    rng = np.random.default_rng(7)
    rows, labels = rng.normal(0, 1, (60, 256)), ["a"] * 30 + ["b"] * 30
    stamp = rng.normal(0, 3, 64)
    rows[:8, 64:128] = stamp + rng.normal(0, 0.1, (8, 64))
    got = patterns.find(patterns.segments(frame(spark, rows, labels), "id", "label", "embedding", 4)).collect()
    assert [(r["class"], r["region"], r["members"]) for r in got] == [("a", 1, list(range(8)))]


def test_a_planted_corner_patch_in_images_is_found(spark, tmp_path):
    from test_sources import png

    from plumbline.sources import images

    rng = np.random.default_rng(11)
    stamp = np.kron(np.indices((4, 4)).sum(0) % 2, np.ones((4, 4)))[:, :, None] * 255

    def folder(name, stamped):
        (tmp_path / name).mkdir()
        for i in range(16):
            image = rng.integers(0, 255, (100, 110, 3))
            if stamped and i < 6:
                image[-16:, :16] = stamp
            png(tmp_path / name / f"{'ab'[i % 2] if not stamped else 'a' if i < 10 else 'b'}_{i:02d}.png", image)
        decoded = images.decoded(spark, str(tmp_path / name)).withColumn("name", F.element_at(F.split("path", "/"), -1))
        return patterns.image_segments(decoded.withColumn("label", F.substring("name", 1, 1)), "name", "label")

    parts = folder("stamped", True)
    assert parts.count() == 80 and len(parts.first()["vec"]) == len(parts.first()["rest"]) == 32 * 32
    got = patterns.find(parts).collect()
    assert [(r["class"], patterns.REGIONS[r["region"]], r["members"]) for r in got] == [("a", "bottom_left", [f"a_{i:02d}.png" for i in range(6)])]
    assert patterns.find(folder("clean", False)).collect() == []


@pytest.mark.parametrize("way", ["prune_by_class", "prune_by_noise_rate", "both"])
def test_pruning_of_one_hot_label(spark, way):
    """Rows to prune are chosen by places in a global order, as a ranking of each label would choose them."""
    rng = np.random.default_rng(2)
    n = 600
    labels = [("hot" if i < 500 else "cold") for i in range(n)]
    p_hot = rng.beta(4, 2, n).round(3)
    probabilities = spark.createDataFrame([(i, c, float(p if c == "hot" else 1 - p)) for i, p in enumerate(p_hot) for c in ("hot", "cold")], "id long, class string, p double")
    frame = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    p = {(i, c): (p_hot[i] if c == "hot" else 1 - p_hot[i]) for i in range(n) for c in ("hot", "cold")}
    mean = {c: np.mean([p[i, c] for i in range(n) if labels[i] == c]) for c in ("hot", "cold")}
    joint = {}
    for i in range(n):
        likely = [c for c in ("hot", "cold") if p[i, c] >= mean[c]]
        if likely:
            best = max(likely, key=lambda c: (p[i, c], c))
            joint[labels[i], best] = joint.get((labels[i], best), 0) + 1
    by_class, by_rate = set(), set()
    for c, o in (("hot", "cold"), ("cold", "hot")):
        total = sum(v for (a, _), v in joint.items() if a == c)
        size = labels.count(c)
        count = int(np.floor(joint.get((c, o), 0) / total * size + 0.5)) if total else 0
        own = [i for i in range(n) if labels[i] == c]
        by_class |= set(sorted(own, key=lambda i: (p[i, c], i))[:count])
        by_rate |= set(sorted(own, key=lambda i: (p[i, c] - p[i, o], i))[:count])
    got = {r["id"] for r in label_noise.confident_mask(probabilities, frame, way).collect()}
    assert got == {"prune_by_class": by_class, "prune_by_noise_rate": by_rate, "both": by_class & by_rate}[way] and got


def test_windows_mmd_and_calibration(spark):
    rng = np.random.default_rng(8)
    reference, same, far = (frame(spark, rng.normal(m, 1, (40, 8))) for m in (0, 0, 3))
    calibration = drift.calibrated(reference, "id", "embedding", draws=60)
    row = calibration.first()
    value = lambda f: drift.window_mmd(reference, f.withColumn("window_no", F.lit(0).cast("long")), "id", "embedding", permutations=50, sigma=row["sigma"]).first()
    assert value(far)["mmd"] > row["threshold"] > 0 and value(far)["p_value"] == 0 and value(same)["mmd"] < value(far)["mmd"]
    drift.require_same_reference(calibration, reference, "id", "embedding")
    with pytest.raises(ValueError):
        drift.require_same_reference(calibration, far, "id", "embedding")
    assert drift.bandwidth(np.ones((5, 2))) == 1.0 and drift.mmd2(np.ones((5, 2)), np.ones((5, 2)), 1.0) == 0


def test_mmd_takes_all_reference_rows_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(drift, "TILE_ROWS", 500)
    rng = np.random.default_rng(9)
    base = np.vstack([rng.normal(0, 1, (700, 4)), rng.normal(3, 1, (500, 4))])
    live = np.vstack([rng.normal(1, 1, (40, 4)), base[::30]])
    members = frame(spark, live).withColumn("window_no", (F.col("id") / 40).cast("long")).unionByName(frame(spark, [[0.0, 1.0]]).withColumn("window_no", F.lit(2).cast("long")))
    got = {r["window_no"]: r for r in drift.window_mmd(frame(spark, base), members, "id", "embedding", sigma=1.5, permutations=20).collect()}
    for window in (0, 1):
        part = live[40 * window : 40 * window + 40]
        assert got[window]["mmd"] == pytest.approx(drift.mmd2(base, part, 1.5), abs=1e-9) and got[window]["n"] == 40
        assert abs(got[window]["p_value"] - drift.permutation_p(base, part, 1.5, 60, 1)[0]) < 0.3
    assert got[0]["p_value"] == 0 and got[1]["p_value"] > 0.5
    assert got[2]["mmd"] is None and got[2]["p_value"] is None


def test_calibration_draws_from_all_rows(spark, monkeypatch):
    rows = drift._numbered(frame(spark, [[float(i)] for i in range(900)]), "id", "embedding")
    drawn = drift._drawn(rows, 900, 40, 120, 1).collect()
    assert len(drawn) == 4800 and len({r["v"][0] for r in drawn}) > 880 and len({(r["draw"], r["v"][0]) for r in drawn}) == 4800
    monkeypatch.setattr(drift, "_sample", lambda *_: np.array([[0.0], [1.0]]))
    assert drift.calibrated(frame(spark, [[float(i % 2)] for i in range(900)]), "id", "embedding", draws=5).first()["threshold"] > 0


def test_an_index_has_no_gaps_when_its_parts_are_joined(spark):
    wide = spark.range(20_000).withColumn("text", F.concat(*(F.sha2(F.concat("id", F.lit(i)), 256) for i in range(20))))
    assert drift.indexed(wide, ["id"]).filter("row_index = id and text is not null").count() == 20_000


@pytest.mark.parametrize("parts", [1, 16, 200])
def test_an_index_counts_from_nought_over_any_number_of_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = spark.range(0, 50_000, 1, 7).select((F.col("id") * 7919 % 50_000).alias("id"), F.repeat(F.lit("x"), 40).alias("payload"), (F.col("id") % 3).alias("k"))
        found = drift.indexed(rows, ["id"])
        summed = found.agg(F.count_distinct("row_index").alias("n"), F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.count_if(F.col("row_index") != F.col("id")).alias("wrong")).first()
        assert tuple(summed) == (50_000, 0, 49_999, 0)
        assert found.select("row_index").distinct().count() == 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_size_matched_calibration_and_window_checks(spark):
    rng = np.random.default_rng(12)
    reference, pool = (frame(spark, rng.normal(0, 1, (n, 6))) for n in (60, 200))
    calibration = drift.size_matched_null(reference, pool, "id", "embedding", 20, draws=40)
    row = calibration.first()
    assert (row["n"], row["m"], row["draws"]) == (60, 20, 40) and 0 < row["null"]["min"] <= row["null"]["median"] <= row["threshold"] <= row["null"]["max"]
    assert drift.size_matched_null(reference, pool, "id", "embedding", 20, draws=40).first()["calibration_id"] == row["calibration_id"]
    with pytest.raises(ValueError, match="pool rows"):
        drift.size_matched_null(reference, pool, "id", "embedding", 500)
    assert drift.pooled_bandwidth(reference, frame(spark, rng.normal(9, 1, (60, 6))), "id", "embedding") > row["sigma"]

    live = frame(spark, np.vstack([rng.normal(0, 1, (20, 6)), rng.normal(4, 1, (20, 6)), rng.normal(4, 1, (20, 6))])).withColumn("window_no", (F.col("id") / 20).cast("long")).withColumn("light", F.when(F.col("id") < 40, 1.0).otherwise(1.5))
    tested = drift.window_mmd(reference, live, "id", "embedding", sigma=row["sigma"])
    described = live.groupBy("window_no").agg(F.count("*").alias("size"))
    levels = profile.window_levels(reference.withColumn("light", F.lit(1.0)), live, {"light": ["light"]}, ("label",))
    got = {r["window_no"]: r for r in drift.checked(described, tested, row["threshold"], levels, size=20).collect()}
    assert [got[i]["assessment"] for i in range(3)] == ["NO_SIGNIFICANT_SHIFT", "UNEXPLAINED_SHIFT", "OPERATIONAL_SHIFT_LIKELY"]
    assert (got[1]["severity"], got[1]["confidence"], got[2]["measured"]) == ("HIGH", 0.7, ["HIGH", "LOW"])
    assert {r["assessment"] for r in drift.checked(described, tested, None).collect()} == {"INSUFFICIENT_EVIDENCE"}
    assert {(r["assessment"], r["gap"]) for r in drift.checked(described, tested, 0.1, size=30).collect()} == {("INSUFFICIENT_EVIDENCE", "20 rows, calibrated for 30")}


@pytest.mark.parametrize("n, windows", [(9, 0), (10, 1), (15, 2)])
def test_count_windows(spark, n, windows):
    members = drift.assigned(drift.indexed(spark.range(n), ["id"]), drift.Windows(10, 5))
    got = {}
    for r in members.collect():
        got.setdefault(r["window_no"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(5 * k, 5 * k + 10)) for k in range(windows)}


def test_guards(spark):
    validate.guard_vectors(frame(spark, [[1, 2], [3, 4]]), "id", "embedding")
    with pytest.raises(ValueError, match="finite"):
        validate.guard_vectors(frame(spark, [[1, 2], [3, float("nan")]]), "id", "embedding")
    with pytest.raises(ValueError, match="dimensions"):
        validate.guard_vectors(frame(spark, [[1, 2], [3]]), "id", "embedding")
    with pytest.raises(ValueError):
        validate.require_coverage(spark.range(3), spark.range(4), "id")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_activity_counts_parts_of_a_second(spark):
    """A row a microsecond behind an edge belongs to the later bucket, and one behind the end to none."""
    from plumbline.operators import reports

    rows = spark.sql("select 'm' as m, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) as ts from values (0.0), (10.0), (10.000001), (19.999999), (20.0), (20.000001) as v(s)")
    got = reports.activity_series(rows, "ts", "m", "2024-01-01 00:00:20", 2, 10)
    assert sorted((r["bucket"], r["n"]) for r in got.collect()) == [(0, 1), (1, 3)]


def test_exact_tiles_shuffle_rows_once(spark, monkeypatch):
    """Rows are not copied to tiles, so more tiles shuffle no more; partners come out as from all pairs."""
    rows = spark.createDataFrame([(i, [float((i * 37 + j * j * 11) % 23 - 11) for j in range(5)]) for i in range(300)], "id long, v array<double>")
    want = sorted(tuple(r) for r in duplicates.best_partner(duplicates.near_pairs(rows, "id", "v", 0.6)).collect())
    near = sorted(tuple(r) for r in duplicates.nearest(rows, "id", "v", 4).collect())
    monkeypatch.setattr(duplicates, "TILE_ROWS", 25)
    assert sorted(tuple(r) for r in duplicates.best_partners(rows, "id", "v", 0.6).collect()) == want
    assert sorted(tuple(r) for r in duplicates.nearest(rows, "id", "v", 4).collect()) == near
    for tiled in (duplicates.nearest(rows, "id", "v", 4), duplicates.near_pairs(rows, "id", "v", 0.6)):
        plan = tiled._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapGroupsInPandas" not in plan
