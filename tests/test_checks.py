import json

import numpy as np
import pytest

from plumbline.operators import checks, evaluate, fusion, label_noise, validate
from plumbline.sources import annotations


def samples(spark, seed=5):
    """Two classes of 60; rows 4, 35 and 70 mislabelled, 120 a copy of 10, 121 far away."""
    rng = np.random.default_rng(seed)
    rows = np.vstack([rng.normal(0, 1, (60, 8)), rng.normal(6, 1, (60, 8))]) * np.arange(1, 9) * 10 + 100
    labels = ["day" if (i < 60) != (i in (4, 35, 70)) else "night" for i in range(120)]
    rows, labels = np.vstack([rows, rows[10], rows[20] + np.arange(1, 9) * 150]), [*labels, labels[10], "day"]
    return spark.createDataFrame([(i, l, v.tolist()) for i, (l, v) in enumerate(zip(labels, rows))], "id long, label string, v array<double>")


def test_all_checks_over_one_scale(spark):
    done = checks.run(samples(spark), "id", "v", "label")
    got = {r["id"]: r for r in done.flagged.collect()}
    assert done.errors == {} and done.checks == ("duplicate", "ood", "label_flip")
    flips = {r["id"] for r in label_noise.find(checks.standardised(samples(spark), "v"), "id", "v", "label", checks.FLIPS, scaled=True).collect()}
    assert {i for i, r in got.items() if "label_flip" in r["flags"]} == flips and len(flips & {4, 35, 70}) >= 2 and flips <= {4, 35, 70, 121}
    assert {i for i, r in got.items() if "duplicate" in r["flags"]} >= {10, 120}
    assert "ood" in got[121]["flags"] and "distance" in got[121]["reason"]
    assert (got[10]["n_flags"], got[10]["confidence"], got[10]["severity"], got[10]["disposition"]) == (1, 0.6, "MEDIUM", "REVIEW")
    several = [r for r in got.values() if r["n_flags"] >= 2]
    assert all(r["severity"] == "HIGH" and r["confidence"] == 0.75 and r["reason"].count(";") == 1 for r in several if r["n_flags"] == 2)


def test_a_failing_check_is_named_and_the_others_go_on(spark):
    frame = samples(spark)
    few = frame.filter("id < 6 or id = 120 or id = 10")
    done = checks.run(few, "id", "v", "label", checks=("duplicate", "ood"))
    assert list(done.errors) == ["ood"] and "needed" in done.errors["ood"]
    assert {r["id"] for r in done.flagged.collect()} == {10, 120}
    odd = checks.run(frame, "id", "v", "label", checks.Config(ood=checks.Ood(trim_fraction=0.7), duplicate=checks.Duplicate(3.0)), checks=("duplicate", "ood"))
    assert set(odd.errors) == {"duplicate", "ood"} and "0.7" in odd.errors["ood"] and odd.flagged.collect() == []
    with pytest.raises(ValueError, match="ids repeat"):
        checks.run(frame.unionByName(frame), "id", "v", "label")


def test_configuration_from_json():
    own = checks.Config()
    assert (own.duplicate.similarity_threshold, own.ood.trim_fraction, own.ood.calibration_splits, own.ood.mad_k, own.policy.ood) == (0.99, 0.10, 5, 5.0, "HIGH")
    assert (own.label_flip.filter_by, own.label_flip.min_confidence_gap, own.label_flip.min_alt_prob, own.label_flip.min_odds_ratio, own.label_flip.min_centroid_ratio) == ("both", 0.15, 0.35, 1.5, 1.0)
    read = checks.Config.read(json.loads('{"mode": "offline", "ood": {"trim_fraction": 0.2, "quantile": 0.99, "calibration_splits": 8}, "label_flip": {"enabled": true, "n_neighbors": 7}, "policy": {"duplicate": {"severity": "LOW", "disposition": "REVIEW"}}}'))
    assert (read.ood.trim_fraction, read.ood.calibration_splits, read.ood.seed, read.label_flip.n_neighbors, read.label_flip.n_splits, read.policy.duplicate, read.policy.ood) == (0.2, 8, 42, 7, 5, "LOW", "HIGH")
    assert checks.Config.read({}) == own


def test_other_classes_of_a_sample_are_no_flips(spark):
    frame = samples(spark).filter("id < 120")
    also = spark.createDataFrame([(35, "day"), (35, "dog"), (70, "dog")], "id long, class string")
    assert {r["id"] for r in label_noise.find(frame, "id", "v", "label", also=also).collect()} == {4, 70}


def test_long_vectors_are_held_against_centres_of_length_one(spark):
    rng = np.random.default_rng(3)
    base = np.vstack([np.eye(64)[0] * 8 + rng.normal(0, 0.5, (40, 64)), np.eye(64)[1] * 8 + rng.normal(0, 0.5, (40, 64))])
    labels = [("a" if i < 40 else "b") if i != 7 else "b" for i in range(80)]
    (row,) = label_noise.find(spark.createDataFrame([(i, l, v.tolist()) for i, (l, v) in enumerate(zip(labels, base))], "id long, label string, v array<double>"), "id", "v", "label").collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    centre = {c: unit[[l == c for l in labels]].mean(0) for c in "ab"}
    apart = {c: 1 - unit[7] @ (centre[c] / np.linalg.norm(centre[c])) for c in "ab"}
    assert row["id"] == 7 and row["centroid_ratio"] == pytest.approx((apart["b"] + 1e-4) / (apart["a"] + 1e-4))


def test_splits_fall_back_to_annotation_files(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "val.txt").write_text("x1\n\n x2 \n")
    (tmp_path / "sets" / "train.txt").write_text("\n")
    (tmp_path / "xml").mkdir()
    for name in ("x1", "x2", "x3"):
        (tmp_path / "xml" / f"{name}.xml").write_text("<annotation/>")
    ids = lambda split: sorted(r[0] for r in annotations.image_ids(spark, str(tmp_path / "sets"), str(tmp_path / "xml"), split).collect())
    assert ids("val") == ["x1", "x2"] and ids("train") == ids("trainval") == ids(None) == ["x1", "x2", "x3"]
    assert {tuple(r) for r in annotations.splits(spark, str(tmp_path / "sets")).collect()} == {("x1", "val"), ("x2", "val")}


def test_set_summary_and_first_labels(spark):
    box = lambda c, flag: (c, flag, flag, False)
    rows = [("s1", [box("a", True), box("b", False)]), ("s2", [box("a", False)]), ("s3", [])]
    found = spark.createDataFrame(rows, "sample_id string, objects array<struct<class:string,truncated:boolean,occluded:boolean,difficult:boolean>>")
    split = spark.createDataFrame([("s1", "train"), ("s2", "val")], "sample_id string, split string")
    row = annotations.voc_summary(found, split).first()
    assert (row["images"], row["objects"], row["truncated"], row["occluded"], row["difficult"], row["mean_objects"], row["splits"]) == (3, 3, 1, 1, 0, 1.0, {"train": 1, "val": 1, "trainval": 1})
    lines = spark.createDataFrame([("f1", 1, 2), ("f1", 0, 1), ("f2", 0, None), ("f2", 1, 0), ("f3", 0, 7), ("f4", 0, -1)], "sample_id string, line_no int, class_id int")
    names = spark.createDataFrame([(0, "cat"), (1, "dog")], "class_id int, name string")
    assert {tuple(r) for r in annotations.first_labels(lines, names).collect()} == {("f1", 1, "dog"), ("f3", 7, "7")}
    images = spark.createDataFrame([(1, "d/One.jpg"), (2, "two.png"), (3, None)], "id long, file_name string")
    marks = spark.createDataFrame([(5, 1, 20), (4, 1, 10), (6, 2, 30), (7, 3, 10), (8, 9, 10)], "id long, image_id long, category_id long").coalesce(1)
    kinds = spark.createDataFrame([(10, "ten"), (20, "twenty")], "id long, name string")
    assert {tuple(r) for r in annotations.coco_first_labels(images, marks, kinds).collect()} == {("one", "twenty"), ("two", "30")}


def test_sources_of_duplicates_are_no_false_positives(spark):
    truth = spark.createDataFrame([("d", "duplicate", False), ("s", None, True), ("c", None, None), ("o", "ood", False), ("e", None, False)], "id string, corruption string, is_source boolean")
    flags = spark.createDataFrame([("d", "duplicate"), ("s", "duplicate"), ("c", "duplicate"), ("s", "ood"), ("o", "ood"), ("o", "ood")], "id string, check string")
    got = {r["check"]: tuple(r)[1:] for r in evaluate.check_precision(truth, flags, "id", {"duplicate": "duplicate", "ood": "ood"}).collect()}
    assert got == {"duplicate": (2, 1, 0.6667, 0.3333), "ood": (1, 1, 0.5, 0.25)}


def test_samples_take_the_gravest_of_their_groups(spark):
    provenance = spark.createDataFrame([("a", "c1", "s1"), ("b", "c2", None), ("c", "c3", "s1")], "sample string, contributor_id string, source_id string")
    groups = spark.createDataFrame([("contributor", "c1", "MEDIUM"), ("source", "s1", "HIGH"), ("source", "c2", "HIGH")], "group_type string, group_id string, severity string")
    places = fusion.group_places(provenance, groups, "sample")
    assert {r["sample"]: (r["group_place"], r["group_findings"]) for r in places.collect()} == {"a": (3, 2), "c": (3, 1)}
    flags = spark.createDataFrame([("a", "ood", 0.5, "LOW"), ("b", "ood", 0.5, "LOW")], "sample string, detector string, confidence double, severity string")
    assert {r["sample"]: r["severity"] for r in fusion.fuse(flags, "sample", places).collect()} == {"a": "HIGH", "b": "LOW"}


def test_signatures_in_either_case(spark):
    good = dict(assetID="a", moduleName="m", reason="r", evidenceHash="0" * 64, confidence="0.5", severity="LOW", disposition="ACCEPT", timestamp="t", signature="aB" * 64)
    rows = spark.createDataFrame([good, good | {"signature": "g" * 128}, good | {"evidenceHash": "A" * 64}])
    assert [r[0] for r in rows.select(validate.finding_violations()).collect()] == [[], ["signature_form"], ["evidence_hash_form"]]
