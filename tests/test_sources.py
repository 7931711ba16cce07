"""File sources and streams on small files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.drift import Windows
from plumbline.sources import annotations, files, images, reference
from plumbline.streaming import operators as streams


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i in range(3):
        png(tmp_path / f"im{i}.png", rng.integers(0, 255, (24, 30, 3)))
    (tmp_path / "note.txt").write_text("x")
    found = images.files(spark, str(tmp_path))
    assert sorted(r["image_id"] for r in found.collect()) == ["im0", "im1", "im2"]
    decoded = images.decoded(spark, str(tmp_path))
    assert {len(r["embedding"]) for r in images.embeddings(decoded).collect()} == {734}
    assert all(0 < r["brightness"] < 1 and (r["width"], r["height"]) == (30, 24) for r in images.statistics(decoded).collect())
    doubled = images.embeddings(decoded, post_process=lambda batch: batch * 2)
    assert np.allclose(np.array(doubled.orderBy("path").first()["embedding"]), 2 * np.array(images.embeddings(decoded).orderBy("path").first()["embedding"]))
    with pytest.raises(Exception, match="finite"):
        images.embeddings(decoded, post_process=lambda batch: batch * np.nan).collect()
    summed = images.set_statistics(images.statistics(decoded)).first()
    assert summed["image_count"] == 3 and summed["widths"] == [30] and summed["heights"] == [24]
    current = found.select("image_id", "sha256")
    cache = current.limit(2).select("image_id", "sha256", F.lit("b").alias("backbone"), F.array(F.lit(1.0)).alias("embedding"))
    fresh = images.stale(current, cache, "b")
    assert fresh.count() == 1
    assert images.refreshed(current, cache, fresh.withColumn("embedding", F.array(F.lit(2.0))), "b").count() == 3
    with pytest.raises(ValueError):
        images.files(spark, str(tmp_path / "."), False).sparkSession and images.files(spark, str((tmp_path / "empty").mkdir() or tmp_path / "empty"))


@pytest.mark.parametrize("content", [{"a": "cat", "b": "dog"}, {"labels": {"a": "cat", "b": "dog"}}, {"a": {"given_label": "cat"}, "b": {"given_label": "dog"}}])
def test_label_sidecars(spark, tmp_path, content):
    (tmp_path / "labels.json").write_text(json.dumps(content))
    assert dict(map(tuple, annotations.labels(spark, str(tmp_path / "labels.json")).collect())) == {"a": "cat", "b": "dog"}


VOC = "<annotation><filename>{n}.jpg</filename><size><width>100</width><height>50</height><depth>3</depth></size>{o}</annotation>"
BOX = "<object><name>{c}</name><truncated>1</truncated><difficult>0</difficult><bndbox><xmin>{a}</xmin><ymin>1</ymin><xmax>{b}</xmax><ymax>40</ymax></bndbox></object>"


def test_voc(spark, tmp_path):
    cases = {"good": BOX.format(c="dog", a=1, b=20) + BOX.format(c="cat", a=1, b=60), "flat": BOX.format(c="dog", a=20, b=20), "wide": BOX.format(c="dog", a=1, b=103), "odd": BOX.format(c="yak", a=1, b=20), "none": ""}
    for n, o in cases.items():
        (tmp_path / f"{n}.xml").write_text(VOC.format(n=n, o=o))
    rows = annotations.voc(spark, str(tmp_path))
    broken = {r["sample_id"]: r["v"] for r in rows.select("sample_id", annotations.voc_violations().alias("v")).collect()}
    assert broken == {"good": [], "flat": ["degenerate"], "wide": ["outside"], "odd": ["unknown_class"], "none": ["no_objects"]}
    best = annotations.primary_class(rows).filter("sample_id = 'good'").first()
    assert best["primary_class"] == "cat" and best["all_classes"] == ["cat", "dog"]
    assert {r["class"]: (r["objects"], r["images"], r["truncated"]) for r in annotations.voc_statistics(rows).collect()}["dog"] == (3, 3, 3)


def test_coco_and_yolo(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "A.jpg"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "bbox": [0, 0, 5, 5]}, {"id": 2, "image_id": 7, "category_id": 1, "bbox": [0, 0, -5]}], "categories": [{"id": 1, "name": "x"}]}))
    tables = annotations.coco(spark, str(tmp_path / "c.json"))
    there = spark.createDataFrame([("dir/a.jpg",)], "path string")
    assert dict(map(tuple, annotations.coco_integrity(*tables, there).collect())) == {"annotation.image_id": 1, "image.file": 0, "annotation.category_id": 1}
    assert [r[0] for r in tables[1].orderBy("id").select(annotations.coco_violations()).collect()][0] == []
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "P.txt").write_text("\n2 0.1 0.2 0.3 0.4\n1 0.1 0.2\nx 2 0 0 0\n")
    lines = annotations.yolo(spark, str(labels))
    assert [r["violations"] for r in lines.orderBy("line_no").collect()] == [[], ["tokens", "coordinates"], ["class_id", "coordinates"]]
    assert annotations.first_labels(lines).first()["class_id"] == 2
    for body in ("names: ['cat', dog]\n", "names:\n  - cat\n  - dog\n", "nc: 2\nnames:\n  0: cat\n  1: dog\n"):
        (tmp_path / "n.yaml").write_text(body)
        assert [r["name"] for r in annotations.yolo_names(spark, str(tmp_path / "n.yaml")).orderBy("class_id").collect()] == ["cat", "dog"]


def test_splits_take_the_first(spark, tmp_path):
    for name, ids in (("train", "a\n\n b \n"), ("val", "c\n"), ("trainval", "a\nb\nc\nd\n")):
        (tmp_path / f"{name}.txt").write_text(ids)
    assert dict(map(tuple, annotations.splits(spark, str(tmp_path)).collect())) == {"a": "train", "b": "train", "c": "val", "d": "trainval"}


def test_file_gate(spark):
    good = json.dumps({"images": [{"id": 1}], "annotations": [], "categories": []}).encode()
    contents = {"a.json": good, "b.json": b"\x89PNG\r\n\x1a\n....", "c.py": b"print()", "d.json": b"x\0y", "e.json": b'{"images": 5}', "f.json": b"{", "g.json": b'{"images": []}', "h.JPG": b"text", "i.json": b"\x80\x02......", "j.json": b"7z\xbc\xaf'\x1c.."}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in contents.items()], "path string, content binary")
    got = {r["path"]: r for r in files.gate(rows, "coco").collect()}
    assert {n: r["status"] for n, r in got.items()} == {"a.json": "valid", "b.json": "rejected", "c.py": "rejected", "d.json": "rejected", "e.json": "invalid", "f.json": "invalid", "g.json": "warning", "h.JPG": "rejected", "i.json": "rejected", "j.json": "rejected"}
    assert got["b.json"]["errors"] == ["Content is binary (png); renamed files cannot bypass validation"] and got["a.json"]["image_count"] == 1 and len(got["g.json"]["warnings"]) == 3
    lines = spark.createDataFrame([("x.txt", bytearray(b"0 .1 .1 .1 .1\n\n1 2 3\n"))], "path string, content binary")
    found = files.gate(lines, "yolo").first()
    assert (found["status"], found["annotation_count"], found["errors"]) == ("invalid", 2, ["Line 2: expected at least 5 values (class x y w h), found 3"])


def test_bundles(spark):
    rows = spark.createDataFrame([("x", "p", 1, "s", "valid"), ("x", "p", 1, "s", "valid"), ("y", "q", 0, "s", "valid"), ("z", "q", 3, "s", "rejected")], "bundle string, path string, length long, sha256 string, status string")
    assert {r["bundle"]: r["status"] for r in files.bundle_status(rows, "bundle").collect()} == {"x": "invalid", "y": "warning", "z": "invalid"}
    kinds = spark.createDataFrame([("x", "a.json"), ("y", "any/1.txt"), ("z", "r.md"), ("w", "a.json"), ("w", "1.txt"), ("v", "data.yaml"), ("u", "classes.txt"), ("t", "a.JSON")], "bundle string, path string")
    kind = lambda wanted: dict(map(tuple, files.bundle_kind(kinds, "bundle", wanted).collect()))
    assert kind(None) == {"x": "coco", "y": "yolo", "z": "unknown", "w": "coco", "v": "yolo", "u": "unknown", "t": "coco"}
    assert kind("yolo") == kind(None) | {"z": "yolo", "w": "yolo", "u": "yolo"}


def test_assets_are_found_by_file_and_by_folder(spark):
    listed = spark.createDataFrame([("a/b/c.pt", 5, "h"), ("a/d/e", 0, "g")], "path string, length long, sha256 string")
    registry = spark.createDataFrame([(1, "a/b/c.pt"), (2, "a/b"), (3, "a/d"), (4, "a/bx"), (5, "a")], "asset_id int, path string")
    assert {r["asset_id"]: r["reason"] for r in files.availability(registry, listed).collect()} == {1: "present", 2: "present", 3: "empty", 4: "not found", 5: "present"}
    models = spark.createDataFrame([("a/b/c.pt", "h", "c1", "c1"), ("a/b/c.pt", "x", "c1", "c1"), ("a/b/c.pt", None, "c1", "c1"), ("q", "h", "c1", "c1"), ("a/b/c.pt", "h", "c1", "c2")], "path string, registered_sha256 string, contributor_id string, claimed_contributor string")
    assert sorted(r["status"] for r in files.model_assets(models, listed).collect()) == ["INVALID", "INVALID", "VALID", "WARNING", "WARNING"]


def test_listings_keys_examples_and_sinks(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    for name, body in (("h1", {"timestamp": "2024-01-01", "assetID": "x", "moduleName": "M"}), ("h2", {"generatedAt": "2024-02-01"})):
        (store / f"{name}.json").write_text(json.dumps(body))
    listed = files.evidence_listing(spark, str(store))
    assert [r["evidence_id"] for r in listed.collect()] == ["h2", "h1"] and listed.collect()[0]["related"] == "asset-h2"
    found = files.evidence_by_hash(spark.createDataFrame([("h1",), ("h9",)], "evidence_hash string"), listed)
    assert {r["evidence_hash"]: r["evidence"] is None for r in found.collect()} == {"h1": False, "h9": True}
    (tmp_path / "reports").mkdir()
    for i in (1, 2):
        (tmp_path / "reports" / f"{i}.json").write_text(json.dumps({"assessment_id": f"a{i}", "assessment_timestamp": f"2024-0{i}-01", "findings": [{}] * i, "overall_assessment": {"overall_status": "PASS"}}))
    assert [(r["assessment_id"], r["findings"], r["overall_status"]) for r in files.reports(spark, str(tmp_path / "reports")).collect()] == [("a2", 2, "PASS"), ("a1", 1, "PASS")]
    (tmp_path / "key.json").write_text(json.dumps({"labels": {"s1": {"label": "dog", "original_label": "cat", "corruption": "flip"}, "s2": {"label": "dog"}}}))
    assert {r["sample_id"]: (r["label"], r["original_label"], r["corruption"]) for r in files.answer_key(spark, str(tmp_path / "key.json")).collect()} == {"s1": ("dog", "cat", "flip"), "s2": ("dog", None, None)}
    (tmp_path / "ex.csv").write_text("file,true_label\na.png,3\n,1\nb.png,x\n")
    assert [tuple(r) for r in files.examples(spark, str(tmp_path / "ex.csv")).collect()] == [("a.png", 3)]
    rows = spark.createDataFrame([("t1", "x"), ("t1", "x"), ("t2", "y")], "tx_id string, status string")
    assert [files.append_journal(str(tmp_path / "journal"), rows) for _ in range(2)] == [2, 0]
    files.write_results(str(tmp_path / "out"), rows, summary=rows.groupBy("status").count())
    assert spark.read.json(str(tmp_path / "out" / "findings")).count() == 3 and spark.read.json(str(tmp_path / "out" / "summary")).count() == 2


def test_results_in_all_shapes_and_evidence(spark, tmp_path):
    shapes = {"a": {"results": [{"finding": {"assetID": "1", "severity": "LOW", "confidence": "0.5"}}]}, "b": {"results": [{"image_id": "2", "severity": "HIGH"}]}, "c": {"sample_findings": [{"sample_id": "3"}]}, "d": [{"assetID": "4"}, {"image_id": "5"}]}
    for name, body in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert sorted(r["asset_id"] for r in files.results(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4", "5"]
    (tmp_path / "bad.json").write_text("{")
    assert files.evidence_listing(spark, str(tmp_path)).filter("file not like '%bad.json'").count() == 4 == files.evidence_listing(spark, str(tmp_path)).count()
    rows = spark.createDataFrame([("h1", "x"), ("h1", "x"), ("h2", "y")], "evidence_hash string, payload string")
    target = str(tmp_path / "store")
    assert files.store_evidence(target, rows) == 2 and files.store_evidence(target, rows) == 0


def test_stream_windows_equal_batch_and_ledger_is_first_wins(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "ledger")
    rows = spark.range(40).selectExpr("id % 2 as k", "id", "timestamp_seconds(1000 + id) as ts", "id as seq", "concat('a', id % 7) as asset", "concat('h', id % 5) as hash")
    rows.coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(source))
    got = streams.drained(streams.count_windows(stream(), "k", "id", "ts", Windows(8, 3)), str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["window_no"], r["items"]) for r in got) == sorted((str(k), w, list(range(k, 40, 2))[3 * w : 3 * w + 8]) for k in (0, 1) for w in range(5))
    for _ in range(2):
        stream().writeStream.foreachBatch(streams.ledger_sink(table)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(table)
    assert kept.count() == 5 == kept.select("hash").distinct().count()
    counts = streams.activity(stream(), "ts", "asset", "10 seconds", "1 second")
    assert streams.drained(counts, str(tmp_path / "act")).agg(F.sum("n")).first()[0] > 0


def test_replays_of_a_hot_nonce_over_many_batches(spark, tmp_path):
    """All uses but the first, in time, also where a nonce's rows reach Python in several batches."""
    source = tmp_path / "in"
    rows = spark.range(60).selectExpr("if(id % 3 = 0, concat('n', id % 9), 'hot') as nonce", "id", "timestamp_seconds(9000 - 7 * id) as ts")
    rows.coalesce(1).write.parquet(str(source))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        got = streams.drained(streams.replays(stream, "nonce", "id", "ts"), str(tmp_path / "out")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = {}
    for r in rows.collect():
        last[r["nonce"]] = max(last.get(r["nonce"], 0), r["id"])
    assert sorted(r["item"] for r in got) == sorted(set(range(60)) - set(last.values()))


def test_replays_keep_their_state_by_buckets_and_forget(spark, tmp_path):
    """Nonces share a bucket's state; one is forgotten when the watermark is past its last use by more than `keep`."""
    source = str(tmp_path / "in")
    at = [(f"n{i}", i, 10_000 + i) for i in range(200)], [("n0", 300, 10_500), ("late", 301, 60_000)], [("n0", 302, 60_100), ("n1", 303, 60_200), ("late", 304, 60_300)]
    for rows in at:
        spark.createDataFrame(rows, "nonce string, id long, s long").select("nonce", "id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("nonce string, id long, ts timestamp").parquet(source)
        done = streams.replays(stream, "nonce", "id", "ts", "2 hours", buckets=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        done.awaitTermination()
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 3 for p in done.recentProgress)
    # n0 and n1 are forgotten by the last batch, late is not
    assert sorted(r["item"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [300, 304]


def test_reference_refuses_what_its_manifest_does_not_say(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"h{i}", [float(i), 1.0]) for i in range(5)], "sample_id string, sha256 string, embedding array<double>")
    reference.build(rows, str(tmp_path), "b")
    loaded, manifest = reference.load(spark, str(tmp_path))
    assert loaded.count() == 5 and manifest.first()["dim"] == 2
    with pytest.raises(ValueError, match="dim"):
        reference.load(spark, str(tmp_path), 3)
    rows.limit(4).write.mode("overwrite").parquet(str(tmp_path / "embeddings"))
    with pytest.raises(ValueError, match="rows"):
        reference.load(spark, str(tmp_path))


def test_image_descriptor_by_hand():
    """An image of the target's size is not resized, so that every number follows from its pixels one by one."""
    import pandas as pd

    bgr = np.random.default_rng(3).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    row = {"height": 64, "width": 64, "channels": 3, "data": bgr.tobytes()}
    rgb = bgr[:, :, ::-1] / 255
    got = images.grid_statistics(pd.DataFrame([row, row]))
    assert got.shape == (2, 734) and np.array_equal(got[0], got[1])
    cell = rgb[8:16, 16:24, 1]
    assert np.allclose(got[0][(64 + 8 + 2) * 3 : (64 + 8 + 2) * 3 + 3], [cell.mean(), cell.std(), np.percentile(cell, 90)])
    plane = rgb[:, :, 2]
    slope = np.sqrt(sum(g**2 for g in np.gradient(plane)))
    centred = plane - plane.mean()
    by_hand = [plane.mean(), plane.std(), np.percentile(plane, 90), np.percentile(plane, 10), (centred**3).mean() / plane.std() ** 3, (centred**4).mean() / plane.std() ** 4, slope.mean(), np.percentile(slope, 90), plane.max()]
    assert np.allclose(got[0][576 + 18 : 576 + 27], by_hand)
    grey = 0.299 * rgb[:, :, 0] + 0.587 * rgb[:, :, 1] + 0.114 * rgb[:, :, 2]
    assert np.allclose(got[0][603 : 603 + 2], [grey[:8, :8].mean(), grey[:8, 8:16].mean()]) and np.allclose(got[0][667], grey[:8, :8].std())
    edges = np.sqrt(sum(g**2 for g in np.gradient(grey))) > 0.08
    assert np.allclose(got[0][731:], [np.percentile(grey, 10), grey.std(), edges.mean()])


def test_box_resize_averages_whole_pixels():
    image = np.zeros((128, 128, 3))
    image[::2] = 100
    assert np.all(images.resized(image, 64) == 50) and images.resized(np.full((10, 7, 3), 9), 64).shape == (64, 64, 3)


def test_windows_of_a_stream_are_checked_as_in_a_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, "a", float(i), [float(x) for x in rng.normal(0 if i < 20 else 4, 1, 4)]) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, k string, at double, v array<double>").withColumn("ts", F.timestamp_seconds("at"))
    reference = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(50)], "id long, v array<double>")
    table.drop("v", "at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    windows = streams.count_windows(stream, "k", "id", "ts", Windows(20, 20))
    sink = streams.window_check_sink(reference, table, "id", "v", 0.1, str(tmp_path / "out"), size=20, sigma=2.0)
    windows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r["number"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # without measured statistics a shift has no explanation and no evidence against one
    assert {n: r["assessment"] for n, r in got.items()} == {0: "NO_SIGNIFICANT_SHIFT", 1: "INSUFFICIENT_EVIDENCE"} and got[1]["mmd"] > 0.1 > got[0]["mmd"]
