import os

from pyspark.sql import functions as F

from plumbline.sources import upsert

SCHEMA = "k long, at int, v string"


def files(folder):
    return {os.path.relpath(os.path.join(d, name), folder): os.stat(os.path.join(d, name)).st_mtime_ns for d, _, names in os.walk(folder) for name in names if name.startswith("part-")}


def rows(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(folder).select("k", "at", "v").collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "t")
    base = spark.createDataFrame([(i, 0, f"v{i}") for i in range(200)], SCHEMA)
    assert len(upsert.upsert(folder, base, "k", "at", buckets=16)) == 16
    assert rows(spark, folder) == [(i, 0, f"v{i}") for i in range(200)]
    before = files(folder)
    assert upsert.upsert(folder, base, "k", "at", buckets=16) == [] and files(folder) == before
    changes = spark.createDataFrame([(3, 1, "new"), (3, 2, "newer"), (5, -1, "late"), (900, 0, "more"), (7, 0, "v7")], SCHEMA)
    touched = upsert.upsert(folder, changes, "k", "at", buckets=16)
    own = {r["k"]: r["b"] for r in changes.select("k", upsert.bucket("k", 16).alias("b")).collect()}
    assert touched == sorted({own[3], own[900]})
    after = files(folder)
    kept = lambda found: {f: t for f, t in found.items() if int(f.split("/")[0].removeprefix("bucket=")) not in touched}
    assert kept(after) == kept(before) and after != before
    want = {i: (i, 0, f"v{i}") for i in range(200)} | {3: (3, 2, "newer"), 900: (900, 0, "more")}
    assert rows(spark, folder) == sorted(want.values())
    assert upsert.upsert(folder, changes, "k", "at", buckets=16) == [] and files(folder) == after


def test_rows_that_go_and_null_keys(spark, tmp_path):
    folder = str(tmp_path / "t")
    upsert.upsert(folder, spark.createDataFrame([(1, 0, "a"), (2, 0, None), (None, 0, "n")], SCHEMA), "k", "at", buckets=4)
    gone = spark.createDataFrame([(1, 1, None, True), (2, 1, "b", None), (None, 2, "m", False), (8, 0, None, True)], SCHEMA + ", gone boolean")
    assert upsert.upsert(folder, gone, "k", "at", buckets=4, deleted="gone")
    assert sorted(map(tuple, spark.read.parquet(folder).select("k", "at", "v").collect()), key=str) == [(2, 1, "b"), (None, 2, "m")]
    assert upsert.upsert(folder, gone, "k", "at", buckets=4, deleted="gone") == []
    assert upsert.upsert(folder, gone.limit(0), "k", "at", buckets=4, deleted="gone") == []


def test_stream_of_changes(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    for batch in range(3):
        spark.createDataFrame([(i, batch, f"{batch}-{i}") for i in range(batch, 10)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(upsert.upsert_sink(folder, "k", "at", buckets=4)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark, folder) == [(i, min(i, 2), f"{min(i, 2)}-{i}") for i in range(10)]


def test_feature_cache_embeds_only_what_is_new(spark, tmp_path):
    folder, asked = str(tmp_path / "c"), []

    def embed(frame):
        asked.append(sorted(r["image_id"] for r in frame.collect()))
        return frame.select("image_id", F.array(F.length("sha256").cast("double")).alias("embedding"))

    images = lambda pairs: spark.createDataFrame(pairs, "image_id string, sha256 string")
    upsert.refresh_cache(folder, images([("a", "1"), ("b", "2"), ("c", "3")]), embed, "x", buckets=8)
    upsert.refresh_cache(folder, images([("a", "1"), ("b", "22"), ("d", "4")]), embed, "x", buckets=8)
    assert upsert.refresh_cache(folder, images([("a", "1"), ("b", "22"), ("d", "4")]), embed, "x", buckets=8) == []
    assert asked == [["a", "b", "c"], ["b", "d"], []]
    assert sorted((r["image_id"], r["sha256"], r["embedding"]) for r in spark.read.parquet(folder).collect()) == [("a", "1", [1.0]), ("b", "22", [2.0]), ("d", "4", [1.0])]
    upsert.refresh_cache(folder, images([("a", "1")]), embed, "y", buckets=8)
    assert asked[-1] == ["a"] and [(r["image_id"], r["backbone"]) for r in spark.read.parquet(folder).collect()] == [("a", "y")]
