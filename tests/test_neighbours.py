import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, label_noise, neighbours

SF = "/root/testdata/sf0.001"


def recall(spark, got, want):
    both = got.select("id", "neighbour").intersect(want.select("id", "neighbour")).count()
    return both / want.count()


def clustered(spark, n=3000, dimension=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dimension)) * 4
    rows = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dimension))
    return spark.createDataFrame([(i, v.tolist(), int(i % 5)) for i, v in enumerate(rows)], "id long, v array<double>, fold int").repartition(4)


def test_structured_vectors_need_few_probes(spark, monkeypatch):
    frame = clustered(spark)
    rows = neighbours.representatives(frame, "id", "v", 5)
    index = neighbours.fit(rows, 5)
    assert index.recall >= 0.9 and index.probes * 5 < len(index.centres)
    want, got = duplicates.nearest(frame, "id", "v", 5), neighbours.nearest(frame, "id", "v", 5)
    assert recall(spark, got, want) >= 0.9
    assert got.groupBy("id").count().agg(F.min("count"), F.max("count")).first() == (5, 5)
    # blocks within cells change nothing
    before = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(duplicates, "TILE_ROWS", 7)
    assert sorted(map(tuple, neighbours.nearest(frame, "id", "v", 5).collect())) == before


def test_vectors_without_structure_are_answered_exactly(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, got = duplicates.nearest(frame, "vec_id", "embedding", 5), neighbours.nearest(frame, "vec_id", "embedding", 5)
    assert recall(spark, got, want) >= 0.9


def test_a_third_of_all_rows_with_one_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(2000)] + [(i, [9.0, 9.0, 9.0, 9.0]) for i in range(2000, 3000)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    kept = neighbours.representatives(frame, "id", "v", 3)
    assert kept.count() == 2001 and kept.filter("rid = 2000").first()["ids"] == [2000, 2001, 2002, 2003]
    got = neighbours.nearest(frame, "id", "v", 3)
    assert recall(spark, got, duplicates.nearest(frame, "id", "v", 3)) >= 0.9
    near = {r["id"]: sorted(x["neighbour"] for x in got.filter(F.col("id") == r["id"]).collect()) for r in got.filter("id in (2000, 2999)").select("id").distinct().collect()}
    assert near == {2000: [2001, 2002, 2003], 2999: [2000, 2001, 2002]}


def test_other_folds_only(spark):
    frame = clustered(spark, 1500)
    want, got = duplicates.nearest(frame, "id", "v", 4, within="fold"), neighbours.nearest(frame, "id", "v", 4, within="fold")
    assert recall(spark, got, want) >= 0.9
    assert got.filter(F.col("id") % 5 == F.col("neighbour") % 5).count() == 0


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<double>")
    assert neighbours.nearest(one, "id", "v", 3).collect() == []
    assert neighbours.nearest(one.limit(0), "id", "v", 3).collect() == []
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert sorted(map(tuple, neighbours.nearest(two, "id", "v", 3).collect())) == [(1, 2, 0.0, 1), (2, 1, 0.0, 1)]


@pytest.mark.parametrize("way", ["exact", "index"])
def test_planted_flips_are_found_either_way(spark, way):
    rng = np.random.default_rng(0)
    rows = [(i, (np.array([6.0 * (i % 2)] * 6) + rng.normal(size=6)).tolist(), str(i % 2)) for i in range(400)]
    flips = {4, 35, 51}
    frame = spark.createDataFrame([(i, v, str(1 - int(c)) if i in flips else c) for i, v, c in rows], "id long, v array<double>, label string")
    assert {r["id"] for r in label_noise.find(frame, "id", "v", "label", label_noise.Config(neighbours=way)).collect()} == flips


def shuffled(spark, write):
    """Rows that the stages of `write` shuffle."""
    sc = spark.sparkContext._jsc.sc()

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = rows()
    write()
    return sum(n for stage, n in rows().items() if stage not in before)


def test_the_shuffle_grows_no_faster_than_the_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE_ROWS", 20)
    rng, each = np.random.default_rng(5), []
    for n in (3000, 15000):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.uniform(size=(n, 3)))], "id long, v array<double>").repartition(4).localCheckpoint()
        each.append(shuffled(spark, lambda: neighbours.nearest(frame, "id", "v", 5).write.format("noop").mode("overwrite").save()) / n)
    assert each[1] <= 1.05 * each[0] and each[1] < 7


def test_no_cell_with_something_nearer_is_left_out():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2000, 3)) + [12_000, 0, -500]  # far from the origin, where products round
    index = neighbours.Index(rows[:60], 60, 1.0)
    cells = index.cells(rows, 60)
    distances = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    bound, opened = np.sort(distances, axis=1)[:, 5], 0
    for own in range(60):
        of = np.nonzero(cells[:, 0] == own)[0]
        is_open = index.open(rows[of], cells[of], bound[of])
        assert is_open[:, 0].all()
        opened += is_open.sum()
        for row, asks, order in zip(of, is_open, cells[of]):
            assert set(cells[distances[row] <= bound[row], 0]) <= set(order[asks])
    assert opened < 2000 * 20


@pytest.mark.parametrize("within", [None, "fold"])
def test_texts_as_ids_and_many_equal_vectors(spark, monkeypatch, within):
    monkeypatch.setattr(duplicates, "TILE_ROWS", 7)
    rng = np.random.default_rng(8)
    points = rng.uniform(size=(300, 2))
    copies = np.concatenate([np.arange(300), rng.integers(0, 300, 300), np.full(40, 7)])
    frame = spark.createDataFrame([(f"r{i:04}", points[c].tolist(), int(rng.integers(0, 3))) for i, c in enumerate(copies)], "id string, v array<double>, fold int").repartition(4).localCheckpoint()
    index = neighbours.Index(points[:30], 10, 1.0)
    got = neighbours.nearest(frame, "id", "v", 4, within, index=index)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, duplicates.nearest(frame, "id", "v", 4, within).collect()))


def test_a_vector_that_is_no_number_disturbs_no_other(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.uniform(size=(400, 2)))]
    centres = np.array([v for _, v in rows[:20]])
    odd = [(1000, [float("nan"), 0.5]), (1001, [float("nan"), 0.5]), (1002, [float("inf"), 0.5])]
    plain, with_odd = (spark.createDataFrame(x, "id long, v array<double>").repartition(2) for x in (rows, rows + odd))
    want, got = (sorted(map(tuple, neighbours.nearest(x, "id", "v", 3, index=neighbours.Index(centres, 6, 1.0)).collect())) for x in (plain, with_odd))
    assert [x for x in got if x[0] < 1000] == want
    assert [x for x in got if x[0] >= 1000] == [(1000, 1001, 0.0, 1), (1001, 1000, 0.0, 1)]


def plain_nearest(ids, v, fold, k):
    """What nearest_both gives, by all pairs in double precision."""
    found = set()
    for i in range(len(v)):
        distance = np.sqrt(((v[i] - v) ** 2).sum(1))
        for across, barred in ((0, np.arange(len(v)) == i), (1, fold == fold[i])):
            order = [j for j in np.lexsort((ids, distance)) if not barred[j] and np.isfinite(distance[j])][:k]
            found |= {(ids[i], ids[j], distance[j], rank + 1, across) for rank, j in enumerate(order)}
    return found


@pytest.mark.parametrize("kind", ["noise", "far", "copies", "tiny", "huge", "odd", "one fold"])
def test_both_searches_in_one_pass_lose_nothing_to_single_precision(spark, monkeypatch, kind):
    monkeypatch.setattr(duplicates, "TILE_ROWS", 20)
    monkeypatch.setattr(duplicates, "STEP_ROWS", 16)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(300, 6)) / 3
    if kind == "far":  # clusters far from each other, with distances that single precision can't tell
        v = rng.integers(0, 3, (300, 1)) * 1e6 + v * 1e-3
    elif kind == "copies":
        v = v[rng.integers(0, 20, 300)]
    elif kind in ("tiny", "huge"):
        v = v * (1e-30 if kind == "tiny" else 1e25)
    elif kind == "odd":
        v[:3] = [[np.nan] * 6, [np.inf] + [0.0] * 5, [1e200] * 6]
    ids, fold = np.array([f"r{i:0{1 + i % 4}}" for i in range(300)]), rng.integers(0, 1 if kind == "one fold" else 4, 300)
    frame = spark.createDataFrame([(str(i), x.tolist(), int(f)) for i, x, f in zip(ids, v, fold)], "id string, v array<double>, fold int").repartition(3)
    got = {tuple(r) for r in duplicates.nearest_both(frame, "id", "v", 5, "fold").collect()}
    with np.errstate(all="ignore"):
        want = plain_nearest(ids, v, fold, 5)
    if kind == "odd":  # what has no finite square has no neighbours, as in nearest()
        got, want = ({x for x in rows if "1e200" not in x and int(x[0][1:]) > 2} for rows in (got, want))
        want = {x for x in want if int(x[1][1:]) > 2}
    assert got == want


def test_label_noise_meets_all_pairs_once(spark):
    rng = np.random.default_rng(11)
    frame = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(rng.normal(size=(300, 64)))], "id long, v array<double>, label int").repartition(2)
    plan = label_noise.find(frame, "id", "v", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "SHUFFLE_REPLICATE_NL" not in plan.upper() and plan.count("MapInArrow") <= 1  # neighbours are written already; centres are met in one pass
