"""Exact and near duplicates among vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import unit
from plumbline.tables import durable

#: Rows of one side of a tile, a matrix product, and blocks of so many rows in a file.
TILE_ROWS, FILE_BLOCKS = 2_000, 16
#: Bytes of a block of more rows than TILE_ROWS.
BLOCK_BYTES = 8 << 20
#: Rows of a block that are looked through at a time, pairs whose distances are taken at a time, and parts of a block for a first bound.
STEP_ROWS, MOST_PAIRS, PARTS = 256, 1 << 16, 64


def exact_groups(frame: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, n, first_id) of contents that occur more than once."""
    return frame.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).filter("n > 1")


def _blocks(rows: DataFrame, *more: str, most: int = 1) -> DataFrame:
    """(block, ids, v, *more): `rows` (id, v, *more) packed into rows of at most about TILE_ROWS in the order of their ids.

    Of many rows a block holds up to `most` times TILE_ROWS within BLOCK_BYTES, so that it is read less often.

    Blocks are written once and then meet as a Cartesian product of rows: every task reads the blocks that it needs, and
    no row is copied to tiles by a shuffle.
    """
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first() if most > 1 else (rows.count(), 1)
    fits = BLOCK_BYTES // (8 * max(1, width or 1) * TILE_ROWS)
    times = max(1, min(most, fits, n // (2 * TILE_ROWS * rows.sparkSession.sparkContext.defaultParallelism)))
    n_blocks = max(1, -(-n // (TILE_ROWS * times)))
    fields = ["id", *more]

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        return pd.DataFrame({"block": part["block"].iloc[:1], **{name: [part[name].to_numpy()] for name in fields}, "v": [np.stack(part["v"]).tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    kinds = ", ".join(f"{name} array<{rows.schema[name].dataType.simpleString()}>" for name in fields)
    return durable(dealt.groupBy("block").applyInPandas(packed, f"block int, {kinds}, v binary"), FILE_BLOCKS)


def _met(blocks: DataFrame, *fields: str, ordered: bool = False) -> DataFrame:
    """Pairs of blocks, the first one's fields as q_ and the other's as b_; all pairs of a task's first block come in a row.

    A task holds the other blocks of one partition, about FILE_BLOCKS of many blocks. Fewer would hand on more, as each task tells what it kept.
    """
    n, tasks = max(1, blocks.count()), 2 * blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // FILE_BLOCKS), -(-2 * tasks // n))
    first, other = (blocks.select(*(F.col(name).alias(f"{side}_{name}") for name in ("block", "v", *fields))) for side in "qb")
    spread = first.repartitionByRange(tasks, "q_block")  # evenly, where a hash would deal some tasks several of few blocks
    met = spread.crossJoin(other.coalesce(parts).hint("shuffle_replicate_nl"))
    return met.filter("q_block <= b_block") if ordered else met


def _matrix(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed).reshape(rows, -1)


def _array(column: pa.Array) -> np.ndarray:
    """Texts as such instead of as objects, which can't be sorted by several keys."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _directed(frame: DataFrame, key: str, vector: str) -> DataFrame:
    return frame.select(F.col(key).alias("id"), unit(F.col(vector).cast("array<double>")).alias("v")).filter("v is not null")


def near_pairs(frame: DataFrame, key: str, vector: str, threshold: float = 0.99) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b and a cosine of `threshold` or more, to 6 places, by exact tiles.

    Zero vectors have no direction and are left out. The work is that of all pairs, in tiles of about
    TILE_ROWS rows a side; near_pairs_lsh is the way for tables where that is too much.
    """
    rows = _directed(frame, key, vector)
    kind = rows.schema["id"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tile = {name: batch.column(name)[at] for name in batch.schema.names}
                left, right = (tile[f"{side}_id"].values.to_numpy(zero_copy_only=False) for side in "qb")
                cosines = _matrix(tile["q_v"].as_py(), len(left)) @ _matrix(tile["b_v"].as_py(), len(right)).T
                diagonal = tile["q_block"].as_py() == tile["b_block"].as_py()
                a, b = np.nonzero(np.triu(cosines, 1) >= threshold if diagonal else cosines >= threshold)
                ids = np.sort(np.stack([left[a], right[b]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0], batch.schema.field("q_id").type.value_type), pa.array(ids[1], batch.schema.field("q_id").type.value_type), pa.array(cosines[a, b].round(6))], ["id_a", "id_b", "similarity"])

    return _met(_blocks(rows), "id", ordered=True).mapInArrow(pairs, f"id_a {kind}, id_b {kind}, similarity double")


def best_partners(frame: DataFrame, key: str, vector: str, threshold: float = 0.99) -> DataFrame:
    """best_partner(near_pairs(...)) without the pairs: a task hands on one row for each row that it has met, not one a pair."""
    rows = _directed(frame, key, vector)

    def best(tile: dict, held: tuple | None) -> tuple:
        left, right = tile["q_id"], tile["b_id"]
        cosines = _matrix(tile["q_v"], len(left)) @ _matrix(tile["b_v"], len(right)).T
        cosines[left[:, None] == right[None, :]] = -np.inf
        top = cosines.max(axis=1)
        # the least id of those that round to the same; ids come sorted
        a, b = np.nonzero((cosines >= threshold) & (cosines >= top[:, None] - 2e-6))
        near = cosines[a, b].round(6)
        order = np.lexsort((b, -near, a))
        a, at = np.unique(a[order], return_index=True)
        found, partner = np.full(len(left), -np.inf), np.repeat(right[:1], len(left))
        found[a], partner[a] = near[order][at], right[b[order][at]]
        if held is None:
            return found, partner
        better = (found > held[0]) | ((found == held[0]) & (partner < held[1]))
        return np.where(better, found, held[0]), np.where(better, partner, held[1])

    def told(ids: np.ndarray, held: tuple) -> tuple:
        good = np.isfinite(held[0])
        return ids[good], held[1][good], held[0][good]

    found = _reduced(_blocks(rows), best, told, "id", "partner", "similarity")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "partner"))
    return found.withColumn("n", first).filter("n = 1").drop("n")


def _reduced(blocks: DataFrame, step: Callable, told: Callable, *names: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, id of another row, double, with a fourth name also int): what `step` keeps of a block over all other blocks of a task, as `told` writes it."""
    kind = blocks.schema["id"].dataType.elementType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held = None, None, None

        def out() -> pa.RecordBatch:
            kinds = (id_kind, id_kind, pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(told(ids, held), kinds)], list(names))

        for batch in batches:
            id_kind = batch.schema.field("q_id").type.value_type
            for at in range(batch.num_rows):
                tile = {name: _array(x.values) if isinstance(x := batch.column(name)[at], pa.ListScalar) else x.as_py() for name in batch.schema.names}
                if block is not None and tile["q_block"] != block:
                    yield out()
                    held = None
                block, ids = tile["q_block"], tile["q_id"]
                held = step(tile, held)
        if held is not None:
            yield out()

    return _met(blocks, "id", *more).mapInArrow(reduce, ", ".join(f"{name} {x}" for name, x in zip(names, (kind, kind, "double", "int"))))


def near_pairs_lsh(frame: DataFrame, key: str, vector: str, threshold: float = 0.99, tables: int = 8) -> DataFrame:
    """The same by random projections and an exact check: linear in the rows, but a pair can be missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    # written first, as the filter could otherwise run after the conversion, which can't take nulls
    directed = durable(frame.select(F.col(key).alias("id"), unit(F.col(vector).cast("array<double>")).alias("v")).filter("v is not null"))
    rows = directed.select("id", array_to_vector("v").alias("features"))
    reach = (2 - 2 * threshold) ** 0.5
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="buckets", bucketLength=max(4 * reach, 0.2), numHashTables=tables, seed=7).fit(rows)
    joined = model.approxSimilarityJoin(rows, rows, reach + 1e-9, "distance").filter("datasetA.id < datasetB.id")
    return joined.select(F.col("datasetA.id").alias("id_a"), F.col("datasetB.id").alias("id_b"), F.round(1 - F.col("distance") ** 2 / 2, 6).alias("similarity"))


def endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()


def best_partner(pairs: DataFrame) -> DataFrame:
    """(id, partner, similarity): the most similar other row, the smaller id of equals."""
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("partner"), "similarity").unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("partner"), "similarity"))
    return both.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "partner")).alias("b")).select("id", F.col("b.partner").alias("partner"), (-F.col("b.s")).alias("similarity"))


def nearest(frame: DataFrame, key: str, vector: str, k: int, within: str | None = None) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest other rows by Euclidean distance, ties by id.

    A task holds a block of rows against all blocks of another partition one by one and keeps k of each row, so that
    what is shuffled is k rows a row and partition, not a tile. With `within`, only rows of another value of that
    column count (training rows for a fold).
    """
    return _nearest(frame, key, vector, k, within, (within is not None,)).drop("across")


def nearest_both(frame: DataFrame, key: str, vector: str, k: int, within: str) -> DataFrame:
    """nearest() of all rows (across 0) and of those of another `within` (across 1), by one pass over the pairs."""
    return _nearest(frame, key, vector, k, within, (False, True))


def _nearest(frame: DataFrame, key: str, vector: str, k: int, within: str | None, ways: tuple[bool, ...]) -> DataFrame:
    fold = F.col(within).cast("int") if within else F.lit(-1)
    rows = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), fold.alias("fold"))

    limits = [f"limit{way}" for way in range(len(ways))]

    def step(tile: dict, held: list[Nearest] | None) -> list[Nearest]:
        q, b = _matrix(tile["q_v"], len(tile["q_id"])), _matrix(tile["b_v"], len(tile["b_id"]))
        held = held or [Nearest.none(tile[f"q_{name}"], k, tile["b_id"]) for name in limits]

        def barred(way: int, a: np.ndarray, c: np.ndarray) -> np.ndarray:
            same = tile["q_id"][a] == tile["b_id"][c]
            return same | (tile["q_fold"][a] == tile["b_fold"][c]) if ways[way] else same

        for a, c, distance in _candidates(q, b, k, [x.limit for x in held], barred):
            for way, lists in enumerate(held):
                own = ~barred(way, a, c) & (distance <= lists.limit[a])
                lists.add(a[own], distance[own], tile["b_id"][c[own]])
        return held

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the distance of the k-th of each row within its block, beyond which nothing needs to be looked at."""
        for batch in batches:
            found = [[] for _ in ways]
            for at in range(batch.num_rows):
                own = {name: _array(batch[name][at].values) for name in ("id", "fold")} | {"v": batch["v"][at].as_py()}
                tile = {f"{side}_{name}": x for side in "qb" for name, x in own.items()} | {f"q_{name}": np.full(len(own["id"]), np.inf) for name in limits}
                for lists, way in zip(step(tile, None), found):
                    way.append(lists.limit)
            for name, way in zip(limits, found):
                batch = batch.append_column(name, pa.array(way, pa.list_(pa.float64())))
            yield batch

    def told(ids: np.ndarray, held: list[Nearest]) -> tuple:
        out = []
        for way, lists in zip(ways, held):
            row, place = np.nonzero(np.isfinite(lists.distance))
            out.append((ids[row], lists.id[row, place], lists.distance[row, place], np.full(len(row), int(way), np.int32)))
        return tuple(map(np.concatenate, zip(*out)))

    packed = _blocks(rows, "fold", most=4)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields] + [f"{name} array<double>" for name in limits]
    blocks = durable(packed.mapInArrow(limited, ", ".join(kinds)), FILE_BLOCKS)
    tiles = _reduced(blocks, step, told, "id", "neighbour", "distance", "across", more=("fold", *limits))
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    return tiles.groupBy("id", "across").agg(best.alias("b")).select("id", "across", F.posexplode("b").alias("rank", "n")).select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"), "across")


@dataclass
class Nearest:
    """The k nearest so far of each row of a block, in order; a distance of infinity stands for none. Nothing beyond a row's limit counts."""

    distance: np.ndarray
    id: np.ndarray
    limit: np.ndarray

    @staticmethod
    def none(limit: np.ndarray, k: int, ids: np.ndarray) -> Nearest:
        return Nearest(np.full((len(limit), k), np.inf), np.zeros((len(limit), k), ids.dtype), limit.copy())

    def add(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        k = self.distance.shape[1]
        if ids.dtype != self.id.dtype:  # longer texts
            self.id = self.id.astype(np.promote_types(ids.dtype, self.id.dtype))
        met, at = np.unique(row, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(met)), k), at])
        distance, ids = np.concatenate([self.distance[met].ravel(), distance]), np.concatenate([self.id[met].ravel(), ids])
        order = np.lexsort((ids, distance, place))
        start = np.searchsorted(place[order], np.arange(len(met)))
        first = order[start[:, None] + np.arange(k)]
        self.distance[met], self.id[met] = distance[first], ids[first]
        self.limit[met] = np.minimum(self.limit[met], self.distance[met, -1])


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """What at least k values of each row reach, or all where there are fewer: the k-th greatest of the parts' greatest."""
    wide = values.shape[1] // PARTS
    if wide > 1 and 4 * k <= PARTS:
        values = values[:, : wide * PARTS].reshape(len(values), PARTS, wide).max(axis=2)
    nth = values.shape[1] - min(k, values.shape[1])
    return np.partition(values, nth, axis=1)[:, nth]


def _candidates(q: np.ndarray, b: np.ndarray, k: int, limits: list[np.ndarray], barred: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of b, distance) of all pairs that may be among the k nearest of a row in a way, of which nothing beyond its limit counts.

    Pairs are looked through by products in single precision, whose rounding has a bound: none that counts is
    lost, and those left get their distances in double precision. Where single precision leaves too many, double takes its place.
    """
    around = b.mean(0)  # products of what is far from the origin would lose the digits that count
    around[~np.isfinite(around)] = 0
    x, y = q - around, b - around
    x2, y2 = (x**2).sum(1), (y**2).sum(1)
    reach = y2[np.isfinite(y2)].max(initial=0)
    large = max(reach, x2[np.isfinite(x2)].max(initial=0)) > 1e30
    # q.b - |b|^2 / 2 falls as the distance of a row of q grows
    base = np.column_stack([y, -y2 / 2])
    kinds = {kind: base.T.astype(kind) for kind in ((np.float64,) if large else (np.float32,))}
    for at in range(0, len(q), STEP_ROWS):
        part = np.arange(at, min(at + STEP_ROWS, len(q)))
        rows = np.column_stack([x[part], np.ones(len(part))])
        for kind in (np.float64,) if large else (np.float32, np.float64):
            if kind not in kinds:
                kinds[kind] = base.T.astype(kind)
            with np.errstate(invalid="ignore", over="ignore"):
                near = rows.astype(kind) @ kinds[kind]
                slack = (x.shape[1] + 8) * (2 * float(np.finfo(kind).eps) * (np.sqrt(x2[part] * reach) + reach + x2[part]) + 2 * float(np.finfo(kind).tiny))
                least = np.full(len(part), np.inf)
                for way, known in enumerate(limits):
                    last = known[part]
                    limit = (x2[part] - last**2) / 2
                    if len(open_ := np.nonzero(np.isinf(last))[0]):
                        own = near[open_]
                        own[barred(way, part[open_, None], np.arange(len(b))[None, :]) | np.isnan(own)] = -np.inf
                        limit[open_] = _least(own, k) - slack[open_]
                    least = np.minimum(least, limit)
                bound = np.maximum((least - slack).astype(kind), np.finfo(kind).min)  # what is barred or no number has no products
                a, c = np.divmod(np.flatnonzero(near >= bound[:, None]), len(b))
            if kind == np.float64 or len(a) <= max(8 * len(part) * k * len(limits), near.size // 64):
                break
        for first in range(0, len(a), MOST_PAIRS):
            one, other = part[a[first : first + MOST_PAIRS]], c[first : first + MOST_PAIRS]
            yield one, other, np.sqrt(((q[one] - b[other]) ** 2).sum(1))
