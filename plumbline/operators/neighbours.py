"""Nearest neighbours below the square of the rows, by a partitioned index of coarse centres.

Rows drawn as centres part the space into cells, about 2 sqrt(n) of them, so that the work is that of
n^1.5 instead of n^2. A row is held against the rows of the `probes` cells whose centres are nearest to it.
How many probes it takes is measured, not guessed: for a bounded sample of rows the true neighbours
are found by one pass over all rows, and the least number of probes is taken that reaches the wanted recall
on them. Where that is more than a third of all cells (vectors without any structure have no better
index), the exact tiles of duplicates.nearest answer instead.

Equal vectors are looked up once: of each, and of each fold, only the k + 1 smallest ids can be
neighbours, which are picked before the shuffle. They travel with their vector, so that no neighbour is joined to its ids.
A row is first held against its own cell. What it finds there bounds what can be nearer, and it goes on only to
those of its cells that reach within that bound, which leaves out nothing. So rows are not copied to all their probes.
Cells of many rows are cut into blocks, so that a task holds at most about two blocks whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import duplicates
from plumbline.tables import durable

#: Bytes of all centres, which go to every task, and rows whose distances to them are taken at a time.
MOST_BYTES, ROWS = 16 << 20, 512
#: Bytes of a block's vectors, and distances that are held at a time.
BLOCK_BYTES, MOST_STEPS = 16 << 20, 1 << 20
#: Rows of the sample that the probes are measured on, and what is aimed at beyond the wanted recall.
SAMPLE, MARGIN = 256, 0.02


@dataclass(frozen=True)
class Index:
    """Centres (a row each), probes a query and the recall that the sample had with them."""

    centres: np.ndarray
    probes: int
    recall: float

    def cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the n nearest centres of each row, nearest first."""
        apart = (self.centres**2).sum(1)[None, :] - 2 * rows @ self.centres.T
        near = np.argpartition(apart, n - 1, axis=1)[:, :n] if n < len(self.centres) else np.tile(np.arange(n), (len(rows), 1))
        return np.take_along_axis(near, np.argsort(np.take_along_axis(apart, near, 1), axis=1, kind="stable"), 1)

    def open(self, rows: np.ndarray, cells: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which of its cells can hold something within `bound` of a row; all rows have the same first cell, which is their own.

        What lies in a cell lies beyond the plane halfway between its centre and any other centre.
        """
        used, place = np.unique(cells, return_inverse=True)
        place, own = place.reshape(cells.shape), self.centres[cells[0, 0]]
        centres, x = self.centres[used] - own, rows - own
        apart = np.take_along_axis((centres**2).sum(1)[None, :] - 2 * x @ centres.T, place, 1)
        rounded = 1e-12 * ((rows**2).sum(1) + (self.centres**2).sum(1).max())
        with np.errstate(invalid="ignore"):  # equal centres without a bound
            return ~(apart > 2 * np.sqrt((centres**2).sum(1))[place] * bound[:, None] + rounded[:, None])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def representatives(frame: DataFrame, key: str, vector: str, k: int, within: str | None = None) -> DataFrame:
    """(rid, v, fold, ids): each distinct vector of a fold once, with the k + 1 smallest ids that have it; rid is the smallest."""
    fold = F.col(within).cast("int") if within else F.lit(-1)
    rows = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), fold.alias("fold"))
    equal = Window.partitionBy("v", "fold").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1)  # a group limit is taken in each task before the shuffle
    # a second window instead of groups, which would shuffle vectors again, as they take other zeros for keys
    return few.withColumn("ids", F.collect_list("id").over(equal.rowsBetween(0, k))).filter("n = 1").select(F.col("id").alias("rid"), "v", "fold", "ids")


def _drawn(rows: DataFrame, n: int, seed: int) -> list:
    """The n rows of least seeded hash."""
    return rows.select("rid", "v", "fold").orderBy(F.xxhash64("rid", "fold", F.lit(seed)), "rid", "fold").limit(n).collect()


def true_neighbours(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """(query, rid, v, distance): the k nearest of all `rows` to each of a bounded number of queries, in one pass."""
    vectors, folds = np.array([q["v"] for q in queries]), np.array([q["fold"] for q in queries])
    ids = [q["rid"] for q in queries]

    own = np.array(ids)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for part in batches:
            for at in range(0, len(part), ROWS * 4):
                base = part.iloc[at : at + ROWS * 4]
                b, rid, fold = np.stack(base["v"]), base["rid"].to_numpy(), base["fold"].to_numpy()
                d2 = np.maximum((vectors**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * vectors @ b.T, 0)
                same = fold[None, :] == folds[:, None]
                d2[same & ((rid[None, :] == own[:, None]) | (folds[:, None] >= 0))] = np.inf
                near = np.argpartition(d2, min(k, len(b)) - 1, axis=1)[:, :k]
                held = np.take_along_axis(d2, near, 1), rid[near], b[near]
                if best is not None:
                    both = [np.concatenate(x, axis=1) for x in zip(best, held)]
                    near = np.argpartition(both[0], min(k, both[0].shape[1]) - 1, axis=1)[:, :k]
                    held = tuple(np.take_along_axis(x, near[:, :, None] if x.ndim == 3 else near, 1) for x in both)
                best = held
        if best is not None:
            query, place = np.nonzero(np.isfinite(best[0]))
            if len(query):
                yield pd.DataFrame({"query": query, "rid": best[1][query, place], "v": list(best[2][query, place]), "distance": np.sqrt(best[0][query, place])})

    found = rows.select("rid", "v", "fold").mapInPandas(scan, f"query int, rid {rows.schema['rid'].dataType.simpleString()}, v array<double>, distance double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "rid"))
    return found.withColumn("n", nearest).filter(F.col("n") <= k).drop("n")


def fit(rows: DataFrame, k: int, recall: float = 0.9, seed: int = 7, sample: int = SAMPLE) -> Index:
    """An index over `rows` (rid, v, fold): what leaves the cluster is bounded by MOST_BYTES of centres and k neighbours for each row of the sample."""
    n = rows.count()
    width = len((rows.select("v").first() or ([0.0],))[0])
    size = max(1, min(n, round(2 * n**0.5), MOST_BYTES // (8 * width)))
    centres = np.array([r["v"] for r in _drawn(rows, size, seed)] or [[0.0] * width])
    queries = _drawn(rows, sample, seed + 1)
    index = Index(centres, len(centres), 1.0)
    found = true_neighbours(rows, queries, k).select("query", "v").collect() if queries else []
    if not found:
        return index
    order = index.cells(np.array([q["v"] for q in queries]), len(centres))
    place = np.argsort(order, axis=1)  # of each cell in the order of each query
    needed = np.sort(place[[r["query"] for r in found], index.cells(np.array([r["v"] for r in found]), 1)[:, 0]]) + 1
    probes = int(needed[min(len(needed), int(np.ceil((recall + MARGIN) * len(needed)))) - 1])
    return Index(centres, probes, float((needed <= probes).mean()))


def _closest(q: np.ndarray, b: np.ndarray, ids: np.ndarray, ends: np.ndarray, barred: Callable, limit: np.ndarray, most: int, same: bool = False) -> tuple:
    """(row of q, distance, id) of the `most` nearest ids of each row, in that order, none beyond its limit.

    Row i of b has the ids before ends[i] from ends[i - 1] on. With `same`, q is b, and a row has its own ids at 0.
    """
    found = []
    around = b.mean(0)  # products of what is far from the origin would lose the digits that count
    around[~np.isfinite(around)] = 0
    y = b - around
    y2 = (y**2).sum(1)
    reach = y2[np.isfinite(y2)].max(initial=0)
    starts, step = np.concatenate([[0], ends[:-1]]), max(16, MOST_STEPS // len(b))
    for at in range(0, len(q), step):
        part = np.arange(at, min(at + step, len(q)))
        x = q[part] - around
        x2 = (x**2).sum(1)
        d2 = np.maximum(x2[:, None] + y2[None, :] - 2 * x @ y.T, 0)
        if same:
            d2[np.arange(len(part)), part] = 0
        if (no := barred(part)) is not None:
            d2[no] = np.inf
        nth = min(most, len(b)) - 1
        last = np.partition(d2, nth, axis=1)[:, nth]
        last = np.minimum(np.where(np.isfinite(last), last, np.inf), limit[part] ** 2)
        # the products round differently from the exact distances, so that near ties stay until these are known
        a, c = np.nonzero(np.isfinite(d2) & (d2 <= (last + 1e-9 * (np.where(np.isfinite(x2), x2, 0) + reach))[:, None]))
        distance = np.sqrt(((q[part[a]] - b[c]) ** 2).sum(1))
        if same:
            distance[part[a] == c] = 0
        n = ends[c] - starts[c]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, distance, near = np.repeat(part[a], n), np.repeat(distance, n), ids[np.repeat(starts[c], n) + inner]
        order = np.lexsort((near, distance, a))
        a, distance, near = a[order], distance[order], near[order]
        kept = (np.arange(len(a)) - np.searchsorted(a, a) < most) & (distance <= limit[a])
        found.append((a[kept], distance[kept], near[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _lists(row: np.ndarray, distance: np.ndarray, near: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """The (distance, id) of each of n rows, of arrays sorted by row."""
    entries = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), pa.array(near, kind)], ["distance", "id"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), entries)


def nearest(frame: DataFrame, key: str, vector: str, k: int, within: str | None = None, recall: float = 0.9, seed: int = 7, index: Index | None = None) -> DataFrame:
    """(id, neighbour, distance, rank) as duplicates.nearest gives them, of which at least `recall` are found.

    Distances are exact, ties go to the smaller id; a row may have fewer than k neighbours only where its cells hold fewer.
    """
    rows = durable(representatives(frame, key, vector, k, within))
    index = index or fit(rows, k, recall, seed)
    if index.probes * 3 > len(index.centres):
        return duplicates.nearest(frame, key, vector, k, within)
    kind = rows.schema["rid"].dataType.simpleString()
    block_rows = duplicates.TILE_ROWS * max(1, min(8, BLOCK_BYTES // (8 * index.centres.shape[1] * duplicates.TILE_ROWS)))
    listed = f"array<struct<distance: double, id: {kind}>>"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cells = index.cells(_vectors(part["v"]), index.probes)
                yield part.append_column("cells", pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * index.probes, pa.int32()), pa.array(cells.ravel().astype(np.int32))))

    near = durable(rows.mapInArrow(placed, f"rid {kind}, v array<double>, fold int, ids array<{kind}>, cells array<int>"))
    # a cell of many rows is cut into blocks; their numbers are a row for each centre
    based = near.withColumn("cell", F.col("cells")[0])
    n_blocks = F.broadcast(durable(based.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("i_all"))))

    def own(part: pa.Table) -> pa.Table:
        """What each row of a block has near it there, and the cells that can hold something nearer."""
        part = part.combine_chunks()
        v, fold, ids, cells = _vectors(_whole(part["v"])), part["fold"].to_numpy(), _whole(part["ids"]), _vectors(_whole(part["cells"]))
        entries = ids.flatten()
        found = _closest(v, v, duplicates._array(entries), np.cumsum(ids.value_lengths().to_numpy()), lambda a: fold[a, None] == fold[None, :] if within else None, np.full(len(v), np.inf), k + 1, not within)
        start = np.searchsorted(found[0], np.arange(len(v)))
        full = np.searchsorted(found[0], np.arange(len(v)), "right") - start > k
        bound = np.full(len(v), np.inf)
        bound[full] = found[1][start[full] + k]
        asks = index.open(v, cells, bound)
        asks[:, 0] = part["i_all"][0].as_py() > 1  # the cell's other blocks
        asked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(asks.sum(1))]), pa.int32()), pa.array(cells[asks].astype(np.int32)))
        return part.select(["rid", "v", "fold", "ids", "cell", "i"]).append_column("near", _lists(*found, len(v), entries.type)).append_column("asks", asked)

    block = F.pmod(F.xxhash64("rid", "fold"), F.col("i_all")).cast("int").alias("i")
    dealt = based.join(n_blocks, "cell").select("rid", "v", "fold", "ids", "cells", "cell", "i_all", block)
    first = durable(dealt.groupBy("cell", "i").applyInArrow(own, f"rid {kind}, v array<double>, fold int, ids array<{kind}>, cell int, i int, near {listed}, asks array<int>"))

    # only rows that can find something nearer go to other blocks
    bound = F.when(F.size("near") > k, F.col("near")[k]["distance"]).otherwise(F.lit(float("inf"))).alias("bound")
    asking = first.filter(F.size("asks") > 0)
    asked = asking.select("rid", "v", "fold", bound, F.col("cell").alias("own_cell"), F.col("i").alias("own_i"), F.explode("asks").alias("cell")).join(n_blocks, "cell")
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_all") - 1))).filter("cell <> own_cell or i <> own_i")
    n_asked = F.broadcast(durable(asking.select(F.explode("asks").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("j_all"))))
    base = first.select("cell", "i", "rid", "v", "fold", "ids").join(n_asked, "cell").select("cell", "i", F.explode(F.sequence(F.lit(0), F.col("j_all") - 1)).alias("j"), *(F.col(name).alias(f"b_{name}") for name in ("v", "fold", "ids")))
    queries = asked.join(n_asked, "cell").select("cell", "i", F.pmod(F.xxhash64("rid", "fold", F.lit(1)), F.col("j_all")).cast("int").alias("j"), "rid", "v", "fold", "bound")

    def met(base: pa.Table, queries: pa.Table) -> pa.Table:
        """What rows of other blocks find in a block."""
        ids = _whole(base["b_ids"])
        entries = ids.flatten()
        if not base.num_rows or not queries.num_rows:
            queries, found = queries.slice(0, 0), (np.zeros(0, int), np.zeros(0), entries.slice(0, 0))
        else:
            base_fold, fold = base["b_fold"].to_numpy(), queries["fold"].to_numpy()
            found = _closest(_vectors(_whole(queries["v"])), _vectors(_whole(base["b_v"])), duplicates._array(entries), np.cumsum(ids.value_lengths().to_numpy()), lambda a: fold[a, None] == base_fold[None, :] if within else None, queries["bound"].to_numpy(), k + 1)
        row = np.unique(found[0])
        return queries.select(["rid", "fold"]).take(pa.array(row, pa.int64())).append_column("near", _lists(np.searchsorted(row, found[0]), *found[1:], len(row), entries.type))

    found = base.groupBy("cell", "i", "j").cogroup(queries.groupBy("cell", "i", "j")).applyInArrow(met, f"rid {kind}, fold int, near {listed}")
    more = asking.select("rid", "fold", "near", "ids").unionByName(found, allowMissingColumns=True)
    merged = more.groupBy("rid", "fold").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.max("ids").alias("ids"))
    lists = first.filter(F.size("asks") == 0).select("rid", "fold", "near", "ids").unionByName(merged)
    answers = lists.filter(F.size("ids") <= k).select(F.explode("ids").alias("id"), "near")
    # of vectors of more rows, only the first ids are known here
    many = rows.filter(F.size("ids") > k).select("rid", "v", "fold")
    if n_many := many.count():
        fold = F.col(within).cast("int") if within else F.lit(-1)
        every = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), fold.alias("fold"))
        known = many.join(lists.filter(F.size("ids") > k).select("rid", "fold", "near"), ["rid", "fold"]).select("v", "fold", "near")
        fits = n_many * (8 * index.centres.shape[1] + 32 * (k + 1)) <= MOST_BYTES
        answers = answers.unionByName(every.join(F.broadcast(known) if fits else known, ["v", "fold"]).select("id", "near"))
    own_lists = answers.select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own_lists.select("id", F.posexplode("near").alias("rank", "x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
