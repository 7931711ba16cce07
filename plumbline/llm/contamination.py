"""Benchmark decontamination by greedy string tiling.

Texts are read as tokens: runs of ASCII letters, digits and non-ASCII characters, ASCII in lower case. A
document and an item (a benchmark text) that share a seed, SEED tokens in a row found by their Karp-Rabin
hash (a polynomial of the tokens, rolled along by prefix sums), are tiled: the longest match of tokens that
no tile has yet covered on either side becomes a tile, again and again, until none of SEED tokens is left.
One run finds all matches; each later turn takes the longest from a heap and cuts what tiles now cover, which
gives the tiles that another run over the rest would. Tiles that count are compared by their words' bytes,
and a pair in which hashes collided is tiled again by whole words. The share of the item's tokens under tiles is its
coverage. As tiles may lie in any order, reordered passages are caught too. A document is contaminated
by an item that it covers by LEAST or more.

The items' seeds go to all tasks while there are at most MOST_SEEDS of them, which is checked; a larger
benchmark is joined on its seeds instead, with equal results. Work grows with documents that hold seeds.

Defined results: null and empty texts have no tokens; an item of under SEED tokens can't be told from
chance and matches nothing; texts of any length are tiled whole; of equally long matches the one that
begins first in the item, then in the document, becomes the tile; repeated rows give repeated results;
a null id is kept; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, mapped, text_of
from plumbline.llm.polyhash import Prefixes, U, mixed, powers

SEED = 5
LEAST = 0.5
MOST_SEEDS = 1 << 21

_BASE = 0x8EBC6AF09C88C6E3
_SEED_BASE = 0xD1342543DE82EF95
_STEP = U(0x9E3779B97F4A7C15)
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TILES = "array<struct<item_start:int,doc_start:int,length:int>>"
_RESULT = f"coverage double, tiles {_TILES}"


def tokens(text: bytes) -> np.ndarray:
    """A hash of each token."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], _TOKEN[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, U)
    start, size = edges[::2], edges[1::2] - edges[::2]
    prefixes = Prefixes(_LOWER[raw], _BASE, 5, 1 << max(12, len(raw).bit_length()))
    return mixed(prefixes.of(start, size) + size.astype(U) * _STEP)


def seeds(own: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The Karp-Rabin hash of each run of `seed` tokens."""
    n = max(0, len(own) - seed + 1)
    up, down = powers(_SEED_BASE, 1 << max(12, len(own).bit_length()))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(own * up[: len(own)], dtype=U)])
    return mixed((sums[seed : seed + n] - sums[:n]) * down[:n])


def words(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.translate(bytes(_LOWER)))


def same_words(item: list[bytes], doc: list[bytes], tiles: list[tuple[int, int, int]]) -> bool:
    """Whether the words under the tiles are the same, byte by byte."""
    return all(item[i : i + n] == doc[d : d + n] for i, d, n in tiles)


def tiled_by_words(item: list[bytes], doc: list[bytes], seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles without hashes: words are numbered, and runs of `seed` words looked up as they are."""
    number: dict[bytes, int] = {}
    own, other = (np.array([number.setdefault(word, len(number)) for word in text], dtype=U) for text in (item, doc))
    places: dict[tuple, list[int]] = {}
    for at in range(len(item) - seed + 1):
        places.setdefault(tuple(item[at : at + seed]), []).append(at)
    pairs = [(i, d) for d in range(len(doc) - seed + 1) for i in places.get(tuple(doc[d : d + seed]), ())]
    if not pairs:
        return []
    at_item, at_doc = map(np.array, zip(*pairs))
    return tile(own, other, at_item, at_doc, seed)


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), given all places where they share a seed."""
    order = np.lexsort((at_item, at_doc - at_item))
    at_item, at_doc = at_item[order], at_doc[order]
    new = np.concatenate([[True], (at_item[1:] != at_item[:-1] + 1) | (at_doc[1:] != at_doc[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(at_item)]])) + seed - 1
    heap = [(-int(n), int(i), int(d)) for n, i, d in zip(length, at_item[first], at_doc[first])]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        # tokens that are free on both sides and truly equal, as hashes may collide
        free = ~(in_item[i : i + n] | in_doc[d : d + n]) & (item[i : i + n] == doc[d : d + n])
        if free.all():
            in_item[i : i + n], in_doc[d : d + n] = True, True
            tiles.append((i, d, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= seed:
                heapq.heappush(heap, (-int(b - a), i + int(a), d + int(a)))
    return sorted(tiles)


@dataclass
class Index:
    """Seeds of a bounded benchmark, sorted, each with its item and its place there."""

    ids: list
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    raws: list[bytes]

    @classmethod
    def of(cls, rows: list[tuple], seed: int) -> "Index":
        items = [tokens(raw) for _, raw in rows]
        found = [seeds(item, seed) for item in items]
        hashes = np.concatenate([np.zeros(0, U), *found])
        item = np.repeat(np.arange(len(items)), [len(f) for f in found]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(f)) for f in found)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        # about one place in sixteen is taken, so that a pair's sieve is small
        sieve = np.zeros(1 << min(24, max(8, (16 * len(hashes)).bit_length())), bool)
        sieve[(hashes & U(len(sieve) - 1)).astype(np.int64)] = True
        return cls([row[0] for row in rows], items, hashes[order], item[order], place[order], sieve, [row[1] for row in rows])

    def matches(self, raw: bytes, seed: int, least: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item number, coverage, tiles) of each item that shares a seed and is covered by `least` or more."""
        doc = tokens(raw)
        own = seeds(doc, seed)
        maybe = np.flatnonzero(self.sieve[(own & U(len(self.sieve) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return
        begin, end = (np.searchsorted(self.hashes, own[maybe], side) for side in ("left", "right"))
        times = end - begin
        at_doc = np.repeat(maybe, times)
        at = np.repeat(begin, times) + np.arange(len(at_doc)) - np.repeat(np.cumsum(times) - times, times)
        for number in np.unique(self.item[at]):
            here = self.item[at] == number
            tiles = tile(self.items[number], doc, self.place[at[here]], at_doc[here], seed)
            if sum(t[2] for t in tiles) < least * len(self.items[number]):
                continue
            if not same_words(item := words(self.raws[number]), found := words(raw), tiles):
                tiles = tiled_by_words(item, found, seed)
            if (coverage := sum(t[2] for t in tiles) / len(item)) >= least:
                yield int(number), coverage, tiles


def _tile_rows(batches: Iterator[pa.RecordBatch], index: Callable[[], Index], seed: int, least: float) -> Iterator[pa.RecordBatch]:
    own = index()
    for rows in batches:
        out = []
        for doc_id, raw in zip(rows["doc_id"].to_pylist(), rows["raw"]):
            out += [(doc_id, own.ids[n], coverage, tiles) for n, coverage, tiles in own.matches(raw.as_py(), seed, least)]
        yield _result(out)


def _result(out: list[tuple]) -> pa.RecordBatch:
    tile_kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    doc_ids, item_ids, coverages, tiles = zip(*out) if out else ((), (), (), ())
    tiles = [[{"item_start": i, "doc_start": d, "length": n} for i, d, n in t] for t in tiles]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.int64()), pa.array(coverages, pa.float64()), pa.array(tiles, tile_kind)], ["doc_id", "item_id", "coverage", "tiles"])


def _clean_rows(batches: Iterator[pa.RecordBatch], index: Callable[[], Index], seed: int, least: float) -> Iterator[pa.RecordBatch]:
    own = index()
    for rows in batches:
        texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
        yield rows.filter(pa.array([not any(True for _ in own.matches((text or "").encode(), seed, least)) for text in texts], pa.bool_()))


def _pair_rows(batches: Iterator[pa.RecordBatch], seed: int, least: float) -> Iterator[pa.RecordBatch]:
    """The same for pairs of texts that a join has brought together."""
    for rows in batches:
        out = []
        for doc_id, item_id, raw, item in zip(*(rows[name].to_pylist() for name in ("doc_id", "item_id", "raw", "item"))):
            out += [(doc_id, item_id, coverage, tiles) for _, coverage, tiles in Index.of([(0, item)], seed).matches(raw, seed, least)]
        yield _result(out)


def _seed_rows(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [np.unique(seeds(tokens(raw.as_py()), seed)).view(np.int64) for raw in rows["raw"]]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows["key"].to_numpy(), [len(f) for f in found])), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["key", "seed"])


def _bounded_index(items: DataFrame, seed: int, most: int) -> Callable[[], Index] | None:
    """The items' index for all tasks, or None if they have more seeds than `most`.

    Tokens are at least a byte and a separator apart, so half the bytes bound the seeds.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 1), F.lit(0)).alias("n")).first()["n"]
    if size > 2 * most:
        return None
    rows = items.sparkSession.sparkContext.broadcast([(row["item_id"], bytes(row["item"])) for row in items.collect()])
    held: list[Index] = []

    def index() -> Index:
        if not held:
            held.append(Index.of(rows.value, seed))
        return held[0]

    return index


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), text_of("text").cast("binary").alias("item"))


def find(documents: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each document and each item that it covers by `least` or more."""
    items = _items(benchmark)
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").cast("binary").alias("raw"))
    schema = f"doc_id long, item_id long, {_RESULT}"
    index = _bounded_index(items, seed, most_seeds)
    if index is not None:
        return texts.mapInArrow(lambda batches: _tile_rows(batches, index, seed, least), schema)
    pairs = _pairs(texts.withColumn("key", F.xxhash64("raw")), items, seed)
    return pairs.select("doc_id", "item_id", "raw", "item").mapInArrow(lambda batches: _pair_rows(batches, seed, least), schema)


def _pairs(texts: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """Rows of `texts` (key, raw, ...) with each item (item_id, item) that shares a seed; no row is lost if keys collide."""
    keyed = items.withColumn("number", F.xxhash64("item_id", "item"))
    of_items = keyed.select(F.col("number").alias("key"), F.col("item").alias("raw")).mapInArrow(lambda batches: _seed_rows(batches, seed), "key long, seed long").withColumnRenamed("key", "number")
    of_texts = texts.select("key", "raw").mapInArrow(lambda batches: _seed_rows(batches, seed), "key long, seed long")
    shared = durable(of_texts.join(of_items, "seed").select("key", "number").distinct())
    return texts.join(shared, "key").join(keyed, "number")


def without_leaks(documents: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """The rows of `documents` that no item contaminates, with all their columns."""
    items = _items(benchmark)
    index = _bounded_index(items, seed, most_seeds)
    if index is not None:
        return mapped(documents, lambda batches: _clean_rows(batches, index, seed, least))
    # rows are told apart by their text, as equal texts share their fate
    texts = documents.select(text_of("text").cast("binary").alias("raw")).distinct().withColumn("key", F.xxhash64("raw"))
    named = _pairs(texts, items, seed).select(F.col("key").alias("doc_id"), "item_id", "raw", "item")
    bad = named.mapInArrow(lambda batches: _pair_rows(batches, seed, least), f"doc_id long, item_id long, {_RESULT}")
    return documents.join(bad.select("doc_id").distinct(), F.xxhash64(text_of("text").cast("binary")) == bad["doc_id"], "left_anti")
