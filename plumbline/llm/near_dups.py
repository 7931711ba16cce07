"""Near-duplicate documents by weighted Jaccard similarity of their word shingles, with BagMinHash.

A document is the multiset of its shingles of SHINGLE consecutive words. The signature draws, for each
shingle, a Poisson process of points over time for each dyadic block of its weight axis ([0, 1), [1, 2),
[2, 4), ...); a point counts if it lies below the shingle's weight, so that the blocks refine the weight
hierarchically, and it falls to one of SIZE components. A component keeps its first point. Two documents
share it with a probability of just their weighted Jaccard similarity. Points are drawn up to a time by
which all components are most likely to have one, so that long documents draw about one point a shingle.

1. Documents with equal multisets are one node, named by the least id.
2. Signatures are banded: nodes that agree in all ROWS components of one of the bands meet in a bucket.
3. A bucket's centre is the node whose buckets are largest altogether. Every other node is verified with
   it by the exact multiset overlap, so that groups of any size take linear work.
4. Nodes that aren't in the class of a centre of theirs are then held against all nodes that share the
   centre, block by block, by exact overlaps from inverted lists, and what joins two classes is a link.
5. Links of LEAST similarity or more make classes by connected components.

Defined results: a text of fewer than SHINGLE words is one shingle, texts without words (null, empty or
white space) are equal to each other; a null id counts as the smallest; rows with the same id are one
document, so their classes merge, and each gets a row; ties go to the smaller id; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_of, whole_groups
from plumbline.llm.polyhash import Prefixes, U, mixed
from plumbline.operators.graph import components

SHINGLE = 5
LEAST = 0.8
SIZE = 128
ROWS = 4
BLOCK_NODES = 4_000
BLOCK_BYTES = 8 << 20

_BASE = 0xA24BAED4963EE407
_STEP, _OTHER, _BLOCK = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_NULL_ID = -(1 << 63)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, a run of anything but ASCII white space."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.zeros(0, U)
    prefixes = Prefixes(raw, _BASE, 3, 1 << max(12, len(raw).bit_length()))
    return mixed(prefixes.of(start, size) + size.astype(U) * _STEP)


def shingles(text: bytes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, as sorted hashes, and how often each occurs."""
    words = word_hashes(text)
    n = max(1, len(words) - width + 1) if len(words) else 0
    total = np.zeros(n, U)
    for at in range(min(width, len(words))):
        total = mixed(total + words[at : at + n] + _STEP)
    return np.unique(total, return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The BagMinHash signature of a multiset: for each component the hash of its first point."""
    if not len(items):
        return np.zeros(size, U)
    blocks = 1 + np.ceil(np.log2(weights)).astype(np.int64)
    owner = np.repeat(np.arange(len(items)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    width = np.where(number == 0, 1.0, 2.0 ** (number - 1))
    low, weight = np.where(number == 0, 0.0, width), weights[owner]
    seeds = mixed(items[owner] + number.astype(U) * _BLOCK)
    horizon = size * (np.log(size) + 5) / float(weights.sum())
    while True:
        times, hashes, places = [], [], []
        live, now, drawn = np.arange(len(seeds)), np.zeros(len(seeds)), 0
        batch = max(1, min(4096, int(horizon * width.mean() * 1.1) + 1))
        while live.size:
            number = np.arange(drawn, drawn + batch).astype(U)
            hashed = mixed(seeds[live][:, None] + (number + U(1)) * _STEP)
            at = now[live][:, None] + np.cumsum(-np.log(((hashed >> U(11)).astype(float) + 0.5) * 2.0**-53) / width[live][:, None], axis=1)
            mark = mixed(hashed + _OTHER)
            inside = low[live][:, None] + width[live][:, None] * ((mark >> U(11)).astype(float) * 2.0**-53) < weight[live][:, None]
            good = (at < horizon) & inside
            times.append(at[good])
            hashes.append(hashed[good])
            places.append((mark[good] & U(size - 1)).astype(np.int64))
            now[live] = at[:, -1]
            live, drawn = live[at[:, -1] < horizon], drawn + batch
        late_first = np.argsort(-np.concatenate(times), kind="stable")
        found, filled = np.zeros(size, U), np.zeros(size, bool)
        component = np.concatenate(places)[late_first]
        found[component] = np.concatenate(hashes)[late_first]
        filled[component] = True
        if filled.all():
            return found
        horizon *= 2


def band_hashes(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = found.reshape(-1, rows)
    total = mixed(np.arange(1, len(parts) + 1).astype(U) * _OTHER)
    for at in range(rows):
        total = mixed(total + parts[:, at] * _STEP)
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        keys, others, bands = [], [], []
        for text in rows["raw"]:
            items, counts = shingles(text.as_py())
            keys.append(int((mixed(items + _STEP) * counts.astype(U)).sum(dtype=U).view(np.int64)))
            others.append(int((mixed(items ^ _OTHER) * counts.astype(U)).sum(dtype=U).view(np.int64)))
            bands.append(band_hashes(signature(items, counts)))
        yield pa.RecordBatch.from_arrays([rows["node"], pa.array(keys), pa.array(others), pa.array(bands, pa.list_(pa.int64()))], ["node", "key", "other", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    last, bag = None, None
    for rows in batches:
        good = []
        for raw_a, raw_b in zip(rows["raw_a"].to_pylist(), rows["raw_b"].to_pylist()):
            if raw_b != last:
                last, bag = raw_b, shingles(raw_b)
            good.append(similarity(shingles(raw_a), bag) >= least)
        yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The (a, b) of `pairs` that are similar; `texts` is (node, raw), with a row for each text of a node."""
    named = pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("raw_a")), "a")
    named = named.join(texts.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), "b")
    return named.select("a", "b", "raw_a", "raw_b").mapInArrow(lambda batches: _verify(batches, least), "a long, b long")


def _elements(text: bytes) -> np.ndarray:
    """A shingle's first occurrence, its second, and so on, as elements of a set: multisets overlap as these sets do."""
    items, counts = shingles(text)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(items, counts) + turn.astype(U) * _BLOCK)


def _missing_links(node: np.ndarray, own: np.ndarray, queries: np.ndarray, base: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of `queries` to `base` that join two classes, a spanning few of them, by counting overlaps over inverted lists."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(base)), sizes[base])
    values, inverse, lengths = np.unique(np.concatenate([sets[i] for i in base]), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(inverse, kind="stable")]
    begins = np.cumsum(lengths) - lengths
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    links = []
    for x in queries:
        place = np.searchsorted(values, sets[x])
        place[place == len(values)] = 0
        place = place[values[place] == sets[x]]
        n = lengths[place]
        at = np.repeat(begins[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(holders[at], minlength=len(base))
        union = sizes[x] + sizes[base] - shared
        for y in base[(own[base] != own[x]) & (shared >= least * union) & (union > 0)]:
            if root(int(own[x])) != root(int(own[y])):
                parent[root(int(own[y]))] = root(int(own[x]))
                links.append((int(node[x]), int(node[y])))
    return links


def _link_rows(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "unit", 1):
        unit, node, own, query = (table[name].to_numpy() for name in ("unit", "node", "own", "query"))
        sets = [_elements(raw) for raw in table["raw"].to_pylist()]
        links = []
        for one in np.unique(unit):
            queries, base = np.flatnonzero((unit == one) & query), np.flatnonzero((unit == one) & ~query)
            if len(queries) and len(base):
                links += _missing_links(node, own, queries, base, sets, least)
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def rest_links(members: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) that link what the centres left apart; `members` is (centre, node, own, open).

    Each open node is held against all nodes of its centre that aren't in its class. A centre's nodes are
    dealt to blocks of at most BLOCK_NODES nodes or BLOCK_BYTES on average, and a task holds two blocks;
    what leaves it is at most a link for each class that it joins to another.
    """
    full = members.join(members.filter("open").select("centre").distinct(), "centre").join(texts, "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.length("raw")) / BLOCK_BYTES)).cast("int")
    dealt = full.join(full.groupBy("centre").agg(blocks.alias("blocks")), "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    columns = ["node", "own", "raw"]
    queries = dealt.filter("open").select("centre", *columns, "block", other).select(F.xxhash64("centre", "block", "other").alias("unit"), *columns, F.lit(True).alias("query"))
    base = dealt.select("centre", *columns, "block", other).select(F.xxhash64("centre", "other", "block").alias("unit"), *columns, F.lit(False).alias("query"))
    return queries.unionByName(base).repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: _link_rows(batches, least), "a long, b long")


def classes(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class) and class_size."""
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("node"), text_of("text").cast("binary").alias("raw"))
    signed = durable(texts.mapInArrow(_sign, "node long, key long, other long, bands array<long>"))
    heads = signed.groupBy("key", "other").agg(F.min("node").alias("head"))
    named = durable(signed.select("node", "key", "other").join(heads, ["key", "other"]).select("node", "head").distinct())
    # one row for each distinct text: the row of the least id
    single = signed.join(heads, ["key", "other"]).filter("node = head").dropDuplicates(["node", "key", "other"])

    banded = single.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = durable(banded.join(sizes, "band"))
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weight, "node")
    centres = weighed.groupBy("band").agg(F.max(F.struct("weight", F.bitwise_not("node").alias("first"), F.col("node").alias("centre"))).getField("centre").alias("centre"))
    stars = durable(shared.join(centres, "band").select("band", "node", "centre"))
    chosen = durable(texts.join(weight.select("node"), "node").dropDuplicates(["node", "raw"]))

    links = durable(verified(stars.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), chosen, least))
    found = durable(components(links))

    # what a bucket's centre did not settle
    in_class = stars.select("centre", "node").distinct().join(found, "node", "left").select("node", "centre", F.coalesce("class_id", "node").alias("own"))
    in_class = in_class.join(found.select(F.col("node").alias("centre"), F.col("class_id").alias("of_centre")), "centre", "left")
    members = durable(in_class.select("centre", "node", "own", (F.col("own") != F.coalesce("of_centre", "centre")).alias("open")))
    links = durable(links.unionByName(rest_links(members, chosen, least)))

    # one id may stand for several texts, which then are linked
    links = links.unionByName(named.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    ends = components(links)
    ids = texts.select("node").join(ends, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))
    count = ids.groupBy("class_id").agg(F.count("*").alias("class_size"))
    own = lambda name: F.when(F.col(name) != _NULL_ID, F.col(name))
    return ids.join(count, "class_id").select(own("node").alias("doc_id"), own("class_id").alias("class_id"), "class_size")


def without_duplicates(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class of `documents`, that of its least doc_id, with all columns; of several rows with that id the one with the least text."""
    node, turn = "__node", "__turn"
    while {node, turn} & set(documents.columns):
        node, turn = node + "_", turn + "_"
    keep = classes(documents, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias(node)).distinct()
    named = documents.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).join(keep, node, "left_semi")
    columns = ["`" + name.replace("`", "``") + "`" for name in documents.columns]
    rest = [column for column in columns if column not in ("`doc_id`", "`text`")]
    first = Window.partitionBy(node).orderBy("text", *([F.to_json(F.struct(*rest))] if rest else []))
    return named.withColumn(turn, F.row_number().over(first)).filter(F.col(turn) == 1).select(*columns)
