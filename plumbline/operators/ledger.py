"""Append-only ledger with first-wins guards, upserts and event folds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import components
from plumbline.operators.profile import placed
from plumbline.tables import durable, together

#: Rounds of joins before the rows still open are folded.
ROUNDS = 8


def first_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__turn = 1").drop("__turn")


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an upsert of changes over a base is this over their union."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).filter("__turn = 1").drop("__turn")


def _classes(rows: DataFrame) -> DataFrame:
    """`rows` with a column component: rows that share an asset or a hash, directly or by way of others."""
    links = [rows.join(rows.groupBy(c).agg(F.min("seq").alias("least")), c).select(F.col("seq").alias("a"), F.col("least").alias("b")) for c in ("asset", "hash")]
    found = components(links[0].unionByName(links[1]))
    return rows.join(found.withColumnRenamed("node", "seq"), "seq", "left").withColumn("component", F.coalesce("class_id", "seq")).drop("class_id")


def first_wins(submissions: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """`submissions` (seq, asset, hash, ...) with status COMMITTED, ASSET_EXISTS or DUPLICATE_EVIDENCE.

    In order of seq, which must be unique, a row is turned away if its asset, or else its hash, is already
    committed; a row that is turned away reserves neither. A null asset or hash clashes with nothing.
    """
    fields = submissions.select("seq", F.col("asset").cast("string"), F.col("hash").cast("string"))
    if committed is not None:
        # a number of its own for each, before those of all submissions; written, as it would be given anew at each reading
        fields = fields.unionByName(durable(committed.select((F.monotonically_increasing_id() - F.lit((1 << 63) - 1)).alias("seq"), F.col("asset").cast("string"), F.col("hash").cast("string"))))
    fields = durable(fields)
    won = _winners(fields.filter("asset is not null or hash is not null"))
    for column in ("asset", "hash"):
        # at most one winner has a key
        fields = fields.join(won.filter(F.col(column).isNotNull()).select(column, F.col("seq").alias(f"by_{column}")), column, "left")
    status = F.when(F.col("by_asset") < F.col("seq"), "ASSET_EXISTS").when(F.col("by_hash") < F.col("seq"), "DUPLICATE_EVIDENCE").otherwise("COMMITTED")
    return submissions.join(fields.select("seq", status.alias("status")), "seq")


def _winners(rows: DataFrame) -> DataFrame:
    """The rows (seq, asset, hash) that are committed.

    In each round those rows win that are the first open ones of both their asset and their hash, and the
    rows that share a key with a winner close. A key of any number of rows takes one round, as its least
    seq is found before the shuffle. What ROUNDS leave open are long chains, in which each row waits for
    the one before; these are folded, each component on its own.
    """
    left, won = rows, []
    for _ in range(ROUNDS):
        first = left
        for column in ("asset", "hash"):
            least = left.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("seq").alias(f"least_{column}"))
            first = first.join(least, column, "left")
        now = durable(first.filter("seq = coalesce(least_asset, seq) and seq = coalesce(least_hash, seq)").select("seq", "asset", "hash"))
        won.append(now)
        left = durable(left.join(now.select("asset"), "asset", "left_anti").join(now.select("hash"), "hash", "left_anti").select("seq", "asset", "hash"))
        if left.isEmpty():
            break
    else:
        ordered = together(_classes(left), "component").sortWithinPartitions("component", "seq")
        won.append(durable(ordered.select("component", "seq", "asset", "hash").mapInPandas(_fold, left.schema)))
    return reduce(DataFrame.unionByName, won)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The winners among rows that come sorted by component and seq; what is held is one component's keys."""
    at, assets, hashes = None, set(), set()
    for part in batches:
        good = np.zeros(len(part), bool)
        for i, (component, asset, hash_) in enumerate(zip(part["component"], part["asset"], part["hash"])):
            if component != at:
                at, assets, hashes = component, set(), set()
            good[i] = (asset is None or asset not in assets) and (hash_ is None or hash_ not in hashes)
            if good[i]:
                assets.add(asset)
                hashes.add(hash_)
        yield part.loc[good, ["seq", "asset", "hash"]]


def append_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks, one a key: what an insert-only sink has to append."""
    return rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def committed_entry(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """`findings` (finding_id, hash, ledger_key) with the latest COMMITTED entry that has its hash or its key."""
    good = entries.filter("status = 'COMMITTED'").select("tx_id", "hash", "ledger_key", "at")
    by_hash = findings.select("finding_id", "hash").join(good.drop("ledger_key"), "hash").select("finding_id", "tx_id", "at")
    by_key = findings.select("finding_id", "ledger_key").join(good.drop("hash"), "ledger_key").select("finding_id", "tx_id", "at")
    best = by_hash.unionByName(by_key).groupBy("finding_id").agg(F.max(F.struct("at", "tx_id")).alias("b"))
    return findings.join(best.select("finding_id", F.col("b.tx_id").alias("tx_id"), F.col("b.at").alias("committed_at")), "finding_id", "left")


def ledger_info(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "COMMITTED").alias("committed"), F.max("block").alias("latest_block"), F.max_by("tx_id", "block").alias("latest_tx"))


def quarantine_state(events: DataFrame, key: str) -> DataFrame:
    """(key, status, steps) from events (key, at, action, actor): the last action, and how many there were. One row a task and key is shuffled."""
    last = F.max(F.struct("at", "action", "actor"))
    return events.groupBy(key).agg(last.alias("last"), F.count("*").alias("steps")).select(key, F.col("last.action").alias("status"), "steps")


def quarantine_timeline(events: DataFrame, key: str) -> DataFrame:
    """`events` with their step, 1 and up within a key in order of time; a key of any number of events is put in order by many tasks."""
    return placed(events, key, "at", "action", "actor").withColumn("step", F.col("__place") + 1).drop("__place", "__n")
