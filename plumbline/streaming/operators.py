"""Streaming forms of the window, replay, ledger and activity operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import fourier
from plumbline.operators.chain import GENESIS, Form, hash_of
from plumbline.operators.drift import Windows, _sample, bandwidth, checked, inner_sum, window_mmd
from plumbline.operators.ledger import first_wins
from plumbline.tables import durable, written


def count_windows(stream: DataFrame, key: str, item: str, ts: str, windows: Windows) -> DataFrame:
    """(key, window_no, items, first_ts, last_ts): complete count windows of each key, as soon as they are whole.

    Rows of a micro-batch are taken in order of time and item; the state of a key is at most a window.
    """
    least, hop = windows.rows, windows.hop

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, items, times = state.get if state.exists else (0, [], [])
        rows = pd.concat(list(parts)).sort_values(["ts", "item"])
        items = [*items, *rows["item"].tolist()]
        times = [*times, *rows["ts"].astype("datetime64[us]").astype("int64").tolist()]
        whole = max(0, (len(items) - least) // hop + 1)
        state.update((number + whole, items[whole * hop :], times[whole * hop :]))
        if whole:
            starts = [hop * i for i in range(whole)]
            first, last = (pd.to_datetime([times[at + shift] for at in starts], unit="us") for shift in (0, least - 1))
            yield pd.DataFrame({"key": name[0], "window_no": range(number, number + whole), "items": [items[at : at + least] for at in starts], "first_ts": first, "last_ts": last})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(item).cast("long").alias("item"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, window_no long, items array<long>, first_ts timestamp, last_ts timestamp", "number long, items array<long>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def replays(stream: DataFrame, nonce: str, item: str, ts: str, keep: str = "2 days", buckets: int = 4096) -> DataFrame:
    """(nonce, item, ts) of events whose nonce was used before; a nonce is forgotten `keep` after the watermark passed its last use.

    Nonces are dealt by hash over `buckets`, each a group with the nonces in use as its state, as a group for each nonce
    costs a call for each. A micro-batch writes the state of the buckets that it meets anew.
    """
    millis = pd.Timedelta(keep).value // 1_000_000

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        now, used, first = state.getCurrentWatermarkMs(), {}, None
        for rows in [] if state.hasTimedOut else parts:
            latest = rows.groupby("nonce", sort=False)["at"].max()
            for own, at in zip(latest.index.tolist(), latest.tolist()):
                used[own] = max(used.get(own, now), at)
            old = rows["nonce"].isin(set(known))
            yield rows.loc[old, ["nonce", "item", "ts"]]
            # of a new nonce all but the first use so far are replays
            fresh = rows.loc[~old, ["nonce", "item", "ts"]]
            fresh = (fresh if first is None else pd.concat([first, fresh])).sort_values(["nonce", "ts", "item"])
            again = fresh.duplicated("nonce")
            yield fresh[again]
            first = fresh[~again]
        for own, at in used.items():
            known[own] = max(known.get(own, 0), at + millis)
        held = {own: until for own, until in known.items() if until >= now}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(min(held.values()))
        elif state.exists:
            state.remove()

    rows = stream.select(F.col(nonce).cast("string").alias("nonce"), F.col(item).cast("long").alias("item"), F.col(ts).cast("timestamp").alias("ts")).filter(F.length("nonce") > 0)
    dealt = rows.withWatermark("ts", "1 hour").select("*", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"), F.pmod(F.xxhash64("nonce"), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandasWithState(fold, "nonce string, item long, ts timestamp", "nonces array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class _Chain(StatefulProcessor):
    """Appends a chain's events in order of their numbers; what it keeps of a chain is its length and last hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "n long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.end.get() if self.end.exists() else (0, GENESIS)
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        hashes = []
        for before, behind in zip(events["before"], events["behind"]):
            previous = last or GENESIS
            last = hash_of(before, previous, behind)
            hashes.append((previous, last))
        self.end.update((n + len(events), last))
        previous, own = zip(*hashes)
        yield pd.DataFrame({"chain": key[0], "seq": events["seq"].to_numpy(), "place": range(n, n + len(events)), "previous_hash": previous, "event_hash": own})

    def close(self) -> None:
        pass


def chained(stream: DataFrame, chain: str, seq: str, form: Form) -> DataFrame:
    """(chain, seq, place, previous_hash, event_hash): events appended to their chains as they come, as chain.build links them in a batch.

    `place` numbers a chain's events from 0. A micro-batch's events of a chain are taken in order of `seq`; the state is one
    value a chain, kept by the RocksDB state store, so a restart from the checkpoint goes on where it stopped.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(chain).cast("string").alias("chain"), F.col(seq).cast("long").alias("seq"), form.before.alias("before"), form.behind.alias("behind"))
    schema = "chain string, seq long, place long, previous_hash string, event_hash string"
    return rows.groupBy("chain").transformWithStateInPandas(_Chain(), schema, "append", "none")


def activity(stream: DataFrame, ts: str, module: str, span: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(bucket, module, n) by tumbling windows of event time; rows more than `late` behind are left out."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", span).alias("w"), module).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), module, "n")


def ledger_sink(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the first-wins rows of a micro-batch (seq, asset, hash) to a Parquet ledger."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        try:
            # a batch that is run again must not meet its own rows
            before = spark.read.parquet(table).filter(F.col("batch") < number).select("asset", "hash")
            done = spark.read.parquet(table).filter(F.col("batch") == number).limit(1).count()
        except Exception as error:  # noqa: BLE001  the ledger does not exist yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            before, done = None, 0
        if not done:
            first_wins(batch.select("seq", "asset", "hash"), before).filter("status = 'COMMITTED'").select("seq", "asset", "hash", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(table)

    return append


def window_check_sink(reference: DataFrame | fourier.Fitted, vectors: DataFrame, key: str, vector: str, threshold: float, target: str, size: int | None = None, sigma: float | None = None, seed: int = 42) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that checks the complete windows of a micro-batch (count_windows' rows) against a reference, as drift.checked does.

    The vectors of a window's items are looked up by `key`. A micro-batch that runs again replaces its own rows.
    What the test needs of the reference alone is worked out once, before the first micro-batch: the kernel's sum over its
    pairs, or nothing at all with a reference that was fitted by fourier.fitted, whose windows are tested in linear time.
    """
    linear = isinstance(reference, fourier.Fitted)
    if not linear:
        sigma = sigma or bandwidth(_sample(reference, key, vector, seed, 512))
        inner = inner_sum(reference, vector, sigma)

    def check(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with written(batch.sparkSession):
            windows = durable(batch.select(F.col("key").alias("stream"), F.col("window_no").alias("number"), F.xxhash64("key", "window_no").alias("window_no"), "items", "first_ts", "last_ts"))
            members = durable(windows.select("window_no", F.explode("items").alias(key)).join(vectors.select(key, vector), key))
            described = windows.select("window_no", "stream", "number", "first_ts", "last_ts", F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("digest"))
            tested = fourier.window_mmd(reference, members, vector) if linear else window_mmd(reference, members, key, vector, seed, sigma=sigma, inner=inner)
            checked(described, tested, threshold, size=size).drop("measured", "declared").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return check


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}*.parquet")


def drained(result: DataFrame, folder: str) -> DataFrame:
    """All rows of a streaming result over what its source has now, by way of a table in a shared folder."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    spark = result.sparkSession
    return spark.read.schema(result.schema).parquet(path)
