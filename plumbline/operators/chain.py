"""Hash chains, sealed records, nonces and evidence bound by hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.functions.text import canonical_value
from plumbline.operators.profile import placed
from plumbline.tables import durable, together

GENESIS = "0" * 64


def link(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


@dataclass(frozen=True)
class Form:
    """How an event is hashed: SHA-256 of `before`, the previous hash and `behind`. An event with a null in either has no hash."""

    before: Column
    behind: Column

    def hash_after(self, previous: Column) -> Column:
        return F.sha2(F.concat(self.before, previous, self.behind), 256)


def piped(payload: str) -> Form:
    """The previous hash, a bar and the payload."""
    return Form(F.lit(""), F.concat(F.lit("|"), F.col(payload).cast("string")))


def nested(events: DataFrame, columns: list[str] | None = None, previous: str = "previous_event_hash", own: str = "event_hash") -> Form:
    """An event as canonical JSON of its columns, nested ones included, with the previous hash among them as `previous` and without its own hash."""
    kinds = {f.name: f.dataType for f in events.schema.fields if f.name not in (previous, own) and (columns is None or f.name in columns)}
    part = lambda name: F.concat(F.lit(json.dumps(name) + ":"), canonical_value(F.col(f"`{name}`"), kinds[name]))
    first, last = sorted(name for name in kinds if name < previous), sorted(name for name in kinds if name > previous)
    before = F.concat(F.lit("{"), *(x for name in first for x in (part(name), F.lit(","))), F.lit(json.dumps(previous) + ':"'))
    return Form(before, F.concat(F.lit('"'), *(x for name in last for x in (F.lit(","), part(name))), F.lit("}")))


def hash_of(before: str | None, previous: str, behind: str | None) -> str | None:
    return None if before is None or behind is None else hashlib.sha256(f"{before}{previous}{behind}".encode()).hexdigest()


def _folded(events: DataFrame, chain: str, seq: str, form: Form, kept: list[str], heads: bool) -> DataFrame:
    """Chains as a stream of their events in order: what a task holds is one batch and the last hash."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, n, sha256 = None, GENESIS, 0, hashlib.sha256
        for rows in batches:
            out: list[tuple] = []
            for key, before, behind in zip(*(rows[name].to_pylist() for name in ("chain", "before", "behind"))):
                if n and key != at:
                    if heads:
                        out.append((at, n, last))
                    n = 0
                if not n:
                    at, last = key, GENESIS
                previous = last or GENESIS
                last = None if before is None or behind is None else sha256(b"%b%b%b" % (before, previous.encode(), behind)).hexdigest()
                if not heads:
                    out.append((previous, last))
                n += 1
            if heads:
                yield _batch(out, rows.schema.field("chain").type)
            else:
                previous, after = zip(*out) if out else ((), ())
                own = [i for i, name in enumerate(rows.schema.names) if name not in ("before", "behind")]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in own), pa.array(previous, pa.string()), pa.array(after, pa.string())], [*(rows.schema.names[i] for i in own), "previous_hash", "event_hash"])
        if heads and n:
            yield _batch([(at, n, last)], pa.array([at]).type)

    plain = events.select(F.col(chain).alias("chain"), F.col(seq).alias("seq"), *(F.col(name).alias(f"kept{i}") for i, name in enumerate(kept)), form.before.cast("binary").alias("before"), form.behind.cast("binary").alias("behind"))
    ordered = together(plain, "chain").sortWithinPartitions("chain", "seq")
    if heads:
        return ordered.mapInArrow(fold, f"chain {plain.schema['chain'].dataType.simpleString()}, n long, head string").withColumnRenamed("chain", chain)
    schema = StructType([f for f in plain.schema.fields if f.name not in ("before", "behind")]).add("previous_hash", "string").add("event_hash", "string")
    return ordered.mapInArrow(fold, schema).toDF(chain, seq, *kept, "previous_hash", "event_hash")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    chain, n, head = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chain, kind), pa.array(n, pa.int64()), pa.array(head, pa.string())], ["chain", "n", "head"])


def _form(payload: str | Form) -> Form:
    return piped(payload) if isinstance(payload, str) else payload


def build(events: DataFrame, chain: str, seq: str, payload: str | Form, kept: list[str] | None = None) -> DataFrame:
    """(chain, seq, payload, previous_hash, event_hash). A chain is a fold over its own events, in order.

    With a Form in place of the payload's name, the columns in `kept` stand for the payload.
    """
    return _folded(events, chain, seq, _form(payload), kept if kept is not None else [payload] if isinstance(payload, str) else [], False)


def head_hash(events: DataFrame, chain: str, seq: str, payload: str | Form) -> DataFrame:
    """(chain, n, head): the last hash of each chain."""
    return _folded(events, chain, seq, _form(payload), [], True)


def verify(events: DataFrame, chain: str, seq: str, payload: str | Form) -> DataFrame:
    """(chain, n, valid, first_error, at): gaps, broken links and changed events; only the first break counts.

    Each event's own hash is checked where it lies and only its outcome is shuffled. Events are then dealt by ranges
    of chain and number, so one chain of any length is checked by many tasks: a task hands on, for each
    chain that it meets, one row with what its neighbours need (its size, its first number and link, its last
    hash) and its first break, and these few rows are put together by chain.
    """
    form = _form(payload)
    good = F.coalesce(F.col("event_hash") == form.hash_after(F.col("previous_hash")), F.col("event_hash").isNull() & form.hash_after(F.col("previous_hash")).isNull())
    kind = events.schema[chain].dataType
    plain = events.select(F.col(chain).alias("chain"), F.col(seq).cast("long").alias("seq"), F.col("previous_hash").alias("previous"), F.col("event_hash").alias("own"), good.alias("good"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        names = ["chain", "part", "n", "first_seq", "first_previous", "last_own", "at", "error"]
        kinds = None

        def out(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

        for rows in batches:
            kinds = kinds or [rows.schema.field("chain").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            done = []
            for key, number, previous, own, fine in zip(*(rows[name].to_pylist() for name in ("chain", "seq", "previous", "own", "good"))):
                if held is None or key != held[0]:
                    if held is not None:
                        done.append(held)
                    held = [key, part, 0, number, previous, None, None, None]
                n = held[2]
                if held[6] is None:
                    skipped = number is None or held[3] is None or number - n != held[3]
                    error = "sequence" if skipped else "link" if n and previous != (held[5] or GENESIS) else None if fine else "hash"
                    if error:
                        held[6:] = n, error
                held[2], held[5] = n + 1, own
            yield out(done)
        if held is not None:
            yield out([held])

    schema = StructType([StructField("chain", kind)]).add("part", "integer").add("n", "long").add("first_seq", "long").add("first_previous", "string").add("last_own", "string").add("at", "long").add("error", "string")
    # written first, as ranges are drawn from a pass of their own
    found = durable(plain).repartitionByRange("chain", "seq").sortWithinPartitions("chain", "seq", "own").mapInArrow(segments, schema)
    # one row for each chain and task that met it
    order = Window.partitionBy("chain").orderBy("part")
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.lag("last_own").over(order), F.lit(GENESIS))
    edge = F.when(~F.col("first_seq").eqNullSafe(start), "sequence").when(~F.col("first_previous").eqNullSafe(before), "link")
    joined = found.withColumns({"start": start, "edge": edge}).withColumn("error", F.coalesce("edge", "error")).withColumn("at", F.when(F.col("edge").isNotNull(), F.col("start")).otherwise(F.col("start") + F.col("at")))
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("at", "error")))
    summed = joined.groupBy("chain").agg(F.sum("n").alias("n"), first.alias("f"))
    return summed.select(F.col("chain").alias(chain), "n", F.col("f").isNull().alias("valid"), F.col("f.error").alias("first_error"), F.col("f.at").alias("at"))


def gaps(rows: DataFrame, chain: str, seq: str) -> DataFrame:
    """(chain, n, first_seq, last_seq, contiguous) of sequence numbers."""
    summed = rows.groupBy(chain).agg(F.count("*").alias("n"), F.count_distinct(seq).alias("d"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    return summed.select(chain, "n", "first_seq", "last_seq", ((F.col("d") == F.col("n")) & (F.col("last_seq") - F.col("first_seq") + 1 == F.col("n"))).alias("contiguous"))


def replays(rows: DataFrame, nonce: str, *order: str) -> DataFrame:
    """Rows whose nonce an earlier row has used, with the number of the use; null and empty nonces count as none.

    A use's number is a place among the nonce's rows in a global order, so a nonce of any number of rows is spread over tasks.
    """
    used = placed(rows.filter(F.length(nonce) > 0), nonce, *order)
    return used.withColumn("use", F.col("__place") + 1).filter("use > 1").drop("__place", "__n")


def verify_seals(records: DataFrame, content: list[str], expected: DataFrame | None = None, signature_ok: Column | None = None) -> DataFrame:
    """`records` with verdict VALID, TAMPERED or UNREGISTERED.

    contentHash must be the hash of the content columns joined by |, no content may be missing, and the
    signature must have been checked: `signature_ok` is a boolean column or a user's UDF; without it no
    record is valid. `expected` (modelAssetID, registered_digest) binds records to registered models.
    """
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in content)), 256)
    whole = F.lit(True)
    for name in content:
        whole &= F.col(name).isNotNull()
    good = whole & F.coalesce(F.col("contentHash") == digest, F.lit(False)) & F.coalesce(signature_ok if signature_ok is not None else F.lit(False), F.lit(False))
    if expected is None:
        return records.withColumn("verdict", F.when(good, "VALID").otherwise("TAMPERED"))
    bound = records.join(F.broadcast(expected), "modelAssetID", "left")
    return bound.withColumn("verdict", F.when(~good | (F.col("registered_digest") != F.col("modelDigest")), "TAMPERED").when(F.col("registered_digest").isNull(), "UNREGISTERED").otherwise("VALID"))


def seal_summary(verified: DataFrame) -> DataFrame:
    n = F.count("*")
    return verified.agg(n.alias("checked"), F.count_if(F.col("verdict") == "VALID").alias("valid"), F.count_if(F.col("verdict") != "VALID").alias("invalid"), F.when(n == 0, "NO_RECORDS").when(F.count_if(F.col("verdict") != "VALID") > 0, "FAIL").otherwise("PASS").alias("status"))


def unbound(findings: DataFrame, evidence: DataFrame, hash_: str = "evidence_hash") -> DataFrame:
    """(key columns of findings, problem): findings whose evidence is missing or does not have their hash. `evidence` has (evidence_hash, payload)."""
    stored = evidence.select(F.col("evidence_hash").alias(hash_), (F.sha2(F.col("payload").cast("binary"), 256) == F.col("evidence_hash")).alias("same"))
    joined = findings.join(stored, hash_, "left")
    return joined.withColumn("problem", F.when(F.col("same").isNull(), "missing").when(~F.col("same"), "changed")).filter("problem is not null").drop("same")
