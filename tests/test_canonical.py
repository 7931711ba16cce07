import datetime
import hashlib
import json
import math
import random
import struct
from decimal import Decimal

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import chain
from plumbline.streaming import operators as streams

HARD = [
    (0.0, "0.0"), (-0.0, "-0.0"), (1.0, "1.0"), (1e15, "1000000000000000.0"), (9999999999999998.0, "9999999999999998.0"), (1e16, "1e+16"), (1.2345678901234568e17, "1.2345678901234568e+17"),
    (1e22, "1e+22"), (1e23, "1e+23"), (2e23, "2e+23"), (1e-4, "0.0001"), (1e-5, "1e-05"), (0.00012, "0.00012"), (5e-324, "5e-324"), (2.2250738585072014e-308, "2.2250738585072014e-308"),
    (1.7976931348623157e308, "1.7976931348623157e+308"), (0.1, "0.1"), (100.5, "100.5"), (-3.25e-7, "-3.25e-07"), (2.0**89, "6.189700196426902e+26"), (9.037182062628436e17, "9.037182062628436e+17"),
    (float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"),
]
STRINGS = [("", '""'), ("a/b", '"a/b"'), ('q"\\', '"q\\"\\\\"'), ("\n\r\t\b\f", '"\\n\\r\\t\\b\\f"'), ("\x00\x1f\x7f", '"\\u0000\\u001f\\u007f"'), ("é", '"\\u00e9"'), ("😀", '"\\ud83d\\ude00"'), ("\\u00e9 é", '"\\\\u00e9 \\u00e9"'), (None, "null")]


def test_doubles_of_a_literal_table(spark):
    frame = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(HARD)], "i int, v double")
    assert [r[0] for r in frame.orderBy("i").select(text.canonical_double(F.col("v"))).collect()] == [t for _, t in HARD]


def test_doubles_like_the_standard_library(spark):
    rng = random.Random(2)
    values = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(2000)] + [rng.random() * 10 ** rng.randint(-8, 24) for _ in range(2000)] + [2.0**k for k in range(-80, 130)]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r[0] for r in frame.orderBy("i").select(text.canonical_double(F.col("v"))).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != json.dumps(v)] == []


def test_strings_of_a_literal_table(spark):
    frame = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(STRINGS)], "i int, v string")
    kind = frame.schema["v"].dataType
    assert [r[0] for r in frame.orderBy("i").select(text.canonical_value(F.col("v"), kind)).collect()] == [t for _, t in STRINGS]


def test_any_nesting(spark):
    schema = "`b.c` struct<z: array<map<string, double>>, a: map<int, string>, n: array<struct<y: boolean, x: bigint>>>, a string, d decimal(10,2), t timestamp, e date"
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    rows = [(([{"é": 1.0, "a": None}, {}, None], {10: "x", 9: None}, [(True, 5), None, (None, None)]), "q", Decimal("1.50"), when, when.date()), (None, None, None, None, None), ((None, None, []), "", None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    first = '{"a":"q","b.c":{"a":{"9":null,"10":"x"},"n":[{"x":5,"y":true},null,{"x":null,"y":null}],"z":[{"a":null,"\\u00e9":1.0},{},null]},"d":1.50,"e":"2024-01-02","t":"2024-01-02T03:04:05.000006"}'
    empty = '{"a":null,"b.c":null,"d":null,"e":null,"t":null}'
    last = '{"a":"","b.c":{"a":null,"n":[],"z":null},"d":null,"e":null,"t":null}'
    assert [r[0] for r in frame.select(text.canonical(frame)).collect()] == [first, empty, last]
    assert frame.select(text.canonical_hash(frame, "a", "d")).first()[0] == hashlib.sha256(b'{"a":"q","d":1.50}').hexdigest()
    with pytest.raises(TypeError):
        text.canonical(spark.createDataFrame([(b"x",)], "v binary"))


def test_any_text_like_the_standard_library(spark):
    # of 15 digits, which the shortest text of a double always shows
    numbers = st.floats(allow_nan=False, allow_subnormal=False).map(lambda x: float(f"{x:.15g}"))

    @settings(max_examples=3, deadline=None, phases=[Phase.generate])
    @given(st.lists(st.tuples(st.text(max_size=30), st.dictionaries(st.text(max_size=5), numbers, max_size=4)), min_size=20, max_size=60))
    def check(rows):
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, s string, m map<string,double>")
        got = [r[0] for r in frame.orderBy("i").select(text.canonical(frame, "s", "m")).collect()]
        assert got == [json.dumps({"s": s, "m": m}, sort_keys=True, separators=(",", ":")) for s, m in rows]

    check()


EVENTS = [("c1", i, "2024-01-01T00:00:00", f"kind{i % 3}", [f"r{i}", "é"], {"score": i / 7, "n": float("1e16")}) for i in range(7)] + [("c2", i, None, "k", [], {}) for i in range(3)]
EVENT = "assessment_id string, sequence_index long, timestamp string, event_type string, reference_ids array<string>, data map<string,double>"


def by_hand(events):
    """Heads of the chains of nested events, with the standard library's JSON."""
    last, rows = {}, {}
    names = ["assessment_id", "sequence_index", "timestamp", "event_type", "reference_ids", "data"]
    for event in sorted(events, key=lambda e: (e[0], e[1])):
        body = dict(zip(names, event)) | {"previous_event_hash": last.get(event[0], "0" * 64)}
        own = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows[event[0], event[1]] = (body["previous_event_hash"], own)
        last[event[0]] = own
    return rows, last


def test_chains_of_nested_events(spark):
    events = spark.createDataFrame(EVENTS, EVENT).repartition(3)
    rows, heads = by_hand(EVENTS)
    form = chain.nested(events)
    assert {r["assessment_id"]: r["head"] for r in chain.head_hash(events, "assessment_id", "sequence_index", form).collect()} == heads
    built = chain.build(events, "assessment_id", "sequence_index", form, ["timestamp", "event_type", "reference_ids", "data"])
    assert {(r["assessment_id"], r["sequence_index"]): (r["previous_hash"], r["event_hash"]) for r in built.collect()} == rows
    check = lambda frame: {r[0]: tuple(r)[1:] for r in chain.verify(frame, "assessment_id", "sequence_index", chain.nested(frame.drop("previous_hash"))).collect()}
    assert check(built) == {"c1": (7, True, None, None), "c2": (3, True, None, None)}
    changed = built.withColumn("data", F.when((F.col("assessment_id") == "c1") & (F.col("sequence_index") == 4), F.create_map(F.lit("score"), F.lit(4 / 7 + 1e-16), F.lit("n"), F.lit(1.0))).otherwise(F.col("data")))
    assert check(changed)["c1"] == (7, False, "hash", 4)


def test_streamed_chains_go_on_after_a_restart(spark, tmp_path):
    many = [("long", i, str(i), "k", [str(i)], {"x": math.sqrt(i)}) for i in range(60)] + EVENTS
    _, heads = by_hand(many)
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENT).schema

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        done = streams.chained(stream, "assessment_id", "sequence_index", chain.nested(stream))
        done.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 2), (2, 5), (5, 60)):
        part = [e for e in many if low <= e[1] < high]
        spark.createDataFrame(part, EVENT).repartition(2).write.mode("append").parquet(source)
        drain()
    got = spark.read.parquet(target)
    assert got.count() == len(many)
    last = got.groupBy("chain").agg(F.max_by("event_hash", "place").alias("head"))
    assert {r["chain"]: r["head"] for r in last.collect()} == heads
