import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from plumbline.llm import importance, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def brute(documents, target, percent, most, buckets, least, seed):
    """documents: (doc_id, text); the rows of resample in plain Python."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for texts, counts in ((documents, s), (target, t)):
        for _, text in texts:
            for f in features(text, most)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    rows, able = [], []
    for doc_id, text in documents:
        found, words = features(text, most)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if words >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 191, 1000, 4096, 70_001, 1_500_000])
def test_crc_of_any_length(length):
    raw = np.random.default_rng(length).integers(0, 256, length + 7, dtype=np.uint8)
    starts = np.array([0, 3, 7])
    got = importance.crcs(raw, starts, starts + length)
    assert [int(x) for x in got] == [zlib.crc32(raw[s : s + length].tobytes()) for s in starts]


def test_many_spans_at_once():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 3_000_000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 2_000_000, 60_000), np.minimum(rng.geometric(0.03, 60_000), 400)
    got = importance.crcs(raw, starts, starts + lengths)
    assert all(int(g) == zlib.crc32(raw[s : s + n].tobytes()) for g, s, n in zip(got, starts, lengths))
    assert len(importance.crcs(raw, starts[:0], starts[:0])) == 0


def test_whole_table_like_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    frame = queries.QUERIES["op11_importance_resampling"](spark, SF)
    cursor = con.execute(importance.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    assert frame.columns == names
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_edges_like_brute_force(spark, most):
    long = " ".join(f"w{i % 977}" for i in range(300_000)) + " " + "x" * 200_000
    texts = [None, "", "  ,;  ", "One two-three\nÉÀ 日本 a1B2", long, "Ünï " * 30, "a " * 25, "a " * 25, "b c " * 40, "İ K ſ " * 9, "tail"]
    documents = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, "b c " * 40), (99, "z " * 21)]
    target = [(0, "b c b c"), (1, None), (2, "Éà w1 w2 w3")]
    frame = spark.createDataFrame([(*row, "dup") for row in documents], "doc_id long, text string, score string").repartition(3)
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(frame, aim, percent=50, most=most, buckets=50, least_words=20, seed=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(documents, target, 50, most, 50, 20, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [tuple(r) for r in importance.resample(some, none).collect()] == brute([(1, "a b")], [], 10, 1, 10_000, 20, 2024)
