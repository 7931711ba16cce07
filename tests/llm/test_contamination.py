import random
import re

import pytest

from plumbline.llm import contamination


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def tiled(item, doc, seed=5):
    """Coverage and tiles by comparing all places."""
    in_item, in_doc, tiles = [0] * len(item), [0] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not in_item[i + n] and not in_doc[d + n]:
                    n += 1
                if n >= seed and (best is None or n > best[0]):
                    best = n, i, d
        if best is None:
            return sum(in_item) / max(1, len(item)), sorted(tiles)
        n, i, d = best
        in_item[i : i + n] = in_doc[d : d + n] = [1] * n
        tiles.append((i, d, n))


def fixture():
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(3, 30)))) for i in range(8)] + [(50, None), (51, "a b")]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(3):
            item = random.choice(items[:8])[1].split()
            half = len(item) // 2
            parts += random.choice([item, item[half:] + item[:half], [random.choice(vocabulary) for _ in range(10)]])
        docs.append((i, ", ".join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    return docs + [(100, None), (101, ""), (None, items[4][1]), (5, docs[5][1])], items


@pytest.mark.parametrize("most_seeds", [contamination.MOST_SEEDS, 1])
def test_like_brute_force_with_and_without_broadcast(spark, most_seeds):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for doc_id, text in docs:
        for item_id, item in items:
            coverage, tiles = tiled(words(item), words(text))
            if len(words(item)) >= 5 and coverage >= contamination.LEAST:
                expected.append((doc_id, item_id, coverage, tiles))
    got = [(r[0], r[1], r[2], [tuple(t) for t in r[3]]) for r in contamination.find(d, b, most_seeds=most_seeds).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and expected
    bad = {row[0] for row in expected}
    kept = contamination.without_leaks(d.selectExpr("text", "doc_id", "1 as raw"), b, most_seeds=most_seeds).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted((r for r in docs if r[0] not in bad), key=str)
    assert contamination.find(d.limit(0), b, most_seeds=most_seeds).count() == 0
    assert contamination.find(d, b.limit(0), most_seeds=most_seeds).count() == 0


def test_collisions_are_settled_by_words(monkeypatch):
    items, doc = [(1, b"a b c d e f"), (2, b"v w x y z")], b"one a b c d e f two"
    monkeypatch.setattr(contamination, "tokens", lambda raw: contamination.np.ones(len(contamination.words(raw)), contamination.U))
    assert [(n, c) for n, c, _ in contamination.Index.of(items, 5).matches(doc, 5, 0.5)] == [(0, 1.0)]


def test_a_very_long_text(spark):
    random.seed(9)
    item = [f"i{n}" for n in range(60)]
    text = " ".join([random.choice("abcdefgh") for _ in range(150_000)] + item[30:] + ["x"] * 50_000 + item[:30])
    got = contamination.find(spark.createDataFrame([(1, text), (2, text[:200_000])], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["coverage"], len(r["tiles"])) for r in got] == [(1, 1.0, 2)]
