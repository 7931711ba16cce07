import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import substrings


def brute(docs, length):
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, raw in texts:
        for at in range(len(raw) - length + 1):
            first[raw[at : at + length]] = min(first.get(raw[at : at + length], (i, at)), (i, at))
    out = []
    for (i, raw), (doc_id, _) in zip(texts, docs):
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if first[raw[at : at + length]] < (i, at):
                gone[at : at + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (at == 0 or not gone[at - 1]) for at, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    random.seed(5)
    word = lambda n, letters: "".join(random.choice(letters) for _ in range(n))
    passages = [word(random.randint(90, 300), "abé \n") for _ in range(6)]
    docs = [(i, word(random.randint(0, 300), "abcdefgh ") + random.choice(passages)[random.randint(0, 80) :] + word(50, "xyz") + random.choice(passages)) for i in range(40)]
    return docs + [(100, None), (101, ""), (None, passages[0]), (7, passages[1]), (7, passages[1]), (3, docs[3][1]), (200, "a" * 1000), (201, "ab" * 500), (202, docs[10][1])]


@pytest.mark.parametrize("length, gram, hot, bits", [(100, 20, substrings.HOT, 64), (30, 8, substrings.HOT, 64), (30, 8, 2, 64), (30, 8, 0, 64), (30, 8, substrings.HOT, 1), (100, 20, 1, 2)])
def test_like_brute_force(spark, length, gram, hot, bits):
    """Few `bits` make contexts collide; a low `hot` sends all anchors through pieces."""
    docs = fixture()
    got = substrings.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), length, gram, hot, bits).drop("kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, length)


def test_kept_bytes_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "x" * 99, 1), (2, "é" * 60, 2), (3, "é" * 60, 3)], "doc_id long, text string, raw int")
    got = {r["doc_id"]: r for r in substrings.deduplicate(frame).collect()}
    assert bytes(got[1]["kept"]) == b"x" * 99
    # within one text only the first of the repeated strings stays
    assert got[2]["n_removed"] == 118 and got[3]["n_removed"] == 120 and got[3]["n_spans"] == 1
    assert substrings.deduplicate(frame.limit(0)).count() == 0


def test_suffix_sort_and_extensions():
    random.seed(2)
    text = bytes(random.choice(b"ab") for _ in range(600))
    raw = np.frombuffer(text, np.uint8)
    suffixes = substrings.Suffixes(raw, 40)
    starts = np.arange(len(raw) - 40)
    order = suffixes.sort(starts, np.zeros(len(starts), int))
    ranked = [text[s : s + 40] for s in starts[order]]
    assert ranked == sorted(ranked)
    a, b = starts[:-1], starts[1:]
    shared = [next((k for k in range(40) if text[x + k] != text[y + k]), 40) for x, y in zip(a, b)]
    assert suffixes.extension(a, b).tolist() == shared


def test_collisions_are_settled_by_bytes(monkeypatch):
    from plumbline.llm import polyhash

    monkeypatch.setattr(polyhash, "byte_values", lambda seed: np.zeros(256, np.uint64))
    contexts = [b"a" * 30, b"b" * 30, b"a" * 30]
    owner, within = substrings.repeated_windows(contexts, np.zeros(3, int), np.zeros(3, int), np.arange(3), np.zeros(3, int), 30)
    assert owner.tolist() == [2] and within.tolist() == [0]


def test_long_texts_and_a_hot_passage(spark):
    """Texts over BLOCK bytes, and a passage in so many documents that its edges make hot anchors."""
    random.seed(4)
    letters = lambda n: "".join(random.choices("abcdefghij klmno", k=n))
    long, passage = letters(2 * substrings.BLOCK + 5_000), letters(160)
    docs = [(0, long), (1, letters(700) + long[substrings.BLOCK - 300 : substrings.BLOCK + 400] + letters(50)), (2, long[1:])]
    docs += [(10 + i, letters(20) + passage + letters(20)) for i in range(substrings.HOT + 300)]
    got = substrings.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, 100)
