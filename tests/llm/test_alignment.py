import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment, queries

SF = "/root/testdata/sf0.01"
HARD = ["  lead  two\n\n x </s> <|endoftext|> <0x41> <unk> é ", "a▁b c", "it's we'll 12 34 ﬁ ½ ¿qué? «x»", "日本語 テキスト 😀 😀😀\x00 q\r\n\tz", "a   b c ​ d\x1c e", " ", "\n", "  x", "x ᠎ y﻿ z", "a" * 5000, "one two " * 40]


def tokenizers():
    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    letters = alignment._byte_of_letter()
    entries = {i: entry for entry, i in a.get_vocab().items()}

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in entries[i]) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        raw = (" " + text).encode()
        return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b)), b"".join(bytes_a) == raw == b"".join(bytes_b)

    return encode


def groups_and_links(a, b):
    """Groups as text and all overlapping pairs, token by token."""
    groups, links, left, right, at_a, at_b, i, j = [], [], [], [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        links.append((a[i][0], b[j][0]))
        end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
        if end_a <= end_b:
            left.append(str(a[i][0]))
            at_a, i = end_a, i + 1
        if end_b <= end_a:
            right.append(str(b[j][0]))
            at_b, j = end_b, j + 1
        if end_a == end_b:
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return groups, links


def brute(documents):
    encode, known, rows = tokenizers(), Counter(), []
    for doc_id, text in documents:
        a, b, same = encode(text) if text else ([], [], False)
        groups, links = groups_and_links(a, b) if same else ([], [])
        known.update(links)
        rows.append((doc_id, len(a) if same else 0, len(b) if same else 0, groups, links))
    highest = Counter()
    for (_, b), n in known.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (
            (doc_id, n_a, n_b, len(groups), len(links), sum(known[x] == highest[x[1]] for x in links), sum(known[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc_id, n_a, n_b, groups, links in rows
        ),
        key=str,
    )


def test_whole_table_like_brute_force(spark):
    documents = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = queries.QUERIES["op12_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(documents)


@pytest.mark.parametrize("hot", [0, 3, 1 << 20])
def test_edges_with_and_without_the_table_of_frequent_pairs(spark, hot):
    documents = [(i, t) for i, t in enumerate([None, "", *HARD])] + [(3, HARD[2]), (None, HARD[2]), (50, "one two " * 40)]
    frame = spark.createDataFrame([(*row, "x") for row in documents], "doc_id long, text string, uid string").repartition(2)
    got = alignment.scores(frame, queries.BYTE_BPE, queries.PIECE_BPE, hot)
    assert sorted(map(tuple, got.collect()), key=str) == brute(documents)
    assert alignment.scores(frame.limit(0), queries.BYTE_BPE, queries.PIECE_BPE, hot).collect() == []


def test_portions_and_forgetting_change_nothing(monkeypatch):
    own = alignment.Aligner(queries.BYTE_BPE, queries.PIECE_BPE)
    texts = [*HARD, " ".join(HARD), "w x y " * 3000]
    whole = [aligned.row() for aligned in own.align(texts)]
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    own.units.forget()
    parts = [aligned.row() for aligned in own.align(texts)]
    assert [r[:5] for r in whole] == [r[:5] for r in parts]
    assert all((x[5] == y[5]).all() and (x[6] == y[6]).all() for x, y in zip(whole, parts))


def test_chains_of_overlaps_reach_their_last_token():
    import numpy as np

    ends_a, ends_b = np.arange(2, 2003, 2), np.array([*range(1, 2002, 2), 2002])
    label_a, label_b, links = alignment.labelled(ends_a, ends_b)
    assert set(label_a) == set(label_b) == {len(ends_a) - 1}
    assert links.shape[1] == len(set(ends_a) | set(ends_b))
