import random
import time

import pyarrow.parquet as pq

from plumbline.llm import queries
from plumbline.llm import token_counts as tc
from plumbline.llm.bpe import PreTokenizer
from plumbline.llm.queries import RANKS


def alone(raw, costs):
    """Best (cost, tokens) of a pre-token, without a trie."""
    best = [(0, 0)]
    for end in range(1, len(raw) + 1):
        best.append(min((best[s][0] + costs[raw[s:end]], best[s][1] + 1) for s in range(end) if raw[s:end] in costs))
    return best[-1][1]


def test_like_dynamic_programming_by_hand(spark):
    texts = [(1, "The quick brown foxes, quickly! naïve 12345"), (2, None), (3, ""), (None, "the the theatre theatrical"), (4, "x" * 700 + " " + "漢字" * 90), (4, "again"), (4, "again")]
    costs, split = tc.token_costs(RANKS), PreTokenizer().split
    got = sorted(map(tuple, tc.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), RANKS).collect()), key=str)
    expected = [(i, len(split(t or "")), sum(alone(p.encode(), costs) for p in split(t or ""))) for i, t in texts]
    assert got == sorted(expected, key=str)
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string, n_tokens int"), RANKS).count() == 0


def test_shared_prefixes_are_scored_once():
    trie = tc.Trie({bytes([b]): 1 for b in range(256)})
    trie.learn({"theatre", "theatrical"})
    assert len(trie.score) == 1 + len("theatre") + len("ical")


def test_trie_starts_afresh(monkeypatch):
    monkeypatch.setattr(tc, "MOST_NODES", 3)
    trie = tc.Trie({bytes([b]): 1 for b in range(256)} | {b"ab": 1})
    trie.learn({"abab"})
    trie.learn({"abc"})
    assert trie.counts == {"abc": 2}


def test_long_words_are_held_nowhere_and_take_linear_time(spark):
    rng = random.Random(1)
    costs = tc.token_costs(RANKS)
    trie = tc.Trie(costs)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    for n in (257, 300, 1000, 3000):
        raw = word(n).encode()
        assert trie.alone(raw) == alone(raw, costs)
    assert trie.alone("漢字é".encode() * 100) == alone("漢字é".encode() * 100, costs)
    before = time.process_time()
    trie.alone(word(400_000).encode())
    assert time.process_time() - before < 8
    texts = [(i, " ".join(word(300) for _ in range(5)) + " tail") for i in range(40)] + [(99, word(1_000_000))]
    list_of = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(list_of, RANKS).collect()}
    assert got[0] == sum(alone(p.encode(), costs) for p in PreTokenizer().split(texts[0][1])) and got[99] > 100_000
    splitter, own = tc._trie(RANKS)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts[:40]], "text": [t for _, t in texts[:40]]})
    list(tc._count(iter([batch]), RANKS))
    assert max(map(len, own.counts)) <= tc.LONGEST


def test_whole_table_like_dynamic_programming(spark):
    sf = "/root/testdata/sf0.01"
    costs, split, known = tc.token_costs(RANKS), PreTokenizer().split, {}
    longest = max(map(len, costs))

    def count(piece):
        if piece not in known:
            raw, best = piece.encode(), [(0, 0)]
            for end in range(1, len(raw) + 1):
                best.append(min((best[s][0] + costs[raw[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if raw[s:end] in costs))
            known[piece] = best[-1][1]
        return known[piece]

    expected = {r["doc_id"]: (len(split(r["text"] or "")), sum(map(count, split(r["text"] or "")))) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: (r["n_pre_tokens"], r["n_tokens"]) for r in queries.QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == expected
