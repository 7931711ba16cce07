import itertools
import random
from collections import Counter

import numpy as np

from plumbline.llm import near_dups


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs):
    bags, parent = [bag(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        shared, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if docs[i][0] == docs[j][0] or not total or shared / total >= 0.8:
            parent[root(i)] = root(j)
    key = lambda i: -(1 << 63) if i is None else i
    least, size = {}, Counter(root(i) for i in range(len(docs)))
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), 1 << 63), key(d))
    return sorted(((d, None if least[root(i)] == -(1 << 63) else least[root(i)], size[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def fixture():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[random.choice(vocabulary) for _ in range(random.randint(5, 200))] for _ in range(8)]
    docs = []
    for i in range(90):
        words = list(random.choice(bases))
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        docs.append((i, (" " if i % 3 else "\n").join(words)))
    return docs + [(300, None), (301, ""), (302, " \n"), (None, docs[0][1]), (5, docs[5][1]), (7, docs[80][1]), (400, "a b"), (401, "a b"), (402, "a"), (403, "x " * 3000)]


def test_classes_like_brute_force(spark):
    docs = fixture()
    frame = spark.createDataFrame([(*row, 1) for row in docs], "doc_id long, text string, node int")
    assert sorted(map(tuple, near_dups.classes(frame).collect()), key=str) == brute(docs)
    kept = near_dups.without_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted({row[1] for row in brute(docs)}, key=str)


def test_empty_table(spark):
    assert near_dups.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_similarity_without_bias():
    rng = np.random.default_rng(1)
    estimates, truths = [], []
    for _ in range(60):
        a = Counter({int(x): int(rng.integers(1, 4)) for x in rng.integers(0, 1 << 62, 60)})
        b = Counter({k: v if rng.random() < 0.8 else int(rng.integers(1, 5)) for k, v in a.items() if rng.random() < 0.9})
        both = [(np.array(sorted(c), dtype=np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        estimates.append((near_dups.signature(*both[0]) == near_dups.signature(*both[1])).mean())
        truths.append(near_dups.similarity(*both))
        assert truths[-1] == sum((a & b).values()) / sum((a | b).values())
    assert abs(np.mean(estimates) - np.mean(truths)) < 0.02


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, near_dups.components(links).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_one_row_stays_beside_any_columns(spark):
    frame = spark.createDataFrame([(1, "a b", 2, {"x": 1}), (1, "a b", 1, {"x": 2}), (2, "a b", 3, None), (3, "c", 4, None)], "doc_id long, text string, `a``b.c` int, m map<string,int>")
    assert sorted((r[0], r[2]) for r in near_dups.without_duplicates(frame).collect()) == [(1, 1), (3, 4)]


def test_whole_table_like_all_pairs(spark):
    """Classes over the whole table without bands or signatures: overlaps of all pairs that share any shingle."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for j, own in enumerate(bags):
        shared = Counter()
        for shingle, times in own.items():
            for i, other in holders.get(shingle, ()):
                shared[i] += min(times, other)
            holders.setdefault(shingle, []).append((j, times))
        for i, n in shared.items():
            if n >= 0.8 * (sum(own.values()) + sum(bags[i].values()) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    expected = {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == expected and len(set(expected.values())) < len(expected)
