import random

import numpy as np

from plumbline.llm import toxicity


def table(n, seed):
    random.seed(seed)
    words, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["idiot", "scum", "lowei"]
    rows = []
    for i in range(n):
        text = [random.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(random.choice([1, 2, 9]) if toxic else 0):
            text.insert(random.randrange(40), random.choice(bad) + random.choice(["", ",", "xy"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    train, test = table(1500, 1), table(500, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string"), model).collect()}
    assert np.mean([got[i]["toxic"] == bool(y) for i, _, y in test]) > 0.98
    assert all(r["toxic"] == (r["severity"] > 0) for r in got.values())
    assert all(0 <= r["expected_severity"] <= 2 for r in got.values())
    kept = toxicity.without_toxic(spark.createDataFrame([(t, i, 0) for i, t, _ in test], "text string, doc_id long, severity int"), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["toxic"]}


def test_nulls_empties_and_repeats(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "idiot " * 50_000), (2, "idiot " * 50_000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and not any(r["toxic"] for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_probabilities_sum_to_one():
    p = toxicity.Model({}, (1.0, 3.0)).probabilities(np.array([-900.0, 0.0, 2.0, 900.0]))
    assert np.allclose(p.sum(axis=1), 1) and p[0].argmax() == 0 and p[2].argmax() == 1 and p[3].argmax() == 2


def halves(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), labels.filter("pmod(hash(doc_id), 2) = 0"), labels.filter("pmod(hash(doc_id), 2) = 1")


def test_held_out_accuracy_on_the_tables(spark):
    """Fitted on half of the labels, judged on the other half. Some labels are noise: no model catches all of them."""
    docs, train, test = halves(spark, "/root/testdata/sf0.1")
    model = toxicity.fit(docs, train)
    assert min(model.weights.values()) < 0 < max(model.weights.values())
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(test, "doc_id").collect()
    caught = [r["found"] for r in rows if r["toxic"] == 1]
    false = [r["found"] for r in rows if r["toxic"] == 0]
    assert np.mean(caught) > 0.72 and np.mean(false) < 0.005


def test_grades_come_from_the_labels(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (2, 1, 0), (3, 1, 1), (3, 0, 1), (4, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert sorted(map(tuple, toxicity.graded(labels, 10).collect())) == [(1, 0), (2, 2), (3, 1)]
    assert sorted(map(tuple, toxicity.graded(labels.drop("quality"), 10).collect())) == [(1, 0), (2, 1), (3, 1)]
    assert toxicity.graded(labels, 2).count() == 2


def test_whole_table_like_the_formula(spark):
    """Every document's odds, from its words one by one."""
    from plumbline.llm.queries import op7_toxicity

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r["doc_id"]: r for r in op7_toxicity(spark, folder).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        score = 0.0
        for chunk in sorted(set((row["text"] or "").lower().split())):
            word = ""
            for c in chunk + " ":
                if c.isalpha():
                    word += c
                elif word:
                    score += model.weights.get(word, 0.0) + sum(model.weights.get(word[:n] + "*", 0.0) for n in (4, 5, 6) if len(word) > n)
                    word = ""
        low, high = (1 / (1 + np.exp(score - t)) for t in model.thresholds)
        r = got[row["doc_id"]]
        assert abs(r["expected_severity"] - ((high - low) + 2 * (1 - high))) < 1e-9
        assert r["severity"] == (0 if low >= 0.8 else 1 if high >= 0.8 else 2) and r["toxic"] == (low < 0.8)


def test_extra_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "idiot scum", 7, 8, 9)], "doc_id long, text string, severity int, `toxic.x` int, added int")
    model = toxicity.Model({"idiot": 9.0}, (1.0, 3.0))
    assert toxicity.score(frame, model).first()["severity"] == 2 and toxicity.without_toxic(frame, model).count() == 0
    assert toxicity.without_toxic(frame, toxicity.Model({}, (9.0, 10.0))).collect() == frame.collect()
