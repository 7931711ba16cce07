import corpus_pipeline
from plumbline.llm import toxicity
from plumbline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, ids, seen = docs.columns, {r[0] for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids
        seen.append(len(ids - left))
        ids = left
    assert seen[1] > 0 and seen[2] > 0 and seen[3] == 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} in a row of words {i * 7} that say {i * 13} nothing at all {i}", "en", "s", 3) for i in range(30)], table(spark, SF, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 30
    assert toxicity.without_toxic(docs, toxicity.Model({}, (20.0, 25.0))).count() == 30


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(n))


def fixture(spark):
    """Documents of every fate, with nulls, repeated rows and columns that clash with the operators' own names."""
    item = " ".join(f"item{i}" for i in range(40))
    rows = [(i, words(i, 60)) for i in range(20)]
    rows += [(100 + i, words(i, 60)) for i in range(5)]  # exact copies
    rows += [(200 + i, words(i, 59) + " other") for i in range(5)]  # near copies
    rows += [(300, words(300, 30) + " " + item), (301, " ".join(item.split()[20:] + item.split()[:20]) + " " + words(301, 9))]  # leaks, one reordered
    rows += [(400, words(400, 50) + " card 4429526289707589"), (401, words(401, 50) + " mail a.b@c.example"), (402, words(402, 50) + " idiot scum idiot!"), (500, None), (501, ""), (None, words(600, 60)), (7, words(7, 60)), (3, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, {"k": 3}) for i, t in rows], "doc_id long, text string, found string, node int, `a.b``c` int, added map<string,int>")
    return docs, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"), rows


def test_like_brute_force(spark, tmp_path):
    """All rows of all stages against: single words, all pairs of documents, all tiles of all pairs, the library."""
    import hashlib

    from plumbline.llm import pii
    from tests.llm.test_bpe import library
    from tests.llm.test_contamination import tiled
    from tests.llm.test_contamination import words as item_words
    from tests.llm.test_near_dups import brute

    docs, benchmark, rows = fixture(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = [(1000 + i, words(1000 + i, 20) + (" idiot scum" if i % 2 else ""), i % 2) for i in range(200)]
    train = spark.createDataFrame([(i, t) for i, t, _ in bad], "doc_id long, text string")
    model = toxicity.fit(train, spark.createDataFrame([(i, y) for i, _, y in bad], "doc_id long, toxic int"))
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        got = toxicity.without_toxic(got, model) if name == "toxicity" else stage(spark, got, str(tmp_path))
        if name != "byte_bpe":
            assert got.columns == docs.columns, name
            got = spark.createDataFrame(got.collect(), got.schema)

    clean = [(i, t) for i, t in rows if not {"idiot", "scum"} & set((t or "").replace("!", "").split())]
    classes = {i: c for i, c, _ in brute(clean)}
    least = {}
    for i, t in clean:
        if classes[i] == i:
            least[i] = min(least.get(i, t or ""), t or "")
    unleaked = {i: t for i, t in least.items() if tiled(item_words(benchmark.first()["text"]), item_words(t))[0] < 0.5}
    assert {402, 300, 301, 100, 200} & unleaked.keys() == set() and {0, 400, 401, 500, None} <= unleaked.keys()
    encoding = library()

    def digest(text):
        ids = encoding.encode_ordinary(text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    expected = [(i, *digest(pii.replace(t)[0])) for i, t in unleaked.items()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_empty_tables(spark, tmp_path):
    from tests.llm.test_near_dups import brute

    docs, benchmark, rows = fixture(spark)
    for name, frame in (("documents", docs.limit(0)), ("benchmark", benchmark.limit(0)), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    # nothing is toxic without labels and nothing leaks without a benchmark: one document of each class is left
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len({least for _, least, _ in brute(rows)})
