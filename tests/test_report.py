import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_double, canonical_string, canonical_value, is_hash
from plumbline.operators import report
from plumbline.tables import durable
from test_neighbours import shuffled

ROW = {"finding_id": "f", "category": "DATA_INTEGRITY", "asset_id": "a", "status": "REVIEW", "severity": "HIGH", "confidence": 0.5, "title": "é", "reason": None, "ts": "t", "module_name": "m", "disposition": "REVIEW", "priority": "ROUTINE"}


@pytest.fixture(scope="module")
def documents(spark):
    """Two reports, of 25 and of no findings, in pages of 10."""
    evidence = spark.createDataFrame([(i, f"payload {i}") for i in range(25)], "i int, payload string").withColumn("evidence_hash", F.sha2("payload", 256))
    findings = evidence.select(F.lit("r1").alias("assessment_id"), *(F.lit(v).alias(k) for k, v in ROW.items() if k != "finding_id" and v is not None), F.lit(None).cast("string").alias("reason"), F.format_string("f%02d", "i").alias("finding_id"), "evidence_hash")
    checks = spark.createDataFrame([("r1", "c1", "AUDIT", "n", "m", "PASS"), ("r2", "c2", "AUDIT", "n", "m", "PASS")], "assessment_id string, " + report.CHECK)
    coverage = spark.createDataFrame([("r1", "capability", "x", "SUPPORTED", 3)], "assessment_id string, " + report.COVERAGE)
    events = spark.createDataFrame([("r1", i, f"t{i}", "k", "me", [f"r{i}"], {"é": str(i)}) for i in range(23)], report.EVENT)
    runs = spark.createDataFrame([("r1", "now"), ("r2", "now")], "assessment_id string, assessment_timestamp string")
    return durable(report.assemble(runs, findings, checks, coverage, report.audit_events(events), page=10)), evidence.select("evidence_hash", "payload")


def named(spark, documents, evidence=None, signed=None):
    return sorted((r["assessment_id"], r["part"], r["page"] if r["page"] is not None else -1, r["problem"], r["detail"]) for r in report.problems(documents, evidence, signed).collect())


def test_documents_are_json_and_valid(spark, documents):
    whole, evidence = documents
    parts = {(r["assessment_id"], r["part"], r["page"]): r for r in whole.collect()}
    assert [len(json.loads(parts["r1", "findings", n]["payload"])) for n in range(3)] == [10, 10, 5]
    assert [len(json.loads(parts["r1", "events", n]["payload"])) for n in range(3)] == [10, 10, 3]
    root = json.loads(parts["r1", "root", 0]["payload"])
    assert root["overall_assessment"] == {"overall_status": "REVIEW", "disposition": "REVIEW"} and len(root["parts"]) == 8
    assert json.loads(parts["r2", "root", 0]["payload"])["overall_assessment"] == {"overall_status": "NOT_ASSESSED", "disposition": "REVIEW"}
    for r in parts.values():
        assert r["payload"] == json.dumps(json.loads(r["payload"]), sort_keys=True, separators=(",", ":"))
    signed = whole.filter("part = 'root'").select("assessment_id", "digest")
    assert named(spark, whole, evidence, signed) == []
    assert sorted(tuple(r)[:4] for r in report.verify(whole, evidence, signed).collect()) == [("r1", "VALID", 0, 9), ("r2", "VALID", 0, 2)]


@pytest.mark.parametrize("part, page, old, new", [("findings", 1, '"f13"', '"g13"'), ("checks", 0, '"c1"', '"c9"'), ("coverage", 0, '"n":3', '"n":4'), ("events", 2, '"t21"', '"t99"'), ("root", 0, '"now"', '"new"')])
def test_one_changed_text_in_each_part_is_named(spark, documents, part, page, old, new):
    whole, evidence = documents
    hit = (F.col("assessment_id") == "r1") & (F.col("part") == part) & (F.col("page") == page)
    changed = whole.withColumn("payload", F.when(hit, F.replace("payload", F.lit(old), F.lit(new))).otherwise(F.col("payload")))
    assert changed.filter(hit).first()["payload"] != whole.filter(hit).first()["payload"]
    got = named(spark, changed, evidence)
    assert ("r1", part, page, "changed", "root" if part == "root" else "page") in got
    assert (("r1", "events", -1, "chain hash", "21") in got) == (part == "events")
    assert {r["assessment_id"]: r["verdict"] for r in report.verify(changed, evidence).collect()} == {"r1": "TAMPERED", "r2": "VALID"}


def test_what_digests_alone_do_not_show(spark, documents):
    """Parts that are lost, added or written anew with their digests, evidence that is gone, and another overall verdict."""
    whole, evidence = documents
    assert ("r1", "findings", 2, "missing", "page") in named(spark, whole.filter("not (part = 'findings' and page = 2)"))
    more = whole.unionByName(whole.filter("assessment_id = 'r1' and part = 'checks'").withColumn("page", F.lit(7)))
    assert named(spark, more) == [("r1", "checks", 7, "not listed", "page")]
    assert named(spark, whole, evidence.filter("payload <> 'payload 3'")) == [("r1", "evidence", 0, "missing", "f03")]
    assert named(spark, whole, evidence.withColumn("payload", F.when(F.col("payload") == "payload 24", "x").otherwise(F.col("payload")))) == [("r1", "evidence", 2, "changed", "f24")]
    signed = whole.filter("part = 'root'").select("assessment_id", "digest")
    root = F.col("part") == "root"
    forged = whole.withColumn("payload", F.when(root, F.replace("payload", F.lit('"overall_status":"REVIEW"'), F.lit('"overall_status":"PASS"'))).otherwise(F.col("payload"))).withColumn("digest", F.sha2("payload", 256))
    assert named(spark, forged, None, signed) == [("r1", "root", 0, "changed", "signed digest"), ("r1", "root", 0, "overall", "PASS REVIEW")]
    assert [(r["assessment_id"], r["verdict"]) for r in report.verify(whole.filter("not (assessment_id = 'r2' and part = 'root')")).orderBy("assessment_id").collect()] == [("r1", "VALID"), ("r2", "TAMPERED")]
    bad = whole.withColumn("payload", F.when(F.col("part") == "findings", F.replace("payload", F.lit('"severity":"HIGH"'), F.lit('"severity":"HUGE"'))).otherwise(F.col("payload")))
    assert ("r1", "findings", 0, "form", "severity HUGE") in named(spark, bad)


def test_pages_in_files_of_few_pages(spark, documents):
    """A reader's batch holds up to 4,096 rows of a file, so a file holds few of these large rows."""
    many = spark.range(80).selectExpr("concat('r', id) as assessment_id", "0 as page", "'x' as payload").coalesce(1)
    files = durable(many, report.FILE_PAGES).groupBy("_metadata.file_path").count().collect()
    assert sorted(r["count"] for r in files) == [16, 32, 32]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_rows_are_shuffled_once_and_pages_across_ranges_are_whole(spark, broadcast):
    ids = spark.range(997).select(F.concat(F.lit("r"), F.col("id") % 2).alias("assessment_id"), F.format_string("f%03d", F.col("id") % 900).alias("finding_id"), F.concat(F.lit("t"), "id").alias("title"))
    findings = durable(ids.select("*", *(F.lit(v).cast("double" if k == "confidence" else "string").alias(k) for k, v in {**ROW, "evidence_hash": None}.items() if k not in ids.columns)).repartition(4))
    none = [spark.createDataFrame([], "assessment_id string, " + schema) for schema in (report.CHECK, report.COVERAGE)]
    events = spark.createDataFrame([], report.PARTS["events"][0])
    runs = spark.createDataFrame([("r0", "now"), ("r1", "now")], "assessment_id string, assessment_timestamp string")
    made = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        n = shuffled(spark, lambda: made.append(durable(report.assemble(runs, findings, *none, events, page=10))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if broadcast != "-1":
        assert n < 1.3 * 997
    pages = {(r["assessment_id"], r["page"]): json.loads(r["payload"]) for r in made[0].filter("part = 'findings'").collect()}
    for run, count in (("r0", 499), ("r1", 498)):
        assert [len(pages[run, page]) for page in range(50)] == [10] * 49 + [count - 490]
        assert [(x["finding_id"], x["title"]) for page in range(50) for x in pages[run, page]] == sorted((r["finding_id"], r["title"]) for r in findings.filter(F.col("assessment_id") == run).collect())
    assert {r["verdict"] for r in report.verify(made[0]).collect()} == {"VALID"}


def test_canonical_doubles_in_a_short_way(spark):
    values = [0.9, 0.75, 0.001, 0.002, 1e-3 / 3, 2e-3, 9999999.5, 1e7, 1234.5, 100.0, 0.0, -0.0, -0.5, 1 / 3, 123456.789012345, 0.1 + 0.2, float("nan"), float("-inf"), None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in frame.orderBy("i").select(canonical_double(F.col("v"))).collect()] == [v if v is None else json.dumps(v) for v in values]


@pytest.mark.parametrize("kind, values", [("array<string>", [[], ['a"b'], [None], ["é", None], ["x", "y"], None]), ("map<string,string>", [{}, {'a"b': "é"}, {"k": None}, {"b": "1", "a": "2"}, None])])
def test_canonical_texts_of_one_string(spark, kind, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    assert [r[0] for r in frame.orderBy("i").select(canonical_value(F.col("v"), frame.schema["v"].dataType)).collect()] == [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]


def test_canonical_texts_that_end_a_line(spark):
    """A regex's $ also matches before the last line's end."""
    values = ["a\n", 'a"\r\n', "a ", "\n", "a\u0085", "a\n\n", "a\nb"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in frame.orderBy("i").select(canonical_string(F.col("v"))).collect()] == [json.dumps(v) for v in values]
    hashes = spark.createDataFrame([("a" * 64,), ("a" * 64 + "\n",)], "h string")
    assert [r[0] for r in hashes.select(is_hash(F.col("h"))).collect()] == [True, False]
