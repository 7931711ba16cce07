"""Chains, ledgers, fusion, rules and verdicts on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules, text, vectors
from plumbline.operators import chain, evaluate, evidence, findings, fusion, governance, groups, ledger, models, validate
from plumbline.tables import durable


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chain_breaks_are_reported(spark):
    rows = spark.createDataFrame([("c", i, f"p{i}") for i in range(5)], "chain string, seq long, payload string")
    built = chain.build(rows, "chain", "seq", "payload")
    check = lambda f: chain.verify(f, "chain", "seq", "payload").first()
    assert check(built)["valid"] and check(built)["n"] == 5
    assert check(built.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload"))))["first_error"] == "hash"
    assert tuple(check(built.filter("seq <> 3")))[3:] == ("sequence", 3)
    swapped = built.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")))
    assert check(swapped)["first_error"] == "link"
    assert chain.head_hash(rows, "chain", "seq", "payload").first()["head"] == built.filter("seq = 4").first()["event_hash"]


def test_one_long_chain_is_checked_by_many_tasks(spark):
    """A chain of a million events over 16 tasks; a break at the edge of a task's part counts like any other."""
    import hashlib

    import pandas as pd

    n, last, rows = 1_000_000, chain.GENESIS, []
    for i in range(n):
        own = hashlib.sha256(f"{last}|{i}".encode()).hexdigest()
        rows.append((last, own))
        last = own
    frame = pd.DataFrame(rows, columns=["previous_hash", "event_hash"]).assign(chain="c", seq=range(n), payload=[str(i) for i in range(n)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = spark.createDataFrame(frame)
        check = lambda f: tuple(chain.verify(f, "chain", "seq", "payload").first())
        assert check(built) == ("c", n, True, None, None)
        relinked = built.withColumn("previous_hash", F.when(F.col("seq").isin(777_777, 999_999), chain.GENESIS).otherwise(F.col("previous_hash")))
        assert check(relinked) == ("c", n, False, "link", 777_777)
        assert check(built.filter("seq <> 500000")) == ("c", n - 1, False, "sequence", 500_000)
        assert check(built.withColumn("payload", F.when(F.col("seq") == 123_456, "x").otherwise(F.col("payload")))) == ("c", n, False, "hash", 123_456)
        # every edge between parts
        edges = built.repartitionByRange("chain", "seq").groupBy(F.spark_partition_id()).agg(F.min("seq").alias("seq"))
        assert edges.count() >= 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_verify(events):
    """First break of a chain of (seq, payload, previous, own), in order."""
    import hashlib

    last = chain.GENESIS
    for i, (seq, payload, previous, own) in enumerate(sorted(events, key=lambda e: e[0])):
        error = "sequence" if seq != i else "link" if previous != last else "hash" if own != hashlib.sha256(f"{previous}|{payload}".encode()).hexdigest() else None
        if error:
            return error, i
        last = own
    return None, None


def test_breaks_anywhere_like_brute_force(spark, monkeypatch):
    random.seed(9)
    rows = spark.createDataFrame([(f"c{i % 7}", i // 7, f"p{i}") for i in range(7 * 12)], "chain string, seq long, payload string")
    built = [tuple(r) for r in chain.build(rows, "chain", "seq", "payload").collect()]
    for _ in range(4):
        changed = []
        for c, seq, payload, previous, own in built:
            dice = random.random()
            changed.append((c, seq + (dice < 0.02), payload + "x" * (0.02 < dice < 0.04), "0" * 64 if 0.04 < dice < 0.06 else previous, own))
        frame = spark.createDataFrame(changed, "chain string, seq long, payload string, previous_hash string, event_hash string").dropDuplicates(["chain", "seq"])
        held = {}
        for r in frame.collect():
            held.setdefault(r["chain"], []).append(tuple(r)[1:])
        got = {r["chain"]: (r["first_error"], r["at"]) for r in chain.verify(frame, "chain", "seq", "payload").collect()}
        assert got == {c: brute_verify(events) for c, events in held.items()}


def test_seals(spark):
    rows = spark.createDataFrame([("m", "i", "o", "d"), ("m", "i", None, "d"), ("n", "i", "o", "d"), ("m", "i", "o", "e")], "modelAssetID string, input string, output string, modelDigest string")
    sealed = rows.withColumn("contentHash", F.sha2(F.concat_ws("|", "input", "output"), 256))
    registered = spark.createDataFrame([("m", "d")], "modelAssetID string, registered_digest string")
    verdicts = lambda ok: [r["verdict"] for r in chain.verify_seals(sealed, ["input", "output"], registered, ok).collect()]
    assert sorted(verdicts(F.lit(True))) == ["TAMPERED", "TAMPERED", "UNREGISTERED", "VALID"]
    assert set(verdicts(None)) == {"TAMPERED"}
    assert chain.seal_summary(chain.verify_seals(sealed.limit(0), ["input"])).first()["status"] == "NO_RECORDS"


def brute_ledger(rows):
    assets, hashes, out = set(), set(), {}
    for seq, asset, hash_ in sorted(rows):
        out[seq] = "ASSET_EXISTS" if asset in assets else "DUPLICATE_EVIDENCE" if hash_ in hashes else "COMMITTED"
        if out[seq] == "COMMITTED":
            assets.add(asset)
            hashes.add(hash_)
    return out


def test_a_rejected_row_reserves_nothing(spark):
    random.seed(4)
    rows = [(1, "a", "h1"), (2, "a", "h2"), (3, "b", "h2"), (4, "c", "h2")] + [(i, f"x{random.randrange(60)}", f"y{random.randrange(60)}") for i in range(5, 120)]
    frame = spark.createDataFrame(rows, "seq long, asset string, hash string")
    got = {r["seq"]: r["status"] for r in ledger.first_wins(frame).collect()}
    assert got == brute_ledger(rows) and got[3] == "COMMITTED" and got[4] == "DUPLICATE_EVIDENCE"
    later = [(200, "a", "new"), (201, "new", "h1"), (202, "q", "q")]
    before = frame.join(spark.createDataFrame([(s,) for s, v in got.items() if v == "COMMITTED"], "seq long"), "seq").select("asset", "hash")
    assert [r["status"] for r in ledger.first_wins(spark.createDataFrame(later, "seq long, asset string, hash string"), before).orderBy("seq").collect()] == ["ASSET_EXISTS", "DUPLICATE_EVIDENCE", "COMMITTED"]


@pytest.mark.parametrize("rounds", [1, 3, 50])
def test_chains_of_waiting_rows_and_hot_keys(spark, monkeypatch, rounds):
    """Each row of the chain waits for the one before; a third of the rest share one hash."""
    monkeypatch.setattr(ledger, "ROUNDS", rounds)
    random.seed(rounds)
    rows = [(i, f"a{(i + 1) // 2}", f"h{i // 2}") for i in range(12)]
    rows += [(i, f"x{random.randrange(40)}", "hot" if i % 3 == 0 else f"y{random.randrange(40)}") for i in range(12, 150)]
    got = {r["seq"]: r["status"] for r in ledger.first_wins(spark.createDataFrame(rows, "seq long, asset string, hash string")).collect()}
    assert got == brute_ledger(rows)


@pytest.mark.parametrize("rounds", [0, 4])
def test_null_keys_clash_with_nothing(spark, monkeypatch, rounds):
    monkeypatch.setattr(ledger, "ROUNDS", rounds)
    rows = [(1, None, "h"), (2, None, "h"), (3, None, None), (4, None, None), (5, "a", None), (6, "a", "h"), (7, "b", "h"), (8, None, "i")]
    found = ledger.first_wins(spark.createDataFrame(rows, "seq long, asset string, hash string"))
    assert [r["status"][0] for r in found.orderBy("seq").collect()] == list("CDCCCADC")
    assert ledger.first_wins(spark.createDataFrame([], "seq long, asset string, hash string")).count() == 0


def test_fusion(spark):
    rows = spark.createDataFrame([(1, "duplicate", 0.6, "LOW"), (2, "duplicate", 0.8, "MEDIUM"), (2, "ood", 0.5, "LOW"), (3, "trigger", 0.95, "LOW")], "id long, detector string, confidence double, severity string")
    got = {r["id"]: r for r in fusion.fuse(rows, "id").collect()}
    assert (got[1]["severity"], got[1]["disposition"]) == ("LOW", "REVIEW")
    assert (got[2]["confidence"], got[2]["severity"]) == (0.9, "HIGH")
    assert (got[3]["severity"], got[3]["disposition"]) == ("CRITICAL", "QUARANTINE")
    risky = spark.createDataFrame([(1, 3)], "id long, group_place int")
    assert fusion.fuse(rows, "id", risky).filter("id = 1").first()["severity"] == "HIGH"


def test_group_risk_of_a_bad_contributor(spark):
    provenance = spark.createDataFrame([(i, "c7" if i < 10 else "c1", None) for i in range(30)], "id long, contributor string, batch string")
    found = spark.createDataFrame([(i, "label_flip", "car", "bus") for i in range(4)], "id long, anomaly_type string, original_label string, predicted_label string")
    got = {r["group_id"]: r for r in groups.risk(found, provenance, "id", ["contributor", "batch"]).collect()}
    assert got["c7"]["flagged"] and got["c7"]["fraction"] == 0.4 and got["c7"]["severity"] == "HIGH" and not got["c1"]["flagged"]
    assert groups.dominant_confusion(found, provenance, "id", ["contributor"]).first()["confusion"] == "car -> bus"
    assert groups.missing_dimensions(provenance, ["contributor", "batch"]).first()["limitation"] == "batch unknown for 30 samples"


def test_rates(spark):
    row = evaluate.rates(spark.createDataFrame([(3, 1, 1, 5), (0, 0, 0, 4)], "tp long, fp long, fn long, tn long")).collect()
    assert (row[0]["precision"], row[0]["recall"], row[0]["f1"], row[0]["accuracy"]) == (0.75, 0.75, 0.75, 0.8)
    assert (row[1]["precision"], row[1]["f1"], row[1]["fpr"]) == (0, 0, 0)


def test_both_directions(spark):
    proved = lambda *rows: evaluate.both_directions(spark.createDataFrame(list(rows), "kind string, alert boolean")).first()["proved"]
    assert proved(("normal", False), ("shifted", True)) and not proved(("normal", True), ("shifted", True)) and not proved(("normal", False))
    assert value(spark, text.model_key(F.lit("x/id-00000123_a.pt"))) == "id-00000123" and value(spark, text.model_key(F.lit("Net.PT"))) == "net"


def test_model_verdicts(spark):
    norms = spark.createDataFrame([("m", c, v) for c, v in enumerate([10.0, 11.0, 10.5, 2.0, 10.2])] + [("k", c, 5.0) for c in range(5)], "model_id string, class int, x double")
    mad = models.mad_index(norms, "model_id", "class", "x")
    got = {r["model_id"]: r for r in mad.collect()}
    assert got["m"]["flagged"] and got["m"]["top_class"] == 3 and got["m"]["max_index"] == round(8.2 / (1.4826 * 0.3), 4)
    assert got["k"]["max_index"] == 0 and got["k"]["top_class"] == 0
    deficits = spark.createDataFrame([("m", 3), ("k", 1)], "model_id string, deficit_class int")
    done = models.verdicts(mad, deficits)
    assert {r["model_id"]: r["verdict"] for r in done.collect()} == {"m": "QUARANTINE", "k": "ACCEPT"}
    models.require_assessed(done)
    lacking = models.verdicts(mad, deficits.filter("model_id = 'm'"), spark.createDataFrame([("m",), ("z",)], "model_id string"))
    assert {r["model_id"]: (r["verdict"], r["confidence"] is None) for r in lacking.collect()} == {"m": ("QUARANTINE", False), "k": ("ERROR", True), "z": ("ERROR", True)}
    with pytest.raises(ValueError, match="k, z"):
        models.require_assessed(lacking)
    top = models.top_deficit(spark.createDataFrame([("m", 1, 0.2), ("m", 0, 0.2), ("m", 2, 0.1)], "model_id string, class int, deficit double")).first()
    assert (top["deficit_class"], top["max_deficit"]) == (0, 0.2)


@pytest.mark.parametrize("raw, key", [("a b/c", "a-b-c"), ("--", "unknown"), (None, "unknown"), (".x.", "x"), ("y" * 99, "y" * 64)])
def test_sanitized(spark, raw, key):
    assert value(spark, text.sanitized(F.lit(raw).cast("string"))) == key


def test_text_functions(spark):
    assert value(spark, text.normalized_path(F.lit(".\\a\\..//b/c.TXT"))) == "a/b/c.TXT" and value(spark, text.stem(F.lit("a/B.c.TXT"))) == "b.c"
    assert value(spark, text.class_from_name(F.lit("x/Class_12/y.png"))) == 12 and value(spark, text.class_from_name(F.lit("z"))) is None
    assert value(spark, text.normalized_sample_id(F.lit("image-run-voc2012_7"))) == "7" and value(spark, text.slug(F.lit("  A & b!"))) == "a-b"


def test_rules(spark):
    assert [value(spark, rules.interpretation(F.lit(c))) for c in ("0.8", "0.5", "0.1", "n/a")] == ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
    assert value(spark, rules.finding_type(F.lit("Duplicate of a flipped label"))) == "label_anomaly"
    assert [value(spark, rules.finding_type(F.lit(t))) for t in ("Duplicates", "distribution", "Backdoor", "other")] == ["duplicate_anomaly", "ood_anomaly", "trigger_anomaly", "other"]
    assert value(spark, rules.evidence_tags(F.lit("duplicate and OOD"))) == ["duplicate", "ood"]
    assert value(spark, rules.worst(F.array(F.lit("LOW"), F.lit("CRITICAL"), F.lit("HIGH")))) == "CRITICAL"
    assert value(spark, rules.change_level(rules.relative_change(F.lit(1.1), F.lit(1.0)))) == "MEDIUM"
    assert value(spark, rules.change_level(rules.relative_change(F.lit(1.1), F.lit(0.0)))) == "NOT_AVAILABLE"


def test_vector_functions(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, vectors.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5) and value(spark, vectors.cosine(v(0, 0), v(1, 1))) is None
    assert value(spark, vectors.entropy(v(0.5, 0.5))) == pytest.approx(0.6931471805599453) and value(spark, vectors.argmax(v(1, 3, 3))) == 1
    assert sum(value(spark, vectors.softmax(v(1, 2, 3)))) == pytest.approx(1) and value(spark, vectors.normalised_correlation(v(1, 2), v(5, 5))) == 0


def test_finding_violations(spark):
    good = ("a", "m", "r", "0" * 64, "0.50", "LOW", "REVIEW", "t", "f" * 128)
    rows = [good, ("", "m", "r", "0" * 63, "1.5", "HUGE", "REVIEW", "t", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "assetID string, moduleName string, reason string, evidenceHash string, confidence string, severity string, disposition string, timestamp string, signature string").select(validate.finding_violations()).collect()]
    assert got[0] == [] and set(got[1]) == {"assetID_required", "signature_required", "confidence_range", "severity_unknown", "evidence_hash_form", "signature_form"}


@pytest.mark.parametrize(
    "status, severity, expected",
    [("FAIL", "LOW", ("QUARANTINE", "URGENT")), ("PASS", "CRITICAL", ("QUARANTINE", "URGENT")), ("REVIEW", "LOW", ("REVIEW", "ELEVATED")), ("WARNING", "LOW", ("REVIEW", "ELEVATED")), ("PASS", "HIGH", ("REVIEW", "ELEVATED")), ("INFO", "MEDIUM", ("REVIEW", "ELEVATED")), ("NOT_ASSESSED", "LOW", ("REVIEW", "ROUTINE")), ("PASS", "LOW", ("ACCEPT", "ROUTINE"))],
)
def test_dispositions(spark, status, severity, expected):
    assert tuple(value(spark, rules.disposition(F.lit(status), F.lit(severity)))) == expected


def test_statuses(spark):
    data = lambda s, d: value(spark, rules.data_status(F.lit(s), F.lit(d)))
    assert [data("CRITICAL", "ACCEPT"), data("LOW", "ACCEPT"), data("LOW", "REVIEW"), data("HIGH", "ACCEPT")] == ["FAIL", "PASS", "REVIEW", "REVIEW"]
    assert [value(spark, rules.model_status(F.lit(s))) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")] == ["FAIL", "REVIEW", "REVIEW", "PASS"]
    drift = lambda a: tuple(value(spark, rules.drift_status(F.lit(a))))
    assert [drift(a) for a in ("NO_SIGNIFICANT_SHIFT", "OPERATIONAL_SHIFT_LIKELY", "UNEXPLAINED_SHIFT", "INSUFFICIENT_EVIDENCE")] == [("PASS", "LOW"), ("WARNING", "MEDIUM"), ("REVIEW", "HIGH"), ("NOT_ASSESSED", "LOW")]


@pytest.mark.parametrize(
    "significant, measured, declared, expected",
    [(False, ["HIGH"], [], "NO_SIGNIFICANT_SHIFT"), (True, ["LOW", "MEDIUM"], [], "OPERATIONAL_SHIFT_LIKELY"), (True, ["LOW"], ["HIGH"], "OPERATIONAL_SHIFT_LIKELY"), (True, ["LOW"], ["MEDIUM"], "UNEXPLAINED_SHIFT"), (True, ["LOW"], [], "UNEXPLAINED_SHIFT"), (True, ["NOT_AVAILABLE"], ["NOT_AVAILABLE"], "INSUFFICIENT_EVIDENCE"), (True, [], [], "INSUFFICIENT_EVIDENCE"), (None, ["HIGH"], [], "INSUFFICIENT_EVIDENCE")],
)
def test_drift_assessments(spark, significant, measured, declared, expected):
    words = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    assert value(spark, rules.drift_assessment(F.lit(significant).cast("boolean"), words(measured), words(declared))) == expected


@pytest.mark.parametrize(
    "assessment, mmd, threshold, p, expected",
    [
        ("NO_SIGNIFICANT_SHIFT", 0.01, 0.02, None, (0.75, "LOW", "ACCEPT")),
        ("NO_SIGNIFICANT_SHIFT", 0.0, 0.02, 0.01, (0.55, "LOW", "ACCEPT")),
        ("NO_SIGNIFICANT_SHIFT", 0.0, 0.0, None, (0.6, "LOW", "ACCEPT")),
        ("OPERATIONAL_SHIFT_LIKELY", 1.0, 0.02, None, (0.65, "MEDIUM", "REVIEW")),
        ("OPERATIONAL_SHIFT_LIKELY", 1.0, 0.02, 0.2, (0.75, "MEDIUM", "REVIEW")),
        ("OPERATIONAL_SHIFT_LIKELY", 1.0, 0.02, 0.01, (0.85, "MEDIUM", "REVIEW")),
        ("UNEXPLAINED_SHIFT", 1.0, 0.02, None, (0.7, "HIGH", "REVIEW")),
        ("UNEXPLAINED_SHIFT", 1.0, 0.02, 0.01, (0.9, "HIGH", "REVIEW")),
        ("INSUFFICIENT_EVIDENCE", None, None, None, (0.2, "LOW", "REVIEW")),
    ],
)
def test_drift_policies(spark, assessment, mmd, threshold, p, expected):
    number = lambda x: F.lit(x).cast("double")
    assert tuple(value(spark, rules.drift_policy(F.lit(assessment), number(mmd), number(threshold), number(p)))) == expected


def test_confidence_notes(spark):
    notes = value(spark, rules.data_confidence(F.array(F.lit("ood"), F.lit("trigger"))))
    assert len(notes["basis"]) == 2 and notes["basis"][0].startswith("High residual") and len(notes["limitations"]) == 1
    assert len(value(spark, rules.data_confidence(F.array().cast("array<string>")))["basis"]) == 1
    assert len(value(spark, rules.model_confidence(F.lit(3.5), F.lit(False)))["limitations"]) == 2
    assert value(spark, rules.drift_confidence(F.lit(0.5), F.lit(0.01)))["basis"][1].endswith("0.0100.")


def test_overall_verdicts(spark):
    schema = "finding_id string, asset_id string, title string, status string, severity string, disposition string"
    row = lambda *x: ("f", "a", "t", *x)
    verdict = lambda *rows: tuple(governance.overall(spark.createDataFrame(list(rows), schema)).first())[-2:]
    passed, skipped = row("PASS", "LOW", "ACCEPT"), row("NOT_ASSESSED", "LOW", "REVIEW")
    assert verdict(passed, row("REVIEW", "LOW", "QUARANTINE")) == verdict(row("FAIL", "LOW", "REVIEW")) == verdict(row("PASS", "CRITICAL", "ACCEPT")) == ("FAIL", "QUARANTINE")
    assert verdict(passed, row("WARNING", "HIGH", "REVIEW")) == verdict(row("REVIEW", "LOW", "REVIEW"), skipped) == ("REVIEW", "REVIEW")
    assert verdict(passed, skipped) == ("PASS_WITH_LIMITATIONS", "ACCEPT") and verdict(passed) == ("PASS", "ACCEPT")
    assert tuple(governance.overall(spark.createDataFrame([], schema)).first())[-2:] == ("NOT_ASSESSED", "REVIEW")
    many = spark.createDataFrame([(f"f{i:02}", "a", "t", "FAIL", "LOW", "REVIEW") for i in range(30)], schema)
    assert len(governance.verdict_basis(many).first()["basis"]) == 15


def test_normalised_findings_with_missing_fields(spark):
    bare = findings.from_data(spark.createDataFrame([("i1", None), (None, "x")], "image_id string, reason string")).orderBy("asset_id").collect()
    assert [r["confidence"] for r in bare] == [0.65, 0.65] and bare[0]["asset_id"] == "i1" and bare[1]["asset_id"].startswith("image-")
    assert (bare[0]["severity"], bare[0]["status"], bare[0]["disposition"], bare[0]["reason"]) == ("MEDIUM", "REVIEW", "REVIEW", "Data integrity anomaly flagged.")
    assert findings.from_models(spark.createDataFrame([("m",)], "assetID string")).first()["status"] == "PASS"
    assert findings.from_seals(spark.createDataFrame([("s", "TAMPERED")], "sealID string, verdict string")).first()["reason"].count(";") == 1
    drifted = findings.from_drift(spark.createDataFrame([("w", "UNEXPLAINED_SHIFT", 0.5)], "window_id string, assessment string, mmd double")).first()
    assert (drifted["status"], drifted["severity"], drifted["confidence"]) == ("REVIEW", "HIGH", 0.75) and "0.500000 > 0.010000" in drifted["reason"]
    assert findings.lookup(findings.from_data(spark.createDataFrame([("i1",)], "image_id string")), "i1").count() == 1
    limits = spark.createDataFrame([(["a", "b"],), (["b", None],)], "limitations array<string>")
    assert sorted(r[0] for r in findings.distinct_limitations(limits).collect()) == ["a", "b"]


def test_own_dispositions_sample_ids_and_replays(spark):
    raw = spark.createDataFrame([("s1", "HIGH", "QUARANTINE"), ("s2", "CRITICAL", "ACCEPT"), ("s3", "LOW", None), ("s4", "LOW", "ACCEPT")], "sample_id string, severity string, disposition string")
    got = {r["asset_id"]: (r["disposition"], r["own_disposition"], r["ruled_disposition"], r["priority"], r["ts"]) for r in findings.from_data(raw, now="then").collect()}
    assert got == {"s1": ("QUARANTINE", "QUARANTINE", "REVIEW", "URGENT", "then"), "s2": ("QUARANTINE", "ACCEPT", "QUARANTINE", "URGENT", "then"), "s3": ("REVIEW", None, "REVIEW", "ELEVATED", "then"), "s4": ("ACCEPT", "ACCEPT", "ACCEPT", "ROUTINE", "then")}
    first = {r["asset_id"]: r["asset_id"] for r in findings.from_data(spark.createDataFrame([("a", "i", "s"), (None, "i", "s"), (None, None, "s")], "assetID string, image_id string, sample_id string")).collect()}
    assert set(first) == {"a", "i", "s"}
    assert findings.from_data(raw).first()["ts"] is None
    used = spark.createDataFrame([("x1", "n", 1), ("x2", "n", 2), ("x3", "n", 3), ("x4", "m", 4), ("x5", "", 5), ("x6", "", 6)], "sealID string, nonce string, at int")
    replayed = findings.from_replays(chain.replays(used, "nonce", "at")).orderBy("asset_id").collect()
    assert [(r["asset_id"], r["status"], r["disposition"], r["reason"]) for r in replayed] == [("x2", "FAIL", "QUARANTINE", "Use 2 of nonce n."), ("x3", "FAIL", "QUARANTINE", "Use 3 of nonce n.")]


def test_quarantine_rows_of_a_hot_key(spark):
    events = spark.createDataFrame([("k", i % 50, f"a{i}", "me") for i in range(3000)] + [("z", 1, "x", None)], "key string, at int, action string, actor string").repartition(4)
    assert {tuple(r) for r in ledger.quarantine_state(events, "key").collect()} == {("k", max(f"a{i}" for i in range(49, 3000, 50)), 3000), ("z", "x", 1)}
    steps = [(r["at"], r["action"]) for r in ledger.quarantine_timeline(events, "key").filter("key = 'k'").orderBy("step").collect()]
    assert steps == sorted((i % 50, f"a{i}") for i in range(3000))


def test_quarantine_takes_what_it_lacks_from_the_job(spark):
    rows = spark.createDataFrame([("q1", "t1", None, "own", None, None), ("q2", "t9", None, None, None, None)], "id string, test_id string, dataset_id string, dataset_name string, model_id string, model_name string")
    jobs = spark.createDataFrame([("t1", "d", "dn", "m", "mn")], "test_id string, dataset_id string, dataset_name string, model_id string, model_name string")
    got = {r["id"]: (r["dataset_id"], r["dataset_name"], r["model_name"]) for r in findings.with_job(rows, jobs).collect()}
    assert got == {"q1": ("d", "own", "mn"), "q2": (None, None, None)}


def test_channel_orders(spark):
    schema = "model_id string, order string, predicted int, truth int, entropy double"
    log = [("good", "RGB", 1, 1, 0.1), ("good", "BGR", 1, 0, 0.1), ("tie", "RGB", 1, 0, 0.1), ("tie", "BGR", 1, 0, 0.1)] + [("flat", o, 1, None, 0.1) for o in ("RGB", "BGR")] + [("free", o, i, None, e) for o, e in (("RGB", 0.5), ("BGR", 0.2)) for i in (0, 1)]
    got = {r["model_id"]: (r["tier"], r["chosen"], r["status"]) for r in models.channel_order(spark.createDataFrame(log, schema), spark.createDataFrame([(m,) for m in ("good", "tie", "flat", "free", "gone")], "model_id string")).collect()}
    assert got == {"good": ("TIER_A", "RGB", "OK"), "tie": ("TIER_A", "UNCERTAIN", "CALIBRATION_FAILED"), "flat": ("TIER_C", "UNCERTAIN", "CALIBRATION_UNCERTAIN"), "free": ("TIER_C", "BGR", "OK"), "gone": ("TIER_D", "N/A", "CALIBRATION_IMPOSSIBLE")}


def test_digest_does_not_depend_on_order_and_uses_more_levels_for_more_rows(spark, monkeypatch):
    from plumbline.operators import profile

    rows = spark.range(2_000).withColumn("x", F.col("id") * 7)
    whole = profile.digest(rows, "id", "x").first()
    assert profile.digest(rows.orderBy(F.desc("id")).repartition(7), "id", "x").first() == whole and profile.digest(rows.filter("id > 0"), "id", "x").first() != whole
    monkeypatch.setattr(profile, "GROUP_ROWS", 1)
    deep = profile.digest(rows, "id", "x").first()
    assert deep["n"] == 2_000 and deep["digest"] != whole["digest"] and profile.digest(rows.repartition(5), "id", "x").first() == deep


def test_report_forms(spark):
    import hashlib
    import json

    good = {name: {} for name in evidence.REPORT_FIELDS} | {"schema_version": "1.0", "overall_assessment": {"overall_status": "PASS", "disposition": "ACCEPT"}, "audit": {"chain_valid": True, "events": []}}
    finding = {name: "x" for name in evidence.FINDING_FIELDS} | {"category": "AUDIT", "status": "PASS", "severity": "LOW", "confidence": {"value": 0.5}, "evidence": [], "recommendation": {"disposition": "ACCEPT"}}
    good["findings"] = [finding, finding | {"confidence": {"value": "UNKNOWN"}}]
    bad = {k: v for k, v in good.items() if k != "system"} | {"schema_version": "one", "overall_assessment": {"overall_status": "GREAT", "disposition": "ACCEPT"}, "audit": {"events": 3}}
    bad["findings"] = [finding | {"severity": "INFO", "confidence": {"value": 1.5}}, {k: v for k, v in finding.items() if k != "title"} | {"confidence": 0.5, "recommendation": {"disposition": "BURN"}}]
    found = [r[0] for r in spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "report string").select(evidence.report_violations(F.col("report"))).collect()]
    assert found[0] == []
    assert [tuple(r) for r in found[1]] == [
        (None, "system_missing"),
        (None, "schema_version_form"),
        (None, "overall_status_unknown"),
        (None, "chain_valid_missing"),
        (None, "events_form"),
        (0, "severity_unknown"),
        (0, "confidence_range"),
        (1, "title_missing"),
        (1, "confidence_form"),
        (1, "recommendation_unknown"),
    ]
    text = json.dumps(good)
    digests = spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest().upper()), (text, "0" * 64), (text, None)], "report string, digest string")
    assert [r["digest_ok"] for r in evidence.with_report_digest(digests, "report").collect()] == [True, False, False]


def test_a_chain_is_dealt_to_one_task_above_a_join(spark):
    """A repartition by the key of a join below it is dropped, and the join's rows may then be read in pieces."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = durable(spark.range(4_000, numPartitions=8).select(F.concat(F.lit("c"), F.col("id") % 2).alias("chain"), F.col("id").alias("seq"), F.col("id").cast("string").alias("payload")))
        built = chain.build(rows.join(rows.groupBy("chain").agg(F.min("seq").alias("first")), "chain"), "chain", "seq", "payload")
        assert "REPARTITION_BY_COL" in built._jdf.queryExecution().executedPlan().toString()
        own = [tuple(r) for r in built.filter("chain = 'c1'").select("seq", "previous_hash", "event_hash").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [seq for seq, _, _ in own] == list(range(1, 4_000, 2))
    assert [b for _, b, _ in own] == [chain.GENESIS, *(hashed for _, _, hashed in own[:-1])]
