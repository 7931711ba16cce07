import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, quantiles

P = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 0.999, 1.0]


def values(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 2, 20_000)] + [("ties", float(x)) for x in rng.integers(0, 4, 3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 9.0), ("one", None), ("nan", float("nan")), ("nan", 1.0), ("same", 7.0), ("same", 7.0)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def plain(frame, *keys):
    good = frame.filter("x is not null and not isnan(x)")
    return {tuple(r)[:-2]: (r["n"], r["q"]) for r in good.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("x", F.array(*map(F.lit, P))).alias("q")).collect()}


@pytest.mark.parametrize("slack", [0.01, 0.0])
def test_exact_like_percentile(spark, monkeypatch, slack):
    """Also with brackets that miss their ranks, and with many small blocks of places."""
    monkeypatch.setattr(quantiles, "BLOCK", 100)
    frame = values(spark)
    for keys in (("g",), ()):
        got = {tuple(r)[:-2]: (r["n"], r["quantiles"]) for r in quantiles.exact(frame, "x", P, *keys, slack=slack).collect()}
        assert got == plain(frame, *keys)


def test_only_the_bracket_is_put_in_order(spark, monkeypatch):
    seen = []
    before = quantiles.placed
    monkeypatch.setattr(quantiles, "placed", lambda frame, *order: seen.append(frame.count()) or before(frame, *order))
    frame = values(spark).filter("g = 'hot'")
    quantiles.exact(frame, "x", [0.5], "g").collect()
    assert len(seen) == 1 and 0 < seen[0] < 1_500


def test_sketches_merge(spark):
    frame = values(spark).filter("g in ('hot', 'ties')")
    halves = [quantiles.sketches(frame.filter(F.pmod(F.hash("x"), F.lit(2)) == i), "x", "g") for i in range(2)]
    both = quantiles.merged(halves[0].unionByName(halves[1]), "g")
    got = {r["g"]: r for r in quantiles.sketched(both, [0.1, 0.5, 0.9], "g").collect()}
    assert {g: r["n"] for g, r in got.items()} == {"hot": 20_000, "ties": 3_000}
    x = np.sort([r["x"] for r in frame.filter("g = 'hot'").collect()])
    for p, q in zip([0.1, 0.5, 0.9], got["hot"]["quantiles"]):
        assert abs(np.searchsorted(x, q) / len(x) - p) < 0.02


def test_scale_and_summary_like_the_small_forms(spark):
    frame = values(spark).filter("x is not null and not isnan(x)")
    order = lambda f: sorted(map(tuple, f.collect()), key=str)
    for keys, own in ((("g",), frame.filter("g is not null")), ((), frame)):
        assert order(quantiles.robust_scale(own, "x", *keys)) == order(profile.robust_scale(own, "x", *keys))
    rounded = lambda f: f.select("g", "n", F.round("mean", 9), F.round("std", 9), "min", "median", "p95", "p99", "max")
    assert order(rounded(quantiles.null_summary(frame, "x", "g"))) == order(rounded(profile.null_summary(frame, "x", "g")))
    assert quantiles.exact(frame.limit(0), "x", [0.5], "g").collect() == []
