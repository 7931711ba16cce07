"""Vector arithmetic on array columns, inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` or its lambdas use it."""
    return F.get(F.transform(F.array(value), f), 0)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values), F.lit(0))


def std(values: Column) -> Column:
    """The population's deviation."""
    return given(mean(values), lambda m: F.sqrt(mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length 1; null for a zero vector, which has no direction."""
    return given(norm(vector), lambda size: F.when(size > 0, F.transform(vector, lambda x: x / size)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.greatest(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.lit(0.0))


def z_scores(vector: Column, mean: Column, std: Column) -> Column:
    """Dimensions with next to no spread keep a scale of 1."""
    return F.zip_with(F.zip_with(vector, mean, lambda x, m: x - m), std, lambda d, s: d / F.when(s < 1e-12, 1.0).otherwise(s))


def rbf(d2: Column, sigma: Column) -> Column:
    return F.exp(-F.least(d2 / (2 * sigma * sigma), F.lit(700.0)))


def softmax(scores: Column) -> Column:
    raised = given(F.array_max(scores), lambda peak: F.transform(scores, lambda x: F.exp(x - peak)))
    return given(raised, lambda r: given(total(r), lambda whole: F.transform(r, lambda x: x / whole)))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)) * F.ln(F.greatest(x, F.lit(1e-12)))))


def noisy_or(confidences: Column) -> Column:
    """1 minus the product of misses, each confidence held within [0.01, 0.99] and the result within [0.50, 0.98]."""
    held = F.transform(confidences, lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99)))
    missed = F.aggregate(held, F.lit(1.0), lambda acc, c: acc * (1 - c))
    return F.round(F.least(F.greatest(1 - missed, F.lit(0.50)), F.lit(0.98)), 2)


def normalised_correlation(a: Column, b: Column) -> Column:
    """Cosine of the mean-centred vectors, 0 where either is flat."""
    centred = lambda v: given(mean(v), lambda m: F.transform(v, lambda x: x - m))
    sizes = lambda x, y: given(norm(x), lambda n: given(norm(y), lambda k: F.when((n < 1e-9) | (k < 1e-9), 0.0).otherwise(dot(x, y) / (n * k))))
    return given(centred(a), lambda x: given(centred(b), lambda y: sizes(x, y)))
