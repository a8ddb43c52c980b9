"""Arithmetic on vectors kept as arrays, on scores, and small parsing functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def pair_features(a: Column, b: Column) -> Column:
    return F.array(euclidean(a, b), cosine(a, b))


def jaccard(common: Column, degree_a: Column, degree_b: Column) -> Column:
    union = degree_a + degree_b - common
    return F.when(union > 0, common / union).otherwise(0.0)


def scaled(value: Column, largest: Column) -> Column:
    """``value / largest``; 0 where nothing is larger than 0."""
    return F.when(largest > 0, value / largest).otherwise(0.0)


def z_score(value: Column, mean: Column, deviation: Column, epsilon: float = 1e-6) -> Column:
    return (value - mean) / (deviation + epsilon)


def clean_score(score: Column) -> Column:
    """NaN and null become 0, everything else is clipped to 0..1."""
    return F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def blend(a: Column, b: Column, weight: float) -> Column:
    return weight * a + (1 - weight) * b


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """-1 where a point is missing."""
    return F.coalesce(F.hypot(x1 - x2, y1 - y2), F.lit(-1.0))


def optional_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y")


def settings(text: Column) -> Column:
    """Map of a ``k=v,k=v`` string."""
    return F.str_to_map(text, F.lit(","), F.lit("="))
