"""Vector distances as column expressions (doubles, inside the JVM). All distances ascend: smaller is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine, kept within 0 and 2; 1 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def cosine_similarity(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalized(a: Column) -> Column:
    """a over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


METRICS = {"l2": l2, "l2_squared": l2_squared, "cosine": cosine, "inner_product": negative_dot}
#: Metrics whose underlying measure grows with likeness; distances here always ascend.
SIMILARITIES = ("cosine", "inner_product")


def is_similarity(metric: str) -> bool:
    """Whether the measure behind a metric is a similarity; METRICS turns it into a distance either way."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    return metric in SIMILARITIES
