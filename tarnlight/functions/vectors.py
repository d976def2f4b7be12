"""Dense and sparse vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_size(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("boolean"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(same_size(a, b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x / n).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.when(same_size(a, b), _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))))


SCORES = {"cosine": cosine, "l2": l2, "dot": dot}


def sparse_dot(s: Column, query: dict[int, float]) -> Column:
    """Over shared dimensions; null where none is shared."""
    weights = F.create_map(*(F.lit(x) for k, w in sorted(query.items()) for x in (k, float(w))))
    shared = F.filter(F.arrays_zip(s["idx"].alias("idx"), s["w"].alias("w")), lambda e: F.map_contains_key(weights, e["idx"]))
    return F.when(F.size(shared) > 0, _sum(F.transform(shared, lambda e: e["w"].cast("double") * F.try_element_at(weights, e["idx"]))))
