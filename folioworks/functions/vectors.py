"""Vector expressions over arrays; sums run in order, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often ``f`` names it, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 beside a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: str, a: Column, b: Column) -> Column:
    """Larger is nearer: cosine, dot, or euclid with its sign turned."""
    return {"cosine": cosine, "dot": dot, "euclid": lambda x, y: -euclid(x, y)}[distance](a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return once(_double(a), lambda v: once(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)))


def rrf_term(rank: Column) -> Column:
    """Reciprocal rank of a 1-based rank; 0 where there is none."""
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half-even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part.cast("double") * 100 / whole, 1)).otherwise(0.0)
