"""Windows over a symbol's sessions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def by(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def last(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The row and the n - 1 before it."""
    return by(*keys, order=order).rowsBetween(-(n - 1), 0)


def prior(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The n rows before the row."""
    return by(*keys, order=order).rowsBetween(-n, -1)


def ahead(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The n rows after the row."""
    return by(*keys, order=order).rowsBetween(1, n)


def rolling(agg: Column, x: Column, n: int, least: int | None = None, *keys: str) -> Column:
    """agg over the last n rows where at least `least` (all n by default) have x."""
    w = last(n, *keys)
    return F.when(F.count(x).over(w) >= (least or n), agg.over(w))


def lag(x: Column | str, n: int = 1, *keys: str) -> Column:
    return F.lag(x, n).over(by(*keys))


def ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(EPS)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))
