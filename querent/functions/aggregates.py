"""Aggregate functions, rankings and windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions.expr import AGGREGATED, WINDOW, Agg, Expr, Over, Rank, Record, as_record
from querent.functions.shape import Leaf, Opt


def _aggregate(fn: Callable, a: Any, dtype: T.DataType | None, text: str, nullable: bool = True) -> Record:
    r = as_record(a)
    leaf = Leaf(dtype, nullable)
    return Record(Opt(leaf) if nullable else leaf, [Agg(fn, r.columns(), dtype, text)], AGGREGATED)


def count(a: Any) -> Record:
    """Rows in which the column is not NULL; of a record of several columns, all rows."""
    return _aggregate(lambda *c: F.count(c[0] if len(c) == 1 else F.struct(*c)), a, T.LongType(), "COUNT", nullable=False)


def sum_(a: Any) -> Record:
    """The sum, in the argument's type for integers."""
    dtype = as_record(a).dtype
    if isinstance(dtype, T.IntegralType) and not isinstance(dtype, T.LongType):
        return _aggregate(lambda c: F.sum(c).cast(dtype), a, dtype, "SUM")
    return _aggregate(F.sum, a, dtype, "SUM")


def avg(a: Any) -> Record:
    return _aggregate(F.avg, a, T.DoubleType(), "AVG")


def max_(a: Any) -> Record:
    return _aggregate(F.max, a, as_record(a).dtype, "MAX")


def min_(a: Any) -> Record:
    return _aggregate(F.min, a, as_record(a).dtype, "MIN")


def every(a: Any) -> Record:
    return _aggregate(F.bool_and, a, T.BooleanType(), "EVERY")


def any_(a: Any) -> Record:
    return _aggregate(F.bool_or, a, T.BooleanType(), "ANY")


def some(a: Any) -> Record:
    return _aggregate(F.some, a, T.BooleanType(), "SOME")


def aggregate(fn: Callable[..., Column], a: Any, dtype: T.DataType | None = None) -> Record:
    """Any Spark aggregate, built in or a pandas UDAF."""
    return _aggregate(fn, a, dtype, getattr(fn, "__name__", "agg"))


def _rank(fn: Callable, dtype: T.DataType, text: str) -> Record:
    return Record(Leaf(dtype, False), [Rank(fn, dtype, text)], WINDOW)


def rank() -> Record:
    return _rank(F.rank, T.IntegerType(), "RANK()")


def dense_rank() -> Record:
    return _rank(F.dense_rank, T.IntegerType(), "DENSE_RANK()")


def row_number() -> Record:
    return _rank(F.row_number, T.IntegerType(), "ROW_NUMBER()")


def percent_rank() -> Record:
    return _rank(F.percent_rank, T.DoubleType(), "PERCENT_RANK()")


def cume_dist() -> Record:
    return _rank(F.cume_dist, T.DoubleType(), "CUME_DIST()")


class Windowing:
    """PARTITION BY and ORDER BY of a window; frames are SQL's defaults."""

    def __init__(self) -> None:
        self.partition: list[Expr] = []
        self.order: list[tuple[Expr, str, str | None]] = []

    def partition_by(self, r: Record) -> Windowing:
        self.partition += r.columns()
        return self

    def order_by(self, r: Record, direction: str = "asc", nulls: str | None = None) -> Windowing:
        self.order += [(e, direction, nulls) for e in r.columns()]
        return self

    def asc(self, r: Record, nulls: str | None = None) -> Windowing:
        return self.order_by(r, "asc", nulls)

    def desc(self, r: Record, nulls: str | None = None) -> Windowing:
        return self.order_by(r, "desc", nulls)


def window() -> Windowing:
    return Windowing()


def over(r: Record, w: Windowing) -> Record:
    """Every column of the record over the window."""
    context = AGGREGATED if any(isinstance(x, Agg) for e in r.columns() for x in e.walk() if x is not e) else WINDOW
    return Record(r._shape, [Over(e, w.partition, w.order) for e in r.columns()], context)
