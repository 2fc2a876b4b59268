"""Relations: lazy, reusable queries, lowered to DataFrames when they are run.

A relation is made from a function that describes it with a :class:`Query`::

    @relation
    def big_orders(q):
        o = q.query(Orders)
        c = q.query_maybe(Customer)
        q.on(o.o_custkey == c.c_custkey)
        q.wheres(o.o_totalprice > 1000.0)
        return record(o.o_orderkey, c.c_name)

The function runs afresh each time the relation is used, so one relation may be
joined many times over. Clauses lower in SQL's order: joins, WHERE, GROUP BY,
HAVING, windows, SELECT (DISTINCT), ORDER BY. Results have columns f0..fn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count as counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.expr import AGGREGATED, FLAT, Agg, Expr, Key, Over, Param, Record, RecordList, Ref, Scope, Sub, as_record, exists, ordered, placeholder, record
from querent.functions.shape import Leaf, Opt, Path, Shape, Tup
from querent.operators.grouping import Element, Unit, cross

_names = counter()


class Relation:
    """A query of some shape; see the module's text."""

    def plan(self) -> Any:
        raise NotImplementedError

    @property
    def shape(self) -> Shape:
        raise NotImplementedError

    def frame(self, scope: Scope) -> DataFrame:
        """The rows as a DataFrame with columns f0..fn."""
        raise NotImplementedError

    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.shape.width)]

    def params(self) -> set[str]:
        """Names of the parameters that have to be bound."""
        return set()

    # set operations; all but the *_all ones remove duplicates
    def union(self, other: Relation) -> Relation:
        return SetOperation("union", self, other)

    def union_all(self, other: Relation) -> Relation:
        return SetOperation("union_all", self, other)

    def except_(self, other: Relation) -> Relation:
        return SetOperation("except", self, other)

    def except_all(self, other: Relation) -> Relation:
        return SetOperation("except_all", self, other)

    def intersect(self, other: Relation) -> Relation:
        return SetOperation("intersect", self, other)

    def intersect_all(self, other: Relation) -> Relation:
        return SetOperation("intersect_all", self, other)

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Limited(self, n, offset)


def as_relation(x: Any) -> Relation:
    return x if isinstance(x, Relation) else TableRelation(x)


class TableRelation(Relation):
    """A scan of a model's columns."""

    def __init__(self, model: type):
        if not getattr(model, "__table__", ""):
            raise TypeError(f"{model!r} has no table")
        self.model = model

    @property
    def shape(self) -> Shape:
        return self.model.shape()

    def names(self) -> list[str]:
        return self.model.names()

    def frame(self, scope: Scope) -> DataFrame:
        table = scope.db.table(self.model.__table__, self.model.schema())
        return table.select(*[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(self.model.names())])


class FrameRelation(Relation):
    """Any DataFrame, batch or streaming, as a relation of a model or shape."""

    def __init__(self, df: DataFrame, shape: Shape | None = None):
        self.df = df
        self._shape = shape or (Tup([Leaf(f.dataType, f.nullable) for f in df.schema.fields]) if len(df.columns) > 1 else Leaf(df.schema.fields[0].dataType))

    @property
    def shape(self) -> Shape:
        return self._shape

    def frame(self, scope: Scope) -> DataFrame:
        return self.df.toDF(*self.names())


class RawQuery(Relation):
    """SQL text; parameters are Spark's named ones."""

    def __init__(self, text: str, shape: Shape, parameters: Iterable[str] = ()):
        self.text, self._shape, self._params = text, shape, set(parameters)

    @property
    def shape(self) -> Shape:
        return self._shape

    def params(self) -> set[str]:
        return set(self._params)

    def frame(self, scope: Scope) -> DataFrame:
        scope.db.expose()
        return scope.db.spark.sql(self.text, args={k: scope.params[k] for k in self._params} or None).toDF(*self.names())


class SetOperation(Relation):
    def __init__(self, kind: str, left: Any, right: Any):
        self.kind, self.left, self.right = kind, as_relation(left), as_relation(right)
        if self.left.shape.width != self.right.shape.width:
            raise TypeError(f"{kind} of {self.left.shape.width} and {self.right.shape.width} columns")

    @property
    def shape(self) -> Shape:
        return self.left.shape

    def params(self) -> set[str]:
        return self.left.params() | self.right.params()

    def frame(self, scope: Scope) -> DataFrame:
        a, b = self.left.frame(scope), self.right.frame(scope)
        return {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "except": lambda: a.subtract(b), "except_all": lambda: a.exceptAll(b), "intersect": lambda: a.intersect(b), "intersect_all": lambda: a.intersectAll(b)}[self.kind]()


class Limited(Relation):
    def __init__(self, source: Any, n: int, offset: int):
        self.source, self.n, self.offset = as_relation(source), n, offset

    @property
    def shape(self) -> Shape:
        return self.source.shape

    def names(self) -> list[str]:
        return self.source.names()

    def params(self) -> set[str]:
        return self.source.params()

    def frame(self, scope: Scope) -> DataFrame:
        df = self.source.frame(scope)
        return (df.offset(self.offset) if self.offset else df).limit(self.n)


class Query:
    """Collects the clauses of one relation."""

    def __init__(self, grouped: bool = False):
        self.grouped = grouped
        self.items: list[tuple[Relation, list[str], bool]] = []
        self.conditions: list[list[Record]] = []
        self.restrictions: list[Record] = []
        self.havings: list[Record] = []
        self.elements: list[Element] = []
        self.orders: list[tuple[Expr, str, str | None]] = []
        self.unique_rows = False

    # joins
    def _add(self, source: Any, maybe: bool) -> Record:
        rel = as_relation(source)
        n = next(_names)
        own = [f"t{n}_{i}" for i in range(rel.shape.width)]
        self.items.append((rel, own, maybe))
        self.conditions.append([])
        refs: list[Expr] = [Ref(name, leaf.dtype, label) for name, leaf, label in zip(own, rel.shape.leaves(), rel.names(), strict=True)]
        return Record(Opt(rel.shape) if maybe else rel.shape, refs, FLAT)

    def query(self, source: Any) -> Record:
        return self._add(source, False)

    def query_maybe(self, source: Any) -> Record:
        """Joined as the optional side: LEFT, RIGHT or FULL by the other side's kind."""
        return self._add(source, True)

    def on(self, predicate: Record) -> Query:
        """ANDed to the condition of the latest join."""
        if len(self.items) < 2:
            raise TypeError("on() needs a join")
        self.conditions[-1].append(predicate)
        return self

    # restrictions
    def wheres(self, predicate: Record) -> Query:
        if predicate._context == AGGREGATED:
            raise TypeError("an aggregate belongs into having()")
        self.restrictions.append(predicate)
        return self

    def having(self, predicate: Record) -> Query:
        self._needs_grouping()
        self.havings.append(predicate)
        return self

    def distinct(self) -> Query:
        self.unique_rows = True
        return self

    def all_(self) -> Query:
        self.unique_rows = False
        return self

    # grouping
    def _needs_grouping(self) -> None:
        if not self.grouped:
            raise TypeError("grouping belongs into an aggregate_relation")

    def group_by(self, what: Record | Element) -> Record:
        """A record groups by all its columns; see ``querent.operators.grouping`` for sets."""
        self._needs_grouping()
        if isinstance(what, Record):
            unit = Unit(what)
            self.elements.append(unit)
            return Record(what._shape, list(unit.keys), AGGREGATED)
        self.elements.append(what)
        return what.record if isinstance(what, Unit) else Record(Tup([]), [], AGGREGATED)

    # ordering
    def order_by(self, r: Record, direction: str = "asc", nulls: str | None = None) -> Query:
        self.orders += [(e, direction, nulls) for e in r.columns()]
        return self

    def asc(self, r: Record, nulls: str | None = None) -> Query:
        return self.order_by(r, "asc", nulls)

    def desc(self, r: Record, nulls: str | None = None) -> Query:
        return self.order_by(r, "desc", nulls)

    # subqueries
    def query_list(self, source: Any) -> RecordList:
        return RecordList(as_relation(source))

    def query_exists(self, source: Any) -> Record:
        return exists(self.query_list(source))

    def query_scalar(self, source: Unique) -> Record:
        if not isinstance(source, Unique):
            raise TypeError("a scalar needs a relation marked as unique")
        if source.shape.width != 1:
            raise TypeError("a scalar has one column")
        leaf = source.shape.leaves()[0]
        return Record(Opt(leaf), [Sub("scalar", source, (), leaf.dtype)], FLAT)

    # lowering
    def lower(self, result: Record, scope: Scope) -> DataFrame:
        own = frozenset(n for _, names, _ in self.items for n in names)
        here = Scope(scope.db, scope.params, own, scope.outer, scope.beyond)
        df = self._joined(here)
        for r in self.restrictions:
            df = df.where(r.expr.build(here))
        if self.grouped:
            df, here = self._aggregated(df, result, here)
            for r in self.havings:
                df = df.where(r.expr.build(here))
        return self._projected(df, result, here)

    def _joined(self, here: Scope) -> DataFrame:
        if not self.items:
            return here.db.spark.range(1).select()
        inside = Scope(here.db, here.params)
        df, left_maybe = None, False
        for (rel, names, maybe), conditions in zip(self.items, self.conditions, strict=True):
            right = rel.frame(inside).toDF(*names)
            if df is None:
                df, left_maybe = right, maybe
                continue
            how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[left_maybe, maybe]
            built: Column | None = None
            for c in conditions:
                one = c.expr.build(here)
                built = one if built is None else built & one
            if built is None:
                df = df.crossJoin(right) if how == "inner" else df.join(right, F.lit(True), how)
            else:
                df = df.join(right, built, how)
            left_maybe = False
        return df

    def _aggregated(self, df: DataFrame, result: Record, here: Scope) -> tuple[DataFrame, Scope]:
        found: dict[int, Agg] = {}

        def collect(e: Expr) -> None:
            if isinstance(e, Agg):
                found[id(e)] = e
            else:
                for c in e.children():
                    collect(c)

        for e in [*result.columns(), *[h.expr for h in self.havings], *[o for o, _, _ in self.orders]]:
            collect(e)
        sets = cross(self.elements) if self.elements else []
        keys = {id(k): k for s in [*sets, *[s for e in self.elements for s in e.sets]] for k in s}
        key_names = {k: f"k{i}" for i, k in enumerate(keys)}
        agg_names = {a: f"a{i}" for i, a in enumerate(found)}
        terms = [a.fn(*[x.build(here) for x in a.args]).alias(agg_names[i]) for i, a in found.items()]
        if not keys:
            df = df.select(*terms) if terms else df.select(F.count(F.lit(1)).alias("n"))
            if len(sets) > 1:
                raise TypeError("empty grouping sets")
        else:
            df = df.withColumns({key_names[i]: k.source.build(here) for i, k in keys.items()})
            columns = [F.col(n) for n in key_names.values()]
            if len(sets) == 1:
                df = df.groupBy(*columns).agg(*terms) if terms else df.select(*columns).distinct()
            else:
                named = [[F.col(key_names[id(k)]) for k in s] for s in sets]
                df = df.groupingSets(named, *columns).agg(*(terms or [F.count(F.lit(1)).alias("n")]))
        return df, Scope(here.db, here.params, here.own, here.outer, here.beyond, key_names, agg_names, True)

    def _projected(self, df: DataFrame, result: Record, here: Scope) -> DataFrame:
        names = [f"f{i}" for i in range(len(result.columns()))]
        if not names:
            raise TypeError("a relation needs at least one column")
        shown = {id(e): n for e, n in zip(result.columns(), names, strict=True)}
        hidden = {id(e): f"o{i}" for i, (e, _, _) in enumerate(self.orders) if id(e) not in shown}
        if hidden and self.unique_rows:
            raise TypeError("DISTINCT rows can only be ordered by what is selected")
        columns = [e.build(here).alias(n) for e, n in zip(result.columns(), names, strict=True)]
        columns += [e.build(here).alias(hidden[id(e)]) for e, _, _ in self.orders if id(e) in hidden]
        df = df.select(*columns)
        if self.unique_rows:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*[ordered(F.col(shown.get(id(e)) or hidden[id(e)]), d, n) for e, d, n in self.orders])
            if hidden:
                df = df.select(*names)
        return df


class Described(Relation):
    """A relation described by a function of a Query."""

    def __init__(self, describe: Callable[[Query], Record], grouped: bool = False):
        self.describe, self.grouped = describe, grouped

    def plan(self) -> tuple[Query, Record]:
        q = Query(self.grouped)
        result = as_record(self.describe(q))
        if self.grouped and any(isinstance(e, Ref) for e in result.columns()):
            raise TypeError("an aggregated query returns keys and aggregates only")
        if not self.grouped and any(isinstance(x, (Agg, Key)) for e in result.columns() for x in _outside_windows(e)):
            raise TypeError("aggregates belong into an aggregate_relation")
        return q, result

    @property
    def shape(self) -> Shape:
        return self.plan()[1]._shape

    def params(self) -> set[str]:
        q, result = self.plan()
        found: set[str] = set()

        def look(e: Expr) -> None:
            for x in e.walk():
                if isinstance(x, Param):
                    found.add(x.name)
                if isinstance(x, Sub):
                    found.update(x.relation.params())
                if isinstance(x, Key):
                    look(x.source)

        for rel, _, _ in q.items:
            found |= rel.params()
        for r in [result, *q.restrictions, *q.havings, *[c for cs in q.conditions for c in cs]]:
            for e in r.columns():
                look(e)
        for e, _, _ in q.orders:
            look(e)
        for unit in q.elements:
            for s in unit.sets:
                for k in s:
                    look(k.source)
        return found

    def frame(self, scope: Scope) -> DataFrame:
        q, result = self.plan()
        return q.lower(result, scope)


def _outside_windows(e: Expr) -> Iterable[Expr]:
    yield e
    if not isinstance(e, Over):
        for c in e.children():
            yield from _outside_windows(c)


class Unique(Relation):
    """A relation that is asserted to have one row at most."""

    def __init__(self, source: Any):
        self.source = as_relation(source)

    @property
    def shape(self) -> Shape:
        return self.source.shape

    def names(self) -> list[str]:
        return self.source.names()

    def params(self) -> set[str]:
        return self.source.params()

    def frame(self, scope: Scope) -> DataFrame:
        return self.source.frame(scope)


def relation(describe: Callable[[Query], Record]) -> Relation:
    return Described(describe)


def aggregate_relation(describe: Callable[[Query], Record]) -> Relation:
    return Described(describe, grouped=True)


def unique_relation(describe: Callable[[Query], Record]) -> Unique:
    return Unique(Described(describe))


def unique(source: Any) -> Unique:
    return Unique(source)


def table(model: type) -> Relation:
    return TableRelation(model)


# direct style joins
def _join(left: Any, right: Any, predicates: tuple[Callable[[Record, Record], Record], ...], maybe: tuple[bool, bool]) -> Relation:
    def describe(q: Query) -> Record:
        a, b = q._add(left, maybe[0]), q._add(right, maybe[1])
        for p in predicates:
            q.on(p(a, b))
        return record(a, b)

    return Described(describe)


def inner(left: Any, right: Any, *predicates: Callable) -> Relation:
    return _join(left, right, predicates, (False, False))


def left(left_: Any, right: Any, *predicates: Callable) -> Relation:
    return _join(left_, right, predicates, (False, True))


def right(left_: Any, right_: Any, *predicates: Callable) -> Relation:
    return _join(left_, right_, predicates, (True, False))


def full(left_: Any, right_: Any, *predicates: Callable) -> Relation:
    return _join(left_, right_, predicates, (True, True))


# lookups by key
def key_path(model: type, names: list[str] | None = None) -> Path:
    return model.path(*(names or model.primary_key()))


def unique_select(model: type, names: list[str]) -> Relation:
    """Rows by a key that is given as the parameter ``key``."""
    path = key_path(model, names)

    def describe(q: Query) -> Record:
        r = q.query(model)
        q.wheres(r[path] == placeholder("key", path.target))
        return r

    return Described(describe)


def primary_select(model: type) -> Relation:
    if not model.primary_key():
        raise TypeError(f"{model.__name__} has no primary key")
    return unique_select(model, model.primary_key())


def derived_unique_relation(model: type, names: list[str], value: Any, project: Callable[[Record], Record] | None = None) -> Unique:
    """The row with a key value, which may belong to an enclosing query."""
    path = key_path(model, names)

    def describe(q: Query) -> Record:
        r = q.query(model)
        q.wheres(r[path] == value)
        return project(r) if project else r

    return Unique(Described(describe))


def aggregated_unique(source: Any, path: Callable[[Record], Record], function: Callable[[Record], Record]) -> Unique:
    """One aggregate over a whole relation."""

    def describe(q: Query) -> Record:
        return function(path(q.query(source)))

    return Unique(Described(describe, grouped=True))

