"""Scalar expressions and records of them.

An expression is a small tree that is turned into a Spark ``Column`` when the
query around it is lowered, for only then is it known which columns are the
query's own and which belong to an enclosing one (an outer reference).
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions.shape import Leaf, Opt, Path, Shape, Tup, bare, identity, part

FLAT, AGGREGATED, WINDOW = "flat", "aggregated", "window"


@dataclass
class Scope:
    """What an expression may refer to while a query is lowered."""

    db: Any
    params: dict[str, Any]
    own: frozenset[str] = frozenset()
    outer: frozenset[str] = frozenset()
    beyond: frozenset[str] = frozenset()
    keys: dict[int, str] = field(default_factory=dict)
    aggregates: dict[int, str] = field(default_factory=dict)
    grouped: bool = False

    def inner(self) -> Scope:
        return Scope(self.db, self.params, frozenset(), self.own, self.outer | self.beyond)


class Expr:
    dtype: T.DataType | None = None

    def build(self, scope: Scope) -> Column:
        raise NotImplementedError

    def children(self) -> Iterable[Expr]:
        return ()

    def walk(self) -> Iterable[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()


class Ref(Expr):
    """A column of a joined relation, by its unique name."""

    def __init__(self, name: str, dtype: T.DataType | None, label: str = ""):
        self.name, self.dtype, self.label = name, dtype, label

    def build(self, scope: Scope) -> Column:
        if self.name in scope.own:
            if scope.grouped:
                raise TypeError("a grouped query may only use its keys and aggregates")
            return F.col(self.name)
        if self.name in scope.outer:
            return F.col(self.name).outer()
        if self.name in scope.beyond:
            raise TypeError("a reference may not skip a query level: project it in the query between")
        raise TypeError(f"{self.label or self.name} does not belong to this query or the one around it")


class Lit(Expr):
    def __init__(self, value: Any, dtype: T.DataType | None):
        self.value, self.dtype = value, dtype

    def build(self, scope: Scope) -> Column:
        if self.dtype is None:
            return F.lit(self.value)
        return F.lit(self.value).cast(self.dtype)


class Param(Expr):
    def __init__(self, name: str, dtype: T.DataType):
        self.name, self.dtype = name, dtype

    def build(self, scope: Scope) -> Column:
        if self.name not in scope.params:
            raise KeyError(f"no value for parameter {self.name}")
        return F.lit(scope.params[self.name]).cast(self.dtype)


class Op(Expr):
    """fn applied to built arguments; text is a template for SQL rendering."""

    def __init__(self, fn: Callable[..., Column], args: list[Expr], dtype: T.DataType | None, text: str = ""):
        self.fn, self.args, self.dtype, self.text = fn, args, dtype, text

    def build(self, scope: Scope) -> Column:
        return self.fn(*[a.build(scope) for a in self.args])

    def children(self) -> Iterable[Expr]:
        return self.args


class Native(Expr):
    """A Spark column taken as it is."""

    def __init__(self, column: Column, dtype: T.DataType | None = None, text: str = ""):
        self.column, self.dtype, self.text = column, dtype, text

    def build(self, scope: Scope) -> Column:
        return self.column


class Key(Expr):
    """A grouping key as seen after the grouping."""

    def __init__(self, source: Expr):
        self.source, self.dtype = source, source.dtype

    def build(self, scope: Scope) -> Column:
        if id(self) not in scope.keys:
            raise TypeError("this key belongs to another query")
        return F.col(scope.keys[id(self)])


class Agg(Expr):
    def __init__(self, fn: Callable[..., Column], args: list[Expr], dtype: T.DataType | None, text: str):
        self.fn, self.args, self.dtype, self.text = fn, args, dtype, text

    def build(self, scope: Scope) -> Column:
        if id(self) in scope.aggregates:
            return F.col(scope.aggregates[id(self)])
        if scope.aggregates is ROW:
            return self.fn(*[a.build(scope) for a in self.args])
        raise TypeError("an aggregate outside of an aggregated query or window")

    def children(self) -> Iterable[Expr]:
        return self.args


#: In place of scope.aggregates: aggregates apply to what they get.
ROW: dict[int, str] = {}


class Over(Expr):
    def __init__(self, term: Expr, partition: list[Expr], order: list[tuple[Expr, str, str | None]]):
        self.term, self.partition, self.order, self.dtype = term, partition, order, term.dtype

    def build(self, scope: Scope) -> Column:
        from pyspark.sql import Window

        spec = Window.partitionBy(*[p.build(scope) for p in self.partition])
        order = [ordered(e.build(scope), d, n) for e, d, n in self.order]
        if not order and isinstance(self.term, Rank):
            order = [F.lit(1)]  # ranking needs an order in Spark; all rows tie
        if order:
            spec = spec.orderBy(*order)
        term = self.term
        built = term.fn(*[a.build(scope) for a in term.args]) if isinstance(term, (Agg, Rank)) else term.build(scope)
        return built.over(spec)

    def children(self) -> Iterable[Expr]:
        return [*(self.term.args if isinstance(self.term, (Agg, Rank)) else [self.term]), *self.partition, *[e for e, _, _ in self.order]]


class Rank(Expr):
    def __init__(self, fn: Callable[..., Column], dtype: T.DataType, text: str):
        self.fn, self.args, self.dtype, self.text = fn, [], dtype, text

    def build(self, scope: Scope) -> Column:
        raise TypeError("a ranking needs over()")


class Sub(Expr):
    """EXISTS, IN or a scalar over a relation, maybe correlated."""

    def __init__(self, kind: str, relation: Any, needle: list[Expr] = (), dtype: T.DataType | None = None):
        self.kind, self.relation, self.needle, self.dtype = kind, relation, list(needle), dtype

    def children(self) -> Iterable[Expr]:
        return self.needle

    def build(self, scope: Scope) -> Column:
        frame = self.relation.frame(scope.inner())
        if self.kind == "exists":
            return frame.exists()
        if self.kind == "scalar":
            return frame.scalar()
        needle = [n.build(scope) for n in self.needle]
        if len(needle) == 1:
            return needle[0].isin(frame)
        return F.struct(*[n.alias(f"f{i}") for i, n in enumerate(needle)]).isin(frame)


def ordered(column: Column, direction: str, nulls: str | None) -> Column:
    return getattr(column, {None: direction, "first": f"{direction}_nulls_first", "last": f"{direction}_nulls_last"}[nulls])()


# --- records ---------------------------------------------------------------

_PLAIN = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), dt.time: T.TimeType(6), dt.timedelta: T.DayTimeIntervalType()}


def type_of(value: Any) -> T.DataType | None:
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return T.TimestampType() if value.tzinfo else T.TimestampNTZType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, decimal.Decimal):
        return T.DecimalType(38, max(0, -value.as_tuple().exponent))
    return next((t for k, t in _PLAIN.items() if isinstance(value, k)), None)


class Record:
    """Expressions with a shape, in a context (flat, aggregated or window)."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, shape: Shape, exprs: list[Expr], context: str = FLAT):
        if len(exprs) != shape.width:
            raise TypeError(f"{len(exprs)} columns for a shape of {shape.width}")
        self._shape, self._exprs, self._context = shape, exprs, context

    # projection
    def __getattr__(self, name: str) -> Record:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._part(name)

    def __getitem__(self, which: int | str | Path) -> Record:
        if isinstance(which, Path):
            target = which.target
            if isinstance(self._shape, Opt):
                target = Opt(target)
            return Record(target, [self._exprs[i] for i in which.indexes], self._context)
        return self._part(which)

    def _part(self, which: int | str) -> Record:
        at, shape = part(self._shape, which)
        return Record(shape, self._exprs[at : at + shape.width], self._context)

    def just(self) -> Record:
        return Record(Opt(self._shape), self._exprs, self._context)

    flatten_maybe = just

    @property
    def expr(self) -> Expr:
        if len(self._exprs) != 1:
            raise TypeError(f"one column is needed here, not {len(self._exprs)}")
        return self._exprs[0]

    @property
    def dtype(self) -> T.DataType | None:
        return self.expr.dtype

    def columns(self) -> list[Expr]:
        return list(self._exprs)

    # comparison: rows compare column by column in three-valued logic
    def __eq__(self, other: Any) -> Record:  # type: ignore[override]
        return self._compare(other, lambda a, b: a == b, "=")

    def __ne__(self, other: Any) -> Record:  # type: ignore[override]
        return self._compare(other, lambda a, b: a != b, "<>")

    def __lt__(self, other: Any) -> Record:
        return self._compare(other, lambda a, b: a < b, "<")

    def __le__(self, other: Any) -> Record:
        return self._compare(other, lambda a, b: a <= b, "<=")

    def __gt__(self, other: Any) -> Record:
        return self._compare(other, lambda a, b: a > b, ">")

    def __ge__(self, other: Any) -> Record:
        return self._compare(other, lambda a, b: a >= b, ">=")

    def _compare(self, other: Any, fn: Callable, symbol: str) -> Record:
        right = as_record(other, self)
        n = len(self._exprs)
        if len(right._exprs) != n:
            raise TypeError(f"{n} columns compared with {len(right._exprs)}")
        if n == 1:
            return self._predicate(Op(fn, [*self._exprs, *right._exprs], T.BooleanType(), f"({{}} {symbol} {{}})"), right)

        def rows(*cols: Column) -> Column:
            a, b = cols[:n], cols[n:]
            same = [x == y for x, y in zip(a, b, strict=True)]
            if symbol in ("=", "<>"):
                out = same[0]
                for s in same[1:]:
                    out = out & s
                return out if symbol == "=" else ~out
            out = fn(a[-1], b[-1])
            for i in range(n - 2, -1, -1):
                strict = a[i] < b[i] if symbol[0] == "<" else a[i] > b[i]
                out = strict | (same[i] & out)
            return out

        marks = ", ".join(["{}"] * n)
        return self._predicate(Op(rows, [*self._exprs, *right._exprs], T.BooleanType(), f"(({marks}) {symbol} ({marks}))"), right)

    def _predicate(self, expr: Expr, *others: Record) -> Record:
        return Record(Leaf(T.BooleanType()), [expr], _context(self, *others))

    # logic
    def __and__(self, other: Any) -> Record:
        other = as_record(other)
        return self._predicate(Op(lambda a, b: a & b, [self.expr, other.expr], T.BooleanType(), "({} AND {})"), other)

    def __or__(self, other: Any) -> Record:
        other = as_record(other)
        return self._predicate(Op(lambda a, b: a | b, [self.expr, other.expr], T.BooleanType(), "({} OR {})"), other)

    def __invert__(self) -> Record:
        return self._predicate(Op(lambda a: ~a, [self.expr], T.BooleanType(), "(NOT {})"))

    # arithmetic; the operands' type is kept
    def __add__(self, other: Any) -> Record:
        return self._arithmetic(other, lambda a, b: a + b, "+")

    def __radd__(self, other: Any) -> Record:
        return as_record(other, self)._arithmetic(self, lambda a, b: a + b, "+")

    def __sub__(self, other: Any) -> Record:
        return self._arithmetic(other, lambda a, b: a - b, "-")

    def __rsub__(self, other: Any) -> Record:
        return as_record(other, self)._arithmetic(self, lambda a, b: a - b, "-")

    def __mul__(self, other: Any) -> Record:
        return self._arithmetic(other, lambda a, b: a * b, "*")

    def __rmul__(self, other: Any) -> Record:
        return as_record(other, self)._arithmetic(self, lambda a, b: a * b, "*")

    def __truediv__(self, other: Any) -> Record:
        right = as_record(other, self)
        dtype = self.dtype or right.dtype
        if isinstance(dtype, T.IntegralType) and isinstance(right.dtype, (T.IntegralType, type(None))):
            return self._arithmetic(right, lambda a, b: F.call_function("div", a, b).cast(dtype), "/")
        return self._arithmetic(right, lambda a, b: a / b, "/")

    def __rtruediv__(self, other: Any) -> Record:
        return as_record(other, self) / self

    def _arithmetic(self, other: Any, fn: Callable, symbol: str) -> Record:
        right = as_record(other, self)
        return self._like(Op(fn, [self.expr, right.expr], self.dtype or right.dtype, f"({{}} {symbol} {{}})"), right)

    def __neg__(self) -> Record:
        return self._like(Op(lambda a: -a, [self.expr], self.dtype, "(- {})"))

    def _like(self, expr: Expr, *others: Record) -> Record:
        maybe = any(isinstance(r._shape, Opt) for r in (self, *others))
        leaf = Leaf(expr.dtype, True) if maybe else Leaf(expr.dtype, False)
        return Record(Opt(leaf) if maybe else leaf, [expr], _context(self, *others))

    def cast(self, dtype: T.DataType) -> Record:
        """Re-type a number; Spark needs the conversion that the type says."""
        return self._like(Op(lambda a: a.cast(dtype), [self.expr], dtype, "{}"))

    from_integral = cast

    def show_num(self) -> Record:
        return self.cast(T.StringType())

    # strings
    def concat(self, other: Any) -> Record:
        right = as_record(other, self)
        return self._like(Op(F.concat, [self.expr, right.expr], T.StringType(), "({} || {})"), right)

    def like(self, pattern: Any) -> Record:
        """SQL LIKE without an escape character: a back-slash stands for itself."""
        if isinstance(pattern, str):
            return self._predicate(Op(lambda a: a.like(pattern.replace("\\", "\\\\")), [self.expr], T.BooleanType(), f"({{}} LIKE {quoted(pattern)})"))
        right = as_record(pattern)
        return self._predicate(Op(lambda a, b: F.like(a, F.replace(b, F.lit("\\"), F.lit("\\\\"))), [self.expr, right.expr], T.BooleanType(), "({} LIKE {})"), right)

    # nulls
    def is_nothing(self) -> Record:
        return self._predicate(Op(lambda a: a.isNull(), [self._exprs[self._shape.key]], T.BooleanType(), "({} IS NULL)"))

    def is_just(self) -> Record:
        return ~self.is_nothing()

    # membership
    def in_(self, values: Any) -> Record:
        """A list of literals, or a relation (see ``Query.query_list``)."""
        if isinstance(values, RecordList):
            return self._predicate(Sub("in", values.relation, self._exprs, T.BooleanType()))
        own = list(values)
        if not own:
            raise ValueError("IN needs at least one value")
        if len(self._exprs) == 1:
            args = [as_record(v, self).expr for v in own]
            marks = ", ".join(["{}"] * len(args))
            return self._predicate(Op(lambda a, *b: a.isin(*b), [self.expr, *args], T.BooleanType(), f"({{}} IN ({marks}))"))
        out = self == own[0]
        for v in own[1:]:
            out = out | (self == v)
        return out


class RecordList:
    """A relation as the right side of IN, or for EXISTS."""

    def __init__(self, relation: Any):
        self.relation = relation


def _context(*records: Record) -> str:
    kinds = {r._context for r in records}
    return AGGREGATED if AGGREGATED in kinds else WINDOW if WINDOW in kinds else FLAT


def as_record(value: Any, like: Record | None = None) -> Record:
    if isinstance(value, Record):
        return value
    if isinstance(value, Column):
        return Record(Leaf(None), [Native(value)])
    if isinstance(value, tuple):
        own = [as_record(v, like[i] if like is not None and isinstance(bare(like._shape), Tup) else None) for i, v in enumerate(value)]
        return record(*own)
    if hasattr(value, "__fields__"):
        shape = type(value).shape()
        return Record(shape, [Lit(v, x.dtype) for v, x in zip(shape.encode(value), shape.leaves(), strict=True)])
    dtype = type_of(value)
    if like is not None and len(like._exprs) == 1 and like.dtype is not None and (value is None or type(dtype) is not type(like.dtype) and isinstance(dtype, T.NumericType) and isinstance(like.dtype, T.NumericType) and not (isinstance(dtype, T.FractionalType) and isinstance(like.dtype, T.IntegralType))):
        dtype = like.dtype
    leaf = Leaf(dtype, value is None)
    return Record(leaf, [Lit(value, dtype)])


def value(v: Any, dtype: T.DataType | None = None) -> Record:
    """A literal of any supported type: scalars, tuples, model instances."""
    if dtype is not None:
        return Record(Leaf(dtype, v is None), [Lit(v, dtype)])
    return as_record(v)


def true() -> Record:
    return value(True)


def false() -> Record:
    return value(False)


def nothing(shape: Any) -> Record:
    """NULL for every column of a shape, model or type."""
    s = shape_of(shape)
    return Record(Opt(s), [Lit(None, x.dtype) for x in s.leaves()])


def shape_of(x: Any) -> Shape:
    if isinstance(x, Shape):
        return x
    if isinstance(x, T.DataType):
        return Leaf(x)
    if isinstance(x, tuple):
        return Tup([shape_of(p) for p in x])
    return x.shape()


def record(*parts: Any) -> Record:
    """A tuple of records; ``record(a)`` is a itself."""
    own = [as_record(p) for p in parts]
    if len(own) == 1:
        return own[0]
    return Record(Tup([r._shape for r in own]), [e for r in own for e in r._exprs], _context(*own))


def construct(kind: type, *parts: Any) -> Record:
    """A record of a model's type (or any class with ``shape``) from its fields."""
    own = [as_record(p) for p in parts]
    shape = kind.shape()
    return Record(shape, [e for r in own for e in r._exprs], _context(*own))


def expr(text: str, dtype: T.DataType | None = None) -> Record:
    """Raw SQL text as an expression."""
    return Record(Leaf(dtype), [Native(F.expr(text), dtype, text)])


def unary(fn: Callable[[Column], Column], a: Any, dtype: T.DataType | None = None) -> Record:
    r = as_record(a)
    return r._like(Op(fn, [r.expr], dtype or r.dtype, f"{getattr(fn, '__name__', 'f')}({{}})"))


def binary(fn: Callable[[Column, Column], Column], a: Any, b: Any, dtype: T.DataType | None = None) -> Record:
    left = as_record(a)
    right = as_record(b, left)
    return left._like(Op(fn, [left.expr, right.expr], dtype or left.dtype, f"{getattr(fn, '__name__', 'f')}({{}}, {{}})"), right)


def exists(rows: RecordList) -> Record:
    return Record(Leaf(T.BooleanType()), [Sub("exists", rows.relation, (), T.BooleanType())])


def from_maybe(default: Any, maybe: Record) -> Record:
    """The optional record, or the default when its key column is NULL; other NULLs stay."""
    key = maybe._exprs[maybe._shape.key]
    inner = bare(maybe._shape)
    d = as_record(default, maybe)
    own = [Op(lambda k, x, y: F.when(k.isNull(), x).otherwise(y), [key, x, y], leaf.dtype, "CASE WHEN ({} IS NULL) THEN {} ELSE {} END") for x, y, leaf in zip(d._exprs, maybe._exprs, inner.leaves(), strict=True)]
    return Record(inner, own, _context(d, maybe))


def _cases(branches: list[tuple[Record, Record]], other: Record | None) -> Record:
    if not branches:
        raise ValueError("CASE needs at least one branch")
    first = branches[0][1]
    n = len(branches)
    out = []
    for i in range(len(first._exprs)):
        args = [c.expr for c, _ in branches] + [r._exprs[i] for _, r in branches] + ([other._exprs[i]] if other is not None else [])

        def build(*cols: Column) -> Column:
            col = F.when(cols[0], cols[n])
            for k in range(1, n):
                col = col.when(cols[k], cols[n + k])
            return col.otherwise(cols[2 * n]) if len(cols) > 2 * n else col

        out.append(Case(build, args, first._exprs[i].dtype or (other._exprs[i].dtype if other is not None else None), n))
    shape = first._shape if other is not None else Opt(first._shape)
    return Record(shape, out, _context(*[x for b in branches for x in b], *([other] if other is not None else [])))


class Case(Op):
    def __init__(self, fn: Callable, args: list[Expr], dtype: T.DataType | None, n: int):
        super().__init__(fn, args, dtype)
        self.text = "CASE " + " ".join("WHEN {%d} THEN {%d}" % (k, n + k) for k in range(n)) + (" ELSE {%d}" % (2 * n) if len(args) > 2 * n else "") + " END"


def case_search(branches: list[tuple[Any, Any]], otherwise: Any) -> Record:
    """CASE WHEN ... ELSE ... END; results may be whole records."""
    own = [(as_record(c), as_record(r)) for c, r in branches]
    return _cases(own, as_record(otherwise, own[0][1] if own else None))


def case_search_maybe(branches: list[tuple[Any, Any]]) -> Record:
    return _cases([(as_record(c), as_record(r)) for c, r in branches], None)


def case(subject: Record, branches: list[tuple[Any, Any]], otherwise: Any) -> Record:
    """Simple CASE: the subject is compared with each branch's value."""
    return case_search([(subject == w, r) for w, r in branches], otherwise)


def case_maybe(subject: Record, branches: list[tuple[Any, Any]]) -> Record:
    return case_search_maybe([(subject == w, r) for w, r in branches])


def placeholder(name: str, shape: Any) -> Record:
    """A named parameter of any shape, bound when the relation is run."""
    s = shape_of(shape)
    leaves = s.leaves()
    own = [Param(name if len(leaves) == 1 else f"{name}.{i}", x.dtype) for i, x in enumerate(leaves)]
    return Record(s, own)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def path_record(r: Record, p: Path | None) -> Record:
    return r[p or identity(r._shape)]
