"""Shapes of records: which flat columns form which tuple, record or optional."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


class Shape:
    """Flat columns with structure. ``width`` columns; key: the one that tells an optional's presence."""

    width = 0
    key = 0

    def leaves(self) -> list[Leaf]:
        raise NotImplementedError

    def decode(self, values: list[Any]) -> Any:
        raise NotImplementedError

    def encode(self, value: Any) -> list[Any]:
        raise NotImplementedError


@dataclass(frozen=True)
class Leaf(Shape):
    dtype: T.DataType
    nullable: bool = True
    width = 1

    def leaves(self) -> list[Leaf]:
        return [self]

    def decode(self, values: list[Any]) -> Any:
        return values[0]

    def encode(self, value: Any) -> list[Any]:
        return [value]


class Tup(Shape):
    def __init__(self, parts: list[Shape]):
        self.parts = list(parts)
        self.width = sum(p.width for p in self.parts)
        self.key = self.parts[0].key if self.parts else 0

    def leaves(self) -> list[Leaf]:
        return [x for p in self.parts for x in p.leaves()]

    def spans(self) -> list[tuple[int, int]]:
        ends, at = [], 0
        for p in self.parts:
            ends.append((at, at + p.width))
            at += p.width
        return ends

    def decode(self, values: list[Any]) -> Any:
        return tuple(p.decode(values[a:b]) for p, (a, b) in zip(self.parts, self.spans(), strict=True))

    def encode(self, value: Any) -> list[Any]:
        return [x for p, v in zip(self.parts, value, strict=True) for x in p.encode(v)]


class Rec(Tup):
    def __init__(self, kind: type, fields: list[tuple[str, Shape]], key: int = 0):
        super().__init__([s for _, s in fields])
        self.kind, self.names, self.key = kind, [n for n, _ in fields], key

    def decode(self, values: list[Any]) -> Any:
        return self.kind(*super().decode(values))

    def encode(self, value: Any) -> list[Any]:
        return super().encode([getattr(value, n) for n in self.names])


class Opt(Shape):
    def __init__(self, inner: Shape):
        self.inner = inner.inner if isinstance(inner, Opt) else inner
        self.width, self.key = self.inner.width, self.inner.key

    def leaves(self) -> list[Leaf]:
        return [Leaf(x.dtype, True) for x in self.inner.leaves()]

    def decode(self, values: list[Any]) -> Any:
        return None if self.width and values[self.key] is None else self.inner.decode(values)

    def encode(self, value: Any) -> list[Any]:
        return [None] * self.width if value is None else self.inner.encode(value)


def bare(shape: Shape) -> Shape:
    return shape.inner if isinstance(shape, Opt) else shape


def part(shape: Shape, which: int | str) -> tuple[int, Shape]:
    """(first column, shape) of a tuple's or record's part, seen through an optional."""
    inner = bare(shape)
    if not isinstance(inner, Tup):
        raise TypeError("a single column has no parts")
    if isinstance(which, str):
        if not isinstance(inner, Rec) or which not in inner.names:
            raise AttributeError(which)
        which = inner.names.index(which)
    child = inner.parts[which]
    return inner.spans()[which][0], Opt(child) if isinstance(shape, Opt) else child


class Path:
    """Column indexes of one record type; ``a >> b`` composes."""

    def __init__(self, indexes: list[int], source: Shape, target: Shape | None = None):
        self.indexes, self.source = list(indexes), source
        if target is None:
            leaves = source.leaves()
            own: list[Shape] = [leaves[i] for i in self.indexes]
            target = own[0] if len(own) == 1 else Tup(own)
        self.target = target

    def __rshift__(self, other: Path) -> Path:
        return Path([self.indexes[i] for i in other.indexes], self.source, other.target)

    @property
    def width(self) -> int:
        return len(self.indexes)


def identity(shape: Shape) -> Path:
    return Path(list(range(shape.width)), shape, shape)
