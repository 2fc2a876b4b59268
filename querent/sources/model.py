"""Declared tables: models, fields, keys, and how they map to Spark schemas.

A model is declared as a class, or inferred from any DataFrame::

    class Customer(Model):
        __table__ = "customer"
        c_custkey = Field(T.LongType(), primary_key=True)
        c_name = Field(T.StringType(), nullable=True)

``Customer.c_name`` is a path into records of that type; instances hold values
and are what rows decode to. Columns stay flat: a nested record takes as many
columns as it has leaves.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from querent.functions.shape import Leaf, Path, Rec, Shape


class Field:
    """A column. ``unique`` names a uniqueness constraint it belongs to."""

    def __init__(self, dtype: T.DataType, *, nullable: bool = False, primary_key: bool = False, unique: str | None = None, default: Any = None):
        self.dtype, self.nullable, self.primary_key, self.unique, self.default = dtype, nullable and not primary_key, primary_key, unique, default
        self.name = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, instance: Any, owner: type) -> Any:
        if instance is None:
            return owner.path(self.name)
        return instance.__dict__.get(self.name)


class Model:
    """Base of declared record types; see the module's text."""

    __table__ = ""
    __fields__: tuple[Field, ...] = ()
    #: Order of a composite key's columns, where it differs from the columns' order.
    __key__: tuple[str, ...] = ()

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        own = [v for v in vars(cls).values() if isinstance(v, Field)]
        cls.__fields__ = (*cls.__fields__, *own)

    def __init__(self, *args: Any, **kw: Any):
        names = self.names()
        if len(args) > len(names) or (unknown := set(kw) - set(names)):
            raise TypeError(f"{type(self).__name__} has the fields {names}")
        self.__dict__.update(dict.fromkeys(names), **dict(zip(names, args, strict=False)), **kw)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.__dict__ == other.__dict__

    def __hash__(self) -> int:
        return hash(tuple(self.__dict__.values()))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items())})"

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in cls.__fields__]

    @classmethod
    def shape(cls) -> Shape:
        return Rec(cls, [(f.name, Leaf(f.dtype, f.nullable)) for f in cls.__fields__], cls.not_null_index())

    @classmethod
    def path(cls, *names: str) -> Path:
        """Path to one column, or to several as a tuple."""
        return Path([cls.names().index(n) for n in names], cls.shape())

    @classmethod
    def not_null_index(cls) -> int:
        """The column that tells whether an optional record is there."""
        keys = [i for i, f in enumerate(cls.__fields__) if f.primary_key]
        return next(iter(keys + [i for i, f in enumerate(cls.__fields__) if not f.nullable]), 0)

    @classmethod
    def primary_key(cls) -> list[str]:
        return list(cls.__key__) or [f.name for f in cls.__fields__ if f.primary_key]

    @classmethod
    def unique_key(cls, name: str) -> list[str]:
        return [f.name for f in cls.__fields__ if f.unique == name]

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dtype, f.nullable) for f in cls.__fields__])

    @classmethod
    def values(cls, record: Model) -> list[Any]:
        return [getattr(record, n) for n in cls.names()]


def model_from_frame(name: str, df: DataFrame, *, primary_key: tuple[str, ...] = (), overrides: dict[str, T.DataType] | None = None) -> type[Model]:
    """A model with the frame's columns, lower-cased; an override keeps nullability."""
    fields = {}
    for f in df.schema.fields:
        column = f.name.lower()
        fields[column] = Field((overrides or {}).get(column, f.dataType), nullable=f.nullable and column not in primary_key, primary_key=column in primary_key)
    if not fields:
        raise ValueError(f"{name} has no columns")
    return type(name.title().replace("_", ""), (Model,), {"__table__": name, "__key__": tuple(primary_key), **fields})
