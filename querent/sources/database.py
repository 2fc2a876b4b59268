"""Where tables come from, and how relations are run and fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from querent.functions.expr import Scope
from querent.operators.relation import Relation, as_relation

S = TypeVar("S")


class Database:
    """Tables of a folder of Parquet files, of a snapshot store, or of Spark's catalog, in the order store, frames, folder, catalog."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: Any = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.store, self.frames = spark, folder, store, dict(frames or {})

    def table(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The table; with a model's schema the files of a folder need not be looked into before the query runs."""
        if self.store is not None and self.store.exists(name):
            return self.store.read(name)
        if name in self.frames:
            return self.frames[name]
        if self.folder is not None:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.table(name)

    def expose(self) -> None:
        """Named frames as views, for raw SQL."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)

    def frame(self, rel: Any, names: list[str] | None = None, **params: Any) -> DataFrame:
        """The relation as a DataFrame; Catalyst has analysed it, nothing has run."""
        rel = as_relation(rel)
        values = _flat(params)
        if missing := rel.params() - values.keys():
            raise KeyError(f"no value for the parameters {sorted(missing)}")
        return rel.frame(Scope(self, values)).toDF(*(names or rel.names()))

    def execute(self, text: str, **params: Any) -> DataFrame:
        """Any SQL statement as it is; UPDATE, DELETE and MERGE need tables whose format supports them."""
        self.expose()
        return self.spark.sql(text, args=params or None)

    # fetching
    def prepare(self, rel: Any) -> Prepared:
        return Prepared(self, as_relation(rel))

    @contextmanager
    def prepared(self, rel: Any) -> Iterator[Prepared]:
        yield self.prepare(rel)

    def run(self, rel: Any, **params: Any) -> list[Any]:
        """All rows, decoded."""
        return self.prepare(rel).bind(**params).execute().fetch_all()

    def iterate(self, rel: Any, **params: Any) -> Iterator[Any]:
        """Decoded rows, fetched a partition at a time."""
        return iter(self.prepare(rel).bind(**params).execute())

    def first(self, rel: Any, **params: Any) -> Any:
        """The first row or None; further rows are ignored."""
        return self.prepare(rel).bind(**params).execute().fetch_unique()

    def one_or_none(self, rel: Any, **params: Any) -> Any:
        """The only row or None; more than one is an error."""
        return self.prepare(rel).bind(**params).execute().fetch_only()


def _flat(params: dict[str, Any]) -> dict[str, Any]:
    out = {}
    for k, v in params.items():
        if isinstance(v, tuple):
            out.update({f"{k}.{i}": x for i, x in enumerate(v)})
        elif hasattr(v, "__fields__"):
            out.update({f"{k}.{i}": x for i, x in enumerate(type(v).values(v))})
        out[k] = v
    return out


class Prepared:
    def __init__(self, db: Database, rel: Relation):
        self.db, self.rel = db, rel

    def bind(self, **params: Any) -> Bound:
        return Bound(self, params)

    def execute(self, **params: Any) -> Executed:
        return self.bind(**params).execute()


class Bound:
    def __init__(self, prepared: Prepared, params: dict[str, Any]):
        self.prepared, self.params = prepared, params

    def execute(self) -> Executed:
        p = self.prepared
        return Executed(p.db.frame(p.rel, **self.params), p.rel.shape)


class Executed:
    """Rows of a query, decoded on the way; each method reads from the first row on, fetch() from where it was."""

    def __init__(self, df: DataFrame, shape: Any):
        self.df, self.shape = df, shape
        self._rows: Iterator[Any] | None = None

    def __iter__(self) -> Iterator[Any]:
        return (self.shape.decode(list(r)) for r in self.df.toLocalIterator())

    def fetch(self) -> Any:
        """The next row, or None at the end."""
        if self._rows is None:
            self._rows = iter(self)
        return next(self._rows, None)

    def fetch_all(self) -> list[Any]:
        return [self.shape.decode(list(r)) for r in self.df.collect()]

    def fetch_unique(self) -> Any:
        return next((self.shape.decode(list(r)) for r in self.df.take(1)), None)

    def fetch_only(self) -> Any:
        rows = self.df.take(2)
        if len(rows) > 1:
            raise ValueError("more than one row")
        return self.shape.decode(list(rows[0])) if rows else None

    def fold(self, fn: Callable[[S, Any], S], start: S) -> S:
        for row in self:
            start = fn(start, row)
        return start

    def for_each(self, fn: Callable[[Any], Any]) -> list[Any]:
        return [fn(row) for row in self]
