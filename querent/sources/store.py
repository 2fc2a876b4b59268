"""Snapshot-versioned Parquet tables with INSERT, UPDATE, DELETE and key updates.

A store is a folder of immutable data files and numbered version files; a
version lists the data files of every table, which is a snapshot of the whole
store. Inserts add files and leave the rest alone; updates and deletes first
look for the files that hold affected rows (a pruned, filtered scan) and
rewrite only those. A commit writes the next version aside and gives it its
name by a rename that never replaces a file, so readers see the old or the new
snapshot of all tables and nothing between, and of two writers of one version
one fails. The one that fails takes the new version for its base and tries
again if nobody changed a table that it had read; else it gets ``Conflict``,
and none of its tables has changed. All file access goes through Hadoop's file
system, so the store may lie anywhere Spark can write.

Within ``with store.transaction() as tx`` statements see their own effects;
nothing persists unless the block ends normally.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions.expr import FLAT, Record, Ref, Scope, as_record
from querent.functions.shape import Path
from querent.operators.relation import Query, Relation, as_relation
from querent.sources.database import Database, _flat


def _renamed(model: type, df: DataFrame) -> DataFrame:
    """The columns under names that no relation inside a statement can capture."""
    return df.select(*[F.col(f"`{n}`").alias(f"target_{n}") for n in model.names()], *PLACE)


#: A row's file and its place in it: the same in every scan, however files are split.
PLACE = ("target_file", "target_row")


def _counted(rows: DataFrame, hit: Column, times: Column | None = None) -> tuple[DataFrame, Callable[[], int]]:
    """rows, and how many of them were hit (each so many times) once they have been written: one pass for both."""
    seen = Observation()
    return rows.observe(seen, F.coalesce(F.sum(F.when(hit, F.lit(1) if times is None else times)), F.lit(0)).alias("n")), lambda: int(seen.get["n"])


#: Rows that a bulk insert takes at a time.
CHUNK = 100_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, base: Database | None = None):
        self.spark, self.root, self.base = spark, root.rstrip("/"), base

    # files
    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        """The newest version's number and its tables."""
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        last = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        return last, self._version(last) if last else {}

    def _version(self, number: int) -> dict:
        stream = self._fs().open(self._path("_versions", f"{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _load(self, name: str, version: int | None = None) -> dict:
        tables = self._latest()[1] if version is None else self._version(version)
        if name not in tables:
            raise KeyError(f"no table {name}")
        return tables[name]

    def _publish(self, version: int, tables: dict) -> bool:
        """Whether this is now the version of that number."""
        jvm, fs = self.spark._jvm, self._fs()
        staged, target = self._path("_versions", f".{uuid.uuid4().hex}"), self._path("_versions", f"{version:08d}.json")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # never replaces
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), options)
            return True
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False

    def exists(self, name: str) -> bool:
        return name in self._latest()[1]

    def versions(self) -> list[int]:
        """The numbers of the store's snapshots."""
        fs, folder = self._fs(), self._path("_versions")
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json")) if fs.exists(folder) else []

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._frame(self._load(name, version))

    def _frame(self, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        if not state["data"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{d}" for d in state["data"]])

    def create(self, model: type, rows: DataFrame | None = None) -> None:
        """A new table of the model's columns, with the rows given."""
        with self.transaction() as tx:
            tx.state[model.__table__] = {"schema": model.schema().jsonValue(), "data": []}
            tx.changed.add(model.__table__)
            if rows is not None:
                tx._append(model.__table__, rows.select(*model.names()))

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        tx = Transaction(self)
        yield tx
        tx.commit()

    def prepare(self, verb: str, *args: Any, **kw: Any) -> PreparedStatement:
        """An INSERT, UPDATE, DELETE or raw statement whose placeholders are bound later, again and again."""
        if verb not in VERBS:
            raise ValueError(f"a statement is one of {', '.join(VERBS)}")
        return PreparedStatement(self, verb, args, kw)

    # one statement, one transaction
    def __getattr__(self, verb: str) -> Callable:
        if verb.startswith("_") or not hasattr(Transaction, verb):
            raise AttributeError(verb)

        def run(*args: Any, **kw: Any) -> Any:
            with self.transaction() as tx:
                return getattr(tx, verb)(*args, **kw)

        return run


#: Statements that may be prepared.
VERBS = ("delete", "execute", "insert_query", "insert_value", "update", "update_all_columns")


class PreparedStatement:
    def __init__(self, store: Store, verb: str, args: tuple, kw: dict[str, Any]):
        self.store, self.verb, self.args, self.kw = store, verb, args, kw

    def bind(self, **params: Any) -> BoundStatement:
        return BoundStatement(self, params)

    def execute(self, **params: Any) -> int:
        return self.bind(**params).execute()

    def map(self, rows: Iterable[dict[str, Any]]) -> list[int]:
        """The counts of one execution a row of parameters, all in one transaction."""
        with self.store.transaction() as tx:
            return [self.bind(**row).execute(tx) for row in rows]


class BoundStatement:
    def __init__(self, prepared: PreparedStatement, params: dict[str, Any]):
        self.prepared, self.params = prepared, params

    def execute(self, tx: Transaction | None = None) -> int:
        """The number of rows affected, in a transaction of its own or in the one given."""
        p = self.prepared
        return getattr(tx or p.store, p.verb)(*p.args, **p.kw, **self.params)


class Assignments:
    """SET terms and restrictions of an update, or values of an insert."""

    def __init__(self, model: type):
        self.model = model
        self.terms: dict[str, Record] = {}
        self.query = Query()

    def assign(self, target: Path | str, value: Any) -> Assignments:
        """A column, or several by a path, take the value's columns."""
        path = self.model.path(target) if isinstance(target, str) else target
        names = [self.model.names()[i] for i in path.indexes]
        own = as_record(value) if not isinstance(value, Record) else value
        if len(own.columns()) != len(names):
            raise TypeError(f"{len(names)} columns for {len(own.columns())} values")
        for n, e in zip(names, own.columns(), strict=True):
            if n in self.terms:
                raise TypeError(f"{n} is assigned twice")
            self.terms[n] = Record(as_record(None)._shape, [e], own._context)
        return self

    def wheres(self, predicate: Record) -> Assignments:
        self.query.wheres(predicate)
        return self

    query_list = property(lambda self: self.query.query_list)
    query_exists = property(lambda self: self.query.query_exists)
    query_scalar = property(lambda self: self.query.query_scalar)


class Transaction:
    """Statements over staged snapshots; each returns the number of rows it affected."""

    def __init__(self, store: Store):
        self.store = store
        self.version, self.start = store._latest()
        self.state: dict[str, dict] = {}
        self.changed: set[str] = set()

    # staging
    def _of(self, name: str) -> dict:
        if name not in self.state:
            if name not in self.start:
                raise KeyError(f"no table {name}")
            self.state[name] = self.start[name]
        return self.state[name]

    def exists(self, name: str) -> bool:
        return name in self.state or name in self.start

    def read(self, name: str) -> DataFrame:
        return self.store._frame(self._of(name))

    def _write(self, name: str, rows: DataFrame) -> list[str]:
        """Writes rows; the new files."""
        schema = T.StructType.fromJson(self._of(name)["schema"])
        folder = f"{name}/data-{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(f"{self.store.root}/{folder}")
        found = self.store._fs().listStatus(self.store._path(folder))
        return [f"{folder}/{n}" for n in sorted(f.getPath().getName() for f in found) if n.startswith("part-")]

    def _append(self, name: str, rows: DataFrame) -> int:
        state = self._of(name)
        rows, seen = _counted(rows, F.lit(True))
        files = self._write(name, rows)
        self.state[name] = {**state, "data": [*state["data"], *files]}
        self.changed.add(name)
        return seen()

    def _rewrite(self, name: str, affected: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], tuple[DataFrame, Callable[[], int]]]) -> int:
        """Changes the files that hold rows of affected(all rows); the rows' number.

        The frames have the table's columns and PLACE.
        """
        state = self._of(name)
        if not state["data"]:
            return 0
        scan = lambda files: self.store._frame({**state, "data": files}).select("*", F.col("_metadata.file_path").alias("target_file"), F.col("_metadata.row_index").alias("target_row"))
        # One row a file at most.
        paths = {"/".join(r[0].rsplit("/", 3)[1:]) for r in affected(scan(state["data"])).select("target_file").distinct().collect()}
        hit = [f for f in state["data"] if "/".join(f.rsplit("/", 2)) in paths]
        if not hit:
            return 0
        rows, count = change(scan(hit))
        files = self._write(name, rows)
        self.state[name] = {**state, "data": [*[f for f in state["data"] if f not in hit], *files]}
        self.changed.add(name)
        return count()

    def commit(self) -> None:
        """All changed tables in one version; Conflict, and none of them, if another writer changed a table used here."""
        if not self.changed:
            return
        version, now = self.version, self.start
        while not self.store._publish(version + 1, now | {n: self.state[n] for n in self.changed}):
            version, now = self.store._latest()
            if clash := sorted(n for n in self.state if now.get(n) != self.start.get(n)):
                raise Conflict(f"another writer has changed {', '.join(clash)}")
        self.version, self.start = version + 1, now | {n: self.state[n] for n in self.changed}
        self.changed.clear()

    def _db(self) -> Database:
        base = self.store.base
        return Database(self.store.spark, base.folder if base else None, store=self, frames=base.frames if base else None)

    def frame(self, rel: Any, names: list[str] | None = None, **params: Any) -> DataFrame:
        """A relation over the transaction's view of the tables."""
        return self._db().frame(rel, names, **params)

    # INSERT
    def insert(self, model: type, rows: Iterable[Any], columns: Path | None = None) -> int:
        """Model instances, or tuples of the columns of a path; one append however many."""
        names = [model.names()[i] for i in columns.indexes] if columns else model.names()
        if len(set(names)) != len(names):
            raise TypeError("a column is inserted twice")
        values = [tuple(model.values(r)) if isinstance(r, model) else (r if isinstance(r, tuple) else (r,)) for r in rows]
        schema = T.StructType([T.StructField(f.name, f.dataType) for n in names for f in model.schema().fields if f.name == n])
        return self._append(model.__table__, self._filled(model, self.store.spark.createDataFrame(values, schema)))

    def bulk_insert(self, model: type, rows: Iterable[Any], columns: Path | None = None, chunk: int = CHUNK, between: Callable[[int], Any] | None = None) -> int:
        """As :meth:`insert`, for any number of rows: they are taken ``chunk`` at a time, each an append of its own.

        After each chunk but the last ``between`` is called with the number of
        rows so far. A chunk that isn't stored as it was given is an error.
        """
        if chunk < 1:
            raise ValueError("a chunk has at least one row")
        total, source = 0, iter(rows)
        part = list(islice(source, chunk))
        while part:
            if (n := self.insert(model, part, columns)) != len(part):
                raise RuntimeError(f"{n} rows were stored of a chunk of {len(part)}")
            total += n
            part = list(islice(source, chunk))
            if part and between:
                between(total)
        return total

    def insert_value(self, model: type, describe: Callable[[Assignments], Any], **params: Any) -> int:
        """One row by assignments of literals and placeholders."""
        own = Assignments(model)
        describe(own)
        if not own.terms:
            raise ValueError("nothing is assigned")
        scope = Scope(self._db(), _flat(params))
        row = self.store.spark.range(1).select(*[r.expr.build(scope).alias(n) for n, r in own.terms.items()])
        return self._append(model.__table__, self._filled(model, row))

    def insert_value_list(self, model: type, rows: list[Any], columns: Path | None = None) -> int:
        return self.insert(model, rows, columns)

    def insert_query(self, model: type, rel: Any, columns: Path | None = None, **params: Any) -> int:
        names = [model.names()[i] for i in columns.indexes] if columns else model.names()
        if len(set(names)) != len(names):
            raise TypeError("a column is inserted twice")
        return self._append(model.__table__, self._filled(model, self.frame(as_relation(rel), names, **params)))

    def _filled(self, model: type, rows: DataFrame) -> DataFrame:
        given = set(rows.columns)
        for f in model.__fields__:
            if f.name not in given and not f.nullable and f.default is None:
                raise ValueError(f"{f.name} needs a value")
        return rows.select(*[F.col(f"`{f.name}`") if f.name in given else F.lit(f.default).cast(f.dtype).alias(f.name) for f in model.__fields__])

    # UPDATE, DELETE
    def _target(self, model: type, params: dict[str, Any]) -> tuple[Record, Scope]:
        names = [f"target_{n}" for n in model.names()]
        refs = [Ref(n, leaf.dtype, label) for n, leaf, label in zip(names, model.shape().leaves(), model.names(), strict=True)]
        return Record(model.shape(), list(refs), FLAT), Scope(self._db(), _flat(params), frozenset(names))

    def _where(self, model: type, query: Query, scope: Scope) -> Callable[[DataFrame], DataFrame]:
        def affected(df: DataFrame) -> DataFrame:
            df = _renamed(model, df)
            for r in query.restrictions:
                df = df.where(r.expr.build(scope))
            return df

        return affected

    def _matched(self, df: DataFrame, query: Query, scope: Scope) -> DataFrame:
        """df with a column that tells whether the restrictions are TRUE.

        A subquery may stand in a filter only, so the places of the rows that
        pass are joined back.
        """
        if not query.restrictions:
            return df.withColumn("hit", F.lit(True))
        plain = all(not any(type(x).__name__ == "Sub" for x in r.expr.walk()) for r in query.restrictions)
        if plain:
            hit = F.lit(True)
            for r in query.restrictions:
                hit = hit & r.expr.build(scope)
            return df.withColumn("hit", F.coalesce(hit, F.lit(False)))
        found = df
        for r in query.restrictions:
            found = found.where(r.expr.build(scope))
        found = found.select(*PLACE, F.lit(True).alias("found"))
        return df.join(found, list(PLACE), "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")

    def update(self, model: type, describe: Callable[[Assignments, Record], Any], **params: Any) -> int:
        """SET by assignments over the old row, where the restrictions are TRUE."""
        row, scope = self._target(model, params)
        own = Assignments(model)
        describe(own, row)
        if not own.terms:
            raise ValueError("nothing is set")

        def change(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
            rows, count = _counted(self._matched(_renamed(model, df), own.query, scope), F.col("hit"))
            old = {n: F.col(f"target_{n}") for n in model.names()}
            new = {n: F.when(F.col("hit"), own.terms[n].expr.build(scope)).otherwise(c) if n in own.terms else c for n, c in old.items()}
            return rows.select(*[c.alias(n) for n, c in new.items()]), count

        return self._rewrite(model.__table__, self._where(model, own.query, scope), change)

    def update_all_columns(self, model: type, record: Any, describe: Callable[[Assignments, Record], Any] | None = None, **params: Any) -> int:
        def whole(a: Assignments, row: Record) -> None:
            a.assign(model.path(*model.names()), as_record(record))
            if describe:
                describe(a, row)

        return self.update(model, whole, **params)

    def key_update(self, model: type, records: Iterable[Any], key: list[str] | None = None) -> int:
        """Replace the non-key columns of the rows with the records' keys, a record after the other.

        Of records that share a key the last one's values stay; the rows count once for each.
        """
        names = key or model.primary_key()
        rest = [n for n in model.names() if n not in names]
        if not names or not rest:
            raise TypeError("a key update needs a key and columns besides it")
        last: dict[tuple, list] = {}
        for r in records:
            own = tuple(getattr(r, n) for n in names)
            last[own] = [*model.values(r), last.get(own, [0])[-1] + 1]
        schema = T.StructType([*model.schema().fields, T.StructField("times", T.LongType())])
        new = self.store.spark.createDataFrame(list(map(tuple, last.values())), schema).select(*[F.col(n).alias(f"new_{n}") for n in model.names()], F.col("times").alias("new times"), F.lit(True).alias("hit"))
        same = [F.col(n) == F.col(f"new_{n}") for n in names]

        def change(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
            rows, count = _counted(df.join(new, same, "left"), F.col("hit"), F.col("new times"))
            return rows.select(*[F.col(n) if n in names else F.when(F.col("hit"), F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in model.names()]), count

        return self._rewrite(model.__table__, lambda df: df.join(new, same, "left_semi"), change)

    def delete(self, model: type, describe: Callable[[Assignments, Record], Any] | None = None, **params: Any) -> int:
        """Remove the rows for which the restrictions are TRUE; NULL keeps a row."""
        row, scope = self._target(model, params)
        own = Assignments(model)
        if describe:
            describe(own, row)

        def change(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
            rows, count = _counted(self._matched(_renamed(model, df), own.query, scope), F.col("hit"))
            return rows.where(~F.col("hit")).select(*[F.col(f"target_{n}").alias(n) for n in model.names()]), count

        return self._rewrite(model.__table__, self._where(model, own.query, scope), change)

    # raw statements
    def execute(self, text: str, **params: Any) -> int:
        """INSERT INTO, UPDATE or DELETE FROM a table of the store, as SQL text with named parameters."""
        from querent.sources.rawsql import statement

        own = statement(text)
        names = [f["name"] for f in self._of(own.table)["schema"]["fields"]]
        if own.verb == "insert":
            return self._append(own.table, self._raw_rows(own, names, params))
        if unknown := [n for n in own.terms if n not in names]:
            raise TypeError(f"{own.table} has no column {unknown[0]}")
        args = _flat(params) or None

        def view(df: DataFrame) -> DataFrame:
            df.createOrReplaceTempView(own.table)
            terms = ", ".join(["", *[f"{x} AS `new {n}`" for n, x in own.terms.items()]])
            return self.store.spark.sql(f"SELECT {', '.join(PLACE)}{terms} FROM {own.table} WHERE {own.where or 'TRUE'}", args=args)

        def change(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
            rows, count = _counted(df.join(view(df).withColumn("hit", F.lit(True)), list(PLACE), "left").fillna(False, ["hit"]), F.col("hit"))
            if own.verb == "delete":
                return rows.where(~F.col("hit")).select(*names), count
            return rows.select(*[F.when(F.col("hit"), F.col(f"new {n}")).otherwise(F.col(n)).alias(n) if n in own.terms else F.col(n) for n in names]), count

        self._exposed()
        return self._rewrite(own.table, view, change)

    def _exposed(self) -> None:
        """The store's tables and the base's frames as views."""
        for name in {*self.start, *self.state}:
            self.read(name).createOrReplaceTempView(name)
        if self.store.base:
            self.store.base.expose()

    def _raw_rows(self, own: Any, names: list[str], params: dict[str, Any]) -> DataFrame:
        self._exposed()
        given = own.columns or names
        rows = self.store.spark.sql(own.rows, args=_flat(params) or None)
        if len(rows.columns) != len(given) or set(given) - set(names) or len(set(given)) != len(given):
            raise TypeError(f"{len(rows.columns)} values for the columns {given} of {own.table}")
        rows = rows.toDF(*given)
        return rows.select(*[F.col(n) if n in given else F.lit(None).alias(n) for n in names])


__all__ = ["BoundStatement", "PreparedStatement", "Assignments", "Conflict", "Relation", "Store", "Transaction"]
