"""SQL text of relations and statements, for logs and export; nothing here runs.

Tables in FROM are named T0, T1, ... in the order they are joined; columns of
derived tables and of results are f0, f1, ...
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from querent.functions.expr import Agg, Expr, Key, Lit, Native, Op, Over, Param, Rank, Record, Ref, Sub, quoted
from querent.operators.grouping import Power, Unit
from querent.operators.relation import Described, Limited, Query, RawQuery, Relation, SetOperation, TableRelation, Unique, as_relation


@dataclass
class Config:
    """Dialect switches of the text."""

    alias_as: bool = False
    quote: str = ""
    product_unit: bool = True
    schema: str = ""
    schema_qualified: bool = True
    normalized: bool = True

    def name(self, column: str) -> str:
        return f"{self.quote}{column.replace(self.quote, self.quote * 2)}{self.quote}" if self.quote else column

    def table(self, name: str) -> str:
        name = name.lower() if self.normalized else name
        if not (self.schema and self.schema_qualified):
            return self.name(name)
        return f"{self.name(self.schema.upper() if self.normalized else self.schema)}.{self.name(name)}"


@dataclass
class _Text:
    config: Config
    names: dict[str, str] = field(default_factory=dict)
    tables: int = 0

    # literals and expressions
    def literal(self, e: Lit) -> str:
        v = e.value
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "(0=0)" if v else "(0=1)"
        if isinstance(v, str):
            return quoted(v)
        if isinstance(v, (bytes, bytearray)):
            return quoted(bytes(v).decode())
        if isinstance(e.dtype, T.TimestampType):
            return f"TIMESTAMPTZ '{v:%Y-%m-%d %H:%M:%S%z}'"
        if isinstance(e.dtype, T.TimestampNTZType):
            return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
        if isinstance(e.dtype, T.DateType):
            return f"DATE '{v.isoformat()}'"
        if isinstance(e.dtype, T.TimeType):
            return f"TIME '{v.isoformat()}'"
        return f"({v})" if isinstance(v, (int, float)) and v < 0 else str(v)

    def expr(self, e: Expr) -> str:
        if isinstance(e, Ref):
            return self.names.get(e.name, self.config.name(e.label or e.name))
        if isinstance(e, Lit):
            return self.literal(e)
        if isinstance(e, Param):
            return "?"
        if isinstance(e, Native):
            return e.text or str(e.column)
        if isinstance(e, Key):
            return self.expr(e.source)
        if isinstance(e, Agg):
            return f"{e.text.upper()} ({', '.join(map(self.expr, e.args))})" if len(e.args) == 1 else f"{e.text.upper()} (({', '.join(map(self.expr, e.args))}))"
        if isinstance(e, Rank):
            return e.text.replace("()", " ()")
        if isinstance(e, Over):
            inside = []
            if e.partition:
                inside.append("PARTITION BY " + ", ".join(map(self.expr, e.partition)))
            if e.order:
                inside.append("ORDER BY " + self.orders(e.order))
            return f"{self.expr(e.term)} OVER ({' '.join(inside)})"
        if isinstance(e, Sub):
            own = _Text(self.config, dict(self.names), self.tables)
            body = own.relation(e.relation)
            self.tables = own.tables
            if e.kind == "exists":
                return f"(EXISTS ({body}))"
            if e.kind == "scalar":
                return f"({body})"
            needle = [self.expr(n) for n in e.needle]
            return f"({needle[0] if len(needle) == 1 else '(' + ', '.join(needle) + ')'} IN ({body}))"
        if isinstance(e, Op):
            return e.text.format(*[self.expr(a) for a in e.args]) if e.text else f"f({', '.join(map(self.expr, e.args))})"
        raise TypeError(f"no text for {type(e).__name__}")

    def orders(self, orders: list) -> str:
        return ", ".join(f"{self.expr(e)} {d.upper()}{f' NULLS {n.upper()}' if n else ''}" for e, d, n in orders)

    # relations
    def relation(self, rel: Relation) -> str:
        if isinstance(rel, Unique):
            return self.relation(rel.source)
        if isinstance(rel, TableRelation):
            return f"SELECT {', '.join(map(self.config.name, rel.names()))} FROM {self.config.table(rel.model.__table__)}"
        if isinstance(rel, RawQuery):
            return rel.text
        if isinstance(rel, Limited):
            return f"{self.relation(rel.source)} LIMIT {rel.n}{f' OFFSET {rel.offset}' if rel.offset else ''}"
        if isinstance(rel, SetOperation):
            word = rel.kind.replace("_", " ").upper()
            return f"{self._operand(rel.left)} {word} {self._operand(rel.right)}"
        if isinstance(rel, Described):
            return self._described(*rel.plan())
        raise TypeError(f"no text for {type(rel).__name__}")

    def _operand(self, rel: Relation) -> str:
        nested = isinstance(rel, (SetOperation, Limited)) or isinstance(rel, Described) and bool(rel.plan()[0].orders)
        return f"({self.relation(rel)})" if nested else self.relation(rel)

    def _source(self, rel: Relation, names: list[str]) -> str:
        alias = f"T{self.tables}"
        self.tables += 1
        while isinstance(rel, Unique):
            rel = rel.source
        base = isinstance(rel, TableRelation)
        for n, shown in zip(names, rel.names() if base else [f"f{i}" for i in range(len(names))], strict=True):
            self.names[n] = f"{alias}.{self.config.name(shown) if base else shown}"
        text = self.config.table(rel.model.__table__) if base else f"({self.relation(rel)})"
        return f"{text}{' AS' if self.config.alias_as else ''} {alias}"

    def _described(self, q: Query, result: Any) -> str:
        parts = []
        product, left_maybe = "", False
        for i, ((rel, names, maybe), conditions) in enumerate(zip(q.items, q.conditions, strict=True)):
            source = self._source(rel, names)
            if i == 0:
                product, left_maybe = source, maybe
                continue
            word = {(False, False): "INNER JOIN", (False, True): "LEFT JOIN", (True, False): "RIGHT JOIN", (True, True): "FULL JOIN"}[left_maybe, maybe]
            on = " AND ".join(self.expr(c.expr) for c in conditions) or "(0=0)"
            product, left_maybe = f"{product if i == 1 else f'({product})'} {word} {source} ON {on}", False
        columns = ", ".join(f"{self.expr(e)} AS f{i}" for i, e in enumerate(result.columns()))
        parts.append(f"SELECT {'DISTINCT' if q.unique_rows else 'ALL'} {columns}")
        if product:
            parts.append(f"FROM {product}")
        elif not self.config.product_unit:
            raise ValueError("this dialect needs a FROM clause")
        if q.restrictions:
            parts.append("WHERE " + " AND ".join(self.expr(r.expr) for r in q.restrictions))
        if q.elements:
            parts.append("GROUP BY " + ", ".join(self._element(e) for e in q.elements))
        if q.havings:
            parts.append("HAVING " + " AND ".join(self.expr(h.expr) for h in q.havings))
        if q.orders:
            parts.append("ORDER BY " + self.orders(q.orders))
        return " ".join(parts)

    def _element(self, e: Unit | Power) -> str:
        if isinstance(e, Unit):
            return ", ".join(map(self.expr, e.keys))
        return "GROUPING SETS (" + ", ".join(f"({', '.join(map(self.expr, s))})" for s in e.sets) + ")"


def to_sql(rel: Any, config: Config | None = None, suffix: str = "") -> str:
    """The relation's SELECT; suffix words follow as they are."""
    text = _Text(config or Config()).relation(as_relation(rel))
    return f"{text} {suffix}" if suffix else text


def column_texts(record: Any, config: Config | None = None) -> list[str]:
    """The text of each column of a record, or of a model's columns."""
    c = config or Config()
    if isinstance(record, Record):
        return [_Text(c).expr(e) for e in record.columns()]
    return [c.name(n) for n in as_relation(record).names()]


def export_sql(path: str, *relations: Any, config: Config | None = None) -> None:
    """Writes the texts to a local file, one a line."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(f"{to_sql(r, config)};\n" for r in relations)


def _where(text: _Text, query: Query) -> str:
    return " WHERE " + " AND ".join(text.expr(r.expr) for r in query.restrictions) if query.restrictions else ""


def insert_sql(model: type, columns: list[str] | None = None, rows: int = 1, config: Config | None = None) -> str:
    c = config or Config()
    names = columns or model.names()
    marks = f"({', '.join('?' * len(names))})"
    return f"INSERT INTO {c.table(model.__table__)} ({', '.join(map(c.name, names))}) VALUES {', '.join([marks] * rows)}"


def rows_per_insert(model: type, placeholders: int = 256) -> int:
    """Rows of one multi-row INSERT for a hint of placeholders a statement."""
    return max(1, -(-placeholders // len(model.names())))


def insert_query_sql(model: type, rel: Any, columns: list[str] | None = None, config: Config | None = None) -> str:
    c = config or Config()
    return f"INSERT INTO {c.table(model.__table__)} ({', '.join(map(c.name, columns or model.names()))}) {to_sql(rel, c)}"


def _statement(model: type, describe: Any, config: Config) -> tuple[_Text, Any]:
    from querent.sources.store import Assignments

    text = _Text(config, tables=1)
    refs: list[Expr] = [Ref(f"target_{n}", leaf.dtype, n) for n, leaf in zip(model.names(), model.shape().leaves(), strict=True)]
    text.names.update({f"target_{n}": f"T0.{config.name(n)}" for n in model.names()})
    own = Assignments(model)
    if describe:
        describe(own, Record(model.shape(), refs))
    return text, own


def update_sql(model: type, describe: Any, config: Config | None = None) -> str:
    c = config or Config()
    text, own = _statement(model, describe, c)
    if not own.terms:
        raise ValueError("nothing is set")
    sets = ", ".join(f"{c.name(n)} = {text.expr(r.expr)}" for n, r in own.terms.items())
    return f"UPDATE {c.table(model.__table__)}{' AS' if c.alias_as else ''} T0 SET {sets}{_where(text, own.query)}"


def key_update_sql(model: type, key: list[str] | None = None, config: Config | None = None) -> str:
    c = config or Config()
    names = key or model.primary_key()
    rest = [n for n in model.names() if n not in names]
    return f"UPDATE {c.table(model.__table__)} SET {', '.join(f'{c.name(n)} = ?' for n in rest)} WHERE {' AND '.join(f'{c.name(n)} = ?' for n in names)}"


def delete_sql(model: type, describe: Any = None, config: Config | None = None) -> str:
    c = config or Config()
    text, own = _statement(model, describe, c)
    return f"DELETE FROM {c.table(model.__table__)}{' AS' if c.alias_as else ''} T0{_where(text, own.query)}"


__all__ = ["Config", "column_texts", "delete_sql", "export_sql", "insert_query_sql", "insert_sql", "key_update_sql", "rows_per_insert", "to_sql", "update_sql"]
