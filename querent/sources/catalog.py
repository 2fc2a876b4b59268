"""Schema inference: column and key metadata of databases, as models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from querent.sources.model import Field, Model, model_from_frame

_NTZ, _S, _B = T.TimestampNTZType(), T.StringType(), T.BinaryType()
_INTERVAL = T.DayTimeIntervalType()

# The type names each database's catalog uses, and their types here.
POSTGRESQL = {
    "bool": T.BooleanType(), "char": _S, "name": _S, "int8": T.LongType(), "int2": T.ShortType(), "int4": T.IntegerType(), "text": _S, "oid": T.IntegerType(),
    "float4": T.FloatType(), "float8": T.DoubleType(), "abstime": _NTZ, "reltime": _INTERVAL, "tinterval": _INTERVAL, "bpchar": _S, "varchar": _S, "uuid": _S,
    "date": T.DateType(), "time": T.TimeType(6), "timestamp": _NTZ, "timestamptz": T.TimestampType(), "interval": _INTERVAL, "timetz": T.TimestampType(),
}
MYSQL = {
    "CHAR": _S, "VARCHAR": _S, "TINYTEXT": _S, "TEXT": _S, "MEDIUMTEXT": _S, "LONGTEXT": _S, "TINYBLOB": _B, "BLOB": _B, "MEDIUMBLOB": _B, "LONGBLOB": _B,
    "DATE": T.DateType(), "DATETIME": _NTZ, "TIME": T.TimeType(6), "TIMESTAMP": T.TimestampType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(),
    "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
}
ORACLE = {
    "CHAR": _S, "VARCHAR": _S, "VARCHAR2": _S, "NCHAR": _S, "NVARCHAR2": _S, "BINARY_FLOAT": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType(), "DATE": _NTZ,
    "BLOB": _B, "CLOB": _S, "NCLOB": _S, "LONG RAW": _B, "RAW": _B, "ROWID": _S, "UROWID": _S,
}
SQLSERVER = {
    "text": _B, "date": T.DateType(), "time": T.TimeType(6), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "real": T.DoubleType(),
    "datetime": _NTZ, "float": T.DoubleType(), "ntext": _S, "bit": _S, "bigint": T.LongType(), "varchar": _S, "binary": _B, "char": _S, "timestamp": _NTZ,
    "nvarchar": _S, "nchar": _S,
}
SQLITE3 = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "BIGINT": T.LongType(),
    "INT2": T.ShortType(), "INT8": T.LongType(), "CHARACTER": _S, "VARCHAR": _S, "TEXT": _S, "BLOB": _B, "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(), "DATE": T.DateType(), "DATETIME": _NTZ,
}
DB2 = {
    "VARCHAR": _S, "CHAR": _S, "CHARACTER": _S, "TIMESTAMP": _NTZ, "DATE": T.DateType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "BLOB": _S, "CLOB": _S,
}
TYPES = {"postgresql": POSTGRESQL, "mysql": MYSQL, "oracle": ORACLE, "sqlserver": SQLSERVER, "sqlite3": SQLITE3, "db2": DB2}


def column_type(system: str, name: str, *, scale: int | None = None, overrides: dict[str, T.DataType] | None = None) -> T.DataType:
    """The type of a catalog's type name; the user's map comes first."""
    if overrides and name in overrides:
        return overrides[name]
    if system == "oracle" and name == "NUMBER":
        return T.DecimalType(38, 0) if scale is None or scale <= 0 else T.DoubleType()
    known = TYPES[system]
    if name not in known:
        raise TypeError(f"{system} has no known type {name!r}")
    return known[name]


def not_null(system: str, flag: object) -> bool:
    """Whether a catalog's nullability flag says NOT NULL."""
    if system == "db2" or system == "oracle":
        return flag == "N"
    if system == "mysql":
        return flag == "NO"
    if system == "sqlserver":
        return flag is None or not flag
    return bool(flag)


#: Column name, type name and nullability flag of a table's columns, in order.
COLUMN_QUERIES = {
    "postgresql": "SELECT a.attname, t.typname, a.attnotnull FROM pg_attribute a JOIN pg_class c ON a.attrelid = c.oid JOIN pg_namespace n ON c.relnamespace = n.oid JOIN pg_type t ON a.atttypid = t.oid WHERE n.nspname = '{schema}' AND c.relname = '{table}' AND a.attnum > 0 AND NOT a.attisdropped ORDER BY a.attnum",
    "mysql": "SELECT column_name, upper(data_type), is_nullable FROM information_schema.columns WHERE table_schema = '{schema}' AND table_name = '{table}' ORDER BY ordinal_position",
    "oracle": "SELECT column_name, data_type, nullable, data_scale FROM dba_tab_columns WHERE owner = '{schema}' AND table_name = '{table}' ORDER BY column_id",
    "sqlserver": "SELECT c.name, t.name, c.is_nullable FROM sys.columns c JOIN sys.types t ON c.user_type_id = t.user_type_id WHERE c.object_id = OBJECT_ID('{schema}.{table}') ORDER BY c.column_id",
    "sqlite3": "SELECT name, type, \"notnull\" FROM pragma_table_info('{table}') ORDER BY cid",
    "db2": "SELECT colname, typename, nulls FROM syscat.columns WHERE tabschema = '{schema}' AND tabname = '{table}' ORDER BY colno",
}
#: Primary-key columns of a table, in key order.
KEY_QUERIES = {
    "postgresql": "SELECT a.attname FROM pg_constraint k JOIN pg_class c ON k.conrelid = c.oid JOIN pg_namespace n ON c.relnamespace = n.oid JOIN pg_attribute a ON a.attrelid = c.oid AND array_position(k.conkey, a.attnum) IS NOT NULL WHERE k.contype = 'p' AND n.nspname = '{schema}' AND c.relname = '{table}' ORDER BY array_position(k.conkey, a.attnum)",
    "mysql": "SELECT k.column_name FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k ON t.constraint_schema = k.constraint_schema AND t.table_name = k.table_name AND t.constraint_name = k.constraint_name WHERE t.constraint_type = 'PRIMARY KEY' AND t.table_schema = '{schema}' AND t.table_name = '{table}' ORDER BY k.ordinal_position",
    "oracle": "SELECT k.column_name FROM dba_constraints c JOIN dba_cons_columns k ON c.owner = k.owner AND c.constraint_name = k.constraint_name WHERE c.constraint_type = 'P' AND c.owner = '{schema}' AND c.table_name = '{table}' ORDER BY k.position",
    "sqlserver": "SELECT c.name FROM sys.indexes i JOIN sys.index_columns x ON i.object_id = x.object_id AND i.index_id = x.index_id JOIN sys.columns c ON x.object_id = c.object_id AND x.column_id = c.column_id WHERE i.is_primary_key = 1 AND i.object_id = OBJECT_ID('{schema}.{table}') ORDER BY x.key_ordinal",
    "sqlite3": "SELECT name FROM pragma_table_info('{table}') WHERE pk > 0 ORDER BY pk",
    "db2": "SELECT k.colname FROM syscat.tabconst c JOIN syscat.keycoluse k ON c.tabschema = k.tabschema AND c.tabname = k.tabname AND c.constname = k.constname WHERE c.type = 'P' AND c.tabschema = '{schema}' AND c.tabname = '{table}' ORDER BY k.colseq",
}


def model_of(system: str, table: str, columns: list[tuple], key: list[str], overrides: dict[str, T.DataType] | None = None) -> type[Model]:
    """A model from what a database's catalog tells: (name, type name, flag[, scale]) a column."""
    if not columns:
        raise ValueError(f"{table} has no columns")
    lower = [k.lower() for k in key]
    fields = {}
    for name, kind, flag, *scale in columns:
        n = name.lower()
        dtype = (overrides or {}).get(n) or column_type(system, kind, scale=scale[0] if scale else None)
        fields[n] = Field(dtype, nullable=not not_null(system, flag) and n not in lower, primary_key=n in lower)
    return type(table.title().replace("_", ""), (Model,), {"__table__": table, "__key__": tuple(lower), **fields})


def read_catalog(spark: SparkSession, system: str, url: str, schema: str, table: str, run: Callable[[str], DataFrame] | None = None, **options: str) -> type[Model]:
    """A model of a database's table, by its own catalog over JDBC, or by ``run``, which gives the rows of a query."""
    if "'" in schema + table:
        raise ValueError("quotes in a name")

    def rows(text: str) -> DataFrame:
        if run:
            return run(text.format(schema=schema, table=table))
        return spark.read.format("jdbc").options(url=url, query=text.format(schema=schema, table=table), **options).load()

    columns = [tuple(r) for r in rows(COLUMN_QUERIES[system]).collect()]
    return model_of(system, table, columns, [r[0] for r in rows(KEY_QUERIES[system]).collect()])


def model_from_table(spark: SparkSession, name: str, *, primary_key: tuple[str, ...] = (), overrides: dict[str, T.DataType] | None = None) -> type[Model]:
    """A model of a table in Spark's catalog, or of the Parquet files at a path."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return model_from_frame(name.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"), df, primary_key=primary_key, overrides=overrides)


def list_columns(spark: SparkSession, name: str) -> DataFrame:
    """name, data_type, nullable of a catalog table's columns."""
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "name string, data_type string, nullable boolean")
