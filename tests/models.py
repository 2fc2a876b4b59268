from pyspark.sql import types as T

from querent.sources.database import Database
from querent.sources.model import Field, Model

I, L, S = T.IntegerType(), T.LongType(), T.StringType()


class SetA(Model):
    __table__ = "set_a"
    a0 = Field(I, primary_key=True)
    a1 = Field(S)
    a2 = Field(S)


class SetB(Model):
    __table__ = "set_b"
    b0 = Field(I, primary_key=True)
    b1 = Field(S, nullable=True)
    b2 = Field(S)


class SetC(Model):
    __table__ = "set_c"
    c0 = Field(I, primary_key=True)
    c1 = Field(S)
    c2 = Field(L)
    c3 = Field(S, nullable=True)


class KeyTest(Model):
    __table__ = "keytest"
    __key__ = ("foo", "name", "bar")
    name = Field(S, primary_key=True)
    bar = Field(I, primary_key=True)
    foo = Field(S, primary_key=True)
    attr = Field(S, unique="one")
    baz = Field(I)


ROWS = {
    SetA: [(1, "A", "x"), (2, "B", "y"), (3, "A", "z"), (9, "Q", "x")],
    SetB: [(1, "A", "x"), (2, None, "y"), (4, "Z", "x")],
    SetC: [(1, "p", 10, None), (1, "p", 10, "m"), (2, "q", 20, "m"), (2, "q", 30, "n")],
}


def database(spark):
    return Database(spark, frames={m.__table__: spark.createDataFrame(rows, m.schema()) for m, rows in ROWS.items()})
