"""Models of the test tables."""

from __future__ import annotations

from pyspark.sql import types as T

from querent.sources.model import Field, Model

_I, _L, _D, _S, _TS = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


class Region(Model):
    __table__ = "region"
    r_regionkey = Field(_I, primary_key=True)
    r_name = Field(_S)


class Nation(Model):
    __table__ = "nation"
    n_nationkey = Field(_I, primary_key=True)
    n_name = Field(_S)
    n_regionkey = Field(_I)


class Customer(Model):
    __table__ = "customer"
    c_custkey = Field(_L, primary_key=True)
    c_name = Field(_S)
    c_nationkey = Field(_I)
    c_acctbal = Field(_D)
    c_mktsegment = Field(_S)


class Supplier(Model):
    __table__ = "supplier"
    s_suppkey = Field(_L, primary_key=True)
    s_name = Field(_S)
    s_nationkey = Field(_I)
    s_acctbal = Field(_D)


class Part(Model):
    __table__ = "part"
    p_partkey = Field(_L, primary_key=True)
    p_name = Field(_S)
    p_brand = Field(_S)
    p_type = Field(_S)
    p_size = Field(_I)
    p_retailprice = Field(_D)


class Orders(Model):
    __table__ = "orders"
    o_orderkey = Field(_L, primary_key=True)
    o_custkey = Field(_L)
    o_orderstatus = Field(_S)
    o_totalprice = Field(_D)
    o_orderdate = Field(_TS)
    o_orderpriority = Field(_S)


class Lineitem(Model):
    __table__ = "lineitem"
    l_orderkey = Field(_L)
    l_partkey = Field(_L)
    l_suppkey = Field(_L)
    l_linenumber = Field(_I)
    l_quantity = Field(_D)
    l_extendedprice = Field(_D)
    l_discount = Field(_D)
    l_tax = Field(_D)
    l_returnflag = Field(_S)
    l_linestatus = Field(_S)
    l_shipdate = Field(_TS)


class Event(Model):
    __table__ = "events"
    event_id = Field(_L, primary_key=True)
    ts = Field(_TS)
    user_id = Field(_L)
    event_type = Field(_S)
    value = Field(_D)
    props = Field(_S)
