"""Named queries over the test tables, each with the SQL that gives the same rows.

A query is described by the relation API and lowered to a DataFrame; the SQL
beside it is what an independent engine runs for comparison.
"""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions import netaddr
from querent.functions.aggregates import aggregate, any_, avg, count, cume_dist, dense_rank, every, max_, min_, over, percent_rank, rank, row_number, some, sum_, window
from querent.functions.expr import case, case_maybe, case_search, case_search_maybe, construct, expr, from_maybe, nothing, placeholder, record, true, unary, value
from querent.functions.shape import Leaf, Tup
from querent.operators import grouping as G
from querent.operators.relation import FrameRelation, RawQuery, aggregate_relation, aggregated_unique, derived_unique_relation, full, inner, left, primary_select, relation, right, table, unique
from querent.plans import sqltext
from querent.plans.tables import Customer, Lineitem, Nation, Orders, Part, Region, Supplier
from querent.sources import catalog
from querent.sources.database import Database
from querent.sources.model import Field, Model, model_from_frame
from querent.sources.sequence import Sequence
from querent.sources.store import Assignments, Conflict, Store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
Build = Callable[[Database], object]


def _entry(name: str, columns: str, sql: str, **params: object) -> Callable[[Build], Build]:
    """Registers a function that gives a relation; columns name its result."""

    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            db = Database(spark, sf_dir)
            return db.frame(build(db), columns.split(), **params)

        _QUERIES[name], _SQL[name] = run, sql
        return build

    return register


def _q(name: str, columns: str, sql: str, grouped: bool = False, **params: object) -> Callable:
    """Registers a describing function of a Query."""

    def register(describe: Callable) -> Callable:
        rel = aggregate_relation(describe) if grouped else relation(describe)
        _entry(name, columns, sql, **params)(lambda db: rel)
        return describe

    return register


def _frame(name: str, sql: str | None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scans, projection ------------------------------------------------------

_entry("scan_table", "r_regionkey r_name", "SELECT r_regionkey, r_name FROM region")(lambda db: table(Region))


@_q("scan_nested_relation", "k p", "SELECT o_orderkey AS k, o_totalprice AS p FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') WHERE o_totalprice > 1000")
def _(q):
    @relation
    def done(p):
        o = p.query(Orders)
        p.wheres(o.o_orderstatus == "F")
        return o

    o = q.query(done)
    q.wheres(o.o_totalprice > 1000.0)
    return record(o.o_orderkey, o.o_totalprice)


@_q("project_record", "a b c", "SELECT c_custkey AS a, c_name AS b, n_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(q):
    c, n = q.query(Customer), q.query(Nation)
    q.on(c.c_nationkey == n.n_nationkey)
    return record(c[Customer.path("c_custkey", "c_name")], n.n_name)


@_q("project_nested_path", "r n", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(q):
    pair = q.query(inner(Nation, Region, lambda n, r: n.n_regionkey == r.r_regionkey))
    return record(pair[1][Region.r_name], pair[0].n_name)


@_q("const_relation", "a b c", "SELECT CAST(1 AS BIGINT) AS a, 'x''y' AS b, CAST(NULL AS DOUBLE) AS c")
def _(q):
    return record(value(1), value("x'y"), nothing(T.DoubleType()))


@_q("literal_types", "b i f s d t u z", "SELECT TRUE AS b, CAST(7 AS INTEGER) AS i, CAST(1.5 AS DOUBLE) AS f, 'back\\slash' AS s, DATE '2020-02-29' AS d, TIMESTAMP '2020-02-29 12:34:56.789' AS t, CAST(-5 AS SMALLINT) AS u, '' AS z")
def _(q):
    return record(true(), value(7, T.IntegerType()), value(1.5), value("back\\slash"), value(dt.date(2020, 2, 29)), value(dt.datetime(2020, 2, 29, 12, 34, 56, 789000)), value(-5, T.ShortType()), value(""))


@_q("distinct_select", "s p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
def _(q):
    o = q.query(Orders)
    q.all_().distinct()
    return record(o.o_orderstatus, o.o_orderpriority)


@_q("all_select", "s", "SELECT o_orderstatus AS s FROM orders")
def _(q):
    o = q.query(Orders)
    q.distinct().all_()
    return o.o_orderstatus


_entry("raw_sql", "k n", "SELECT n_nationkey AS k, upper(n_name) AS n FROM nation WHERE n_regionkey = 2", region=2)(
    lambda db: (db.frames.update(nation=db.table("nation")), RawQuery("SELECT n_nationkey, upper(n_name) FROM nation WHERE n_regionkey = :region", Tup([Leaf(T.IntegerType()), Leaf(T.StringType())]), ["region"]))[1]
)
_entry("infer_model", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda db: table(model_from_frame("nation", db.table("nation"), primary_key=("n_nationkey",))))

# --- filters, predicates ----------------------------------------------------

for _name, _sql, _fn in (
    ("eq", "=", lambda a, b: a == b),
    ("ne", "<>", lambda a, b: a != b),
    ("lt", "<", lambda a, b: a < b),
    ("le", "<=", lambda a, b: a <= b),
    ("gt", ">", lambda a, b: a > b),
    ("ge", ">=", lambda a, b: a >= b),
):

    def _compare(q, fn=_fn):
        p = q.query(Part)
        q.wheres(fn(p.p_size, 25))
        return record(p.p_partkey, p.p_size)

    _q(f"filter_{_name}", "k s", f"SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size {_sql} 25")(_compare)


@_q("filter_and_or_not", "k", "SELECT p_partkey AS k FROM part WHERE (p_size < 10 OR p_retailprice > 1500) AND NOT (p_brand = 'Brand#11')")
def _(q):
    p = q.query(Part)
    q.wheres((p.p_size < 10) | (p.p_retailprice > 1500.0)).wheres(~(p.p_brand == "Brand#11"))
    return p.p_partkey


@_q("filter_in_list", "k s", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size IN (1, 7, 49)")
def _(q):
    p = q.query(Part)
    q.wheres(p.p_size.in_([1, 7, 49]))
    return record(p.p_partkey, p.p_size)


@_q("filter_not_in_list", "k s", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size NOT IN (1, 7, 49)")
def _(q):
    p = q.query(Part)
    q.wheres(~p.p_size.in_([1, 7, 49]))
    return record(p.p_partkey, p.p_size)


@_q("filter_row_in_list", "k", "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')")
def _(q):
    o = q.query(Orders)
    q.wheres(record(o.o_orderstatus, o.o_orderpriority).in_([("F", "1-URGENT"), ("O", "5-LOW")]))
    return o.o_orderkey


@_q("filter_row_less", "k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderpriority <= '3')")
def _(q):
    o = q.query(Orders)
    q.wheres(record(o.o_orderstatus, o.o_orderpriority) <= ("O", "3"))
    return o.o_orderkey


@_q("filter_like", "k n", "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_name LIKE '%1_'")
def _(q):
    c = q.query(Customer)
    q.wheres(c.c_name.like("%1_"))
    return record(c.c_custkey, c.c_name)


@_q("filter_like_expr", "a b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name LIKE substr(b.r_name, 1, 1) || '%'")
def _(q):
    a, b = q.query(Region), q.query(Region)
    q.on(a.r_name.like(unary(lambda c: F.substring(c, 1, 1), b.r_name).concat("%")))
    return record(a.r_name, b.r_name)


_OPTIONAL = "(SELECT c_custkey, c_nationkey, o_orderkey, o_totalprice, o_orderpriority FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey)"


@relation
def _dear(q):
    o = q.query(Orders)
    q.wheres(o.o_totalprice > 300000.0)
    return o


def _optional(q):
    c, o = q.query(Customer), q.query_maybe(_dear)
    q.on(c.c_custkey == o.o_custkey)
    return c, o


@_q("filter_is_null", "k", f"SELECT c_custkey AS k FROM {_OPTIONAL} WHERE o_orderkey IS NULL")
def _(q):
    c, o = _optional(q)
    q.wheres(o.is_nothing())
    return c.c_custkey


@_q("filter_is_not_null", "k o", f"SELECT c_custkey AS k, o_orderkey AS o FROM {_OPTIONAL} WHERE o_orderkey IS NOT NULL")
def _(q):
    c, o = _optional(q)
    q.wheres(o.is_just())
    return record(c.c_custkey, o.o_orderkey)


@_q("from_maybe_scalar", "k p", f"SELECT c_custkey AS k, coalesce(o_totalprice, -1) AS p FROM {_OPTIONAL}")
def _(q):
    c, o = _optional(q)
    return record(c.c_custkey, from_maybe(-1.0, o.o_totalprice))


@_q("from_maybe_record", "k o p", f"SELECT c_custkey AS k, CASE WHEN o_orderkey IS NULL THEN 0 ELSE o_orderkey END AS o, CASE WHEN o_orderkey IS NULL THEN 'none' ELSE o_orderpriority END AS p FROM {_OPTIONAL}")
def _(q):
    c, o = _optional(q)
    pair = record(o.o_orderkey, o.o_orderpriority).just()
    return record(c.c_custkey, from_maybe((0, "none"), pair))


# --- CASE, arithmetic, strings ----------------------------------------------


@_q("case_search", "k c", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, case_search([(p.p_size < 10, "small"), (p.p_size < 30, "middle")], "large"))


@_q("case_simple", "k c", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c FROM orders")
def _(q):
    o = q.query(Orders)
    return record(o.o_orderkey, case(o.o_orderstatus, [("F", value(1, T.IntegerType())), ("O", value(2, T.IntegerType()))], value(3, T.IntegerType())))


@_q("case_maybe", "k c d", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN p_name END AS c, CASE p_size WHEN 1 THEN 'one' END AS d FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, case_search_maybe([(p.p_size < 10, p.p_name)]), case_maybe(p.p_size, [(1, "one")]))


@_q("case_record", "k a b", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN p_brand ELSE p_type END AS a, CASE WHEN p_size < 10 THEN p_size ELSE 0 END AS b FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, case_search([(p.p_size < 10, record(p.p_brand, p.p_size))], record(p.p_type, value(0, T.IntegerType()))))


@_q("arith_int", "k a b c d", "SELECT p_partkey AS k, p_size + 3 AS a, p_size - 40 AS b, p_size * 2 AS c, -p_size AS d FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, p.p_size + 3, p.p_size - 40, 2 * p.p_size, -p.p_size)


@_q("arith_double", "k a b", "SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS a, l_extendedprice / l_quantity AS b FROM lineitem")
def _(q):
    i = q.query(Lineitem)
    price = i.l_extendedprice * (1.0 - i.l_discount) * (1.0 + i.l_tax)
    return record(i.l_orderkey, price, i.l_extendedprice / i.l_quantity)


@_q("int_div", "k a b", "SELECT p_partkey AS k, CAST((p_size - 25) // 7 AS INTEGER) AS a, CAST(p_partkey // 10 AS BIGINT) AS b FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, (p.p_size - 25) / 7, p.p_partkey / 10)


@_q("arith_maybe", "k a", f"SELECT c_custkey AS k, o_orderkey + 1 AS a FROM {_OPTIONAL}")
def _(q):
    c, o = _optional(q)
    return record(c.c_custkey, o.o_orderkey + 1)


@_q("cast_int_to_double", "k a", "SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 4 AS a FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, p.p_size.from_integral(T.DoubleType()) / 4.0)


@_q("show_num", "k s", "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) || '!' AS s FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, p.p_size.show_num().concat("!"))


@_q("concat_strings", "s", "SELECT n_name || '/' || r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(q):
    n, r = q.query(Nation), q.query(Region)
    q.on(n.n_regionkey == r.r_regionkey)
    return n.n_name.concat("/").concat(r.r_name)


@_q("concat_null", "k s", f"SELECT c_custkey AS k, 'p' || o_orderpriority AS s FROM {_OPTIONAL}")
def _(q):
    c, o = _optional(q)
    return record(c.c_custkey, value("p").concat(o.o_orderpriority))


@_q("raw_expression", "k d", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(q):
    o = q.query(Orders)
    return record(o.o_orderkey, unary(F.to_date, o.o_orderdate, T.DateType()))


@_q("raw_sql_term", "k c", "SELECT n_nationkey AS k, 3 AS c FROM nation")
def _(q):
    return record(q.query(Nation).n_nationkey, expr("1 + 2", T.IntegerType()))


# --- joins --------------------------------------------------------------------


@_q("join_inner", "k n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def _(q):
    o, c = q.query(Orders), q.query(Customer)
    q.on(o.o_custkey == c.c_custkey).wheres(o.o_totalprice > 200000.0)
    return record(o.o_orderkey, c.c_name)


@_q("join_left", "c o", f"SELECT c_custkey AS c, o_orderkey AS o FROM {_OPTIONAL}")
def _(q):
    c, o = _optional(q)
    return record(c.c_custkey, o.o_orderkey)


@_q("join_right", "o c", "SELECT o_orderkey AS o, c_custkey AS c FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON c_custkey = o_custkey")
def _(q):
    o, c = q.query_maybe(_dear), q.query(Customer)
    q.on(c.c_custkey == o.o_custkey)
    return record(o.o_orderkey, c.c_custkey)


@_q("join_full", "c o", "SELECT c_custkey AS c, o_orderkey AS o FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def _(q):
    @relation
    def rich(p):
        c = p.query(Customer)
        p.wheres(c.c_acctbal > 5000.0)
        return c

    c, o = q.query_maybe(rich), q.query_maybe(_dear)
    q.on(c.c_custkey == o.o_custkey)
    return record(c.c_custkey, o.o_orderkey)


@_q("join_cross", "a b", "SELECT a.r_name AS a, n_name AS b FROM region a CROSS JOIN nation")
def _(q):
    return record(q.query(Region).r_name, q.query(Nation).n_name)


@_q("join_theta", "a b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def _(q):
    a, b = q.query(Nation), q.query(Nation)
    q.on(a.n_nationkey < b.n_nationkey).on(a.n_regionkey == b.n_regionkey)
    return record(a.n_name, b.n_name)


@_q("join_theta_less", "a b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(q):
    a, b = q.query(Nation), q.query(Nation)
    q.on(a.n_nationkey < b.n_nationkey)
    return record(a.n_name, b.n_name)


@_q("join_self", "a b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey")
def _(q):
    a, b = q.query(Nation), q.query(Nation)
    q.on(a.n_regionkey == b.n_nationkey)
    return record(a.n_name, b.n_name)


@_q("join_3way", "k c n", "SELECT o_orderkey AS k, c_name AS c, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def _(q):
    o, c = q.query(Orders), q.query(Customer)
    q.on(o.o_custkey == c.c_custkey)
    n = q.query(Nation)
    q.on(c.c_nationkey == n.n_nationkey).wheres(n.n_regionkey == 1)
    return record(o.o_orderkey, c.c_name, n.n_name)


@_q("join_bushy", "c n r", "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def _(q):
    c = q.query(Customer)
    place = q.query_maybe(inner(Nation, Region, lambda n, r: n.n_regionkey == r.r_regionkey, lambda n, r: r.r_name != "ASIA"))
    q.on(c.c_nationkey == place[0].n_nationkey)
    return record(c.c_custkey, place[0].n_name, place[1].r_name)


_PAIR = "n_nationkey AS n, s_suppkey AS s"
for _name, _join, _word in (("left", left, "LEFT"), ("right", right, "RIGHT"), ("full", full, "FULL")):

    def _direct(db, join=_join):
        def describe(q):
            pair = q.query(join(Nation, Supplier, lambda n, s: n.n_nationkey == s.s_nationkey, lambda n, s: n.n_regionkey < 3))
            return record(pair[0].n_nationkey, pair[1].s_suppkey)

        return relation(describe)

    _entry(f"join_direct_{_name}", "n s", f"SELECT {_PAIR} FROM nation {_word} JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey < 3")(_direct)


@_q("join_record_key", "k n", "SELECT a.l_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1", grouped=True)
def _(q):
    @relation
    def returned(p):
        i = p.query(Lineitem)
        p.distinct().wheres(i.l_returnflag == "R")
        return record(i.l_orderkey, i.l_linenumber)

    a, b = q.query(returned), q.query(Lineitem)
    q.on(a == b[Lineitem.path("l_orderkey", "l_linenumber")])
    return record(q.group_by(a[0]), count(b.l_orderkey))


@_q("outer_join_on", "n s", "SELECT n_nationkey AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
def _(q):
    n, s = q.query(Nation), q.query_maybe(Supplier)
    q.on(n.n_nationkey == s.s_nationkey).on(s.s_acctbal > 5000.0)
    return record(n.n_nationkey, s.s_suppkey)


@_q("outer_join_where", "n s", "SELECT n_nationkey AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 5000")
def _(q):
    n, s = q.query(Nation), q.query_maybe(Supplier)
    q.on(n.n_nationkey == s.s_nationkey).wheres(s.s_acctbal > 5000.0)
    return record(n.n_nationkey, s.s_suppkey)


# --- aggregation ----------------------------------------------------------------

_FLAGSHIP = "SELECT c_mktsegment AS segment, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment HAVING count(o_orderkey) > 10"


def _money(r):
    return unary(lambda c: F.round(c, 2), r)


@aggregate_relation
def _flagship(q):
    o, c = q.query(Orders), q.query(Customer)
    q.on(o.o_custkey == c.c_custkey).wheres(o.o_orderstatus != "P")
    segment, n, total = q.group_by(c.c_mktsegment), count(o.o_orderkey), sum_(o.o_totalprice)
    q.having(n > 10).desc(total)
    return record(segment, n, _money(total))


_entry("join_group_having", "segment orders total", _FLAGSHIP)(lambda db: _flagship)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["join_group_having"](spark, sf_dir)


@_q("group_count", "s n", "SELECT o_orderstatus AS s, count(o_orderkey) AS n FROM orders GROUP BY 1", grouped=True)
def _(q):
    o = q.query(Orders)
    return record(q.group_by(o.o_orderstatus), count(o.o_orderkey))


@_q("group_sum_avg_min_max", "f s a lo hi n", "SELECT l_returnflag AS f, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 2) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi, CAST(sum(l_linenumber) AS INTEGER) AS n FROM lineitem GROUP BY 1", grouped=True)
def _(q):
    i = q.query(Lineitem)
    f = q.group_by(i.l_returnflag)
    return record(f, _money(sum_(i.l_quantity)), _money(avg(i.l_extendedprice)), min_(i.l_shipdate), max_(i.l_shipdate), sum_(i.l_linenumber))


@_q("group_multi_key", "f s n q", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2", grouped=True)
def _(q):
    i = q.query(Lineitem)
    k = q.group_by(record(i.l_returnflag, i.l_linestatus))
    return record(k, count(i.l_orderkey), _money(sum_(i.l_quantity)))


@_q("group_expression", "y n", "SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1", grouped=True)
def _(q):
    o = q.query(Orders)
    return record(q.group_by(unary(F.year, o.o_orderdate, T.IntegerType())), count(o.o_orderkey))


@_q("having", "c n", "SELECT o_custkey AS c, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) > 12 AND max(o_totalprice) > 100000", grouped=True)
def _(q):
    o = q.query(Orders)
    k, n = q.group_by(o.o_custkey), count(o.o_orderkey)
    q.having(n > 12).having(max_(o.o_totalprice) > 100000.0)
    return record(k, n)


@_q("having_global", "n", "SELECT count(r_regionkey) AS n FROM region HAVING count(r_regionkey) > 100", grouped=True)
def _(q):
    n = count(q.query(Region).r_regionkey)
    q.having(n > 100)
    return n


@_q("agg_global", "n m", "SELECT count(o_orderkey) AS n, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", grouped=True)
def _(q):
    o = q.query(Orders)
    q.wheres(o.o_orderkey < 0)
    return record(count(o.o_orderkey), max_(o.o_totalprice))


@_q("agg_bool", "s e a o", "SELECT o_orderstatus AS s, bool_and(o_totalprice > 1000) AS e, bool_or(o_totalprice > 400000) AS a, bool_or(o_orderpriority = '1-URGENT') AS o FROM orders GROUP BY 1", grouped=True)
def _(q):
    o = q.query(Orders)
    return record(q.group_by(o.o_orderstatus), every(o.o_totalprice > 1000.0), any_(o.o_totalprice > 400000.0), some(o.o_orderpriority == "1-URGENT"))


@_q("agg_custom", "f d", "SELECT l_returnflag AS f, round(stddev_samp(l_quantity), 6) AS d FROM lineitem GROUP BY 1", grouped=True)
def _(q):
    i = q.query(Lineitem)
    return record(q.group_by(i.l_returnflag), unary(lambda c: F.round(c, 6), aggregate(F.stddev_samp, i.l_quantity, T.DoubleType())))


@_q("agg_distinct_select", "n", "SELECT DISTINCT count(o_orderkey) AS n FROM orders GROUP BY o_custkey", grouped=True)
def _(q):
    o = q.query(Orders)
    q.group_by(o.o_custkey)
    q.distinct()
    return count(o.o_orderkey)


@_q("group_keys_only", "s", "SELECT o_orderstatus AS s FROM orders GROUP BY 1", grouped=True)
def _(q):
    return q.group_by(q.query(Orders).o_orderstatus)


@_q("count_record", "s n m", f"SELECT c_custkey % 7 AS s, count(*) AS n, count(o_orderkey) AS m FROM {_OPTIONAL} GROUP BY 1", grouped=True)
def _(q):
    c, o = _optional(q)
    k = q.group_by(unary(lambda x: x % 7, c.c_custkey))
    return record(k, count(record(o.o_orderkey, o.o_totalprice)), count(o.o_orderkey))


_LI = "l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY"
_keys = lambda i: (G.key(i.l_returnflag), G.key(i.l_linestatus))


@_q("rollup", "a b n", f"SELECT {_LI} ROLLUP (l_returnflag, l_linestatus)", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = _keys(i)
    q.group_by(G.rollup(a, b))
    return record(a.record, b.record, count(i.l_orderkey))


@_q("cube", "a b n", f"SELECT {_LI} CUBE (l_returnflag, l_linestatus)", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = _keys(i)
    q.group_by(G.cube(a, b))
    return record(a.record, b.record, count(i.l_orderkey))


@_q("cube_composite", "a b c n", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, (l_linestatus, l_linenumber))", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = G.bkey(i.l_returnflag), G.bkey(record(i.l_linestatus, i.l_linenumber))
    q.group_by(G.cube(a, b))
    return record(a.record, b.record, count(i.l_orderkey))


@_q("grouping_sets", "a b n", f"SELECT {_LI} GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = _keys(i)
    q.group_by(G.grouping_sets(G.key_set(a, b), G.key_set(b)))
    return record(a.record, b.record, count(i.l_orderkey))


@_q("grouping_sets_nested_rollup", "a b c n", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linenumber), (l_linenumber), (l_linenumber))", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = _keys(i)
    c = G.key(i.l_linenumber)
    q.group_by(G.grouping_sets(G.key_set(G.rollup(a, b), c), G.key_set(c)))
    return record(a.record, b.record, c.record, count(i.l_orderkey))


@_q("group_mixed_elements", "a b n", f"SELECT {_LI} ROLLUP (l_returnflag), l_linestatus", grouped=True)
def _(q):
    i = q.query(Lineitem)
    a, b = _keys(i)
    q.group_by(G.rollup(a))
    q.group_by(b)
    return record(a.record, b.record, count(i.l_orderkey))


_entry("aggregated_unique", "m", "SELECT max(o_totalprice) AS m FROM orders")(lambda db: aggregated_unique(Orders, lambda o: o.o_totalprice, max_))

# --- windows ----------------------------------------------------------------------

_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
for _name, _fn, _sql in (
    ("rank", rank, "CAST(rank() {} AS INTEGER)"),
    ("dense_rank", dense_rank, "CAST(dense_rank() {} AS INTEGER)"),
    ("row_number", row_number, "CAST(row_number() {} AS INTEGER)"),
    ("percent_rank", percent_rank, "round(percent_rank() {}, 9)"),
    ("cume_dist", cume_dist, "round(cume_dist() {}, 9)"),
):

    def _ranked(q, fn=_fn, name=_name):
        o = q.query(Orders)
        w = window().partition_by(o.o_custkey)
        if name in ("rank", "dense_rank"):
            w.asc(o.o_orderpriority)
        else:
            w.desc(o.o_totalprice).asc(o.o_orderkey)
        r = over(fn(), w)
        return record(o.o_orderkey, unary(lambda c: F.round(c, 9), r) if name in ("percent_rank", "cume_dist") else r)

    _spec = "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)" if _name in ("rank", "dense_rank") else _W
    _q(f"win_{_name}", "k r", f"SELECT o_orderkey AS k, {_sql.format(_spec)} AS r FROM orders")(_ranked)


@_q("win_sum_running", "k s n", f"SELECT o_orderkey AS k, round(sum(o_totalprice) {_W}, 2) AS s, count(o_orderkey) {_W} AS n FROM orders")
def _(q):
    o = q.query(Orders)
    w = window().partition_by(o.o_custkey).desc(o.o_totalprice).asc(o.o_orderkey)
    return record(o.o_orderkey, _money(over(sum_(o.o_totalprice), w)), over(count(o.o_orderkey), w))


@_q("win_agg_partition_only", "k m a", "SELECT o_orderkey AS k, max(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS a FROM orders")
def _(q):
    o = q.query(Orders)
    w = window().partition_by(o.o_orderstatus)
    return record(o.o_orderkey, over(max_(o.o_totalprice), w), _money(over(avg(o.o_totalprice), w)))


@_q("win_over_aggregate", "c n r", "SELECT o_custkey AS c, count(o_orderkey) AS n, CAST(rank() OVER (ORDER BY count(o_orderkey) DESC) AS INTEGER) AS r FROM orders GROUP BY 1", grouped=True)
def _(q):
    o = q.query(Orders)
    k, n = q.group_by(o.o_custkey), count(o.o_orderkey)
    return record(k, n, over(rank(), window().desc(n)))


@_q("win_multi_column", "k a b", "SELECT p_partkey AS k, max(p_size) OVER (PARTITION BY p_brand, p_type) AS a, min(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS b FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, over(record(max_(p.p_size), min_(p.p_retailprice)), window().partition_by(record(p.p_brand, p.p_type))))


@_q("win_unordered_rank", "k r", "SELECT n_nationkey AS k, CAST(1 AS INTEGER) AS r FROM nation")
def _(q):
    n = q.query(Nation)
    return record(n.n_nationkey, over(rank(), window().partition_by(n.n_regionkey)))


# --- ordering, limits, set operations ---------------------------------------------


@_q("order_by_multi", "s k", "SELECT o_orderstatus AS s, o_orderkey AS k FROM orders")
def _(q):
    o = q.query(Orders)
    q.asc(o.o_orderstatus).desc(o.o_orderkey)
    return record(o.o_orderstatus, o.o_orderkey)


def _by_nulls(direction, nulls):
    """All rows in order; each with its place among the customers of its nation, ordered alike."""

    def build(db):
        def describe(q):
            c, o = _optional(q)
            q.order_by(o.o_totalprice, direction, nulls).asc(o.o_orderkey).asc(c.c_custkey)
            place = over(row_number(), window().partition_by(c.c_nationkey).order_by(o.o_totalprice, direction, nulls).asc(o.o_orderkey).asc(c.c_custkey))
            return record(c.c_custkey, o.o_orderkey, place)

        return relation(describe)

    return build


for _direction in ("asc", "desc"):
    for _nulls in ("first", "last"):
        _entry(
            f"order_{_direction}_nulls_{_nulls}",
            "c o place",
            f"SELECT c_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice {_direction} NULLS {_nulls}, o_orderkey, c_custkey) AS INTEGER) AS place FROM {_OPTIONAL} ORDER BY o_totalprice {_direction} NULLS {_nulls}, o_orderkey, c_custkey",
        )(_by_nulls(_direction, _nulls))


@_entry("order_by_hidden_aggregate", "c", "SELECT o_custkey AS c FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey")
def _(db):
    @aggregate_relation
    def rel(q):
        o = q.query(Orders)
        k = q.group_by(o.o_custkey)
        q.desc(sum_(o.o_totalprice)).asc(k)
        return k

    return rel


@_entry("top_k", "k p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def _(db):
    @relation
    def rel(q):
        o = q.query(Orders)
        q.desc(o.o_totalprice).asc(o.o_orderkey)
        return record(o.o_orderkey, o.o_totalprice)

    return rel.limit(10, 5)


def _regions(model, column, keep):
    def describe(q):
        r = q.query(model)
        q.wheres(keep(r))
        return r[column]

    return relation(describe)


_CUST, _SUPP = "SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS n FROM supplier WHERE s_acctbal > 0"
_cust, _supp = _regions(Customer, "c_nationkey", lambda c: c.c_acctbal > 9000.0), _regions(Supplier, "s_nationkey", lambda s: s.s_acctbal > 0.0)
for _name, _word in (("union", "UNION"), ("union_all", "UNION ALL"), ("except_", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):
    _entry(_name.rstrip("_"), "n", f"{_CUST} {_word} {_SUPP}")(lambda db, name=_name: getattr(_cust, name)(_supp))


@_q("union_nested_ordered", "n m", f"SELECT n, n * 2 AS m FROM (({_CUST} UNION {_SUPP}) EXCEPT SELECT 3)")
def _(q):
    three = relation(lambda p: value(3, T.IntegerType()))
    n = q.query(_cust.union(_supp).except_(three))
    q.asc(n)
    return record(n, n * 2)


# --- subqueries --------------------------------------------------------------------


@_q("exists_uncorrelated", "n", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')")
def _(q):
    n = q.query(Nation)
    q.wheres(q.query_exists(_regions(Region, "r_regionkey", lambda r: r.r_name == "ASIA")))
    return n.n_name


@_q("exists_correlated", "k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(q):
    c = q.query(Customer)
    q.wheres(q.query_exists(_regions(Orders, "o_orderkey", lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 300000.0))))
    return c.c_custkey


@_q("not_exists", "k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(q):
    c = q.query(Customer)
    q.wheres(~q.query_exists(_regions(Orders, "o_orderkey", lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 300000.0))))
    return c.c_custkey


@_q("in_subquery", "k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(q):
    o = q.query(Orders)
    q.wheres(o.o_custkey.in_(q.query_list(_regions(Customer, "c_custkey", lambda c: c.c_mktsegment == "BUILDING"))))
    return o.o_orderkey


@_q("in_subquery_rows", "k", "SELECT l_orderkey AS k FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49)")
def _(q):
    i = q.query(Lineitem)
    pair = Lineitem.path("l_orderkey", "l_linenumber")
    q.wheres(i[pair].in_(q.query_list(_regions(Lineitem, pair, lambda x: x.l_quantity > 49.0))))
    return i.l_orderkey


@_q("not_in_subquery", "n", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def _(q):
    n = q.query(Nation)
    q.wheres(~n.n_nationkey.in_(q.query_list(_regions(Supplier, "s_nationkey", lambda s: s.s_acctbal > 8000.0))))
    return n.n_name


@_q("not_in_subquery_null", "n", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 0 THEN r_regionkey END FROM region)")
def _(q):
    n = q.query(Nation)

    @relation
    def keys(p):
        r = p.query(Region)
        return case_search_maybe([(r.r_regionkey > 0, r.r_regionkey)])

    q.wheres(~n.n_nationkey.in_(q.query_list(keys)))
    return n.n_name


@_q("in_subquery_param", "k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", segment="MACHINERY")
def _(q):
    o = q.query(Orders)
    q.wheres(o.o_custkey.in_(q.query_list(_regions(Customer, "c_custkey", lambda c: c.c_mktsegment == placeholder("segment", T.StringType())))))
    return o.o_orderkey


@_q("scalar_max", "k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def _(q):
    o = q.query(Orders)
    q.wheres(o.o_totalprice == q.query_scalar(aggregated_unique(Orders, lambda x: x.o_totalprice, max_)))
    return o.o_orderkey


@_q("scalar_corr_count", "k n", "SELECT c_custkey AS k, (SELECT count(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer")
def _(q):
    c = q.query(Customer)

    @aggregate_relation
    def of_customer(p):
        o = p.query(Orders)
        p.wheres((o.o_custkey == c.c_custkey) & (o.o_totalprice > 300000.0))
        return count(o.o_orderkey)

    return record(c.c_custkey, q.query_scalar(unique(of_customer)))


@_q("scalar_unique_lookup", "k n", "SELECT c_custkey AS k, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS n FROM customer WHERE c_acctbal > 0")
def _(q):
    c = q.query(Customer)
    q.wheres(c.c_acctbal > 0.0)

    @aggregate_relation
    def name_of(p):
        # An aggregate shows Spark that the correlated scalar has one row.
        n = p.query(Nation)
        p.wheres(n.n_nationkey == c.c_nationkey)
        return max_(n.n_name)

    return record(c.c_custkey, q.query_scalar(unique(name_of)))


@_q("agg_every_in_subquery", "s e", "SELECT o_orderstatus AS s, bool_and(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > -5000)) AS e FROM orders GROUP BY 1", grouped=True)
def _(q):
    o = q.query(Orders)
    rich = q.query_list(_regions(Customer, "c_custkey", lambda c: c.c_acctbal > -5000.0))
    return record(q.group_by(o.o_orderstatus), every(o.o_custkey.in_(rich)))


# --- parameters, keys ----------------------------------------------------------------


@_q("param_filter", "k", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 250000", priority="2-HIGH", least=250000.0)
def _(q):
    o = q.query(Orders)
    q.wheres(record(o.o_orderpriority, true()) == record(placeholder("priority", T.StringType()), true())).wheres(o.o_totalprice > placeholder("least", T.DoubleType()))
    return o.o_orderkey


@_q("param_range", "k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'", range=(dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1)))
def _(q):
    o = q.query(Orders)
    span = placeholder("range", (T.TimestampNTZType(), T.TimestampNTZType()))
    q.wheres((o.o_orderdate >= span[0]) & (o.o_orderdate < span[1]))
    return o.o_orderkey


_entry("primary_select", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7", key=7)(lambda db: primary_select(Nation))
_entry("unique_lookup", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 9")(lambda db: derived_unique_relation(Nation, ["n_nationkey"], value(9, T.IntegerType())))


@_q("construct_record", "n_nationkey n_name n_regionkey", "SELECT n_nationkey + 100 AS n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation")
def _(q):
    n = q.query(Nation)
    return construct(Nation, n.n_nationkey + 100, unary(F.lower, n.n_name), n.n_regionkey)


# --- statements -----------------------------------------------------------------------


class Stock(Model):
    __table__ = "stock"
    k = Field(T.IntegerType(), primary_key=True)
    name = Field(T.StringType())
    region = Field(T.IntegerType(), nullable=True)
    n = Field(T.IntegerType(), default=0)


class Counter(Model):
    __table__ = "counter"
    last = Field(T.LongType(), primary_key=True)


class Other(Model):
    __table__ = "other"
    k = Field(T.LongType(), primary_key=True)


_STOCK = "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS region, n_nationkey * 10 AS n FROM nation"


def _stock(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the table stock in a folder of its own, shared by all executors where there is such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="querent-")
        atexit.register(shutil.rmtree, folder, True)
    db = Database(spark, sf_dir)
    store = Store(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}", db)
    root = spark._jvm.org.apache.hadoop.fs.Path(store.root)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)

    @relation
    def rows(q):
        x = q.query(Nation)
        return record(x.n_nationkey, x.n_name, case_search_maybe([(x.n_regionkey > 0, x.n_regionkey)]), x.n_nationkey * 10)

    store.create(Stock, db.frame(rows, Stock.names()))
    return store


def _statement(name: str, sql: str) -> Callable:
    def register(act: Callable[[Store], object]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            store = _stock(spark, sf_dir)
            act(store)
            return store.read("stock")

        return _frame(name, sql)(run)

    return register


_VALUES = "UNION ALL VALUES (100, 'new', CAST(NULL AS INTEGER), 5), (101, 'it''s', 3, 0)"


@_statement("insert_values", f"{_STOCK} {_VALUES}")
def _(store):
    store.insert(Stock, [Stock(100, "new", None, 5)])
    store.insert_value(Stock, lambda a: a.assign("k", placeholder("k", T.IntegerType())).assign("name", "it's").assign("region", 3), k=101)


@_statement("insert_columns", f"{_STOCK} UNION ALL VALUES (200, 'a', NULL, 0), (201, 'b', NULL, 0)")
def _(store):
    store.insert_value_list(Stock, [(200, "a"), (201, "b")], Stock.path("k", "name"))


@_statement("insert_query", f"{_STOCK} UNION ALL SELECT r_regionkey + 500, r_name, NULL, 0 FROM region WHERE r_regionkey >= 2")
def _(store):
    @relation
    def rows(q):
        r = q.query(Region)
        q.wheres(r.r_regionkey >= placeholder("least", T.IntegerType()))
        return record(r.r_regionkey + 500, r.r_name)

    store.insert_query(Stock, rows, Stock.path("k", "name"), least=2)


@_statement("update_where", f"SELECT k, CASE WHEN region = 2 THEN 'two' ELSE name END AS name, region, n FROM ({_STOCK})")
def _(store):
    store.update(Stock, lambda a, r: a.assign("name", "two").wheres(r.region == 2))


@_statement("update_expr", f"SELECT k, name, region, CASE WHEN k > 10 THEN n + k ELSE n END AS n FROM ({_STOCK})")
def _(store):
    store.update(Stock, lambda a, r: a.assign("n", r.n + r.k).wheres(r.k > placeholder("least", T.IntegerType())), least=10)


@_statement("update_correlated_exists", f"SELECT k, name, region, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = k AND s_acctbal > 8000) THEN -1 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    def describe(a, r):
        a.assign("n", value(-1, T.IntegerType()))
        a.wheres(a.query_exists(_regions(Supplier, "s_suppkey", lambda s: (s.s_nationkey == r.k) & (s.s_acctbal > 8000.0))))

    store.update(Stock, describe)


@_statement("update_all_columns", f"SELECT CASE WHEN k = 3 THEN 33 ELSE k END AS k, CASE WHEN k = 3 THEN 'all' ELSE name END AS name, CASE WHEN k = 3 THEN NULL ELSE region END AS region, CASE WHEN k = 3 THEN 1 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    store.update_all_columns(Stock, Stock(33, "all", None, 1), lambda a, r: a.wheres(r.k == 3))


@_statement("key_update", f"SELECT k, CASE k WHEN 4 THEN 'four' WHEN 6 THEN 'six' ELSE name END AS name, CASE k WHEN 4 THEN NULL WHEN 6 THEN 1 ELSE region END AS region, CASE k WHEN 4 THEN 44 WHEN 6 THEN 66 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    store.key_update(Stock, [Stock(4, "four", None, 44), Stock(6, "six", 1, 66), Stock(999, "none", 1, 1)])


@_statement("delete_where", f"SELECT * FROM ({_STOCK}) WHERE (region > 1) IS NOT TRUE")
def _(store):
    store.delete(Stock, lambda a, r: a.wheres(r.region > 1))


@_statement("delete_not_exists", f"SELECT * FROM ({_STOCK}) WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = k AND s_acctbal > 5000)")
def _(store):
    store.delete(Stock, lambda a, r: a.wheres(~a.query_exists(_regions(Supplier, "s_suppkey", lambda s: (s.s_nationkey == r.k) & (s.s_acctbal > 5000.0)))))


@_statement("transaction_rollback", _STOCK)
def _(store):
    try:
        with store.transaction() as tx:
            tx.delete(Stock)
            raise RuntimeError("given up")
    except RuntimeError:
        pass


@_frame("sequence_pool", "SELECT CAST(x AS BIGINT) AS number FROM range(1, 8) t(x)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stock(spark, sf_dir)
    store.create(Counter)
    store.insert(Counter, [Counter(0)])
    numbers = Sequence(store, Counter, "last")
    pool = numbers.get_pool(4)
    auto = numbers.get_auto_pool(2)
    pool += [next(auto) for _ in range(3)]
    return spark.createDataFrame([(x,) for x in pool], "number long")


_NETS = "(VALUES ('192.168.7.9/24'), ('10.0.0.1'), ('224.0.0.0/4'), ('300.1.1.1'), ('1.2.3.4/33'), ('x'))"


@_frame("inet_v4", "SELECT * FROM (VALUES ('192.168.7.9/24', CAST(3232237321 AS BIGINT), 24, '192.168.7.0/24'), ('10.0.0.1', 167772161, 32, '10.0.0.1/32'), ('224.0.0.0/4', 3758096384, 4, '224.0.0.0/4'), ('300.1.1.1', NULL, NULL, NULL), ('1.2.3.4/33', 16909060, NULL, NULL), ('x', NULL, NULL, NULL)) t(t, host, mask, network)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT col1 AS t FROM {_NETS}")
    t = F.col("t")
    return rows.select("t", netaddr.v4_host(t).alias("host"), netaddr.v4_mask(t).alias("mask"), netaddr.v4_text(netaddr.v4_network(t), netaddr.v4_mask(t)).alias("network"))


@_frame("inet_canonical", "SELECT * FROM (VALUES ('fd00::1/8', 'fd00:0:0:0:0:0:0:1/8'), ('::', '0:0:0:0:0:0:0:0/128'), ('1.2.3.4', '1.2.3.4/32'), ('::1/129', NULL), ('1::2::3', NULL)) t(t, canonical)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT col1 AS t FROM (VALUES ('fd00::1/8'), ('::'), ('1.2.3.4'), ('::1/129'), ('1::2::3'))").select("t", netaddr.canonical("t").alias("canonical"))


@_frame("frame_as_relation", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, sf_dir)
    events = FrameRelation(db.table("events").select("event_type", "user_id"))

    @aggregate_relation
    def rel(q):
        e = q.query(events)
        return record(q.group_by(e[0]), count(e[0]))

    return db.frame(rel, ["t", "n"])


# --- statements: several tables, keys, chunks, prepared and raw ones --------------


@_frame("multi_table_rollback", f"SELECT 'stock' AS t, count(*) AS n, sum(n) AS total FROM ({_STOCK}) UNION ALL SELECT 'counter', 1, 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two writers of one table the later one fails, and its change of another table goes as well."""
    store = _stock(spark, sf_dir)
    store.create(Counter, spark.createDataFrame([(4,)], "last long"))
    try:
        with store.transaction() as tx:
            tx.delete(Stock)
            tx.insert(Counter, [Counter(9)])
            store.update(Counter, lambda a, r: a.assign("last", 5))
    except Conflict:
        pass
    sums = [store.read(t).agg(F.lit(t).alias("t"), F.count("*").alias("n"), F.sum(c).alias("total")) for t, c in (("stock", "n"), ("counter", "last"))]
    return sums[0].unionByName(sums[1])


@_frame("multi_table_commit", f"SELECT 'stock' AS t, count(*) AS n FROM ({_STOCK}) WHERE region IS NOT NULL UNION ALL SELECT 'counter', 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that another one overtook commits all its tables if the other changed none that it used."""
    store = _stock(spark, sf_dir)
    store.create(Counter)
    with store.transaction() as tx:
        tx.delete(Stock, lambda a, r: a.wheres(r.region.is_nothing()))
        store.create(Other)
        tx.insert(Counter, [Counter(1), Counter(2)])
    return store.read("stock").agg(F.lit("stock").alias("t"), F.count("*").alias("n")).unionByName(store.read("counter").agg(F.lit("counter").alias("t"), F.count("*").alias("n")))


@_statement("key_update_repeated_key", f"SELECT k, CASE k WHEN 4 THEN 'last' WHEN 6 THEN 'six' ELSE name END AS name, CASE k WHEN 4 THEN 2 WHEN 6 THEN 1 ELSE region END AS region, CASE k WHEN 4 THEN 45 WHEN 6 THEN 66 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    if store.key_update(Stock, [Stock(4, "first", None, 44), Stock(6, "six", 1, 66), Stock(4, "last", 2, 45)]) != 3:
        raise RuntimeError("a key update counts its rows once for each record")


@_statement("bulk_insert_chunks", f"{_STOCK} UNION ALL SELECT CAST(1000 + x AS INTEGER), 'bulk', NULL, CAST(x AS INTEGER) FROM range(0, 25) t(x) UNION ALL VALUES (2000, 'after', 10, 0), (2001, 'after', 20, 0)")
def _(store):
    seen = []
    store.bulk_insert(Stock, (Stock(1000 + i, "bulk", None, i) for i in range(25)), chunk=10, between=seen.append)
    store.insert(Stock, [Stock(2000 + i, "after", n, 0) for i, n in enumerate(seen)])


@_statement("raw_update", f"SELECT k, CASE WHEN region > 1 AND k <> 9 THEN name || ', it''s ' || k ELSE name END AS name, region, CASE WHEN region > 1 AND k <> 9 THEN n + 7 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    store.execute("UPDATE stock SET name = concat(name, ', it''s ', stock.k), n = n + :more WHERE region > 1 AND k <> :not", more=7, **{"not": 9})


@_statement("raw_update_subquery", f"SELECT k, name, region, CASE WHEN k IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) THEN 0 ELSE n END AS n FROM ({_STOCK})")
def _(store):
    store.base.frames["supplier"] = store.base.table("supplier")
    store.execute("UPDATE stock SET n = 0 WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = stock.k AND s_acctbal > 8000)")


@_statement("raw_insert", f"{_STOCK} UNION ALL VALUES (300, 'a', NULL, 1), (301, 'b', NULL, 2) UNION ALL SELECT k + 400, name, region, n FROM ({_STOCK}) WHERE k < 2")
def _(store):
    store.execute("INSERT INTO stock (k, name, n) VALUES (300, 'a', 1), (301, :name, 2)", name="b")
    store.execute("INSERT INTO stock SELECT k + 400, name, region, n FROM stock WHERE k < 2")


@_statement("raw_delete", f"SELECT * FROM ({_STOCK}) WHERE (region = 1 OR name LIKE 'A%') IS NOT TRUE")
def _(store):
    store.execute("DELETE FROM stock WHERE region = :r OR name LIKE 'A%';", r=1)


@_statement("prepared_statements", f"SELECT k, CASE k WHEN 2 THEN 'two' WHEN 5 THEN 'five' ELSE name END AS name, region, n FROM ({_STOCK}) WHERE k NOT IN (7, 8) UNION ALL VALUES (600, 'x', NULL, 0), (601, 'y', NULL, 0)")
def _(store):
    key, name = placeholder("k", T.IntegerType()), placeholder("name", T.StringType())
    changed = store.prepare("update", Stock, lambda a, r: a.assign("name", name).wheres(r.k == key))
    counts = changed.map([{"k": 2, "name": "two"}, {"k": 5, "name": "five"}, {"k": 999, "name": "none"}])
    gone = store.prepare("delete", Stock, lambda a, r: a.wheres(r.k == key))
    counts += [gone.bind(k=7).execute(), gone.execute(k=8)]
    added = store.prepare("insert_value", Stock, lambda a: a.assign("k", key).assign("name", name))
    counts += added.map({"k": 600 + i, "name": x} for i, x in enumerate("xy"))
    if counts != [1, 1, 0, 1, 1, 1, 1]:
        raise RuntimeError(f"counts of prepared statements: {counts}")


@_frame("statement_counts", "SELECT * FROM (VALUES ('insert', 2), ('insert_query', 5), ('update', 6), ('key_update', 1), ('delete', 5), ('nothing set', -1)) t(verb, n)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of affected rows; an update that sets nothing is refused."""
    store = _stock(spark, sf_dir)
    rows = relation(lambda q: (lambda r: record(r.r_regionkey + 500, r.r_name))(q.query(Region)))
    found = [("insert", store.insert(Stock, [Stock(100, "a", 1, 0), Stock(101, "b", 3, 0)])), ("insert_query", store.insert_query(Stock, rows, Stock.path("k", "name")))]
    found += [("update", store.update(Stock, lambda a, r: a.assign("n", 1).wheres(r.region == 1))), ("key_update", store.key_update(Stock, [Stock(3, "x", 1, 1), Stock(-1, "y", 1, 1)]))]
    found.append(("delete", store.delete(Stock, lambda a, r: a.wheres(r.k >= 500))))
    try:
        found.append(("nothing set", store.update(Stock, lambda a, r: a.wheres(r.k == 1))))
    except ValueError:
        found.append(("nothing set", -1))
    return spark.createDataFrame(found, "verb string, n int")


@_frame("update_number", "SELECT CAST(120 AS BIGINT) AS last, 0 AS back, 1 AS forward")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stock(spark, sf_dir)
    store.create(Counter, spark.createDataFrame([(100,)], "last long"))
    numbers = Sequence(store, Counter, "last")
    counts = numbers.update_number(50), numbers.update_number(120)
    return store.read("counter").select("last", F.lit(counts[0]).alias("back"), F.lit(counts[1]).alias("forward"))


# --- running and fetching ----------------------------------------------------------

_REGIONS = "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey >= 2"


@relation
def _later(q):
    r = q.query(Region)
    q.wheres(r.r_regionkey >= placeholder("least", T.IntegerType())).asc(r.r_regionkey)
    return record(r.r_regionkey, r.r_name)


@_frame("fetch_rows", " UNION ALL ".join(f"SELECT '{how}' AS how, k, name FROM ({_REGIONS})" for how in ("prepared", "fetch", "fetch_all", "iterate", "for_each", "run")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a prepared, bound and executed query, fetched in every way."""
    db, found = Database(spark, sf_dir), []
    with db.prepared(_later) as query:
        found += [("prepared", *r) for r in query.execute(least=2).fetch_all()]
        done = query.bind(least=2).execute()
        while (row := done.fetch()) is not None:
            found.append(("fetch", *row))
        found += [("fetch_all", *r) for r in query.bind(least=2).execute().fetch_all()]
        found += [("for_each", *r) for r in query.execute(least=2).for_each(lambda r: r)]
    found += [("iterate", *r) for r in db.iterate(_later, least=2)]
    found += [("run", *r) for r in db.run(_later, least=2)]
    return spark.createDataFrame(found, "how string, k int, name string")


@_frame("fetch_one", "SELECT * FROM (VALUES ('first', 2), ('first of none', -1), ('only', 4), ('only of none', -1), ('only of many', -2)) t(how, k)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, sf_dir)
    found = [("first", db.first(_later, least=2)[0]), ("first of none", (db.first(_later, least=99) or [-1])[0])]
    found += [("only", db.one_or_none(_later, least=4)[0]), ("only of none", (db.one_or_none(_later, least=99) or [-1])[0])]
    try:
        found.append(("only of many", db.one_or_none(_later, least=2)[0]))
    except ValueError:
        found.append(("only of many", -2))
    return spark.createDataFrame(found, "how string, k int")


@_frame("fetch_fold", "SELECT sum(r_regionkey) AS total, count(*) AS n FROM region WHERE r_regionkey >= 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Database(spark, sf_dir).prepare(_later).execute(least=1)
    return spark.createDataFrame([done.fold(lambda s, r: (s[0] + r[0], s[1] + 1), (0, 0))], "total long, n long")


_SHOWN = {
    "relation": ("SELECT ALL T0.r_regionkey AS f0, T0.r_name AS f1 FROM region T0 WHERE (T0.r_regionkey >= ?) ORDER BY T0.r_regionkey ASC", lambda: sqltext.to_sql(_later)),
    "suffix": ("SELECT r_regionkey, r_name FROM region FOR UPDATE", lambda: sqltext.to_sql(table(Region), suffix="FOR UPDATE")),
    "insert": ("INSERT INTO region (r_regionkey, r_name) VALUES (?, ?)", lambda: sqltext.insert_sql(Region)),
    "update": ("UPDATE region T0 SET r_name = ? WHERE (T0.r_regionkey = 1)", lambda: sqltext.update_sql(Region, lambda a, r: a.assign("r_name", placeholder("n", T.StringType())).wheres(r.r_regionkey == 1))),
    "key update": ("UPDATE region SET r_name = ? WHERE r_regionkey = ?", lambda: sqltext.key_update_sql(Region)),
    "delete": ("DELETE FROM region T0 WHERE (T0.r_regionkey = 1)", lambda: sqltext.delete_sql(Region, lambda a, r: a.wheres(r.r_regionkey == 1))),
    "columns": ("r_regionkey, r_name", lambda: ", ".join(sqltext.column_texts(Region))),
}


@_frame("sql_text", " UNION ALL ".join(f"SELECT '{k}' AS what, '{want}' AS text" for k, (want, _) in _SHOWN.items()))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, make()) for k, (_, make) in _SHOWN.items()], "what string, text string")


@_frame("run_shown_sql", "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey >= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is shown for a relation, run as it stands."""
    db = Database(spark, sf_dir)
    db.table("region").createOrReplaceTempView("region")
    return spark.sql(sqltext.to_sql(_later), args=[2]).toDF("k", "name")


def _refused(act: Callable[[], object]) -> str:
    try:
        act()
    except (TypeError, ValueError) as e:
        return type(e).__name__
    return "accepted"


@_frame("refusals", "SELECT * FROM (VALUES ('empty case', 'ValueError'), ('lateral reference', 'TypeError'), ('empty IN', 'ValueError'), ('on without a join', 'TypeError'), ('column twice', 'TypeError')) t(what, result)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, sf_dir)

    def lateral():
        def describe(q):
            n = q.query(Nation)
            return record(n.n_name, q.query(relation(lambda p: (lambda r: (p.wheres(r.r_regionkey == n.n_regionkey), r.r_name)[1])(p.query(Region)))))

        db.frame(relation(describe))

    found = [
        ("empty case", _refused(lambda: case_search([], 1))),
        ("lateral reference", _refused(lateral)),
        ("empty IN", _refused(lambda: db.frame(relation(lambda q: (lambda n: (q.wheres(n.n_name.in_([])), n.n_name)[1])(q.query(Nation)))))),
        ("on without a join", _refused(lambda: db.frame(relation(lambda q: (lambda n: (q.on(n.n_name == "x"), n.n_name)[1])(q.query(Nation)))))),
        ("column twice", _refused(lambda: Assignments(Stock).assign("n", 1).assign("n", 2))),
    ]
    return spark.createDataFrame(found, "what string, result string")


# --- catalogs and arrays by raw expressions ----------------------------------------


@_frame("catalog_columns", "SELECT * FROM (VALUES ('postgresql', 'id', 'int', FALSE, 2), ('postgresql', 'line', 'smallint', FALSE, 1), ('postgresql', 'note', 'string', TRUE, 0), ('mysql', 'id', 'int', FALSE, 2), ('mysql', 'line', 'smallint', FALSE, 1), ('mysql', 'note', 'string', TRUE, 0), ('oracle', 'id', 'decimal(38,0)', FALSE, 2), ('oracle', 'line', 'double', FALSE, 1), ('oracle', 'note', 'string', TRUE, 0), ('sqlserver', 'id', 'int', FALSE, 2), ('sqlserver', 'line', 'smallint', FALSE, 1), ('sqlserver', 'note', 'string', TRUE, 0), ('sqlite3', 'id', 'int', FALSE, 2), ('sqlite3', 'line', 'smallint', FALSE, 1), ('sqlite3', 'note', 'string', TRUE, 0), ('db2', 'id', 'int', FALSE, 2), ('db2', 'line', 'smallint', FALSE, 1), ('db2', 'note', 'string', TRUE, 0)) t(system, name, type, nullable, key_place)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog queries of six systems over fixtures of their catalog tables: columns, and the places of a key (line, id)."""
    from querent.plans import fixtures

    found = []
    for system in ("postgresql", "mysql", "oracle", "sqlserver", "sqlite3", "db2"):
        model = catalog.read_catalog(spark, system, "", "app", "items", run=fixtures.catalog_runner(spark, system))
        key = model.primary_key()
        found += [(system, f.name, f.dtype.simpleString(), f.nullable, key.index(f.name) + 1 if f.name in key else 0) for f in model.__fields__]
    return spark.createDataFrame(found, "system string, name string, type string, nullable boolean, key_place int")


@_q("array_expression", "k n second", "SELECT p_partkey AS k, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n, string_split(p_type, ' ')[2] AS second FROM part")
def _(q):
    p = q.query(Part)
    return record(p.p_partkey, unary(lambda c: F.size(F.split(c, " ")), p.p_type, T.IntegerType()), unary(lambda c: F.get(F.split(c, " "), 1), p.p_type, T.StringType()))


# --- network addresses of both versions ---------------------------------------------

_ADDRESSES = ("192.168.7.9/24", "10.0.0.0/8", "1.2.3.4", "300.1.1.1", "1.2.3.4/33", "fd00::1/8", "::", "2001:db8::/32", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8/64", "1::2::3", "::1/129", "g::", "x")


@_frame(
    "inet_cidr",
    "SELECT * FROM (VALUES ('192.168.7.9/24', '192.168.7.9/24', '192.168.7.0/24', FALSE), ('10.0.0.0/8', '10.0.0.0/8', '10.0.0.0/8', TRUE), ('1.2.3.4', '1.2.3.4/32', '1.2.3.4/32', TRUE), ('300.1.1.1', NULL, NULL, NULL), ('1.2.3.4/33', NULL, NULL, NULL), "
    "('fd00::1/8', 'fd00:0:0:0:0:0:0:1/8', 'fd00:0:0:0:0:0:0:0/8', FALSE), ('::', '0:0:0:0:0:0:0:0/128', '0:0:0:0:0:0:0:0/128', TRUE), ('2001:db8::/32', '2001:db8:0:0:0:0:0:0/32', '2001:db8:0:0:0:0:0:0/32', TRUE), ('::ffff:1.2.3.4', '0:0:0:0:0:ffff:102:304/128', '0:0:0:0:0:ffff:102:304/128', TRUE), "
    "('1:2:3:4:5:6:7:8/64', '1:2:3:4:5:6:7:8/64', '1:2:3:4:0:0:0:0/64', FALSE), ('1::2::3', NULL, NULL, NULL), ('::1/129', NULL, NULL, NULL), ('g::', NULL, NULL, NULL), ('x', NULL, NULL, NULL)) t(t, address, network, is_network)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t = spark.createDataFrame([(x,) for x in _ADDRESSES], "t string"), F.col("t")
    return rows.select("t", netaddr.canonical(t).alias("address"), netaddr.cidr_text(t).alias("network"), netaddr.is_cidr(t).alias("is_network"))
