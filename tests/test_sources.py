import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from querent.functions import netaddr as N
from querent.functions.aggregates import count, sum_
from querent.functions.expr import placeholder, record, value
from querent.operators import grouping as G
from querent.operators.relation import aggregate_relation, inner, left, relation, table
from querent.plans import sqltext as X
from querent.sources import catalog
from querent.sources.sequence import Sequence
from querent.sources.store import Conflict, Store
from querent.streaming import over_stream, start
from tests.models import KeyTest, SetA, SetB, database


@pytest.fixture
def store(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"), database(spark))
    own.create(KeyTest)
    own.insert(KeyTest, [KeyTest("n", i, "f", f"a{i}", i * 10) for i in range(4)])
    return own


def rows(store):
    return {r.bar: (r.attr, r.baz) for r in store.read("keytest").collect()}


def test_statements_report_affected_rows(store):
    assert store.update(KeyTest, lambda a, r: a.assign("baz", r.baz + 1).wheres(r.bar >= 2)) == 2
    assert rows(store) == {0: ("a0", 0), 1: ("a1", 10), 2: ("a2", 21), 3: ("a3", 31)}
    assert store.delete(KeyTest, lambda a, r: a.wheres(r.baz == placeholder("b", T.IntegerType())), b=21) == 1
    assert store.key_update(KeyTest, [KeyTest("n", 3, "f", "new", 5), KeyTest("n", 9, "f", "x", 1)]) == 1
    assert rows(store) == {0: ("a0", 0), 1: ("a1", 10), 3: ("new", 5)}
    assert store.insert_query(KeyTest, relation(lambda q: (lambda k: record(k.name, k.bar + 100, k.foo, k.attr, k.baz))(q.query(KeyTest)))) == 3
    assert store.bulk_insert(KeyTest, [("m", i, "g", "a", 0) for i in range(5)]) == 5
    assert store.read("keytest").count() == 11
    assert store.delete(KeyTest) == 11 and store.read("keytest").count() == 0


def test_misuse_of_statements(store):
    with pytest.raises(ValueError, match="nothing is set"):
        store.update(KeyTest, lambda a, r: None)
    with pytest.raises(TypeError, match="twice"):
        store.update(KeyTest, lambda a, r: a.assign("baz", 1).assign("baz", 2))
    with pytest.raises(TypeError, match="twice"):
        store.insert(KeyTest, [("a", "b")], KeyTest.path("attr", "attr"))
    with pytest.raises(ValueError, match="needs a value"):
        store.insert(KeyTest, [("a",)], KeyTest.path("attr"))
    assert store.read("keytest").count() == 4


def test_transactions_see_themselves_and_roll_back(store):
    with pytest.raises(RuntimeError), store.transaction() as tx:
        tx.delete(KeyTest, lambda a, r: a.wheres(r.bar == 0))
        assert tx.read("keytest").count() == 3 and store.read("keytest").count() == 4
        raise RuntimeError
    assert store.read("keytest").count() == 4
    with pytest.raises(Conflict), store.transaction() as tx:
        tx.delete(KeyTest)
        store.update(KeyTest, lambda a, r: a.assign("baz", 7))
    assert {v[1] for v in rows(store).values()} == {7}


def test_a_transaction_publishes_all_its_tables_or_none(store, spark):
    store.create(SetB)
    with pytest.raises(Conflict, match="keytest"), store.transaction() as tx:
        tx.insert(SetB, [SetB(1, "a", "b")])
        tx.delete(KeyTest)
        store.update(KeyTest, lambda a, r: a.assign("baz", 7))
    assert store.read("set_b").count() == 0 and {v[1] for v in rows(store).values()} == {7}
    # A writer that was overtaken by one of another table tries again and loses nothing.
    with store.transaction() as tx:
        tx.update(KeyTest, lambda a, r: a.assign("baz", 8))
        store.insert(SetB, [SetB(2, "c", "d")])
    assert {v[1] for v in rows(store).values()} == {8} and store.read("set_b").count() == 1
    last = store.versions()[-1]
    store.delete(KeyTest)
    assert store.read("keytest").count() == 0 and store.read("keytest", last).count() == 4


def test_a_version_is_never_replaced(store):
    tables = store._latest()[1]
    assert not store._publish(store.versions()[-1], {}) and store._latest()[1] == tables
    assert not [n for n in store._fs().listStatus(store._path("_versions")) if n.getPath().getName().startswith(".") and not n.getPath().getName().endswith(".crc")]


def test_bulk_inserts_and_repeated_keys(store):
    seen = []
    assert store.bulk_insert(KeyTest, (("m", 100 + i, "g", "a", 0) for i in range(7)), chunk=3, between=seen.append) == 7 and seen == [3, 6]
    with pytest.raises(ValueError, match="at least one"):
        store.bulk_insert(KeyTest, [], chunk=0)
    assert store.key_update(KeyTest, [KeyTest("n", 3, "f", "one", 1), KeyTest("n", 3, "f", "two", 2), KeyTest("n", 0, "f", "x", 3)]) == 3
    assert rows(store)[3] == ("two", 2) and store.read("keytest").count() == 11


def test_parts_of_raw_statements(store):
    from querent.sources.rawsql import statement

    own = statement("update t set a = concat('x, WHERE', b, (SELECT max(c) FROM u WHERE d = 1)), `e` = 'it''s' /* where */ where f > 'a;' ;")
    assert (own.verb, own.table, own.terms, own.where) == ("update", "t", {"a": "concat('x, WHERE', b, (SELECT max(c) FROM u WHERE d = 1))", "e": "'it''s' /* where */"}, "f > 'a;'")
    own = statement("INSERT INTO t(a, b) VALUES (1, 2)")
    assert (own.columns, own.rows) == (["a", "b"], "VALUES (1, 2)")
    assert statement("DELETE FROM t").where == ""
    for bad in ("DROP TABLE t", "UPDATE t SET a", "DELETE FROM t u"):
        with pytest.raises(ValueError, match="not an assignment|neither"):
            statement(bad)
    with pytest.raises(TypeError, match="twice"):
        statement("UPDATE t SET a = 1, a = 2")
    with pytest.raises(TypeError, match="no column"):
        store.execute("UPDATE keytest SET nope = 1")
    with pytest.raises(TypeError, match="values for"):
        store.execute("INSERT INTO keytest (name) VALUES (1, 2)")
    assert store.execute("DELETE FROM keytest WHERE bar > NULL") == 0 and store.execute("DELETE FROM keytest") == 4
    with pytest.raises(ValueError, match="one of"):
        store.prepare("drop")


def test_v6_columns_agree_with_the_parser(spark):
    import random

    rng = random.Random(2)
    made = [":".join(f"{rng.getrandbits(rng.choice([1, 8, 16])):x}" for _ in range(rng.choice([7, 8, 8, 9]))) for _ in range(60)]
    made += [x.replace(":0:0:", "::", 1) for x in made] + [f"{x}/{rng.randint(0, 140)}" for x in made] + ["1::", "::1", ":1", "1:", "1:::2", "::1.2.3.4/96", "::1.2.3.256", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", " fe80::1 ", "FE80::A/10", "fe80::1%eth0", "::/", "::/x", "::/1/2", "", None]
    frame = spark.createDataFrame([(x,) for x in made], "t string")
    for r in frame.select("t", N.canonical("t").alias("a"), N.cidr_text("t").alias("n"), N.is_cidr("t").alias("c")).collect():
        own = N.parse(r.t)
        net = own and N.cidr_masked(own.version, own.host, own.mask)
        assert (r.a, r.n, r.c) == ((str(own), str(net), own == net) if own else (None, None, None)), r.t


def test_nulls_keep_rows_from_delete(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    own.create(SetB)
    own.insert(SetB, [SetB(1, "A", "x"), SetB(2, None, "y")])
    assert own.delete(SetB, lambda a, r: a.wheres(r.b1 == "A")) == 1
    assert own.delete(SetB, lambda a, r: a.wheres(~(r.b1 == "Z"))) == 0


def test_sequences(spark, tmp_path):
    from querent.sources.model import Field, Model

    class Seq(Model):
        __table__ = "seq"
        last = Field(T.ByteType(), primary_key=True)

    own = Store(spark, str(tmp_path / "s"))
    own.create(Seq)
    numbers = Sequence(own, Seq, "last")
    with pytest.raises(ValueError, match="none"):
        numbers.get_pool(1)
    own.insert(Seq, [Seq(100)])
    assert numbers.get_pool(3) == [101, 102, 103]
    assert numbers.update_number(50) == 0 and numbers.update_number(120) == 1
    with pytest.raises(OverflowError):
        numbers.get_pool(8)
    own.insert(Seq, [Seq(1)])
    with pytest.raises(ValueError, match="more"):
        numbers.get_pool(1)


def test_catalog_types():
    assert catalog.column_type("oracle", "NUMBER", scale=2) == T.DoubleType()
    assert catalog.column_type("oracle", "NUMBER") == T.DecimalType(38, 0)
    assert catalog.column_type("postgresql", "int2", overrides={"int2": T.LongType()}) == T.LongType()
    with pytest.raises(TypeError, match="'money'"):
        catalog.column_type("postgresql", "money")
    model = catalog.model_of("sqlite3", "t", [("ID", "INTEGER", 1), ("Note", "TEXT", 0)], ["ID"])
    assert model.names() == ["id", "note"] and model.primary_key() == ["id"]
    assert [f.nullable for f in model.__fields__] == [False, True]
    assert [catalog.not_null(s, f) for s, f in (("db2", "N"), ("mysql", "YES"), ("oracle", "N"), ("sqlserver", None), ("sqlserver", True), ("postgresql", True))] == [True, False, True, True, False, True]
    with pytest.raises(ValueError, match="no columns"):
        catalog.model_of("mysql", "t", [], [])


def test_catalog_of_spark(spark):
    spark.createDataFrame([(1, "a")], "Id int, Name string").createOrReplaceTempView("catalog_probe")
    model = catalog.model_from_table(spark, "catalog_probe", primary_key=("id",), overrides={"name": T.StringType()})
    assert model.names() == ["id", "name"] and model.primary_key() == ["id"]
    assert {r.name for r in catalog.list_columns(spark, "catalog_probe").collect()} == {"Id", "Name"}


V4 = st.integers(0, (1 << 32) - 1)
V6 = st.integers(0, (1 << 128) - 1)


@given(V4, st.integers(0, 40))
def test_v4_round_trip(host, mask):
    a = N.net_address(4, host, mask)
    assert (a is None) == (mask > 32)
    if a:
        assert N.parse(str(a)) == a and N.cidr_masked(4, host, mask).host == a.network
        assert (N.cidr(4, host, mask) is not None) == (a.network == host)


@given(V6, st.integers(0, 140))
def test_v6_round_trip(host, mask):
    a = N.net_address(6, host, mask)
    assert (a is None) == (mask > 128)
    if a:
        assert N.parse(str(a)) == a and str(a).count(":") == 7
        assert (N.cidr(6, host, mask) is not None) == (a.network == host)


def test_v6_words_and_compression():
    assert N.v6([0xFD00], [1]) == N.parse("fd00::1").host and N.v6([0] * 9) is None
    assert N.parse("fd00::1/8") == N.NetAddress(6, N.v6([0xFD00], [1]), 8)
    assert [N.parse(x) for x in (None, "", "1.2.3", "256.1.1.1", "1.2.3.4/x", "::g")] == [None] * 6
    assert str(N.parse("192.168.0.1/24")) == "192.168.0.1/24"


def test_sql_text():
    assert X.to_sql(table(SetA)) == "SELECT a0, a1, a2 FROM set_a"

    @relation
    def rel(q):
        a, b = q.query(SetA), q.query_maybe(SetB)
        q.on(a.a0 == b.b0).wheres((a.a1 == "it's") & b.b1.is_nothing()).asc(a.a0, "last")
        return record(a.a0, b.b2)

    want = "SELECT ALL T0.a0 AS f0, T1.b2 AS f1 FROM set_a T0 LEFT JOIN set_b T1 ON (T0.a0 = T1.b0) WHERE ((T0.a1 = 'it''s') AND (T1.b1 IS NULL)) ORDER BY T0.a0 ASC NULLS LAST"
    assert X.to_sql(rel) == want
    assert X.to_sql(rel, suffix="FOR UPDATE").endswith("FOR UPDATE")

    @aggregate_relation
    def grouped(q):
        pair = q.query(inner(SetA, SetB, lambda a, b: a.a0 == b.b0))
        k = G.key(pair[0].a1)
        q.group_by(G.rollup(k))
        n = count(pair[0].a0)
        q.having(n > 1)
        return record(k.record, n, sum_(pair[0].a0))

    assert X.to_sql(grouped) == "SELECT ALL T0.f1 AS f0, COUNT (T0.f0) AS f1, SUM (T0.f0) AS f2 FROM (SELECT ALL T1.a0 AS f0, T1.a1 AS f1, T1.a2 AS f2, T2.b0 AS f3, T2.b1 AS f4, T2.b2 AS f5 FROM set_a T1 INNER JOIN set_b T2 ON (T1.a0 = T2.b0)) T0 GROUP BY GROUPING SETS ((T0.f1), ()) HAVING (COUNT (T0.f0) > 1)"
    assert X.insert_sql(SetA, rows=2) == "INSERT INTO set_a (a0, a1, a2) VALUES (?, ?, ?), (?, ?, ?)"
    assert X.rows_per_insert(SetA) == 86
    assert X.key_update_sql(KeyTest) == "UPDATE keytest SET attr = ?, baz = ? WHERE foo = ? AND name = ? AND bar = ?"
    assert X.update_sql(SetA, lambda a, r: a.assign("a1", "x").wheres(r.a0 > placeholder("k", T.IntegerType()))) == "UPDATE set_a T0 SET a1 = 'x' WHERE (T0.a0 > ?)"

    def gone(a, r):
        a.wheres(a.query_exists(relation(lambda q: (lambda b: (q.wheres(b.b0 == r.a0), b.b0)[1])(q.query(SetB)))))

    assert X.delete_sql(SetA, gone, X.Config(quote='"')) == 'DELETE FROM "set_a" T0 WHERE (EXISTS (SELECT ALL T1."b0" AS f0 FROM "set_b" T1 WHERE (T1."b0" = T0."a0")))'
    with pytest.raises(ValueError, match="FROM"):
        X.to_sql(relation(lambda q: value(1)), X.Config(product_unit=False))


def test_sql_export(tmp_path):
    X.export_sql(str(tmp_path / "x.sql"), table(SetA), left(SetA, SetB))
    assert (tmp_path / "x.sql").read_text().splitlines()[0] == "SELECT a0, a1, a2 FROM set_a;"


def test_relations_run_on_streams(spark, tmp_path):
    spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], SetA.schema()).write.parquet(str(tmp_path / "in"))
    stream = over_stream(spark.readStream.schema(SetA.schema()).parquet(str(tmp_path / "in")), SetA, database(spark))

    @relation
    def rel(q):
        a = q.query(stream)
        b = q.query(SetB)
        q.on(a.a0 == b.b0).wheres(a.a0 > 1)
        return record(a.a1, b.b2)

    running = start(database(spark), rel, ["a", "b"], queryName="relations_on_streams", checkpointLocation=str(tmp_path / "ck"))
    running.processAllAvailable()
    running.stop()
    assert [tuple(r) for r in spark.table("relations_on_streams").collect()] == [("B", "y")]


def test_statements_on_empty_tables(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"), database(spark))
    own.create(SetB)
    assert own.insert(SetB, []) == 0
    assert own.insert_query(SetB, relation(lambda q: (lambda b: (q.wheres(value(False)), b)[1])(q.query(SetB)))) == 0
    assert own.update(SetB, lambda a, r: a.assign("b2", "z")) == 0
    assert own.delete(SetB) == 0 and own.key_update(SetB, [SetB(1, "a", "b")]) == 0


def test_raw_statements(spark, tmp_path):
    db = database(spark)
    db.execute("CREATE OR REPLACE TEMP VIEW raw_probe AS SELECT * FROM set_a")
    assert db.execute("SELECT a1 FROM raw_probe WHERE a0 = :k", k=9).collect()[0][0] == "Q"


def test_only_files_with_affected_rows_are_rewritten(store):
    store.insert(KeyTest, [KeyTest("m", 50, "g", "b", 1)])
    store.insert(KeyTest, [KeyTest("m", 60, "g", "c", 2)])
    before = set(store._load("keytest")["data"])
    assert store.update(KeyTest, lambda a, r: a.assign("baz", 9).wheres(r.bar == 50)) == 1
    after = set(store._load("keytest")["data"])
    assert len(before & after) == len(before) - 1
    version = store.versions()
    assert store.delete(KeyTest, lambda a, r: a.wheres(r.bar == 12345)) == 0 and store.versions() == version
    assert rows(store)[50] == ("b", 9) and rows(store)[60] == ("c", 2) and len(rows(store)) == 6
