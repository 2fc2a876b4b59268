import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from querent.functions.aggregates import count, max_, over, rank, sum_, window
from querent.functions.expr import as_record, case_search, from_maybe, nothing, placeholder, record, true, value
from querent.functions.shape import Leaf, Opt, Tup, identity
from querent.operators import grouping as G
from querent.operators.relation import FrameRelation, aggregate_relation, aggregated_unique, derived_unique_relation, full, inner, left, primary_select, relation, right, table, unique, unique_select
from tests.models import KeyTest, SetA, SetB, SetC, database


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


def pairs(join):
    return join(SetA, SetB, lambda a, b: a.a0 == b.b0)


def test_optional_records_decode_by_their_key(db):
    got = db.run(pairs(full))
    assert Counter(got) == Counter([(SetA(1, "A", "x"), SetB(1, "A", "x")), (SetA(2, "B", "y"), SetB(2, None, "y")), (SetA(3, "A", "z"), None), (SetA(9, "Q", "x"), None), (None, SetB(4, "Z", "x"))])
    assert len(db.run(pairs(inner))) == 2 and len(db.run(pairs(left))) == 4 and len(db.run(pairs(right))) == 3


def test_shapes_nest_and_encode():
    pair = Tup([SetA.shape(), Opt(SetB.shape())])
    assert pair.width == 6 and pair.key == 0
    assert pair.decode([1, "a", "b", None, "x", "y"]) == (SetA(1, "a", "b"), None)
    assert pair.encode((SetA(1, "a", "b"), None)) == [1, "a", "b", None, None, None]
    assert (identity(SetA.shape()) >> SetA.path("a2", "a0")).indexes == [2, 0]
    assert Opt(Opt(Leaf(T.LongType()))).inner == Leaf(T.LongType())
    assert KeyTest.primary_key() == ["foo", "name", "bar"] and KeyTest.unique_key("one") == ["attr"]


def test_predicates_are_three_valued(db):
    @relation
    def rel(q):
        b = q.query(SetB)
        return record(b.b0, b.b1 == "A", ~(b.b1 == "A"), (b.b1 == "A") & value(False), (b.b1 == "A") | true(), b.b1.in_(["A", "B"]), b.b1.is_nothing(), record(b.b1, b.b2) == ("A", "y"))

    assert {r[0]: r[1:] for r in db.run(rel)} == {1: (True, False, False, True, True, False, False), 2: (None, None, False, True, None, True, None), 4: (False, True, False, True, False, False, False)}


def test_row_comparison_is_lexicographic(db):
    rng = random.Random(1)
    rows = [tuple(rng.randint(0, 2) for _ in range(4)) for _ in range(40)]
    frame = FrameRelation(db.spark.createDataFrame(rows, "a long, b long, c long, d long"))

    @relation
    def rel(q):
        r = q.query(frame)
        x, y = record(r[0], r[1]), record(r[2], r[3])
        return record(r, x < y, x <= y, x > y, x >= y, x == y, x != y)

    for (a, b, c, d), *got in db.run(rel):
        x, y = (a, b), (c, d)
        assert got == [x < y, x <= y, x > y, x >= y, x == y, x != y]


def test_integer_division_truncates_and_keeps_its_type(db):
    rel = relation(lambda q: record(value(-5, T.IntegerType()) / 3, value(7) / 2, value(7.0) / 2))
    assert db.run(rel) == [(-1, 3, 3.5)]
    assert [f.dataType for f in db.frame(rel).schema.fields] == [T.IntegerType(), T.LongType(), T.DoubleType()]


def test_strings_and_like(db):
    rel = relation(lambda q: record(value("a\\b").like("a\\b"), value("it's").concat("!"), value("ab").like(value("a") .concat("%")), value(None, T.StringType()).concat("x")))
    assert db.run(rel) == [(True, "it's!", True, None)]


def test_from_maybe_looks_at_the_key_only(db):
    @relation
    def rel(q):
        a, b = q.query(SetA), q.query_maybe(SetB)
        q.on(a.a0 == b.b0).asc(a.a0)
        return record(a.a0, from_maybe(SetB(0, "none", "none"), b))

    assert db.run(rel) == [(1, SetB(1, "A", "x")), (2, SetB(2, None, "y")), (3, SetB(0, "none", "none")), (9, SetB(0, "none", "none"))]


def test_literals_of_records(db):
    assert db.run(relation(lambda q: record(value(SetA(5, "a", "b")), nothing(SetB), value((1, "x"))))) == [(SetA(5, "a", "b"), None, (1, "x"))]


def test_grouping_sets_multiply_and_keep_duplicates(db):
    @aggregate_relation
    def rel(q):
        c = q.query(SetC)
        x, y, z = G.key(c.c0), G.key(c.c1), G.key(c.c3)
        q.group_by(G.grouping_sets(G.key_set(G.rollup(x, y), z), G.key_set(z)))
        return record(x.record, y.record, z.record, count(c.c2))

    rows = [(1, "p", 10, None), (1, "p", 10, "m"), (2, "q", 20, "m"), (2, "q", 30, "n")]
    want = Counter()
    for own in ((0, 1, 3), (0, 3), (3,), (3,)):
        groups = Counter(tuple(r[i] if i in own else None for i in (0, 1, 3)) for r in rows)
        want.update((*k, n) for k, n in groups.items())
    assert Counter(db.run(rel)) == want


def test_having_windows_and_order(db):
    @aggregate_relation
    def rel(q):
        c = q.query(SetC)
        k, n = q.group_by(c.c0), sum_(c.c2)
        q.having(count(c.c1) > 1).desc(max_(c.c2))
        return record(k, n, over(rank(), window().desc(n)))

    assert db.run(rel) == [(2, 50, 1), (1, 20, 2)]


def test_misuse_is_refused(db):
    bad = [
        lambda q: q.on(true()),
        lambda q: (q.query(SetA), q.on(true()))[0],
        lambda q: q.having(true()),
        lambda q: count(q.query(SetA).a0),
        lambda q: q.query(SetA).a0.in_([]),
        lambda q: case_search([], 1),
        lambda q: q.query(SetA).nope,
        lambda q: q.query_scalar(table(SetA)),
        lambda q: (lambda a: (q.distinct().asc(a.a1), a.a0)[1])(q.query(SetA)),
    ]
    for describe in bad:
        with pytest.raises((TypeError, ValueError, AttributeError)):
            db.run(relation(describe))
    with pytest.raises(TypeError):
        db.run(aggregate_relation(lambda q: q.query(SetA).a0))
    with pytest.raises(TypeError):
        db.run(aggregate_relation(lambda q: q.query(SetA).a0 + 1))
    with pytest.raises(TypeError):
        table(SetA).union(SetC)


def test_lateral_and_skipping_references_are_refused(db):
    @relation
    def lateral(q):
        a = q.query(SetA)
        b = q.query(relation(lambda p: (lambda x: (p.wheres(x.b0 == a.a0), x)[1])(p.query(SetB))))
        return record(a.a0, b.b0)

    with pytest.raises(TypeError, match="does not belong"):
        db.run(lateral)

    @relation
    def skipping(q):
        a = q.query(SetA)

        @relation
        def middle(p):
            b = p.query(SetB)
            p.wheres(p.query_exists(relation(lambda r: (lambda c: (r.wheres(c.c0 == a.a0), c.c0)[1])(r.query(SetC)))))
            return b.b0

        q.wheres(q.query_exists(middle))
        return a

    with pytest.raises(TypeError, match="skip"):
        db.run(skipping)


def test_correlated_scalars(db):
    @relation
    def rel(q):
        a = q.query(SetA)
        n = aggregate_relation(lambda p: (lambda b: (p.wheres(b.b2 == a.a2), count(b.b0))[1])(p.query(SetB)))
        q.asc(a.a0)
        return record(a.a0, q.query_scalar(unique(n)), q.query_scalar(aggregated_unique(SetC, lambda c: c.c2, max_)))

    assert db.run(rel) == [(1, 2, 30), (2, 1, 30), (3, 0, 30), (9, 2, 30)]


def test_parameters(db):
    @relation
    def rel(q):
        a = q.query(SetA)
        q.wheres(record(a.a0, a.a1) == placeholder("pair", (T.IntegerType(), T.StringType())))
        return a

    assert rel.params() == {"pair.0", "pair.1"}
    assert db.run(rel, pair=(3, "A")) == [SetA(3, "A", "z")]
    assert db.first(primary_select(SetA), key=9) == SetA(9, "Q", "x")
    assert db.run(unique_select(SetA, ["a1"]).union_all(primary_select(SetA)), key="2") == [SetA(2, "B", "y")]
    assert db.run(derived_unique_relation(SetA, ["a0"], value(2, T.IntegerType()), lambda a: a.a1)) == ["B"]
    with pytest.raises(KeyError):
        db.run(rel)


def test_fetching(db):
    ordered = relation(lambda q: (lambda a: (q.asc(a.a0), a.a0)[1])(q.query(SetA)))
    done = db.prepare(ordered).bind().execute()
    assert [done.fetch() for _ in range(6)] == [1, 2, 3, 9, None, None]
    assert done.fold(lambda x, y: x + y, 0) == 15 and done.for_each(lambda x: x * 2) == [2, 4, 6, 18]
    assert db.first(ordered) == 1 and list(db.iterate(ordered)) == [1, 2, 3, 9]
    with db.prepared(primary_select(SetA)) as p:
        assert p.execute(key=1).fetch_only() == SetA(1, "A", "x") and p.execute(key=77).fetch_only() is None
    with pytest.raises(ValueError, match="more than one"):
        db.one_or_none(ordered)


def test_a_relation_can_be_used_many_times(db):
    base = relation(lambda q: q.query(SetA))

    @relation
    def rel(q):
        x, y, z = q.query(base), q.query(base), q.query_maybe(base)
        q.on((x.a0 < y.a0) & (z.a0 == y.a0 + 1))
        return record(x.a0, y.a0, z.a0)

    @relation
    def good(q):
        x, y = q.query(base), q.query(base)
        q.on(x.a0 < y.a0)
        z = q.query_maybe(base)
        q.on(z.a0 == y.a0 + 1)
        return record(x.a0, y.a0, z.a0)

    keys = [1, 2, 3, 9]
    assert Counter(db.run(good)) == Counter((x, y, y + 1 if y + 1 in keys else None) for x in keys for y in keys if x < y)


# --- random queries against plain Python ---------------------------------------


def random_predicate(rng, columns, depth=0):
    """(text-free) builder over a record and a row, side by side."""
    kind = rng.random()
    if depth < 3 and kind < 0.45:
        a, b = random_predicate(rng, columns, depth + 1), random_predicate(rng, columns, depth + 1)
        if kind < 0.15:
            return (lambda r: ~a[0](r)), (lambda t: not a[1](t))
        if kind < 0.3:
            return (lambda r: a[0](r) & b[0](r)), (lambda t: a[1](t) and b[1](t))
        return (lambda r: a[0](r) | b[0](r)), (lambda t: a[1](t) or b[1](t))
    x, y, k, op, sign = rng.randrange(columns), rng.randrange(columns), rng.randint(-5, 5), rng.randrange(3), rng.choice((1, -1))
    test = [lambda a, b: a == b, lambda a, b: a < b, lambda a, b: a > b][op]
    return (lambda r: test(r[x] + k if sign > 0 else r[x] - k, r[y])), (lambda t: test(t[x] + k * sign, t[y]))


def random_table(spark, rng):
    rows = [tuple(rng.randint(-5, 5) for _ in range(3)) for _ in range(rng.randint(0, 9))]
    return rows, FrameRelation(spark.createDataFrame(rows, "x long, y long, z long"))


@pytest.mark.parametrize("seed", range(25))
def test_random_filters_and_joins(spark, db, seed):
    rng = random.Random(seed)
    (a_rows, a), (b_rows, b) = random_table(spark, rng), random_table(spark, rng)
    p, q_, on = random_predicate(rng, 3), random_predicate(rng, 3), rng.randrange(3)
    theta = [lambda x, y: x < y, lambda x, y: x == y, lambda x, y: x > y][on]

    @relation
    def rel(q):
        x, y = q.query(a), q.query(b)
        q.on(theta(x[0], y[1])).wheres(p[0](x)).wheres(q_[0](y))
        return record(x, y)

    assert Counter(db.run(rel)) == Counter((s, t) for s in a_rows for t in b_rows if theta(s[0], t[1]) and p[1](s) and q_[1](t))


def test_literals_take_the_other_sides_type(db):
    assert as_record(3, value(1.5)).dtype == T.DoubleType()
    assert as_record(3, value(1, T.ShortType())).dtype == T.ShortType()
    assert as_record(1.5, value(1)).dtype == T.DoubleType()
