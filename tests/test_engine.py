import datetime as dt
import sqlite3

import pytest

from tarnlight.builder import Request, collection
from tarnlight.errors import Duplicate, QueryError, TypeMismatch, Unmet
from tarnlight.functions import text as textfn
from tarnlight.operators.read import Policy, Reader
from tarnlight.operators.writes import Database, describe
from tarnlight.plans.parser import parse_one
from tarnlight.sources import importers
from tarnlight.sources.catalog import Catalog, sql_type
from tarnlight.streaming import changes

NAN = float("nan")


@pytest.fixture
def ask(spark):
    def make(text, rows, schema, *params, now=None, policy=None, **declared):
        c = Catalog(spark)
        c.register("t", spark.createDataFrame(rows, schema).repartition(2), **declared)
        return Reader(c, params, now, policy).select(parse_one(text))

    return make


ROWS = [(1, 5, 1.5, "Ab", None), (2, None, NAN, "ab", "x"), (3, 7, None, None, "x"), (4, -3, -0.0, "straße", "y")]
SCHEMA = "id long, a long, f double, s string, k string"


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ("a = null", [2]),
        ("a != 5", [2, 3, 4]),
        ("not (a < 6)", [2, 3]),
        ("a < 6", [1, 4]),
        ("not (a = null)", [1, 3, 4]),
        ("a in [5, null]", [1, 2]),
        ("a not in [5, null]", [3, 4]),
        ("f = 99", [2]),
        ("f < 99", [1, 4]),
        ("f <= 1.5", [1, 2, 4]),
        ("not (f > 0)", [2, 3, 4]),
        ("s ~ 'AB'", [1, 2]),
        ("not (s like 'a%')", [3, 4]),
        ("s = 'AB'", [1, 2]),
        ("s = 'STRASSE'", [4]),
        ("a", [1, 3, 4]),
        ("not k", [1]),
        ("a + 2 = 7 or s is null", [1, 3]),
        ("a between -3 and 5", [1, 4]),
        ("a > 2.5", [1, 3]),
    ],
)
def test_two_valued_filters(ask, where, ids):
    got = ask(f"get t select id where {where}", ROWS, SCHEMA, nocase={"s"}, may_hold_nan={"f"}).df
    assert sorted(r.id for r in got.collect()) == ids


def test_arithmetic_is_exact(ask):
    got = ask("get t select id, a / 2 as h, a * 2 - 1 as d, f + 1 as g where id != 2", ROWS, SCHEMA).df.collect()
    assert sorted((r.id, r.h, r.d) for r in got) == [(1, 2, 9), (3, 3, 13), (4, -1, -7)]
    for bad in ("a / 0 as x", "a + 9223372036854775807 as x"):
        with pytest.raises(Exception, match="ZERO|OVERFLOW|overflow"):
            ask(f"get t select {bad}", ROWS, SCHEMA).df.collect()
    with pytest.raises(TypeMismatch):
        ask("get t select s * 2 as x", ROWS, SCHEMA)


def test_groups_checks_and_nulls(ask):
    got = ask("get t select k, count(*) as n, sum(a) as t, count(a) as c group k order k", ROWS, SCHEMA).df.collect()
    assert [tuple(r) for r in got] == [(None, 1, 5, 1), ("x", 2, 7, 1), ("y", 1, -3, 1)]
    with pytest.raises(QueryError, match="neither aggregated"):
        ask("get t select s, count(*) as n group k", ROWS, SCHEMA)
    got = ask("get t select s, count(*) as n group s order n desc, s", ROWS, SCHEMA, nocase={"s"}).df.collect()
    assert (got[0].s, got[0].n) == ("Ab", 2)
    assert ask("get t select sum(a) as t where a > 100", ROWS, SCHEMA).df.head().t is None


def test_require_and_paging(ask):
    with pytest.raises(Unmet, match="why"):
        ask("get t where a > 0 require 3 else 'why'", ROWS, SCHEMA)
    full = [r.id for r in ask("get t select id order a desc", ROWS, SCHEMA).df.collect()]
    assert full == [3, 1, 4, 2]
    for limit in range(5):
        for offset in range(5):
            page = [r.id for r in ask(f"get t select id order a desc limit {limit} offset {offset}", ROWS, SCHEMA).df.collect()]
            assert page == full[offset : offset + limit]


def test_plans_push_filters_and_prune_columns(spark):
    c = Catalog(spark)
    c.register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    df = Reader(c).select(parse_one("get orders select id where o_totalprice > 1000 and o_orderstatus = 'F'")).df
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan
    top = Reader(c).select(parse_one("get orders select id order o_totalprice desc limit 3")).df
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_zoned_buckets_keep_both_hours(spark):
    t = [dt.datetime(2026, 10, 25, 0, 30), dt.datetime(2026, 10, 25, 1, 30), dt.datetime(2026, 3, 29, 0, 30), dt.datetime(2026, 7, 1, 22, 30)]
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(k, x) for k, x in enumerate(t)], "id long, at timestamp"))
    hours = {r.id: r.b for r in Reader(c).select(parse_one("get t select id, bucket(at, 1h, 'Europe/Berlin') as b")).df.collect()}
    assert hours[0] == dt.datetime(2026, 10, 25, 0) and hours[1] == dt.datetime(2026, 10, 25, 1)
    days = {r.id: r.b for r in Reader(c).select(parse_one("get t select id, bucket(at, 1d, 'Europe/Berlin') as b")).df.collect()}
    assert days[0] == days[1] == dt.datetime(2026, 10, 24, 22) and days[3] == dt.datetime(2026, 7, 1, 22)


def test_terms_spans_and_edits():
    assert textfn.terms("Kıİ I Foo_bar ＡＢ") == ["kii", "i", "foo", "bar", "ab"]
    assert textfn.terms("日本語") == ["日本", "本語"] and textfn.terms("日") == ["日"]
    assert textfn.terms("日本", single=True) == ["日", "本", "日本"]
    assert [textfn.edits(a, b, 2) for a, b in (("rust", "rust"), ("rust", "rsut"), ("rust", "dust"), ("rust", "rst"), ("rust", "xrust"))] == [0, 1, 2, 1, 2]
    assert [textfn.allowed(w, 2) for w in ("abcd", "abcde", "abcdefghi")] == [0, 1, 2]
    assert textfn.snippet("a b rust c d rust e f g h", frozenset({"rust"}), 14, "…", "<", ">").count("<rust>") == 2
    assert textfn.utf16("a\U0001f600b") == [0, 1, 3, 4]


DOCS = [(1, "Rust is a language"), (2, "the rust of iron, rust"), (3, "nothing"), (4, None), (5, "languages like RUST \U0001f600 rust")]


def test_match_ranks_by_hand(ask):
    import math

    got = ask("get t select id match s 'rust rust' limit 10", DOCS, "id long, s string").df.collect()
    lengths = {1: 4, 2: 5, 3: 1, 4: 0, 5: 4}
    average = sum(lengths.values()) / 5
    idf = math.log(1 + (5 - 3 + 0.5) / (3 + 0.5))
    want = {i: 2 * idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * lengths[i] / average)) for i, tf in ((1, 1), (2, 2), (5, 2))}
    assert {r.id: pytest.approx(r._score) for r in got} == want
    assert [r.id for r in got] == sorted(want, key=lambda i: (-want[i], i))
    marked = {r.id: r.m for r in ask("get t select id, highlight(s, '<', '>') as m match s 'rust' limit 10", DOCS, "id long, s string").df.collect()}
    assert marked[2] == "the <rust> of iron, <rust>"
    assert {r.id for r in ask("get t select id match s 'lanugage' fuzzy 1 limit 10", DOCS, "id long, s string").df.collect()} == {1}
    assert {r.id for r in ask("get t select id match s 'langua' prefix limit 10", DOCS, "id long, s string").df.collect()} == {1, 5}
    with pytest.raises(QueryError, match="10000"):
        ask("get t select id match s 'rust' limit 10001", DOCS, "id long, s string")


def test_statistics_stay_with_the_collection_but_a_policy_scopes_them(ask):
    a = {r.id: r._score for r in ask("get t select id match s 'rust' limit 9", DOCS, "id long, s string").df.collect()}
    b = {r.id: r._score for r in ask("get t select id where id > 1 match s 'rust' limit 9", DOCS, "id long, s string").df.collect()}
    assert b == {i: s for i, s in a.items() if i > 1}
    rule = Policy({"t": parse_one("get t where id > 1").where})
    c = {r.id: r._score for r in ask("get t select id match s 'rust' limit 9", DOCS, "id long, s string", policy=rule).df.collect()}
    assert set(c) == set(b) and c != b


def test_fusion_by_hand(ask):
    rows = [(k, "rust " * (k % 3), [float(k), 1.0]) for k in range(1, 9)]
    text = [r.id for r in ask("get t select id match s 'rust' limit 20", rows, "id long, s string, v array<float>", metric={"v": "l2"}).df.collect()]
    near = [r.id for r in ask("get t select id near v [3, 1] limit 20", rows, "id long, s string, v array<float>", metric={"v": "l2"}).df.collect()]
    want = {i: sum(1 / (60 + x.index(i) + 1) for x in (text, near) if i in x) for i in {*text, *near}}
    got = ask("get t select id match s 'rust' near v [3, 1] fuse limit 20", rows, "id long, s string, v array<float>", metric={"v": "l2"}).df.collect()
    assert {r.id: pytest.approx(r._score) for r in got} == want
    again = ask("get t select id match s 'rust' rerank v [3, 1] limit 20", rows, "id long, s string, v array<float>", metric={"v": "l2"}).df.collect()
    assert [r.id for r in again] == [i for i in near if i in text]


def test_policies_hide_fields(ask):
    p = Policy(hidden={"t": frozenset({"s"})})
    assert {r.s for r in ask("get t", ROWS, SCHEMA, policy=p).df.collect()} == {None}
    with pytest.raises(QueryError):
        ask("get t select s", ROWS, SCHEMA, policy=p)


def test_builder_and_request(spark):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame(ROWS, SCHEMA))
    q = collection(c, "t").select("id").where("a > $1", 4).where("k = $1", "x")
    assert [r.id for r in q.df().collect()] == [3] and q.count() == 1
    r = Request({"select": "id,a", "a": "gte.5", "order": "-a", "limit": "1"}).query(c, "t")
    assert [tuple(x) for x in r.df().collect()] == [(3, 7)]
    assert Request({"k": "not.is.null"}).query(c, "t").count() == 3
    with pytest.raises(QueryError):
        Request({"a": "gt.x"}).query(c, "t")


def test_functions_of_plugins(spark):
    from pyspark.sql import functions as F

    c = Catalog(spark)
    c.register("t", spark.createDataFrame(ROWS, SCHEMA))
    c.register_function("twice", lambda x: F.col("a") * 0 + x * 2, 1)
    assert [r.x for r in Reader(c).select(parse_one("get t select twice(a) as x where id = 1")).df.collect()] == [10]
    with pytest.raises(QueryError):
        c.register_function("twice", lambda x: x, 1)
    with pytest.raises(QueryError):
        c.register_function("distance", lambda x: x, 1)
    with pytest.raises(QueryError):
        Reader(c).select(parse_one("get t select twice(a, a) as x"))


@pytest.fixture
def db(spark, tmp_path):
    d = Database(Catalog(spark), str(tmp_path / "db"))
    d.run("create collection m (key text nocase @unique, n int, at timestamp @ttl(30m), meta json, v vector<2> @hnsw(l2))")
    return d


def test_writes(db):
    now = dt.datetime(2024, 1, 1)
    db.run("put m [{key: 'a', n: 1}, {key: 'b', n: 2, meta: {x: 1}}]", now=now)
    with pytest.raises(Duplicate):
        db.run("put m {key: 'A', n: 9}", now=now)
    db.run("put m [{key: 'a', n: 5}, {key: 'c', n: 1}, {key: 'C', n: 2}] if absent else set {n: n + new.n}", now=now)
    assert {r.key: r.n for r in db.run("get m select key, n", now=now).df.collect()} == {"a": 6, "b": 2, "c": 3}
    out = db.run("set m {n: n * 10, meta.y: 2} where key = 'b' returning id, n, meta", now=now).df.collect()
    assert [(r.id, r.n, r.meta) for r in out] == [(2, 20, '{"x": 1, "y": 2}')]
    with pytest.raises(Unmet, match="stock"):
        db.run("set m {n: 0}; set m {n: 1} where key = 'zz' require 1 else 'stock'", now=now)
    assert {r.n for r in db.run("get m select n", now=now).df.collect()} == {6, 20, 3}  # the block was put back whole
    db.run("del m where n < 5", now=now)
    assert db.run("get m count", now=now).df.head()[0] == 2
    with pytest.raises(TypeMismatch):
        db.run("put m {key: 'q', n: 'x'}", now=now)
    with pytest.raises(QueryError):
        db.run("put m {nokey: 1}", now=now)
    first = db.run("put m {key: 'once'} returning id", now=now, key="k1").df.head()[0]
    assert db.run("put m {key: 'once'} returning id", now=now, key="k1").df.head()[0] == first
    log = db.changes().orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, len(log) + 1)) and log[-1].op == "put"


def test_expiry_and_schema(db):
    at = dt.datetime(2024, 1, 1, 12)
    db.run("put m [{key: 'old', at: '2024-01-01T11:00:00Z'}, {key: 'new', at: '2024-01-01T11:45:00Z'}, {key: 'ever'}]", now=at)
    assert {r.key for r in db.run("get m select key", now=at).df.collect()} == {"new", "ever"}
    c = db.catalog.get("m")
    live, gone = changes.swept(c, at)
    assert live.count() == 2 and gone.count() == 1
    assert changes.next_expiry(c, at) == dt.datetime(2024, 1, 1, 12, 15)
    assert "key text nocase @unique" in describe(c)
    db.run("alter collection m add field extra int; alter collection m rename field n to count_")
    assert {"extra", "count_"} <= set(db.catalog.get("m").fields)
    db.run("drop collection m")
    assert db.run("collections") == []


def test_restore_to_a_moment(db, spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    db.run("put m [{key: 'a', n: 1}, {key: 'b', n: 1}]", now=t[0])
    snapshot = db.catalog.get("m").df
    db.run("set m {n: 2} where key = 'a'", now=t[1])
    db.run("del m where key = 'b'; put m {key: 'c', n: 3}", now=t[2])
    state = lambda to: {r.key: r.n for r in db.restore(snapshot, "m", to).collect()}
    assert state(t[1]) == {"a": 2, "b": 1} and state(t[2]) == {"a": 2, "c": 3}


def test_change_stream_and_follow(db, spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    db.run("put m [{key: 'a', n: 1}, {key: 'b', n: 1}]", now=now)
    db.run("set m {n: 2} where key = 'a'", now=now)
    db.run("del m where key = 'b'", now=now)
    seen = {"puts": {}, "dels": set()}

    def apply(puts, dels):
        seen["puts"] |= {r.id: r.doc for r in puts.collect()}
        seen["dels"] |= {r.id for r in dels.collect()}

    for _ in range(2):  # a second run goes on from the checkpoint
        q = changes.follow(changes.change_stream(spark, db.folder, collection="m"), apply, str(tmp_path / "check"))
        q.awaitTermination()
    assert set(seen["puts"]) == {1} and '"n":2' in seen["puts"][1] and seen["dels"] == {2}


def test_difference_of_answers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, s string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (4, "n")], "id long, s string")
    puts, dels = changes.difference(a, b)
    assert sorted(r.id for r in puts.collect()) == [3, 4] and [r.id for r in dels.collect()] == [2]
    a = spark.sql("select * from values (1L, 'a', null, map('x', 1)), (2L, null, null, map()), (3L, 'c', 'c', null) t(id, s, t, m)")
    b = spark.sql("select * from values (1L, null, 'a', map('x', 1)), (2L, null, null, map('y', 2)), (3L, 'c', 'c', null) t(id, s, t, m)")
    puts, dels = changes.difference(a, b)
    assert sorted(r.id for r in puts.collect()) == [1, 2] and dels.count() == 0
    assert changes.difference(a, a)[0].count() == 0


def test_streaming_rollup_and_once(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 1), "a"), (1, dt.datetime(2024, 1, 1, 0, 1), "a"), (2, dt.datetime(2024, 1, 1, 0, 9), "b"), (3, dt.datetime(2024, 1, 1, 5), "a")]
    spark.createDataFrame(rows, "eid long, at timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("eid long, at timestamp, k string").parquet(str(tmp_path / "in"))
    out = changes.rollup(changes.once(stream, "eid", "at", "1 hour"), "at", "10 minutes", None, {"n": "count(*)"})
    q = out.writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n,) for r in spark.sql("select * from rolled").collect()] == [(2,)]


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as d:
        d.execute("create table c (id integer primary key, name varchar(20), at datetime, ok boolean, z)")
        d.executemany("insert into c values (?, ?, ?, ?, ?)", [(1, "a", "2024-01-01 00:00:00", 1, 1.5), (2, None, None, 0, 2)])
    s = importers.SqliteSource(path)
    assert s.tables() == ["c"]
    assert importers.planned(s.columns("c"), "id") == ({"id": "int", "name": "text", "at": "timestamp", "ok": "bool", "z": "float"}, "id")
    got = s.read(spark, "c", str(tmp_path / "staged"), batch=1).orderBy("id").collect()
    assert [(r.id, r.name, r.ok, r.z) for r in got] == [(1, "a", True, 1.5), (2, None, False, 2.0)]
    assert [sql_type(x) for x in ("BIGINT", "timestamptz", "numeric(10,2)", "jsonb", "text[]", "bytea")] == ["int", "timestamp", "float", "json", "[text]", "bytes"]


def test_lookup_equals_a_merge_by_hand(spark):
    import random

    rng = random.Random(4)
    parents = [(k, rng.choice([None, 1, 2, 3])) for k in range(20)]
    kids = [(k, rng.choice([None, *range(22)]), rng.randint(0, 9)) for k in range(80)]
    c = Catalog(spark)
    c.register("p", spark.createDataFrame(parents, "id long, g long"))
    c.register("k", spark.createDataFrame(kids, "id long, pid long, n long"))
    got = {r.id: [(x.id, x.n) for x in r.k] for r in Reader(c).select(parse_one("get p select id lookup k on pid select id, n where n > 1 order n desc limit 2 offset 1")).df.collect()}
    want = {p: [(i, n) for i, q, n in sorted((x for x in kids if x[1] == p and x[2] > 1), key=lambda x: (-x[2], x[0]))][1:3] for p, _ in parents}
    assert got == want
    folded = {r.id: (r.k[0].n, r.k[0].s) for r in Reader(c).select(parse_one("get p select id lookup k on pid select count() as n, sum(n) as s")).df.collect()}
    assert folded == {p: (len(x), sum(n for *_, n in x) if x else None) for p, _ in parents for x in [[y for y in kids if y[1] == p]]}


def test_long_lists_are_joined(spark):
    """A list as long as the table was an expression of as many literals."""
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(k, k if k % 7 else None, f"s{k}") for k in range(40)], "id long, n int, s string").repartition(2))
    long = [*range(0, 3000, 3), *range(0, 3000, 3), 5]
    found = lambda q, *p: Reader(c, p).select(parse_one(q)).df
    ids = lambda df: {r.id for r in df.collect()}
    for q, test in (("n in $1", lambda k: bool(k % 7) and k in long), ("not n in $1", lambda k: not (k % 7 and k in long)), ("not not n in $1", lambda k: bool(k % 7) and k in long), ("n in $1 and id > 9", lambda k: k > 9 and bool(k % 7) and k in long), ("n in $1 or id = 2", lambda k: k == 2 or bool(k % 7) and k in long)):
        assert ids(found(f"get t select id where {q}", long)) == {k for k in range(40) if test(k)}, q
    plan = found("get t select id where n in $1", long)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "INSET" not in plan
    assert ids(found("get t select id where s in $1", [f"s{k}" for k in long])) == {k for k in range(40) if k in long}
    assert "LeftSemi" not in found("get t select id where n in $1", long[:20])._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(TypeMismatch):
        found("get t select id where n in $1", [*long, 2**63])
