"""Layers, manifests, the change log, cursors and replicas."""

import datetime as dt

import pytest

from tarnlight.errors import Conflict, Duplicate, Gone, QueryError
from tarnlight.operators.storage import MOST_LAYERS
from tarnlight.operators.writes import Database
from tarnlight.sources.catalog import Catalog
from tarnlight.statements import Statements
from tarnlight.streaming.replica import Replica, claimed
from tarnlight.tools import Tools

NOW = dt.datetime(2024, 3, 1)


def boats(spark, folder, n=40):
    c = Catalog(spark)
    c.register("boats", spark.range(n).selectExpr("id", "concat('boat ', id % 7) as name", "id * 10 as mass", "id % 4 as dock"), unique=())
    return Database(c, str(folder))


def state(db):
    return {r.id: (r.name, r.mass, r.dock) for r in db.run("get boats").df.collect()}


def test_random_writes_equal_a_dictionary(spark, tmp_path):
    import random

    rng = random.Random(3)
    db = boats(spark, tmp_path / "db")
    db.catalog.index_text("boats", "name", str(tmp_path / "index"))
    want = {i: (f"boat {i % 7}", i * 10, i % 4) for i in range(40)}
    for step in range(MOST_LAYERS + 5):
        d, kind = rng.randrange(4), rng.choice(["set", "del", "put", "page"])
        if kind == "set":
            db.run(f"set boats {{mass: mass + {step}, name: 'tug {step}'}} where dock = {d} and id < 30", now=NOW)
            want = {i: ((f"tug {step}", m + step, k) if k == d and i < 30 else (n, m, k)) for i, (n, m, k) in want.items()}
        elif kind == "del":
            db.run(f"del boats where dock = {d} and mass > 300", now=NOW)
            want = {i: x for i, x in want.items() if not (x[2] == d and x[1] > 300)}
        elif kind == "put":
            db.run(f"put boats [{{id: {step}, name: 'new', mass: 1, dock: {d}}}, {{id: {100 + step}, name: 'ferry', mass: 2, dock: {d}}}]", now=NOW)
            want |= {step: ("new", 1, d), 100 + step: ("ferry", 2, d)}
        else:
            db.run("set boats {dock: 9} order mass desc limit 3", now=NOW)
            for i in sorted(want, key=lambda i: (-want[i][1], i))[:3]:
                want[i] = (*want[i][:2], 9)
        assert state(db) == want, (step, kind)
    assert len(db.layers["boats"].parts) <= MOST_LAYERS
    plain = Catalog(spark)
    plain.register("boats", db.catalog.get("boats").df)
    for text in ("ferry", "boat 3", "tug new", "boat tug 1"):
        q = f'get boats select id match name "{text}" limit 9'
        a, b = (x.run(q).df.collect() for x in (db, Database(plain, str(tmp_path / "plain"))))
        assert [(r.id, round(r._score, 9)) for r in a] == [(r.id, round(r._score, 9)) for r in b], text
    # another session finds the same rows, and garbage is what no manifest names
    again = boats(spark, tmp_path / "db")
    assert state(again) == want
    again.run("compact boats")
    assert again.collect_garbage() > 0 and state(again) == want
    assert again.collect_garbage() == 0
    assert sorted(r.seq for r in again.changes().collect()) == list(range(1, again.store.now.seq + 1))


def test_writes_do_not_read_the_table_twice(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    out = db.run("set boats {mass: 0} where dock = 1", now=NOW).df
    assert out.head()[0] == 10
    plan = db.catalog.get("boats").df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    new = spark.read.parquet(db.layers["boats"].parts[0][1])
    assert new.count() == 10  # what changed, and no more


def test_one_of_two_writers_commits(spark, tmp_path):
    a, b = boats(spark, tmp_path / "db"), boats(spark, tmp_path / "db")
    a.run("del boats where id = 1", now=NOW)
    with pytest.raises(Conflict):
        b.run("del boats where id = 2", now=NOW)
    assert 2 in state(b) and 1 not in state(boats(spark, tmp_path / "db"))
    a.store.folder.create(f"{a.store.folder.path}/manifest/000000000099.json", '{"n": 99, "seq"')  # torn
    assert state(boats(spark, tmp_path / "db")).keys() == state(a).keys()


def test_a_key_answers_as_it_did_in_a_later_session(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    first = db.run("put boats {name: 'x', mass: 1, dock: 1} returning id", now=NOW, key="k").df.collect()
    again = boats(spark, tmp_path / "db")
    assert again.run("put boats {name: 'x', mass: 1, dock: 1} returning id", now=NOW, key="k").df.collect() == first
    assert len(state(again)) == 41
    again.collect_garbage()
    assert again.run("put boats {name: 'y'}", now=NOW, key="k").df.collect() == first


def test_unique_and_deleted_answers(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    db.run("create index on boats (mass) @unique")
    with pytest.raises(Duplicate):
        db.run("set boats {mass: 5} where dock = 1", now=NOW)
    gone = db.run("del boats where dock = 2 order mass desc limit 2 returning id, mass", now=NOW).df.collect()
    assert [(r.id, r.mass) for r in gone] == [(38, 380), (34, 340)] and len(state(db)) == 38


def test_cursors_and_what_is_let_go(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    for k in range(3):
        db.run(f"set boats {{mass: {k}}} where dock = {k}", now=NOW)
    assert db.store.advanced("mail", 10) == 10 and db.store.advanced("mail", 4) == 10
    with pytest.raises(QueryError):
        db.store.advanced("mail", 99)
    db.store.trimmed(30)  # the consumer is at 10: later commits stay for it
    assert db.store.now.floor == 10
    with pytest.raises(Gone):
        db.changes(5)
    assert db.changes(10).count() == 20
    again = boats(spark, tmp_path / "db")
    assert again.store.cursor("mail") == 10 and again.changes(10).count() == 20


def test_a_replica_and_another_systems_log(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    copy = boats(spark, tmp_path / "copy")
    r = Replica(copy)
    db.run("set boats {mass: 7} where dock = 1; del boats where dock = 0", now=NOW)
    r.follow(db.folder, str(tmp_path / "check")).awaitTermination()
    assert state(copy) == state(db) and r.reached == 20
    db.run("put boats {id: 77, name: 'late', mass: 0, dock: 3}", now=NOW)
    r.follow(db.folder, str(tmp_path / "check")).awaitTermination()
    r.apply(db.changes())
    assert state(copy) == state(db) and Replica(boats(spark, tmp_path / "copy")).reached == 21
    log = [(1, "boats", "put", 5, '{"id":5,"name":"mirrored","mass":1,"dock":1}'), (2, "boats", "del", 6, None), (3, "boats", "put", 5, '{"id":5,"name":"twice","mass":2,"dock":1}'), (4, "other", "put", 1, "{}")]
    spark.createDataFrame(log, "seq long, collection string, op string, id long, doc string").write.json(str(tmp_path / "log"))
    mirror = boats(spark, tmp_path / "mirror")
    stream = spark.readStream.schema("seq long, collection string, op string, id long, doc string").json(str(tmp_path / "log"))
    Replica(mirror, "feed").follow_rows(stream, str(tmp_path / "check2")).awaitTermination()
    got = state(mirror)
    assert got[5] == ("twice", 2, 1) and 6 not in got and len(got) == 39


def test_statements_by_name_and_claims(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    s = Statements(db)
    s.define("heavy", "get boats select id where mass > $1 order id")
    s.define("heavy", "get boats select id where mass > $1 order id")
    with pytest.raises(QueryError):
        s.define("heavy", "get boats")
    assert [r.id for r in s.run("heavy", 370).df.collect()] == [38, 39]
    with pytest.raises(QueryError):
        s.run("heavy")
    with pytest.raises(QueryError):
        s.run("light")
    row = s.statistics().head()
    assert (row.name, row.runs, row.failures) == ("heavy", 2, 1) and row.longest <= row.seconds
    take = "set boats {dock: 8} where dock = 1 order mass limit 6 returning id"
    assert [r.id for r in claimed(db, take, now=NOW)] == [1, 5, 9, 13, 17, 21]
    assert len(claimed(db, take, now=NOW)) == 4 and claimed(db, take, wait=0.2, every=0.1, now=NOW) == []


def test_tools(spark, tmp_path):
    db = boats(spark, tmp_path / "db")
    tools = Tools(db, writable=True)
    assert {t["name"] for t in tools.describe()} == {"search", "query", "get", "write", "remember", "recall"}
    assert tools.call("get", {"collection": "boats", "id": 3})[0]["mass"] == 30
    assert tools.call("query", {"query": "get boats count where dock = $1", "params": [2]}) == [{"count": 10}]
    assert len(tools.call("search", {"collection": "boats", "field": "name", "text": "boat 5", "limit": 3})) == 3
    tools.call("write", {"query": "del boats where id = 3"})
    assert tools.call("get", {"collection": "boats", "id": 3}) == []
    assert tools.call("recall", {"text": "anchor"}) == []
    tools.call("remember", {"text": "the anchor is in the shed", "tags": ["gear"]})
    tools.call("remember", {"text": "paint dries by noon"})
    assert [r["body"] for r in tools.call("recall", {"text": "anchor"})] == ["the anchor is in the shed"]
    for name, arguments in (("query", {"query": "del boats"}), ("fly", {}), ("get", {"collection": "boats"}), ("get", {"collection": "boats where", "id": 1}), ("search", {"collection": "boats", "field": "name"})):
        with pytest.raises(QueryError):
            tools.call(name, arguments)
    for name, arguments in (("write", {"query": "del boats"}), ("remember", {"text": "x"})):
        with pytest.raises(QueryError):
            Tools(db).call(name, arguments)


def test_hooks_before_and_after_writes(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = []

    class Watch:
        def functions(self):
            return [("doubled", lambda x: x * 2, 1, "twice as much")]

        def before(self, c, op, rows):
            if op == "del":
                return rows.filter("id != 5")
            return rows.withColumn("mass", F.least("mass", F.lit(1000)))

        def after(self, c, op, rows):
            seen.append((c.name, op, rows.count()))

    db = boats(spark, tmp_path / "db")
    db.catalog.install(Watch())
    db.run("put boats {id: 60, name: 'x', mass: 5000, dock: 1}; set boats {mass: doubled(mass)} where id in [3, 60]; del boats where id in [4, 5]", now=NOW)
    got = state(db)
    assert got[60][1] == 1000 and got[3][1] == 60 and 4 not in got and 5 in got
    assert seen == [("boats", "put", 1), ("boats", "set", 2), ("boats", "del", 1)]

    def refuse(c, op, rows):
        raise QueryError("not today")

    db.catalog.hooks.append(("before", refuse))
    with pytest.raises(QueryError, match="not today"):
        db.run("del boats where id = 7", now=NOW)
    assert 7 in state(db)


def test_answers_as_json(spark, tmp_path):
    import json

    from tarnlight.operators.read import Reader
    from tarnlight.plans.parser import parse_one
    from tarnlight.sources.importers import json_answer

    db = boats(spark, tmp_path / "db")
    rows = json_answer(Reader(db.catalog).select(parse_one("get boats select id, mass order mass desc limit 2 facet dock"))).orderBy("place").collect()
    assert [json.loads(r.json) for r in rows if r.part == "rows"] == [{"id": 39, "mass": 390}, {"id": 38, "mass": 380}]
    assert [json.loads(r.json)["count"] for r in rows if r.part == "dock"] == [10] * 4
