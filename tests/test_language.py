import pytest

from tarnlight.errors import QueryError
from tarnlight.plans.ast import Agg, Binary, InList, InSelect, Lit, Path, Unary
from tarnlight.plans.check import check
from tarnlight.plans.parser import parse, parse_one


def test_both_orders_make_one_statement():
    a = parse_one("get t select a, b where x = 1 order a desc limit 3")
    b = parse_one("SELECT a, b FROM t WHERE x = 1 ORDER BY a DESC LIMIT 3")
    assert a == b


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x is not distinct from 1", Binary("=", Path(("x",)), Lit(1))),
        ("x <> 1", Binary("!=", Path(("x",)), Lit(1))),
        ("x not in (1, 2)", Unary("not", InList(Path(("x",)), (Lit(1), Lit(2))))),
        ("x between 1 and 2", Binary("and", Binary(">=", Path(("x",)), Lit(1)), Binary("<=", Path(("x",)), Lit(2)))),
        ("x is true", Binary("=", Path(("x",)), Lit(True))),
        ("x = -3", Binary("=", Path(("x",)), Lit(-3))),
        ("x = 'it''s'", Binary("=", Path(("x",)), Lit("it's"))),
        ("a or b and c", Binary("or", Path(("a",)), Binary("and", Path(("b",)), Path(("c",))))),
    ],
)
def test_conditions(text, want):
    assert parse_one(f"get t where {text}").where == want


def test_inserts_are_puts():
    p = parse_one("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y') ON CONFLICT (a) DO UPDATE SET b = excluded.b RETURNING *")
    assert p.insert and p.if_absent and p.conflict == ("a",) and len(p.documents) == 2
    assert parse_one("put t {a: 1} if absent else set {n: n + new.n}").otherwise.keys() == {"n"}
    assert parse_one("UPDATE t SET a = a + 1 WHERE b = 2").values.keys() == {"a"}
    assert parse_one("DELETE FROM t WHERE a = 1").values is None


def test_inner_gets_and_statements():
    assert isinstance(parse_one("get talks where room in (get rooms select name where seats > 80)").where, InSelect)
    assert len(parse("get t; get u")) == 2
    assert parse_one("get t select last(px by at) as p").items[0].expr == Agg("last", Path(("px",)), Path(("at",)))


@pytest.mark.parametrize("text", ["get", "get t where", "get t limit x", "select a, from t", "get t order a nulls last", "get t right join u on a = b", "get t limit 1 limit 2", "get t where x = " + "(" * 150 + "1", "frob t", "put t {a: 1} if absent else {n: 1}"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse_one(text)


@pytest.mark.parametrize(
    "text",
    [
        'get talks match abstract "storage" near topic [0.5, 1] limit 4',
        'get talks match abstract "storage" fuse limit 4',
        "get talks near topic [0.5, 1] rerank topic [1, 0] limit 4",
        "get talks facet room, year, room",
        "get talks facet seats ranges [50]",
        "get talks facet seats ranges [90, 50, 10]",
        "get talks select room, max(seats) as most group room facet year",
        'get talks match abstract "storage" order year limit 4',
        "get talks near topic [0.5, 1] limit 4 lookup speakers on talk",
        "get talks where sum(seats) > 10",
        "get talks select avg(sum(seats)) as mean",
        "get talks having year > 2000",
        "get talks lookup speakers on talk lookup talks on speaker",
        'get talks match abstract "storage" near topic [1, 0] fuse k 20000 limit 4',
    ],
)
def test_clauses_that_do_not_go_together(text):
    with pytest.raises(QueryError):
        check(parse_one(text))
