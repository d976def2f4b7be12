"""A fluent form of the same statements, and a reading of request parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .errors import QueryError
from .operators.read import Answer, Policy, Reader
from .plans.ast import (
    Binary,
    Facet,
    Fuse,
    InList,
    Item,
    Lit,
    Lookup,
    Match,
    Near,
    Path,
    Rerank,
    Select,
    Sort,
    Unary,
    conjoined,
)
from .plans.parser import Parser
from .sources.catalog import Catalog


def expression(text: Any) -> Any:
    """A text in the query language, or a value that is one already."""
    if not isinstance(text, str):
        return text
    p = Parser(text)
    e = p.expr()
    if p.now.kind != "end":
        raise p.fail("the end")
    return e


def item(text: str) -> Item:
    p = Parser(text)
    out = p.item()
    if p.now.kind != "end":
        raise p.fail("the end")
    return out


@dataclass(frozen=True)
class Query:
    """Each method gives a new query; nothing runs before df(), answer() or count()."""

    catalog: Catalog
    select_: Select
    params: tuple = ()
    policy: Policy | None = None
    now: dt.datetime | None = None

    def _with(self, **more: Any) -> Query:
        return replace(self, select_=replace(self.select_, **more))

    def select(self, *items: str) -> Query:
        return self._with(items=[item(i) for i in items])

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def where(self, condition: Any, *params: Any) -> Query:
        text = condition
        if isinstance(text, str) and params:
            for k in range(len(params), 0, -1):
                text = text.replace(f"${k}", f"${k + len(self.params)}")
        out = self._with(where=conjoined([x for x in (self.select_.where, expression(text)) if x is not None]))
        return replace(out, params=(*self.params, *params))

    def group(self, *keys: str) -> Query:
        return self._with(group=[expression(k) for k in keys])

    def having(self, condition: str) -> Query:
        return self._with(having=expression(condition))

    def order(self, *keys: str) -> Query:
        def one(k: str) -> Sort:
            return Parser(k).sort()

        return self._with(order=[one(k) for k in keys])

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def facet(self, path: str, top: int | None = None, ranges: list | None = None, disjunctive: bool = False) -> Query:
        return self._with(facets=[*self.select_.facets, Facet(Path(tuple(path.split("."))), top, tuple(ranges) if ranges else None, disjunctive)])

    def match(self, field: str, text: str, fuzzy: int | None = None, prefix: bool = False) -> Query:
        return self._with(match=Match(Path((field,)), Lit(text), fuzzy, prefix))

    def near(self, field: str, vector: Any, exact: bool = False) -> Query:
        return self._with(near=Near(Path((field,)), vector, None, exact))

    def rerank(self, field: str, vector: Any, candidates: int = 200) -> Query:
        return self._with(rerank=Rerank(Path((field,)), vector, candidates))

    def fuse(self, k: int = 60, candidates: int = 20) -> Query:
        return self._with(fuse=Fuse(k, candidates))

    def lookup(self, child: Query, on: str | tuple, parent: str | tuple = "id", required: bool = False) -> Query:
        pair = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return self._with(lookup=Lookup(child.select_, pair(on), pair(parent), required))

    def require(self, n: int, reason: str | None = None) -> Query:
        return self._with(require=(n, Lit(reason) if reason else None))

    def answer(self) -> Answer:
        return Reader(self.catalog, self.params, self.now, self.policy).select(self.select_)

    def df(self) -> DataFrame:
        return self.answer().df

    def count(self) -> int:
        return self._with(count=True).df().head()[0]


def collection(catalog: Catalog, name: str, **options: Any) -> Query:
    return Query(catalog, Select(name), **options)


@dataclass
class Request:
    """Parameters of a request: select, where, fields as op.value, order, limit, offset, group, facet, count, and lookup.

    lookup names the collections of a chain, outermost first; parameters that begin with one of these names and a dot are
    that level's: on, parent, select, where, order, limit, offset, required, and its fields as op.value.
    """

    params: dict[str, str] = field(default_factory=dict)

    OPS = {"eq": "=", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "like": "~", "has": "has"}
    KNOWN = frozenset(("select", "order", "limit", "offset", "group", "facet", "count", "where", "lookup"))
    LEVEL = frozenset(("select", "order", "limit", "offset", "group", "where", "on", "parent", "required"))
    TRUE = frozenset(("", "true", "1", "yes"))

    def query(self, catalog: Catalog, name: str) -> Query:
        chain = _split(self.params.get("lookup", ""))
        own = {k: v for k, v in self.params.items() if k.split(".")[0] not in chain}
        out = self.clauses(catalog, name, own, self.KNOWN)
        for f in _split(own.get("facet", "")):
            path, _, top = f.partition(" top ")
            out = out.facet(path.strip(), int(top) if top.strip().isdigit() else None)
        look = None
        for level in reversed(chain):
            look = self.level(catalog, level, look)
        if look:
            out = out._with(lookup=look)
        return out._with(count=True) if "count" in own and own["count"].lower() in self.TRUE else out

    def level(self, catalog: Catalog, name: str, below: Lookup | None) -> Lookup:
        p = {k[len(name) + 1 :]: v for k, v in self.params.items() if k.startswith(f"{name}.")}
        if "on" not in p:
            raise QueryError(f"{name}.on names the fields that lead to the parent")
        child = self.clauses(catalog, name, p, self.LEVEL)
        on, parent = tuple(_split(p["on"])), tuple(_split(p.get("parent", "id")))
        if len(on) != len(parent):
            raise QueryError(f"{name}.on and {name}.parent pair field by field")
        return Lookup(replace(child.select_, lookup=below), on, parent, "required" in p and p["required"].lower() in self.TRUE)

    def clauses(self, catalog: Catalog, name: str, p: dict[str, str], known: frozenset[str]) -> Query:
        out, c = collection(catalog, name), catalog.get(name)
        if p.get("select"):
            out = out.select(*_split(p["select"]))
        if p.get("where"):
            out = out.where(p["where"])
        for f, test in p.items():
            if f not in known:
                out = out.where(self.condition(c, f, test))
        if p.get("group"):
            out = out.group(*_split(p["group"]))
        if p.get("order"):
            out = out.order(*map(_order, _split(p["order"])))
        for k in ("limit", "offset"):
            if k in p:
                if not p[k].isdigit():
                    raise QueryError(f"{k} is a whole number")
                out = getattr(out, k)(int(p[k]))
        return out

    def near(self, catalog: Catalog, name: str, body: dict[str, Any]) -> Query:
        """A search by a vector, which no parameter holds: body has field, vector, limit and perhaps exact and ef."""
        if unknown := set(body) - {"field", "vector", "limit", "exact", "ef"}:
            raise QueryError(f"a search has no {sorted(unknown)[0]}")
        if not isinstance(body.get("vector"), list):
            raise QueryError("a search takes a vector")
        out = self.query(catalog, name).limit(int(body.get("limit", 10)))
        return out._with(near=Near(Path((body["field"],)), Lit(body["vector"]), body.get("ef"), bool(body.get("exact"))))

    def condition(self, c, f: str, test: str) -> Any:
        op, _, value = test.partition(".")
        path = Path(tuple(f.split(".")))
        if op == "is":
            return Unary("is null", path) if value == "null" else Binary("=", path, Lit(value == "true"))
        if op == "not":
            return Unary("not", self.condition(c, f, value))
        if op == "in":
            return InList(path, tuple(Lit(_read(c, path, v)) for v in _split(value.strip("()"))))
        if op not in self.OPS:
            raise QueryError(f"no test {op}")
        return Binary(self.OPS[op], path, Lit(value if op in ("like",) else _read(c, path, value)))


def batch(catalog: Catalog, requests: list[tuple[str, dict[str, str]]]) -> list[Answer]:
    """Several requests, (collection, parameters) each, over the catalog as it is now."""
    return [Request(p).query(catalog, name).answer() for name, p in requests]


def _order(key: str) -> str:
    """`-field`, `field.desc` and `field.asc` as an order of the language."""
    name, _, way = key.rpartition(".")
    if name and way in ("asc", "desc"):
        return f"{name} {way}"
    return key[1:] + " desc" if key.startswith("-") else key


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [x for x in [*out, now.strip()] if x]


def _read(c, path: Path, value: str) -> Any:
    kind = c.kind(path.parts[0]) if c.has(path.parts[0]) else "text"
    try:
        return int(value) if kind == "int" else float(value) if kind == "float" else value == "true" if kind == "bool" else value
    except ValueError:
        raise QueryError(f"{path.text} takes {kind}, not {value!r}") from None
