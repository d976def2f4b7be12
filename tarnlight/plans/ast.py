"""Statements and expressions, as parsed or built."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    n: int


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    @property
    def text(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Interval:
    n: int
    unit: str


@dataclass(frozen=True)
class Unary:
    op: str  # "not", "-", "is null"
    x: Any


@dataclass(frozen=True)
class Binary:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class InList:
    x: Any
    items: tuple


@dataclass(frozen=True)
class InSelect:
    x: Any
    select: Any


@dataclass(frozen=True)
class Exists:
    select: Any


@dataclass(frozen=True)
class Scalar:
    select: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple[Any, Any], ...]
    otherwise: Any


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any = None  # None: every row
    by: Any = None
    distinct: bool = False
    where: Any = None


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class ObjectOf:
    items: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Sort:
    expr: Any
    desc: bool = False
    collate: str | None = None


@dataclass(frozen=True)
class Facet:
    path: Path
    top: int | None = None
    ranges: tuple | None = None
    disjunctive: bool = False


@dataclass(frozen=True)
class Match:
    field: Path
    text: Any
    fuzzy: int | None = None
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    field: Path
    vector: Any
    ef: int | None = None
    exact: bool = False


@dataclass(frozen=True)
class Rerank:
    field: Path
    vector: Any
    candidates: int = 200


@dataclass(frozen=True)
class Fuse:
    k: int = 60
    candidates: int = 20


@dataclass(frozen=True)
class JoinOn:
    kind: str  # inner, left
    table: str
    alias: str
    on: Any


@dataclass
class Lookup:
    select: Select
    child: tuple[str, ...]
    parent: tuple[str, ...]
    required: bool = False


@dataclass
class Select:
    source: str = ""
    alias: str | None = None
    items: list[Item] | None = None
    distinct: bool = False
    where: Any = None
    group: list | None = None
    having: Any = None
    order: list[Sort] = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    count: bool = False
    facets: list[Facet] = field(default_factory=list)
    match: Match | None = None
    near: Near | None = None
    rerank: Rerank | None = None
    fuse: Fuse | None = None
    lookup: Lookup | None = None
    joins: list[JoinOn] = field(default_factory=list)
    require: tuple[Any, Any] | None = None


@dataclass
class Put:
    source: str
    documents: list | Any
    insert: bool = False
    if_absent: bool = False
    otherwise: dict | None = None
    conflict: tuple[str, ...] | None = None
    returning: list[Item] | None = None
    require: tuple[Any, Any] | None = None


@dataclass
class Change:
    """set and del: the rows are picked as a get would page to them."""

    source: str
    values: dict | None  # None: del
    where: Any = None
    order: list[Sort] = field(default_factory=list)
    limit: Any = None
    returning: list[Item] | None = None
    require: tuple[Any, Any] | None = None


@dataclass
class Schema:
    """create, alter, drop, describe, collections, compact."""

    op: str
    name: str | None = None
    fields: list = field(default_factory=list)
    lenient: bool = False
    args: dict = field(default_factory=dict)


@dataclass
class Explain:
    statement: Any


AGGREGATES = frozenset("count sum avg min max first last approx_count_distinct hll_accumulate hll_combine".split())


def walk(e: Any):
    """An expression and all within it, but not inner selects."""
    yield e
    if isinstance(e, Unary):
        yield from walk(e.x)
    elif isinstance(e, Binary):
        yield from walk(e.a)
        yield from walk(e.b)
    elif isinstance(e, InList):
        yield from walk(e.x)
        for i in e.items:
            yield from walk(i)
    elif isinstance(e, InSelect):
        yield from walk(e.x)
    elif isinstance(e, Call):
        for a in e.args:
            yield from walk(a)
    elif isinstance(e, Case):
        for w, t in e.whens:
            yield from walk(w)
            yield from walk(t)
        yield from walk(e.otherwise)
    elif isinstance(e, ListOf):
        for a in e.items:
            yield from walk(a)
    elif isinstance(e, Agg):
        for a in (e.arg, e.by, e.where):
            if a is not None:
                yield from walk(a)


def aggregates(e: Any) -> list[Agg]:
    return [x for x in walk(e) if isinstance(x, Agg)]


def conjuncts(e: Any) -> list:
    if e is None:
        return []
    return conjuncts(e.a) + conjuncts(e.b) if isinstance(e, Binary) and e.op == "and" else [e]


def conjoined(parts: list) -> Any:
    out = None
    for p in parts:
        out = p if out is None else Binary("and", out, p)
    return out
