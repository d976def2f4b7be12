"""What clauses go together, checked before anything runs."""

from __future__ import annotations

from ..errors import QueryError
from .ast import Agg, Call, Path, Select, aggregates, walk

MOST_LEVELS = 8
MOST_TABLES = 9
MOST_INNER = 4
MOST_ROWS = 10_000
MOST_VALUES = 100_000
MOST_DISTINCT = 1_000_000


def aggregated(s: Select) -> bool:
    return s.group is not None or any(aggregates(i.expr) for i in s.items or [])


def name_of(item, k: int = 0) -> str:
    if item.alias:
        return item.alias
    e = item.expr
    if isinstance(e, Path):
        return e.parts[-1] if len(e.parts) > 1 and e.parts[0] != "*" else e.text
    if isinstance(e, Agg):
        inner = "*" if e.arg is None else e.arg.text if isinstance(e.arg, Path) else "expr"
        by = f" by {e.by.text}" if isinstance(e.by, Path) else ""
        return f"{e.name}({'distinct ' if e.distinct else ''}{inner}{by})"
    if isinstance(e, Call):
        return e.name
    raise QueryError("a computed column needs `as <name>`")


def check(s: Select, depth: int = 0, inner: int = 0) -> None:
    if inner > MOST_INNER:
        raise QueryError(f"gets stand in one another at most {MOST_INNER} deep")
    ranked = [n for n, v in (("match", s.match), ("near", s.near), ("fuse", s.fuse), ("rerank", s.rerank)) if v]
    if s.match and s.near and not s.fuse:
        raise QueryError("`match` and `near` rank apart: `fuse` ranks by both")
    if s.fuse and not (s.match and s.near):
        raise QueryError("`fuse` needs both `match` and `near`")
    if s.rerank and (not s.match or s.near):
        raise QueryError("`rerank` orders what a `match` finds")
    if ranked and s.order:
        raise QueryError(f"`{ranked[0]}` orders the rows already")
    if ranked and s.lookup:
        raise QueryError(f"`lookup` doesn't go with `{ranked[0]}`")
    if ranked and aggregated(s):
        raise QueryError(f"aggregates don't go with `{ranked[0]}`")
    if s.fuse and not (1 <= s.fuse.k <= 10_000 and 1 <= s.fuse.candidates <= MOST_ROWS):
        raise QueryError("`fuse` takes k and candidates from 1 to 10 000")
    if s.having is not None and not aggregated(s):
        raise QueryError("`having` tests groups")
    if s.facets:
        if s.near or s.fuse or aggregated(s):
            raise QueryError("facets don't go with near, fuse or aggregates")
        names = [f.path.text for f in s.facets]
        if len(set(names)) < len(names):
            raise QueryError("a facet is asked twice")
        for f in s.facets:
            if f.top is not None and f.ranges is not None:
                raise QueryError("a facet has a top or ranges")
            if isinstance(f.top, int) and not 1 <= f.top <= MOST_ROWS:
                raise QueryError("a facet's top is 1 to 10 000")
            if f.ranges is not None and (not 2 <= len(f.ranges) <= MOST_ROWS + 1 or list(f.ranges) != sorted(set(f.ranges))):
                raise QueryError("ranges are 2 to 10 001 numbers, ascending")
    if s.count and s.order and not aggregated(s):
        raise QueryError("a count has no order")
    if depth > MOST_LEVELS:
        raise QueryError(f"lookups chain over {MOST_LEVELS} levels at most")
    if len(s.joins) >= MOST_TABLES:
        raise QueryError(f"{MOST_TABLES} tables are joined at most")
    for x in [s.where, *(s.group or []), *([] if aggregated(s) else [o.expr for o in s.order])]:
        if x is not None and aggregates(x):
            raise QueryError("an aggregate stands in a select list, a having or an order over groups")
    for i in s.items or []:
        for a in aggregates(i.expr):
            for part in (a.arg, a.by, a.where):
                if part is not None and any(isinstance(y, Agg) for y in walk(part)):
                    raise QueryError("aggregates don't nest")
    if s.lookup:
        chain, at = {s.source}, s.lookup
        while at:
            if at.select.source in chain:
                raise QueryError(f"{at.select.source} stands in the lookups twice")
            chain.add(at.select.source)
            at = at.select.lookup
        check(s.lookup.select, depth + 1, inner)
