"""Groups: one partial and one final aggregation, then having, order and page over the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, TypeMismatch
from ..functions import text
from ..plans.ast import Agg, Item, Path, Select, Sort, aggregates, walk
from ..plans.check import MOST_DISTINCT, name_of
from ..plans.expr import Scope, Typed

#: Registers of a sketch: 2**14, a standard error of 0.81 %.
HLL_BITS = 14


def _sketched(x: Typed, column: Column) -> Column:
    """A column as sketches take it."""
    if x.nocase:
        return text.casefold(column)
    return column.cast("bigint") if x.kind == "int" else column if x.kind in ("text", "bytes") else column.cast("string")


def fold(scope: Scope, a: Agg) -> tuple[Column, str, Column | None]:
    """The aggregate column, its kind, and a count of distinct values that must stay in bounds."""
    keep = scope.test(a.where) if a.where is not None else None
    if a.arg is None:
        return (F.count(F.lit(1)) if keep is None else F.count(F.when(keep, F.lit(1)))), "int", None
    x = scope.typed(a.arg)
    column = x.as_kind("float") if a.name in ("sum", "avg") else x.as_kind("text")
    filtered = column if keep is None else F.when(keep, column)
    if a.distinct:
        if a.name != "count":
            raise QueryError("only count() takes distinct")
        counted = F.count_distinct(text.casefold(filtered) if x.nocase else filtered)
        return counted, "int", counted
    if a.name == "count":
        return F.count(filtered), "int", None
    if a.name in ("sum", "avg"):
        if x.kind not in ("int", "float", "json", "null"):
            raise TypeMismatch(f"{a.name}() takes numbers, not {x.kind}")
        if a.name == "avg":
            return F.avg(filtered.cast("double")), "float", None
        whole = x.kind == "int"
        return F.sum(filtered.cast("bigint" if whole else "double")), "int" if whole else "float", None
    if a.name in ("min", "max"):
        if x.kind not in ("int", "float", "timestamp", "text", "bool", "json"):
            raise TypeMismatch(f"{a.name}() has no order of {x.kind}")
        keys = scope.sort_key(x)
        if len(keys) == 1 and not x.nocase:
            return (F.min if a.name == "min" else F.max)(filtered), x.kind, None
        pick = F.min_by if a.name == "min" else F.max_by
        return pick(filtered, F.when(filtered.isNotNull(), F.struct(*keys))), x.kind, None
    if a.name in ("first", "last"):
        # among rows whose value, and key if one is named, is not null; ties go by id
        at = F.col("id") if a.by is None else F.struct(scope.col(a.by), F.col("id"))
        some = column.isNotNull() if a.by is None else column.isNotNull() & scope.col(a.by).isNotNull()
        pick = F.min_by if a.name == "first" else F.max_by
        return pick(column, F.when(some, at)), x.kind, None
    if a.name == "approx_count_distinct":
        return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_sketched(x, column), F.lit(HLL_BITS))), F.lit(0).cast("bigint")), "int", None
    if a.name == "hll_accumulate":
        return F.hll_sketch_agg(_sketched(x, column), F.lit(HLL_BITS)), "bytes", None
    if a.name == "hll_combine":
        return F.hll_union_agg(column), "bytes", None
    raise QueryError(f"no aggregate {a.name}()")


def ungrouped(items: list[Item], keys: list) -> None:
    """A field stands within an aggregate, or it is a group key."""
    for i in items:
        if i.expr in keys or (isinstance(i.expr, Path) and i.alias is None and i.expr in keys):
            continue
        inside = {id(y) for a in aggregates(i.expr) for y in walk(a)}
        for x in walk(i.expr):
            if isinstance(x, Path) and id(x) not in inside and x not in keys:
                raise QueryError(f"{x.text} is neither aggregated nor a group key")


def grouped(scope: Scope, rows: DataFrame, s: Select) -> tuple[DataFrame, list[Sort], dict[str, Typed], list[str]]:
    """The groups that pass, their order, and what each column of the list means. rows: filtered, with id."""
    items = list(s.items or [])
    named = {i.alias: i.expr for i in items if i.alias}
    keys = []
    for g in s.group or []:
        if isinstance(g, Path) and g.text in named and not scope.collection.has(g.text):
            g = named[g.text]
        elif type(g).__name__ == "Lit" and isinstance(g.value, int):
            if not 1 <= g.value <= len(items):
                raise QueryError(f"the list has no column {g.value}")
            g = items[g.value - 1].expr
        keys.append(g)
    if s.items is None:
        items = [Item(g) for g in keys]
    ungrouped(items, keys)

    key_types = [scope.typed(k) for k in keys]
    shown: list[Column] = []
    by: list[Column] = []
    for k, t in enumerate(key_types):
        column = t.as_kind("text")
        if t.nocase:
            by.append(text.casefold(column).alias(f"_k{k}"))
            shown.append(F.min_by(column, F.col("id")).alias(f"_s{k}"))  # as it is spelt first
        else:
            by.append(column.alias(f"_k{k}"))
            shown.append(None)
    folds: dict[Agg, str] = {}
    columns, guards, kinds = [], [], {}
    orders = [o.expr for o in s.order]
    for x in [*(i.expr for i in items), *([s.having] if s.having is not None else []), *orders]:
        for a in aggregates(x):
            if a not in folds:
                folds[a] = f"_a{len(folds)}"
                column, kind, guard = fold(scope, a)
                columns.append(column.alias(folds[a]))
                kinds[a] = kind
                if guard is not None:
                    guards.append(folds[a])
    columns += [c for c in shown if c is not None]
    out = rows.groupBy(*by).agg(*columns) if columns else rows.select(*by).distinct()
    for g in guards:
        out = out.withColumn(g, F.when(F.col(g) <= MOST_DISTINCT, F.col(g)).otherwise(F.raise_error(F.lit(f"count(distinct) holds {MOST_DISTINCT} values at most")).cast("bigint")))

    over = Scope(scope.catalog, scope.collection, scope.params, scope.now, alias=scope.alias)
    over.aggregate = lambda a: Typed(F.col(folds[a]), kinds[a])
    for k, (e, t) in enumerate(zip(keys, key_types, strict=True)):
        column = F.col(f"_s{k}" if t.nocase else f"_k{k}")
        typed = Typed(column, t.kind if t.kind != "json" else "text", t.nocase, t.collate, ntz=t.ntz)
        if isinstance(e, Path):
            over.names[e.text] = typed
            over.names.setdefault(e.parts[-1], typed)
        over.names[f"\0{k}"] = typed
    swap = {e: f"\0{k}" for k, e in enumerate(keys)}

    def read(e) -> Typed:
        return over.names[swap[e]] if e in swap else over.typed(_swapped(e, swap))

    names = [name_of(i, k) for k, i in enumerate(items)]
    if len(set(names)) < len(names):
        raise QueryError("two columns have one name")
    typed = {n: read(i.expr) for n, i in zip(names, items, strict=True)}
    if s.having is not None:
        over.names |= {n: t for n, t in typed.items() if n not in over.names}
        out = out.filter(over.test(_swapped(s.having, swap)))
    over.names |= typed
    sorts = []
    for o in s.order:
        e = o.expr
        if type(e).__name__ == "Lit" and isinstance(e.value, int):
            e = Path((names[e.value - 1],))
        t = over.names[e.text] if isinstance(e, Path) and e.text in over.names else read(e)
        sorts.append((t, o.desc, o.collate))
    order = [c.desc() if desc else c.asc() for t, desc, collate in sorts for c in scope.sort_key(t, collate)]
    order += [F.col(f"_k{k}").asc() for k in range(len(keys)) if not isinstance(out.schema[f"_k{k}"].dataType, _unordered())]
    return out, order, typed, names


def _unordered() -> tuple:
    from pyspark.sql.types import MapType, VariantType

    return MapType, VariantType


def _swapped(e, keys: dict):
    """The expression with group keys read from the groups."""
    from dataclasses import fields, is_dataclass, replace

    if e in keys:
        return Path((keys[e],))
    if isinstance(e, Agg) or not is_dataclass(e):
        return tuple(_swapped(x, keys) for x in e) if isinstance(e, tuple) else e
    return replace(e, **{f.name: _swapped(getattr(e, f.name), keys) for f in fields(e) if is_dataclass(getattr(e, f.name)) or isinstance(getattr(e, f.name), tuple)}) if not isinstance(e, Path) else e
