"""Selects to DataFrames."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError, Unmet
from ..functions import text as textfn
from ..plans.ast import (
    Binary,
    Call,
    Exists,
    InList,
    InSelect,
    Item,
    Lit,
    Lookup,
    Path,
    Scalar,
    Select,
    Sort,
    Unary,
    conjoined,
    conjuncts,
    walk,
)
from ..plans.check import MOST_ROWS, aggregated, check, name_of
from ..plans.expr import Scope, Typed
from ..sources.catalog import Catalog, Collection
from . import aggregate, facets, search


#: Values of a list that are broadcast at most.
BROADCAST_VALUES = 500_000


@dataclass
class Answer:
    df: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)
    nested: list[str] = field(default_factory=list)  # names of the lookup levels, outermost first

    def flatten(self) -> DataFrame:
        """A row for each innermost child; parents without children stay, with nulls."""
        df = self.df
        for name in self.nested:
            kept = [c for c in df.columns if c != name]
            df = df.select(*kept, F.explode_outer(name).alias("_one"))
            inner = df.schema["_one"].dataType.fieldNames()
            df = df.select(*kept, *(F.col("_one")[c].alias(c if c not in kept else f"{name}.{c}") for c in inner))
        return df


def explained(reader: Reader, s: Any) -> Answer:
    """How a statement would be answered, a step a row: what the scans read and are handed, how it joins, ranks and pages."""
    steps: list[str] = []
    if not isinstance(s, Select):
        steps.append(f"write: {type(s).__name__.lower()} adds a layer of what it changes to {s.source}" if hasattr(s, "source") else f"schema: {getattr(s, 'op', '')}")
    else:
        c = reader.catalog.get(s.source)
        plan = reader.select(s).df._jdf.queryExecution().executedPlan().toString()
        for scan in re.findall(r"FileScan \S+ .*", plan):
            read = re.search(r"ReadSchema: struct<(.*?)>(?:$|,|\s)", scan)
            pushed = re.search(r"PushedFilters: \[(.*?)\](?:,|\s|$)", scan)
            columns = re.match(r"FileScan \S+ \[([^\]]*)\]", scan)
            n = len(re.findall(r"#\d+", columns[1])) if columns else 0
            steps.append(f"scan: {n} columns, the files are handed {pushed[1] if pushed and pushed[1] else 'no filter'}" if read else f"scan: {n} columns")
        if s.where is not None:
            steps.append("filter: " + ("semi and anti joins, and what the scans are handed" if any(isinstance(x, InSelect | Exists) for e in conjuncts(s.where) for x in walk(e)) else "row by row, with what the scans are handed"))
        for kind, n in Counter(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)[^\n]*?(LeftSemi|LeftAnti|LeftOuter|Inner|FullOuter|Cross)", plan)).items():
            steps.append(f"join: {kind[1]} by {kind[0]}" + (f", {n} times" if n > 1 else ""))
        if s.match:
            by = "the text index" if s.match.field.text in c.text_index and not reader.within(reader.scope(s)) else "a read of every text"
            steps.append(f"match: {by} on {s.match.field.text}")
        if s.near:
            codes = s.near.field.text in c.vector_index and not s.near.exact and s.where is None
            steps.append(f"near: {'cells and codes' if codes else 'the exact distance of every row left'} on {s.near.field.text}")
        if s.fuse:
            steps.append(f"fuse: reciprocal ranks, {s.fuse.candidates} candidates a side")
        if s.lookup:
            steps.append(f"lookup: {s.lookup.select.source}" + (", of the parents answered alone" if s.where is not None or s.limit is not None else ""))
        if aggregated(s):
            steps.append("groups: partial sums before the shuffle" if s.group is not None else "groups: one, of partial sums")
        if s.limit is not None:
            steps.append("page: " + ("the best rows of each partition, merged" if "TakeOrderedAndProject" in plan else "the first rows"))
        steps.append(f"rows: {reader.select(s).df.count()}")
    spark = reader.catalog.spark
    return Answer(spark.createDataFrame(list(enumerate(steps, 1)), "step int, what string"))


@dataclass(frozen=True)
class Policy:
    """What a caller may read: a filter for each collection, and fields that are hidden."""

    filters: dict[str, Any] = field(default_factory=dict)
    hidden: dict[str, frozenset[str]] = field(default_factory=dict)
    claims: dict[str, Any] = field(default_factory=dict)


class Reader:
    def __init__(self, catalog: Catalog, params: tuple = (), now: dt.datetime | None = None, policy: Policy | None = None):
        self.catalog, self.params = catalog, tuple(params)
        self.now = (now or dt.datetime.now(dt.UTC)).replace(tzinfo=None)
        self.policy = policy or Policy()

    # rows
    def scope(self, s: Select) -> Scope:
        return Scope(self.catalog, self.catalog.get(s.source), self.params, self.now, alias=s.alias)

    def rows(self, scope: Scope) -> DataFrame:
        """All live rows that the policy lets through, with their id as `id`."""
        c: Collection = scope.collection
        df = c.df if c.id == "id" else c.df.withColumn("id", F.col(c.id))
        if c.ttl is not None:
            df = df.filter(c.alive(F.lit(self.now)))
        rule = self.policy.filters.get(c.name)
        return self.filtered(scope, df, rule) if rule is not None else df

    def filtered(self, scope: Scope, df: DataFrame, where: Any, inner: int = 0) -> DataFrame:
        """Filter by conjuncts: inner gets become semi and anti joins, the rest reaches the scan."""
        for e in conjuncts(where):
            negate = False
            while isinstance(e, Unary) and e.op == "not" and isinstance(e.x, InSelect | Exists | Unary):
                if isinstance(e.x, Unary) and e.x.op != "not":
                    break
                e, negate = e.x, not negate
            if isinstance(e, InSelect):
                found = self.inner(e.select, inner + 1).toDF("_value").filter("_value is not null")
                key = scope.typed(e.x)
                df = df.join(found, key.as_kind("text") == F.col("_value"), "left_anti" if negate else "left_semi")
            elif isinstance(e, Exists):
                df = self.exists(scope, df, e.select, negate, inner)
            elif (many := self.listed_values(scope, e)) is not None:
                key, found, negated = many
                df = df.join(found, key == F.col("_value"), "left_anti" if negated != negate else "left_semi")
            else:
                e = self.scalars(e, inner)
                test = scope.test(Unary("not", e) if negate else e, bare=not negate)
                df = df.filter(test)
        return df

    def listed_values(self, scope: Scope, e: Any) -> tuple[Column, DataFrame, bool] | None:
        """A test of a list of more than MANY_VALUES: what is looked up, the values as rows (`_value`), and whether they are ruled out."""
        negated = isinstance(e, Unary) and e.op == "not"
        e = e.x if negated else e
        found = scope.many(e) if isinstance(e, InList) else None
        if found is None:
            return None
        key, values, kind = found
        rows = self.catalog.spark.createDataFrame(pa.table({"_value": pa.array(values, kind)}))
        return key, F.broadcast(rows) if len(values) <= BROADCAST_VALUES else rows, negated  # counted

    def scalars(self, e: Any, inner: int) -> Any:
        """Comparisons with an inner get's one value: it is asked first, and is one value."""
        if isinstance(e, Binary):
            return Binary(e.op, self.scalars(e.a, inner), self.scalars(e.b, inner))
        if isinstance(e, Unary):
            return Unary(e.op, self.scalars(e.x, inner))
        if isinstance(e, Scalar):
            found = self.inner(e.select, inner + 1).limit(2).collect()
            if len(found) > 1:
                raise QueryError("the inner get answers one value")
            return Lit(found[0][0] if found else None)
        if isinstance(e, InSelect | Exists):
            raise QueryError("an inner get stands alone or with `and`")
        return e

    def inner(self, s: Select, depth: int) -> DataFrame:
        check(s, inner=depth)
        if s.items is None or len(s.items) != 1 or s.lookup or s.count or s.require:
            raise QueryError("an inner get answers one column")
        return self.select(s, depth).df

    def exists(self, scope: Scope, df: DataFrame, s: Select, negate: bool, inner: int) -> DataFrame:
        """One equality ties the inner rows to the outer; the rest filters the inner ones."""
        mine = {scope.alias, scope.collection.name} - {None}
        inside = self.scope(s)
        names = {s.alias, s.source} - {None}
        tie, rest = [], []
        for e in conjuncts(s.where):
            outer = [x for x in walk(e) if isinstance(x, Path) and len(x.parts) > 1 and x.parts[0] in mine - names]
            (tie if outer else rest).append(e)
        if len(tie) != 1 or not isinstance(tie[0], Binary) or tie[0].op != "=":
            raise QueryError("an exists is tied to the outer rows by one equality")
        a, b = tie[0].a, tie[0].b
        if a.parts[0] in mine - names:
            a, b = b, a
        rows = self.filtered(inside, self.rows(inside), conjoined(rest), inner + 1).select(inside.col(a).alias("_key")).distinct()
        return df.join(rows, scope.col(Path(b.parts[1:])) == F.col("_key"), "left_anti" if negate else "left_semi")

    # selects
    def select(self, s: Select, inner: int = 0) -> Answer:
        check(s, inner=inner)
        if s.joins:
            return self.joined(s, inner)
        scope = self.scope(s)
        if s.distinct:
            if any(i for i in s.items or [] if isinstance(i.expr, Call) and i.expr.name in ("highlight", "snippet")):
                raise QueryError("distinct doesn't go with highlights")
            s = replace(s, distinct=False, group=[i.expr for i in s.items or []])
        base = self.rows(scope)

        def left(where: Any) -> DataFrame:
            rows = self.filtered(scope, base, where, inner)
            return self.required(scope, rows, s.lookup) if s.lookup and s.lookup.required and not aggregated(s) else rows

        def counted(rows: DataFrame) -> DataFrame:
            """What facets count: of a match the rows that it finds, whatever the page."""
            return rows.join(self.matched(scope, base, rows, s).rows.select("id"), "id", "left_semi") if s.match else rows

        rows = left(s.where)
        matched = counted(rows) if s.facets else rows
        found = {f.path.text: facets.facet(scope, counted(left(facets.without(s.where, f.path))) if f.disjunctive else matched, f) for f in s.facets}
        if aggregated(s):
            answer = self.groups(scope, rows, s)
        elif s.match or s.near:
            answer = self.ranked(scope, base, rows, s)
        else:
            answer = self.plain(scope, rows, s)
        answer.facets = found
        if s.require:
            self.required_count(answer.df, s.require, scope)
        return answer

    def required_count(self, df: DataFrame, require: tuple[Any, Any], scope: Scope) -> None:
        n, reason = scope.whole(require[0], "require"), require[1]
        got = df.limit(n + 1).count()
        if got != n:
            raise Unmet(scope.value(reason) if reason is not None else f"{n} rows are required, {'more are' if got > n else f'{got}'} found")

    def page(self, df: DataFrame, s: Select, scope: Scope) -> DataFrame:
        if s.offset is not None and (k := scope.whole(s.offset, "offset")):
            df = df.offset(k)
        return df.limit(scope.whole(s.limit, "limit")) if s.limit is not None else df

    def order(self, scope: Scope, order: list[Sort], items: list[Item] | None) -> list[Column]:
        out = []
        named = {i.alias: i.expr for i in items or [] if i.alias}
        for o in order:
            e = o.expr
            if isinstance(e, Lit) and isinstance(e.value, int):
                if not 1 <= e.value <= len(items or []):
                    raise QueryError(f"the list has no column {e.value}")
                e = items[e.value - 1].expr
            elif isinstance(e, Path) and e.text in named and not scope.collection.has(e.parts[0]):
                e = named[e.text]
            out += [c.desc() if o.desc else c.asc() for c in scope.sort_key(scope.typed(e), o.collate)]
        return [*out, F.col("id").asc()]

    def listed(self, scope: Scope, items: list[Item] | None, wanted: set[str] = frozenset(), text_field: str | None = None) -> list[Column]:
        hidden = self.policy.hidden.get(scope.collection.name, frozenset())
        if items is None:
            c = scope.collection
            return [F.col("id"), *(F.lit(None).cast(c.df.schema[f].dataType).alias(f) if f in hidden else F.col(f"`{f}`") for f in c.fields if f != c.id or c.id == f and f != "id")]
        out = []
        for k, i in enumerate(items):
            if any(isinstance(x, Path) and x.parts[0] in hidden for x in walk(i.expr)):
                raise QueryError("the field may not be read")
            if isinstance(i.expr, Call) and i.expr.name in ("highlight", "snippet"):
                out.append(self.marked(scope, i, wanted, text_field))
            else:
                out.append(scope.col(i.expr).alias(name_of(i, k)))
        return out

    def marked(self, scope: Scope, item: Item, wanted: set[str], text_field: str | None) -> Column:
        e = item.expr
        if not wanted:
            raise QueryError(f"{e.name}() marks what a match found")
        if not e.args or not isinstance(e.args[0], Path) or e.args[0].text != text_field:
            raise QueryError(f"{e.name}() takes the field that is matched")
        column = scope.field(e.args[0]).as_kind("text")
        rest = [scope.value(a) for a in e.args[1:]]
        name = item.alias or e.name
        if e.name == "highlight":
            return (textfn.tagged_of(column, wanted, rest[0], rest[1]) if len(rest) == 2 else textfn.highlight_of(column, wanted)).alias(name)
        if not rest or not isinstance(rest[0], int) or rest[0] < 1:
            raise QueryError("snippet() takes a number of characters")
        return textfn.snippet_of(column, wanted, rest[0], rest[1] if len(rest) > 1 else "…", rest[2] if len(rest) > 3 else "", rest[3] if len(rest) > 3 else "").alias(name)

    def plain(self, scope: Scope, rows: DataFrame, s: Select) -> Answer:
        if s.count:
            counted = self.page(rows, s, scope) if s.limit is not None or s.offset is not None else rows
            return Answer(counted.agg(F.count(F.lit(1)).alias("count")))
        if s.order or s.limit is not None or s.offset is not None:
            rows = self.page(rows.orderBy(*self.order(scope, s.order, s.items)), s, scope)
        if s.lookup:
            return self.with_children(scope, rows, self.listed(scope, s.items), s)
        return Answer(rows.select(*self.listed(scope, s.items)))

    def groups(self, scope: Scope, rows: DataFrame, s: Select) -> Answer:
        if s.group is None and (s.limit is not None or s.order):
            # an aggregate without groups is over the page that order and limit pick
            rows = self.page(rows.orderBy(*self.order(scope, s.order, None)), s, scope)
            s = replace(s, order=[], limit=None, offset=None)
        out, order, typed, names = aggregate.grouped(scope, rows, s)
        if s.count:
            out = self.page(out, s, scope) if s.limit is not None or s.offset is not None else out
            return Answer(out.agg(F.count(F.lit(1)).alias("count")))
        if s.group is not None and (s.order or s.limit is not None or s.offset is not None):
            out = self.page(out.orderBy(*order), s, scope)
        elif s.group is not None and s.items is not None:
            out = out.orderBy(*order) if s.order else out
        out = out.select(*(typed[n].as_kind("text").alias(n) for n in names))
        if s.lookup:
            return self.off_groups(scope, out, s.lookup)
        return Answer(out)

    def ranked(self, scope: Scope, base: DataFrame, rows: DataFrame, s: Select) -> Answer:
        if s.count and s.match and not s.near:
            found = search.bm25(scope, base, rows.select("id") if s.where is not None else None, s.match, self.within(scope))
            return Answer(found.rows.agg(F.count(F.lit(1)).alias("count")))
        if s.limit is None:
            raise QueryError("a ranked read says its limit")
        page = scope.whole(s.limit, "limit") + (scope.whole(s.offset, "offset") if s.offset is not None else 0)
        if page > MOST_ROWS:
            raise QueryError(f"a ranked read answers {MOST_ROWS} rows at most")
        most = max(page, s.fuse.candidates if s.fuse else s.rerank.candidates if s.rerank else 0)
        matched = self.matched(scope, base, rows, s, most) if s.match else None
        whole = s.where is None and scope.collection.ttl is None and scope.collection.name not in self.policy.filters
        near = search.near(scope, rows, s.near, whole, most) if s.near else None
        found = matched or near
        if s.fuse:
            found = search.fused(matched, near, s.fuse, page)
        elif s.rerank:
            found = search.reranked(scope, rows, matched, s.rerank, page)
        best = self.page(search.top(found, page), s, scope)
        out = rows.join(F.broadcast(best), "id")  # a page of ids
        columns = self.listed(scope, s.items, found.terms, s.match.field.text if s.match else None)
        order = F.desc("_score") if found.best_first else F.asc("_score")
        return Answer(out.orderBy(order, "id").select(*columns, F.col("_score")))

    def matched(self, scope: Scope, base: DataFrame, rows: DataFrame, s: Select, most: int | None = None) -> search.Ranked:
        """most: only so many of the best are asked for."""
        narrow = s.where is not None or scope.collection.name in self.policy.filters or scope.collection.ttl is not None
        return search.bm25(scope, base, rows.select("id") if narrow else None, s.match, self.within(scope), most)

    def matches(self, s: Select) -> DataFrame:
        """id, _score of every row that a match finds, in no order and without a page."""
        check(s)
        scope = self.scope(s)
        base = self.rows(scope)
        return self.matched(scope, base, self.filtered(scope, base, s.where), s).rows

    def within(self, scope: Scope) -> bool:
        """Statistics of a scoped reader are over what it may read."""
        return scope.collection.name in self.policy.filters

    # lookups
    def required(self, scope: Scope, rows: DataFrame, look: Lookup) -> DataFrame:
        """Parents with a child, before any page."""
        child = self.scope(look.select)
        kids = self.filtered(child, self.rows(child), look.select.where)
        if look.select.lookup and look.select.lookup.required:
            kids = self.required(child, kids, look.select.lookup)
        if aggregated(look.select) and look.select.having is not None:
            folded = self.folded(child, kids, look)
            kids = folded.select(*(F.col(f"_c{k}") for k in range(len(look.child)))).distinct()
        else:
            kids = kids.select(*(child.col(Path((c,))).alias(f"_c{k}") for k, c in enumerate(look.child))).distinct()
        return rows.join(kids, self.tie(scope, look), "left_semi")

    def tie(self, scope: Scope, look: Lookup) -> Column:
        """Null keys match nothing."""
        out = None
        for k, p in enumerate(look.parent):
            one = scope.col(Path((p,))) == F.col(f"_c{k}")
            out = one if out is None else out & one
        return out

    def folded(self, child: Scope, kids: DataFrame, look: Lookup) -> DataFrame:
        """Children aggregated for each parent: _c0.. and the list's columns, with having, order and page inside each."""
        s = look.select
        keys = [Path((c,)) for c in look.child]
        grouped = replace(s, group=[*keys, *(s.group or [])], order=[], limit=None, offset=None, lookup=None, items=[*(Item(k, f"_c{j}") for j, k in enumerate(keys)), *(s.items or [])])
        out, _, typed, names = aggregate.grouped(child, kids, grouped)
        return out.select(*(typed[n].as_kind("text").alias(n) for n in names))

    def restricted(self, kids: DataFrame, child: Scope, look: Lookup, parents: DataFrame | None) -> DataFrame:
        """kids of the parents alone. parents: their keys, as _p0.., or None where all parents are asked."""
        if parents is None:
            return kids
        on = None
        for k, c in enumerate(look.child):
            one = child.col(Path((c,))) == F.col(f"_p{k}")
            on = one if on is None else on & one
        return kids.join(parents, on, "left_semi")

    @staticmethod
    def keys(rows: DataFrame, columns: list[Column]) -> DataFrame:
        return rows.select(*(c.alias(f"_p{k}") for k, c in enumerate(columns)))

    def children(self, look: Lookup, parents: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
        """_c0.., and a column named as the collection with each parent's children in order; names of levels below; columns of a child.

        parents: keys that the children are of; others are left out before they are ordered.
        """
        s = look.select
        child = self.scope(s)
        kids = self.restricted(self.filtered(child, self.rows(child), s.where), child, look, parents)
        n = len(look.child)
        cs = [f"_c{k}" for k in range(n)]
        levels: list[str] = []
        skip = child.whole(s.offset, "offset") if s.offset is not None else 0

        def paged(df: DataFrame) -> DataFrame:
            if skip:
                df = df.filter(F.col("_n") > skip)
            return df.filter(F.col("_n") <= skip + child.whole(s.limit, "limit")) if s.limit is not None else df

        if aggregated(s):
            kids = self.folded(child, kids, look)
            columns = [c for c in kids.columns if c not in cs]
            order = [F.col(o.expr.text).desc() if o.desc else F.col(o.expr.text).asc() for o in s.order if isinstance(o.expr, Path)]
            order += [F.col(f"`{name_of(Item(g))}`") for g in s.group or [] if isinstance(g, Path) and g.text in columns]
            order = order or [F.col(f"`{c}`") for c in columns]
            kids = paged(kids.withColumn("_n", F.row_number().over(Window.partitionBy(*cs).orderBy(*order))))
        else:
            if s.lookup and s.lookup.required:
                kids = self.required(child, kids, s.lookup)
            ranked = F.row_number().over(Window.partitionBy(*(child.col(Path((c,))) for c in look.child)).orderBy(*self.order(child, s.order, s.items)))
            kids = paged(kids.withColumn("_n", ranked))
            ties = [child.col(Path((c,))).alias(f"_c{k}") for k, c in enumerate(look.child)]
            listed = self.listed(child, s.items)
            if s.lookup:
                own = [child.col(Path((p,))) for p in s.lookup.parent]
                narrow = parents is not None or s.where is not None or s.limit is not None or skip or s.lookup.required
                below, deeper, _ = self.children(s.lookup, self.keys(kids, own) if narrow else None)
                below = below.toDF(*[c.replace("_c", "_d") if c.startswith("_c") else c for c in below.columns])
                on = None
                for k, p in enumerate(own):
                    one = p == F.col(f"_d{k}")
                    on = one if on is None else on & one
                kids = kids.join(below, on, "left")
                name = s.lookup.select.source
                listed = [*listed, F.coalesce(F.col(name), F.array()).alias(name)]
                levels = [name, *deeper]
            kids = kids.select("_n", *ties, *listed)
            columns = [c for c in kids.columns if c not in (*cs, "_n")]
        one = F.struct("_n", *(F.col(f"`{c}`") for c in columns))
        # a parent's page of children, or all of them, is one value of the answer
        listed_kids = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
        return kids.groupBy(*cs).agg(listed_kids.alias(s.source)), levels, columns

    def parents(self, scope: Scope, rows: DataFrame, s: Select) -> DataFrame | None:
        """The keys of a select's own rows, where these are not the whole collection; a page's are few enough to broadcast."""
        if s.where is None and s.limit is None and s.offset is None and not s.lookup.required and scope.collection.ttl is None and scope.collection.name not in self.policy.filters:
            return None
        keys = self.keys(rows, [scope.col(Path((p,))) for p in s.lookup.parent])
        return F.broadcast(keys) if s.limit is not None and scope.whole(s.limit, "limit") <= MOST_ROWS else keys

    def with_children(self, scope: Scope, rows: DataFrame, columns: list[Column], s: Select) -> Answer:
        look = s.lookup
        if aggregated(look.select) and look.select.group is None:
            return self.with_folded(scope, rows, columns, s)
        kids, levels, _ = self.children(look, self.parents(scope, rows, s))
        name = look.select.source
        out = rows.join(kids, self.tie(scope, look), "left")
        return Answer(out.select(*columns, F.coalesce(F.col(name), F.array()).alias(name)), nested=[name, *levels])

    def with_folded(self, scope: Scope, rows: DataFrame, columns: list[Column], s: Select) -> Answer:
        """One row of folds for each parent, childless ones too: a count is 0 there, other folds are null."""
        look = s.lookup
        child = self.scope(look.select)
        kids = self.restricted(self.filtered(child, self.rows(child), look.select.where), child, look, self.parents(scope, rows, s))
        kids = self.folded(child, kids, look)
        names = [c for c in kids.columns if not c.startswith("_c")]
        out = rows.join(kids, self.tie(scope, look), "left")
        counts = {name_of(i) for i in look.select.items or [] if getattr(i.expr, "name", "") in ("count", "approx_count_distinct")}
        one = F.struct(*((F.coalesce(F.col(f"`{n}`"), F.lit(0)) if n in counts else F.col(f"`{n}`")).alias(n) for n in names))
        return Answer(out.select(*columns, F.array(one).alias(look.select.source)), nested=[look.select.source])

    def off_groups(self, scope: Scope, groups: DataFrame, look: Lookup) -> Answer:
        """A lookup whose parents are groups: its keys are columns of the list."""
        kids, levels, _ = self.children(look, self.keys(groups, [F.col(f"`{p}`") for p in look.parent]))
        on = None
        for k, p in enumerate(look.parent):
            one = F.col(f"`{p}`") == F.col(f"_c{k}")
            on = one if on is None else on & one
        name = look.select.source
        out = groups.join(kids, on, "inner" if look.required else "left")
        return Answer(out.select(*(F.col(f"`{c}`") for c in groups.columns), F.coalesce(F.col(name), F.array()).alias(name)), nested=[name, *levels])

    # SQL joins
    @staticmethod
    def semi(s: Select, tables: dict[str, Scope], owner: Any, where: list) -> tuple[str, str, Binary, list] | None:
        """Where one table of an inner join is answered and the other is only a filter, each row counting once: (the
        answered table, the other, their tie, the filters of the other). A row counts once where the tie is the other's id,
        which no two rows share, or where the answer is distinct."""
        if len(s.joins) != 1 or s.joins[0].kind != "inner" or s.items is None:
            return None
        own = lambda e: {owner(x)[0] for x in walk(e) if isinstance(x, Path)}
        ties = conjuncts(s.joins[0].on) or [e for e in where if isinstance(e, Binary) and e.op == "=" and len(own(e)) == 2]
        aliases = {i.alias for i in s.items if i.alias}
        read = set().union(*(own(e) for e in (*(i.expr for i in s.items), *(s.group or []), *(o.expr for o in s.order if not (isinstance(o.expr, Path) and o.expr.text in aliases)), *([s.having] if s.having is not None else []))))
        if len(ties) != 1 or not (isinstance(ties[0], Binary) and ties[0].op == "=" and isinstance(ties[0].a, Path) and isinstance(ties[0].b, Path)) or len(read) != 1:
            return None
        kept = read.pop()
        other = next(t for t in tables if t != kept)
        key = next((owner(x)[1] for x in (ties[0].a, ties[0].b) if owner(x)[0] == other), None)
        if key is None or not (key in ("id", tables[other].collection.id) or s.distinct and not aggregated(s)):
            return None
        rest = [e for e in where if e != ties[0]]
        if any(len(own(e)) > 1 for e in rest):
            return None
        return kept, other, ties[0], [e for e in rest if own(e) == {other}]

    def joined(self, s: Select, inner: int) -> Answer:
        """Joins on keys, answered flat. Names that no table qualifies are the first table's."""
        tables: dict[str, Scope] = {s.alias or s.source: self.scope(s)}
        frames: dict[str, DataFrame] = {}
        for j in s.joins:
            if j.alias in tables:
                raise QueryError(f"two tables are named {j.alias}")
            tables[j.alias] = Scope(self.catalog, self.catalog.get(j.table), self.params, self.now, alias=j.alias)
        first = next(iter(tables))

        def owner(p: Path) -> tuple[str, str]:
            if len(p.parts) > 1 and p.parts[0] in tables:
                return p.parts[0], p.parts[1]
            return first, p.parts[0]

        for alias, sc in tables.items():
            df = self.rows(sc)
            frames[alias] = df.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in dict.fromkeys([*df.columns, "id"])))
        columns = {(a, c.split(".", 1)[1]): F.col(f"`{c}`") for a, df in frames.items() for c in df.columns}

        class Wide(Scope):
            def field(me, path: Path) -> Typed:  # noqa: N805
                a, name = owner(path)
                if path.text in me.names:
                    return me.names[path.text]
                if (a, name) not in columns:
                    raise QueryError(f"{tables[a].collection.name} has no field {name}")
                t = Scope.field(tables[a], Path((name,)))
                return replace(t, col=columns[a, name], path=(columns[a, name], "$") if t.kind == "json" else None)

        wide = Wide(self.catalog, tables[first].collection, self.params, self.now)
        where = conjuncts(s.where)
        out = frames[first]
        done = {first}
        for j in s.joins:
            done.add(j.alias)
            ons = conjuncts(j.on)
            if not ons:  # a comma: its key stands in the where
                ons = [e for e in where if isinstance(e, Binary) and e.op == "=" and isinstance(e.a, Path) and isinstance(e.b, Path) and {owner(e.a)[0], owner(e.b)[0]} <= done and j.alias in (owner(e.a)[0], owner(e.b)[0])]
                where = [e for e in where if e not in ons]
            keys = [e for e in ons if isinstance(e, Binary) and e.op == "=" and isinstance(e.a, Path) and isinstance(e.b, Path)]
            if not keys:
                raise QueryError("a join is on a key: an equality of two tables' columns")
            test = None
            for e in ons:
                one = wide.field(e.a).col == wide.field(e.b).col if e in keys else wide.test(e, bare=True)
                test = one if test is None else test & one
            out = out.join(frames[j.alias], test, j.kind)
        nulls = [e for e in where if isinstance(e, Unary) and e.op == "is null"]
        answered = {owner(x)[0] for i in s.items or [] for x in walk(i.expr) if isinstance(x, Path)}
        # a left join whose joined key is null is an anti join
        if len(s.joins) == 1 and s.joins[0].kind == "left" and answered == {first} and len(nulls) == 1 and owner(nulls[0].x)[0] == s.joins[0].alias:
            test = None
            for e in conjuncts(s.joins[0].on):
                one = wide.field(e.a).col == wide.field(e.b).col if isinstance(e, Binary) and e.op == "=" and isinstance(e.b, Path) else wide.test(e, bare=True)
                test = one if test is None else test & one
            out = frames[first].join(frames[s.joins[0].alias], test, "left_anti")
            where = [e for e in where if e not in nulls]
        elif (semi := self.semi(s, tables, owner, conjuncts(s.where))) is not None:
            kept, other, tie, filters = semi
            found = frames[other]
            for e in filters:
                found = found.filter(wide.test(self.scalars(e, inner), bare=True))
            out = frames[kept].join(found, wide.field(tie.a).col == wide.field(tie.b).col, "left_semi")
            where = [e for e in conjuncts(s.where) if e not in filters and e != tie]
        for e in where:
            out = out.filter(wide.test(self.scalars(e, inner), bare=True))
        ids = [F.col(f"`{a}.id`") for a in tables if f"{a}.id" in out.columns]
        rows = out.withColumn("id", F.struct(*ids) if len(ids) > 1 else ids[0])
        if s.distinct:
            s = replace(s, distinct=False, group=[i.expr for i in s.items or []])
        if aggregated(s):
            return self.groups(wide, rows, replace(s, joins=[]))
        if s.count:
            return Answer(rows.agg(F.count(F.lit(1)).alias("count")))
        if s.items is None:
            listed = [F.col(f"`{c}`").alias(c.split(".", 1)[1] if sum(x.split(".", 1)[1] == c.split(".", 1)[1] for x in out.columns) == 1 else c) for c in out.columns]
        else:
            listed = [wide.col(i.expr).alias(name_of(i)) for i in s.items]
        if s.order or s.limit is not None or s.offset is not None:
            rows = self.page(rows.orderBy(*self.order(wide, s.order, s.items)), s, wide)
        return Answer(rows.select(*listed))
