"""Writes over layered tables.

Each write adds a layer of what it put and of the ids that it replaced or deleted (storage.py). A block of writes ends
in one manifest, so that it lands whole or not at all, and outlives the session. Each write also gives change rows (seq,
op, id, doc), kept beside the layers for streams and restores.
"""

from __future__ import annotations

import datetime as dt
import json
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Duplicate, QueryError, TypeMismatch, Unmet
from ..plans.ast import Change, Explain, Item, Lit, ObjectOf, Path, Put, Schema, Select
from ..plans.check import MOST_VALUES
from ..plans.expr import Scope, moment, sparse_value
from ..plans.parser import parse
from ..sources.catalog import Catalog, Collection, spark_type
from . import text_index
from .read import Answer, Policy, Reader, explained
from .storage import MOST_LAYERS, Layers, Store

CHANGES = "seq bigint, at timestamp, collection string, op string, id bigint, doc string"


class Database:
    """Statements over collections that are kept under one folder. A folder that holds a database already gives its rows."""

    def __init__(self, catalog: Catalog, folder: str):
        self.catalog, self.folder = catalog, folder.rstrip("/")
        self.store = Store(catalog.spark, self.folder)
        self.layers: dict[str, Layers] = dict(self.store.now.collections)
        self.origins: dict[str, DataFrame] = {}  # of each collection, the rows under its layers where no path holds them
        self.marks: dict[str, int] = dict(self.store.now.marks)  # see Manifest
        self.staged: tuple | None = None
        self.pending: list[tuple[DataFrame, int]] = []  # change rows and their number
        for name, layers in self.layers.items():
            if name in catalog.collections:
                c = catalog.get(name)
                self.origins[name] = c.df
                catalog.collections[name] = c.with_rows(self.store.merged(layers, c.df, c.id))

    @property
    def spark(self):
        return self.catalog.spark

    # statements
    def run(self, text: str, *params: Any, now: dt.datetime | None = None, policy: Policy | None = None, key: str | None = None) -> Any:
        """The answer of the last statement; all of the text's writes land together. A key that was used answers as it did, in later sessions too."""
        if key is not None and key in self.store.now.keys:
            return Answer(self.spark.read.parquet(self.store.now.keys[key]))
        out = None
        with self.block(key) as kept:
            for s in parse(text):
                out = self.statement(s, params, now, policy)
            if key is not None and isinstance(out, Answer):
                kept.append(self.store.folder.fresh("answers"))
                out.df.write.parquet(kept[0])
                out = Answer(self.spark.read.parquet(kept[0]))
        return out

    def statement(self, s: Any, params: tuple = (), now: dt.datetime | None = None, policy: Policy | None = None) -> Any:
        reader = Reader(self.catalog, params, now, policy)
        if isinstance(s, Select):
            return reader.select(s)
        if isinstance(s, Explain):
            return explained(reader, s.statement)
        if isinstance(s, Put):
            return self.put(reader, s)
        if isinstance(s, Change):
            return self.change(reader, s)
        if isinstance(s, Schema):
            return self.schema(s)
        raise QueryError("no such statement")

    @contextmanager
    def block(self, key: str | None = None):
        """All writes inside land together; an error puts the collections back as they were."""
        if self.staged is not None:
            yield []
            return
        self.staged = dict(self.catalog.collections), dict(self.layers), dict(self.origins), dict(self.marks)
        self.pending = []
        kept: list[str] = []
        try:
            yield kept
            self.commit(key, kept)
        except Exception:
            self.catalog.collections, self.layers, self.origins, self.marks = self.staged
            raise
        finally:
            self.staged, self.pending = None, []

    def commit(self, key: str | None = None, kept: list[str] | None = None) -> None:
        now = self.store.now
        if not self.pending and self.layers == now.collections and self.marks == now.marks and not kept:
            return
        new = replace(now, collections=dict(self.layers), marks=dict(self.marks), keys=now.keys | ({key: kept[0]} if kept else {}))
        if self.pending:
            log = self.pending[0][0]
            for more, _ in self.pending[1:]:
                log = log.unionByName(more)
            last = now.seq + sum(n for _, n in self.pending)
            new = replace(new, seq=last, commits=(*now.commits, self.store.logged(log, now.n + 1, last)))
        self.store.swap(new)

    # storage
    def stored(self, c: Collection, df: DataFrame) -> Collection:
        """df, all rows of the collection, as its new base."""
        self.layers[c.name] = self.store.based(df, c.name)
        self.origins.pop(c.name, None)
        return self.merged(c)

    def merged(self, c: Collection) -> Collection:
        layers = self.layers[c.name]
        out = c.with_rows(self.store.merged(layers, self.origins.get(c.name, c.df), c.id))
        self.catalog.collections[c.name] = out
        return out

    def layered(self, c: Collection, gone: DataFrame, new: DataFrame) -> Collection:
        """The collection after a write: gone has the ids (`id`) that it replaced or deleted, new the rows that it wrote."""
        known = self.layers.get(c.name)
        if known is None:
            known, self.origins[c.name] = Layers(), c.df
        self.layers[c.name] = known = self.store.layered(known, gone, new, c.name)
        out = self.merged(c)
        if len(known.parts) > MOST_LAYERS:
            out = self.stored(out, out.df)
        if c.text_index:
            at, rows = known.parts[-1]
            gone, new = self.spark.read.parquet(at), _with_id(self.spark.read.schema(c.df.schema).parquet(rows), c)
            out = replace(out, text_index={f: text_index.updated(i, gone, new.select("id", f), f) for f, i in c.text_index.items()})
            self.catalog.collections[c.name] = out
        return out

    def changes(self, since: int = 0) -> DataFrame:
        return self.store.changes(CHANGES, since)

    def record(self, c: Collection, rows: DataFrame, op: str, now: dt.datetime) -> None:
        """rows: id and the fields as they are now; a write is one change for each row."""
        base = self.store.now.seq + sum(n for _, n in self.pending)
        rows, seq, n = self.numbered(rows, base)
        doc = F.to_json(F.struct(*(F.col(f"`{x}`") for x in rows.columns if x not in ("_at", "_part", "_before")))) if op == "put" else F.lit(None).cast("string")
        self.pending.append((rows.select(seq.cast("bigint").alias("seq"), F.lit(now).cast("timestamp").alias("at"), F.lit(c.name).alias("collection"), F.lit(op).alias("op"), F.col("id").cast("bigint").alias("id"), doc.alias("doc")), n))

    def numbered(self, rows: DataFrame, base: int) -> tuple[DataFrame, Column, int]:
        """rows in ranges of id, their numbers from base + 1 (places within a range, after the rows of the ranges before), and how many there are."""
        path = self.store.folder.fresh("staged")
        rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
        out = self.spark.read.parquet(path)
        part = F.shiftright("_at", 33)
        counts = out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
        numbered = out.join(F.broadcast(before), part == F.col("_part"))
        return numbered, F.lit(base + 1) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), out.count()

    # documents
    def coerced(self, c: Collection, field: str, v: Any) -> Any:
        """A value as the field's type takes it."""
        if v is None:
            return None
        kind, t = c.kind(field), c.df.schema[field].dataType
        try:
            if kind == "int":
                if isinstance(v, bool) or int(v) != v:
                    raise ValueError
                return int(v)
            if kind == "float":
                if isinstance(v, bool):
                    raise ValueError
                return float(v)
            if kind == "bool":
                if not isinstance(v, bool):
                    raise ValueError
                return v
            if kind == "timestamp":
                if isinstance(v, int):
                    return dt.datetime.fromtimestamp(v / 1000, dt.UTC).replace(tzinfo=None if isinstance(t, T.TimestampNTZType) else dt.UTC)
                at = v if isinstance(v, dt.datetime) else moment(v)
                if at is None:
                    raise ValueError
                return at if isinstance(t, T.TimestampNTZType) or at.tzinfo else at.replace(tzinfo=dt.UTC)
            if kind == "json":
                return json.dumps(v, sort_keys=True)
            if kind == "bytes":
                return v.encode() if isinstance(v, str) else bytes(v)
            if kind == "sparse":
                pairs = sorted(sparse_value(v).items())
                return [k for k, _ in pairs], [w for _, w in pairs]
            if kind == "geo" and (len(v) != 2 or not (-180 <= v[0] <= 180 and -90 <= v[1] <= 90)):
                raise ValueError
            if kind in ("vector", "geo"):
                return [float(x) for x in v]
            if kind == "text" and not isinstance(v, str):
                raise ValueError
            return v
        except (ValueError, TypeError):
            raise TypeMismatch(f"{field} takes {kind}, not {v!r}") from None

    def documents(self, scope: Scope, p: Put) -> list[dict]:
        found = p.documents
        if not isinstance(found, list):
            value = scope.value(found)
            found = value if isinstance(value, list) else [value]
        out = []
        for d in found:
            d = scope.value(d) if not isinstance(d, dict) else d
            if not isinstance(d, dict):
                raise TypeMismatch("a document is an object")
            for k in d:
                if not scope.collection.has(k):
                    raise QueryError(f"{scope.collection.name} has no field {k}")
            out.append(d)
        return out

    def put(self, reader: Reader, p: Put) -> Answer | DataFrame:
        """Documents of the statement meet the rows they collide with; the rest of the collection is only copied."""
        c = self.catalog.get(p.source)
        scope = Scope(self.catalog, c, reader.params, reader.now)
        docs = self.documents(scope, p)
        names = [f for f in c.df.columns if f != c.id]
        keys = [(c.id,), *c.unique]
        given = [{k: self.coerced(c, k, v) for k, v in d.items() if k not in ("id", c.id)} | {"id": d.get("id", d.get(c.id))} for d in docs]
        held = self.held(c, given, keys)
        by_key: dict[tuple, dict] = {}
        for row in held:
            for k in keys:
                if (value := _key(row, k, c)) is not None:
                    by_key[(k, value)] = row
        top = c.df.agg(F.max(c.id)).head()[0] if any(d["id"] is None for d in given) else None
        written: dict[int, dict] = {}
        order: list[int] = []
        for d in given:
            clash = [by_key[(k, v)] for k in keys if (v := _key(d, k, c)) is not None and (k, v) in by_key]
            if clash and p.if_absent:
                if p.otherwise:
                    row = clash[0]
                    row.update({f: self.coerced(c, f, _evaluated(e, row, d, scope)) for f, e in p.otherwise.items()})
                    written[row["id"]] = row
                    order.append(row["id"])
                continue
            other = [r for r in clash if d["id"] is None or r["id"] != d["id"]]
            if other or (clash and p.insert):
                raise Duplicate(f"{c.name} holds that key already")
            if d["id"] is None:
                top = (top or 0) + 1
                d = d | {"id": top}
            missing = [f for f in c.required if d.get(f) is None]
            if missing:
                raise TypeMismatch(f"{missing[0]} is required")
            row = {"id": d["id"], **{f: d.get(f) for f in names}}
            written[row["id"]] = row
            order.append(row["id"])
            for k in keys:
                if (value := _key(row, k, c)) is not None:
                    by_key[(k, value)] = row
        if p.require:
            self.require(scope, len(order), p.require)
        schema = T.StructType([T.StructField(c.id, c.df.schema[c.id].dataType), *(c.df.schema[f] for f in names)])
        new = self.spark.createDataFrame([tuple([r["id"], *(r.get(f) for f in names)]) for r in written.values()], schema).select(*c.df.columns)
        new = self.hooked("before", c, "put", new)
        if written:
            c = self.layered(c, _with_id(new, c).select("id"), new)
            self.record(c, _with_id(new, c), "put", reader.now)
        self.hooked("after", c, "put", new)
        return self.returned(reader, c, list(dict.fromkeys(order)), p.returning)

    def hooked(self, when: str, c: Collection, op: str, rows: DataFrame) -> DataFrame:
        """Runs the hooks of a write. One before it may give other rows to write (of a del: rows that it spares by leaving out), or refuse by raising."""
        for at, hook in self.catalog.hooks:
            if at == when and (given := hook(c, op, rows)) is not None and when == "before":
                rows = given
        return rows

    def held(self, c: Collection, docs: list[dict], keys: list[tuple[str, ...]]) -> list[dict]:
        """Rows that share a key with a document: as many as the documents have keys, at most."""
        test = F.lit(False)
        for k in keys:
            values = [v for d in docs if (v := _key(d, k, c)) is not None]
            if values:
                wanted = self.spark.createDataFrame(values, T.StructType([T.StructField(f"_k{j}", c.df.schema[f].dataType) for j, f in enumerate(k)])).distinct()
                on = None
                for j, f in enumerate(k):
                    one = F.col(f) == F.col(f"_k{j}")
                    on = one if on is None else on & one
                ids = c.df.join(F.broadcast(wanted), on, "left_semi").select(F.col(c.id)).collect()
                test = test | F.col(c.id).isin([r[0] for r in ids]) if ids else test
        return [{"id": r[c.id], **{f: r[f] for f in c.df.columns if f != c.id}} for r in c.df.filter(test).collect()]

    def change(self, reader: Reader, s: Change) -> Answer:
        """set and del; with order, limit, returning or require the rows are picked first, as a get would page to them."""
        c = self.catalog.get(s.source)
        scope = Scope(self.catalog, c, reader.params, reader.now)
        rows = reader.filtered(scope, reader.rows(scope), s.where)
        picked = None
        if s.order or s.limit is not None or s.returning or s.require:
            page = reader.page(rows.orderBy(*reader.order(scope, s.order, None)), Select(s.source, limit=s.limit), scope)
            picked = [r[0] for r in page.select("id").limit(MOST_VALUES + 1).collect()]
            if len(picked) > MOST_VALUES:
                raise QueryError(f"a write that picks its rows picks {MOST_VALUES} at most")
            if s.require:
                self.require(scope, len(picked), s.require)
            ids = self.spark.createDataFrame([(x,) for x in picked], f"_hit {c.df.schema[c.id].dataType.simpleString()}")
            rows = rows.join(F.broadcast(ids), F.col("id") == F.col("_hit"), "left_semi")
        fields = c.df.columns
        if s.values is None:
            # the rows as they were, written once: they are the ids of the layer, the change rows and the answer
            path = self.store.folder.fresh("staged")
            self.hooked("before", c, "del", rows.select(*dict.fromkeys(["id", *fields]))).write.parquet(path)
            old = self.spark.read.parquet(path)
            self.layered(c, old.select("id"), c.df.filter("false"))
            self.record(c, old, "del", reader.now)
            self.hooked("after", c, "del", old)
            if not s.returning:
                return Answer(old.agg(F.count(F.lit(1)).alias("count")))
            places = self.spark.createDataFrame([(x, k) for k, x in enumerate(picked)], "_of bigint, _place int")
            old = old.join(F.broadcast(places), F.col("id") == F.col("_of")).orderBy("_place")
            return Answer(old.select(*reader.listed(scope, _star(s.returning))))
        values: dict[str, Column] = {}
        for f, e in s.values.items():
            name = f.split(".")[0]
            if not c.has(name) or name in ("id", c.id):
                raise QueryError(f"{c.name} has no field {f} to set")
            kind = c.df.schema[name].dataType
            if "." in f:
                values[name] = _path_set(values.get(name, F.col(name)), f.split(".")[1:], scope.value(e))
            elif isinstance(e, ObjectOf) or (c.kind(name) in ("json", "geo", "vector", "sparse", "timestamp") and isinstance(e, Lit)):
                values[name] = F.lit(self.coerced(c, name, scope.value(e))).cast(kind)
            else:
                values[name] = scope.col(e).cast(kind)
        path = self.store.folder.fresh("staged")
        self.hooked("before", c, "set", rows.select(*((values[x].alias(x) if x in values else F.col(x)) for x in fields))).write.parquet(path)
        new = self.spark.read.schema(c.df.schema).parquet(path)
        c = self.layered(c, _with_id(new, c).select("id"), new)
        if any(set(k) & set(values) for k in c.unique):
            self.unique(c, c.df)
        self.record(c, _with_id(new, c), "put", reader.now)
        self.hooked("after", c, "set", new)
        if s.returning:
            return self.returned(reader, c, picked, s.returning)
        return Answer(new.agg(F.count(F.lit(1)).alias("count")))

    def unique(self, c: Collection, df: DataFrame) -> None:
        for k in c.unique:
            some = None
            for f in k:
                some = F.col(f).isNotNull() if some is None else some & F.col(f).isNotNull()
            if not df.filter(some).groupBy(*k).count().filter("count > 1").isEmpty():
                raise Duplicate(f"{c.name} would hold {', '.join(k)} twice")

    def require(self, scope: Scope, n: int, require: tuple[Any, Any]) -> None:
        wanted, reason = scope.whole(require[0], "require"), require[1]
        if n != wanted:
            raise Unmet(scope.value(reason) if reason is not None else f"{wanted} rows are required, {n} found")

    def returned(self, reader: Reader, c: Collection, ids: list[int], returning: list[Item] | None) -> Answer:
        scope = Scope(self.catalog, c, reader.params, reader.now)
        if returning is None:
            return Answer(self.spark.createDataFrame([(len(ids),)], "count bigint"))
        places = self.spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "_of bigint, _place int")
        rows = _with_id(c.df, c).join(F.broadcast(places), F.col("id") == F.col("_of")).orderBy("_place")
        return Answer(rows.select(*reader.listed(scope, _star(returning))))

    # schemas
    def schema(self, s: Schema) -> Any:
        known = self.catalog.collections
        if s.op == "collections":
            return sorted(known)
        if s.op == "describe":
            return describe(self.catalog.get(s.name))
        if s.op == "compact":
            for name in [s.name] if s.name else list(known):
                c = self.catalog.get(name)
                indexes = {f: text_index.compacted(self.spark, i) for f, i in c.text_index.items()}
                c = self.stored(c, c.df.repartitionByRange(c.id).sortWithinPartitions(c.id))
                known[name] = replace(c, text_index=indexes)
            return None
        if s.op == "create":
            if s.name in known:
                if s.lenient:
                    return None
                raise QueryError(f"{s.name} is a collection already")
            fields = [f for f in s.fields]
            ddl = ", ".join(["id bigint", *(f"`{f['name']}` {spark_type(f['type'])}" for f in fields)])
            c = Collection(s.name, self.spark.createDataFrame([], ddl))
            for f in fields:
                c = declared(c, f)
            for kind, parts in s.args.get("keys", []):
                if kind == "unique":
                    c = replace(c, unique=(*c.unique, tuple(p for p, _ in parts)))
            known[s.name] = c
            return None
        if s.op == "drop":
            if s.name not in known and not s.lenient:
                raise QueryError(f"no collection {s.name}")
            known.pop(s.name, None)
            self.layers.pop(s.name, None)
            return None
        if s.op.endswith("index"):
            c = self.catalog.get(s.name)
            names = tuple(f for f, _ in s.fields)
            for kind, _ in s.args.get("indexes", []):
                if kind == "unique":
                    if s.op.startswith("create"):
                        c = replace(c, unique=(*c.unique, names))
                        self.unique(c, c.df)
                else:
                    c = replace(c, hints=c.hints | {kind: [*c.hints.get(kind, []), ",".join(names)]})
            if s.op.startswith("drop"):
                c = replace(c, unique=tuple(u for u in c.unique if u != names))
            known[s.name] = c
            return None
        c, a = self.catalog.get(s.name), s.args
        if "add" in a:
            f = a["add"]
            known[s.name] = declared(self.reshaped(c, c.df.withColumn(f["name"], F.lit(None).cast(spark_type(f["type"])))), f)
        elif "drop" in a:
            known[s.name] = self.reshaped(c, c.df.drop(a["drop"]))
        elif "rename" in a:
            known[s.name] = self.reshaped(c, c.df.withColumnRenamed(*a["rename"]))
        else:
            known[s.name] = declared(c, a["alter"])
        return None

    def reshaped(self, c: Collection, df: DataFrame) -> Collection:
        """The collection with other columns; rows that are kept here are written anew."""
        return self.stored(c, df) if c.name in self.layers else c.with_rows(df)

    def collect_garbage(self) -> int:
        """Deletes layers, staged rows and answers that the latest manifest does not name. No statement may be running."""
        return self.store.collected([*self.layers, *(n for n in self.catalog.collections if n not in self.layers), "staged"])

    # moments
    def restore(self, snapshot: DataFrame, name: str, to: dt.datetime | int, since: int = 0) -> DataFrame:
        """A snapshot (id and fields) and the changes after it (after number since), as of a time or a sequence number."""
        log = self.changes(since).filter(F.col("collection") == name)
        log = log.filter(F.col("seq") <= to) if isinstance(to, int) else log.filter(F.col("at") <= F.lit(to))
        last = log.groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.max_by("doc", "seq").alias("doc")).withColumnRenamed("id", "_id")
        rest = snapshot.join(last, F.col("id") == F.col("_id"), "left_anti")
        now = last.filter("op = 'put'").select(F.from_json("doc", snapshot.schema).alias("d")).select("d.*")
        return rest.unionByName(now)


def _with_id(df: DataFrame, c: Collection) -> DataFrame:
    return df if c.id == "id" else df.withColumn("id", F.col(c.id))


def _star(items: list[Item]) -> list[Item] | None:
    return None if len(items) == 1 and items[0].expr == Path(("*",)) else items


def _key(row: dict, fields: tuple[str, ...], c: Collection) -> tuple | None:
    values = tuple(row.get("id" if f == c.id else f) for f in fields)
    values = tuple(v.casefold() if isinstance(v, str) and f in c.nocase else v for v, f in zip(values, fields, strict=True))
    return None if any(v is None for v in values) else values


def _evaluated(e: Any, row: dict, new: dict, scope: Scope) -> Any:
    """An `else set` expression over the row that is held and the document: n + new.n."""
    from ..plans.ast import Binary, Call, Param

    if isinstance(e, Lit | Param | ObjectOf):
        return scope.value(e)
    if isinstance(e, Path):
        if e.parts[0] in ("new", "excluded") and len(e.parts) == 2:
            return new.get(e.parts[1])
        return row.get(e.parts[-1])
    if isinstance(e, Binary) and e.op in "+-*/":
        a, b = _evaluated(e.a, row, new, scope), _evaluated(e.b, row, new, scope)
        if a is None or b is None:
            return None
        if e.op == "/":
            if isinstance(a, int) and isinstance(b, int):
                return int(a / b) if abs(a) < 2**53 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return a / b
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[e.op]()
    if isinstance(e, Call) and e.name in ("greatest", "least", "coalesce"):
        values = [v for x in e.args if (v := _evaluated(x, row, new, scope)) is not None]
        return None if not values else values[0] if e.name == "coalesce" else (max if e.name == "greatest" else min)(values)
    if isinstance(e, Call) and e.name == "now":
        return scope.now
    raise QueryError("`else set` takes arithmetic over the row and new")


def _path_set(column: Column, parts: list[str], value: Any) -> Column:
    """A json text with one path set."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            doc = json.loads(t) if t else {}
            at = doc
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = value
            return json.dumps(doc, sort_keys=True)

        return s.map(one)

    return run(column)


def declared(c: Collection, f: dict) -> Collection:
    """The collection with a field's declarations taken in."""
    name, kind = f["name"], f.get("type", "")
    if kind == "json":
        c = replace(c, json=c.json | {name})
    if kind == "geo":
        c = replace(c, geo=c.geo | {name})
    if f.get("nocase"):
        c = replace(c, nocase=c.nocase | {name})
    if f.get("collate"):
        c = replace(c, collate=c.collate | {name: f["collate"]})
    if f.get("required"):
        c = replace(c, required=c.required | {name})
    for index, args in f.get("indexes", []):
        if index == "unique":
            c = replace(c, unique=(*c.unique, (name,)))
        elif index == "ttl":
            from ..functions.timefn import step_ms

            c = replace(c, ttl=(name, step_ms(args[0].n, args[0].unit)))
        elif index == "hnsw":
            c = replace(c, metric=c.metric | {name: args[0] if args and isinstance(args[0], str) else "cosine"})
        elif index == "text":
            options = {k: (float(v) if "." in v else int(v)) for k, v in (a for a in args if isinstance(a, tuple))} | {a: True for a in args if isinstance(a, str)}
            c = replace(c, text=c.text | {name: options})
        c = replace(c, hints=c.hints | {index: [*c.hints.get(index, []), name]})
    return c


def describe(c: Collection) -> str:
    """The collection as the statement that declares it."""
    parts = []
    for f in c.fields:
        if f == c.id:
            continue
        marks = [w for w, on in (("required", f in c.required), (f"collate {c.collate.get(f)}", f in c.collate), ("nocase", f in c.nocase), ("@unique", (f,) in c.unique)) if on]
        marks += [f"@{k}" for k, fields in c.hints.items() if f in fields and k != "unique"]
        parts.append(" ".join([f, c.kind(f), *marks]))
    parts += [f"@unique({', '.join(u)})" for u in c.unique if len(u) > 1]
    return f"create collection {c.name} ({', '.join(parts)})"


