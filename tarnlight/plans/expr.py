"""Expressions to Columns.

Predicates are two-valued: null equals null, an ordering against null is false, `not` is exact. A predicate that is a
plain conjunct of a filter keeps Spark's bare comparison, so that it reaches the scan; under `not` and `or` it is made total.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, TypeMismatch
from ..functions import geo, text, timefn, vectors
from ..sources.catalog import Catalog, Collection, kind_of
from .ast import Agg, Binary, Call, Case, InList, Interval, ListOf, Lit, ObjectOf, Param, Path, Unary


#: Values of a list up to which it is an expression, which the scan is handed; longer ones are joined.
MANY_VALUES = 1000


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    nocase: bool = False
    collate: str | None = None
    nan: bool = False
    ntz: bool = False
    literal: bool = False
    path: tuple[Column, str] | None = None  # of a json value: its text column and path

    def as_kind(self, kind: str) -> Column:
        """A json value read as a kind."""
        if self.kind != "json" or self.path is None:
            return self.col
        column, path = self.path
        read = F.get_json_object(column, path)
        return {"int": read.try_cast("bigint"), "float": read.try_cast("double"), "bool": read.try_cast("boolean")}.get(kind, read)


def moment(value: str) -> dt.datetime | None:
    """A time written as text, in UTC; None where it is none."""
    try:
        t = dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t


def literal(value: Any) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise TypeMismatch(f"{value} is beyond an int")
        return Typed(F.lit(value).cast("bigint"), "int")
    if isinstance(value, float):
        return Typed(F.lit(value), "float", nan=value != value)
    if isinstance(value, str):
        return Typed(F.lit(value), "text")
    if isinstance(value, bytes):
        return Typed(F.lit(value), "bytes")
    if isinstance(value, dt.datetime):
        return Typed(F.lit(value), "timestamp")
    if isinstance(value, list | tuple):
        if all(isinstance(x, int | float) and not isinstance(x, bool) for x in value):
            return Typed(F.array(*(F.lit(float(x)) for x in value)), "vector")
        return Typed(F.array(*(literal(x).col for x in value)), "list")
    raise TypeMismatch(f"no literal of {type(value).__name__}")


class Scope:
    """What names mean while one collection's rows are read."""

    def __init__(self, catalog: Catalog, collection: Collection, params: tuple, now: dt.datetime, names: dict[str, Typed] | None = None, alias: str | None = None):
        self.catalog, self.collection, self.params, self.now = catalog, collection, params, now
        self.names = names or {}
        self.alias = alias
        self.aggregate: Any = None  # Agg -> Typed, while groups are read

    # values
    def value(self, e: Any) -> Any:
        """A literal or parameter as a Python value."""
        if isinstance(e, Param):
            if not 1 <= e.n <= len(self.params):
                raise QueryError(f"no parameter ${e.n}")
            return self.params[e.n - 1]
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, ListOf):
            return [self.value(x) for x in e.items]
        if isinstance(e, ObjectOf):
            return {k: self.value(v) for k, v in e.items}
        if isinstance(e, Unary) and e.op == "-":
            return -self.value(e.x)
        if isinstance(e, int | float | str | list | dict):
            return e
        raise QueryError("a literal or a parameter is asked for")

    def whole(self, e: Any, what: str) -> int:
        v = self.value(e)
        if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or v < 0:
            raise QueryError(f"{what} is a whole number of 0 or more, not {v!r}")
        return int(v)

    def field(self, path: Path) -> Typed:
        parts = path.parts
        if path.text in self.names:
            return self.names[path.text]
        c = self.collection
        if len(parts) > 1 and parts[0] in (self.alias, c.name) and not c.has(parts[0]):
            parts = parts[1:]
        name = parts[0]
        if name in self.names and len(parts) == 1:
            return self.names[name]
        if not c.has(name):
            raise QueryError(f"{c.name} has no field {name}" + (", its id is `id`" if name in ("rowid", "_id") else ""))
        column = F.col(f"`{name}`")
        real = c.id if name == "id" else name
        kind = c.kind(real)
        if len(parts) > 1:
            if kind == "struct":
                t = c.df.schema[real].dataType
                for p in parts[1:]:
                    if not isinstance(t, T.StructType) or p not in t.fieldNames():
                        raise QueryError(f"{path.text} leads nowhere")
                    t, column = t[p].dataType, column[p]
                return Typed(column, kind_of(t))
            if kind != "json":
                raise QueryError(f"{name} holds no paths")
            inner = "$." + ".".join(parts[1:])
            return Typed(F.get_json_object(column, inner), "json", path=(column, inner))
        ntz = isinstance(c.df.schema[real].dataType, T.TimestampNTZType)
        nan = kind == "float" and real in c.may_hold_nan
        return Typed(column, kind, real in c.nocase, c.collate.get(real), nan, ntz, (column, "$") if kind == "json" else None)

    def typed(self, e: Any) -> Typed:
        if isinstance(e, Lit | Param):
            return replace(literal(self.value(e)), literal=True)
        if isinstance(e, Path):
            return self.field(e)
        if isinstance(e, ListOf):
            return literal(self.value(e))
        if isinstance(e, Agg):
            if self.aggregate is None:
                raise QueryError(f"{e.name}() stands in a select list or a having")
            return self.aggregate(e)
        if isinstance(e, Unary) and e.op == "-":
            x = self.typed(e.x)
            return Typed(-self.number(x), x.kind if x.kind in ("int", "float") else "float")
        if isinstance(e, Binary) and e.op in ("+", "-", "*", "/"):
            return self.arithmetic(e)
        if isinstance(e, Case):
            return self.case(e)
        if isinstance(e, Call) and e.name not in ("like", "ilike", "within"):
            return self.call(e)
        if isinstance(e, Unary | Binary | InList) or isinstance(e, Call):
            return Typed(self.test(e), "bool")
        raise QueryError(f"no value: {e!r}")

    def col(self, e: Any) -> Column:
        t = self.typed(e)
        return t.as_kind("text")

    @staticmethod
    def number(t: Typed) -> Column:
        if t.kind == "json":
            return t.as_kind("float")
        if t.kind in ("int", "float", "null", "bool"):
            return t.col
        raise TypeMismatch(f"a number is asked for, not {t.kind}")

    def arithmetic(self, e: Binary) -> Typed:
        a, b = self.typed(e.a), self.typed(e.b)
        if e.op == "+" and "text" in (a.kind, b.kind):
            if not {a.kind, b.kind} <= {"text", "null", "json"}:
                raise TypeMismatch("`+` joins two texts")
            return Typed(F.concat(a.as_kind("text"), b.as_kind("text")), "text")
        if "timestamp" in (a.kind, b.kind) and e.op in "+-":
            ms = lambda t: F.unix_millis(t.col.cast("timestamp"))
            if a.kind == b.kind:
                if e.op == "+":
                    raise TypeMismatch("two times have no sum")
                return Typed(ms(a) - ms(b), "int")
            if a.kind == "timestamp":
                shift = self.number(b).cast("bigint")
                out = F.timestamp_millis(ms(a) + (shift if e.op == "+" else -shift))
            elif e.op == "+":
                out = F.timestamp_millis(ms(b) + self.number(a).cast("bigint"))
            else:
                raise TypeMismatch("a number less a time is nothing")
            ntz = (a if a.kind == "timestamp" else b).ntz
            return Typed(out.cast("timestamp_ntz") if ntz else out, "timestamp", ntz=ntz)
        x, y = self.number(a), self.number(b)
        whole = a.kind in ("int", "null") and b.kind in ("int", "null")
        if e.op == "/" and whole:
            return Typed(_div(x.cast("bigint"), y.cast("bigint")), "int")
        x, y = (x.cast("bigint"), y.cast("bigint")) if whole else (x.cast("double"), y.cast("double"))
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[e.op]()
        return Typed(out, "int" if whole else "float")

    def case(self, e: Case) -> Typed:
        values = [self.typed(v) for _, v in e.whens] + [self.typed(e.otherwise)]
        kind = self.common(values)
        out = None
        for (w, _), v in zip(e.whens, values, strict=False):
            test = self.test(w)
            out = F.when(test, v.as_kind(kind)) if out is None else out.when(test, v.as_kind(kind))
        return Typed(out.otherwise(values[-1].as_kind(kind)), kind)

    @staticmethod
    def common(values: list[Typed]) -> str:
        kinds = {v.kind for v in values} - {"null"}
        if kinds <= {"int", "float", "json"} and kinds & {"int", "float"}:
            return "float" if kinds != {"int"} else "int"
        if "json" in kinds and len(kinds) == 2:
            return next(iter(kinds - {"json"}))
        if len(kinds) > 1:
            raise TypeMismatch(f"values of {', '.join(sorted(kinds))} don't go together")
        return next(iter(kinds), "null")

    # calls
    def call(self, e: Call) -> Typed:
        name, args = e.name.lower(), e.args
        if (own := self.catalog.function(e.name, len(args))) is not None:
            return Typed(own(*(self.col(a) for a in args)), "any")
        arity = {"now": (0, 0), "lower": (1, 1), "upper": (1, 1), "len": (1, 1), "timestamp": (1, 1), "norm": (1, 1), "normalize": (1, 1), "hll_estimate": (1, 1), "cosine": (2, 2), "l2": (2, 2), "dot": (2, 2), "distance": (2, 2), "bucket": (2, 3)}
        if name in arity and not arity[name][0] <= len(args) <= arity[name][1]:
            raise QueryError(f"{name}() takes {arity[name][0]} arguments")
        if name == "now":
            return Typed(F.lit(self.now), "timestamp", ntz=True)
        if name in ("lower", "upper"):
            t = self.typed(args[0])
            f = F.lower if name == "lower" else F.upper
            return Typed(f(t.as_kind("text")), "text") if t.kind in ("text", "json") else t
        if name == "len":
            t = self.typed(args[0])
            size = F.length(t.as_kind("text")) if t.kind in ("text", "json", "bytes") else F.size(t.col) if t.kind in ("list", "vector", "geo") else F.lit(0)
            return Typed(F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")), "int")
        if name in ("coalesce", "greatest", "least"):
            values = [self.typed(a) for a in args]
            if not values:
                raise QueryError(f"{name}() takes arguments")
            kind = self.common(values)
            columns = [v.as_kind(kind) for v in values]
            f = {"coalesce": F.coalesce, "greatest": F.greatest, "least": F.least}[name]
            return Typed(columns[0] if len(columns) == 1 else f(*columns), kind)
        if name in ("cosine", "l2", "dot"):
            a, b = self.typed(args[0]), self.typed(args[1])
            if "sparse" in (a.kind, b.kind) and name == "dot":
                field, other = (a, args[1]) if a.kind == "sparse" else (b, args[0])
                return Typed(vectors.sparse_dot(field.col, sparse_value(self.value(other))), "float")
            return Typed(vectors.SCORES[name](a.col, b.col), "float")
        if name == "cosine_distance":
            return Typed(1 - vectors.cosine(self.col(args[0]), self.col(args[1])), "float")
        if name == "negative_dot":
            return Typed(-vectors.dot(self.col(args[0]), self.col(args[1])), "float")
        if name == "norm":
            return Typed(vectors.norm(self.col(args[0])), "float")
        if name == "normalize":
            return Typed(vectors.normalize(self.col(args[0])), "vector")
        if name == "timestamp":
            t = self.typed(args[0])
            if t.kind == "int":
                return Typed(F.timestamp_millis(t.col), "timestamp")
            return t if t.kind == "timestamp" else Typed(t.as_kind("text").try_cast("timestamp"), "timestamp")
        if name == "bucket":
            t = self.typed(args[0])
            if not isinstance(args[1], Interval):
                raise QueryError("bucket() takes a duration, as in 15m")
            n, unit = args[1].n, args[1].unit
            if n <= 0 or unit not in (*timefn.STEPS, "mo", "y"):
                raise QueryError(f"no duration {n}{unit}")
            zone = self.value(args[2]) if len(args) == 3 else None
            if t.kind == "int":
                ms = t.col.cast("bigint")
                return Typed(timefn.zoned_ms(ms, n, unit, zone) if zone else timefn.bucket_ms(ms, n, unit), "int")
            if t.kind != "timestamp":
                raise TypeMismatch("bucket() takes a time or epoch milliseconds")
            return Typed(timefn.bucket(t.col, n, unit, zone, t.ntz), "timestamp", ntz=t.ntz)
        if name == "distance":
            p, q = (self.point(a) for a in args)
            return Typed(geo.distance(p, q), "float")
        if name == "hll_estimate":
            return Typed(F.hll_sketch_estimate(self.col(args[0])), "int")
        raise QueryError(f"no function {e.name}()")

    def point(self, e: Any) -> Column:
        """A geo value: a field, or a literal that is checked."""
        if isinstance(e, Path):
            return self.field(e).col
        v = self.value(e)
        if v is None:
            return F.lit(None).cast("array<double>")
        if not isinstance(v, list | tuple) or len(v) != 2 or not (-180 <= v[0] <= 180 and -90 <= v[1] <= 90):
            raise TypeMismatch("a point is [longitude, latitude] in degrees")
        return F.array(F.lit(float(v[0])), F.lit(float(v[1])))

    # tests
    def many(self, e: InList) -> tuple[Column, list, pa.DataType] | None:
        """What is looked up in a list of more than MANY_VALUES, the list, and its type; None of shorter lists, and of those that are compared value by value."""
        v = self.value(e.items[0]) if len(e.items) == 1 and isinstance(e.items[0], Param) else None
        if v is None and len(e.items) > MANY_VALUES and all(isinstance(i, Lit | Param) for i in e.items):
            v = [self.value(i) for i in e.items]
        if not isinstance(v, list | tuple) or len(v) <= MANY_VALUES:
            return None
        x = self.typed(e.x)
        of, kind = {"int": (int, pa.int64()), "text": (str, pa.string())}.get(x.kind, (None, None))
        if x.nocase or set(map(type, v)) != {of}:
            return None
        if of is int and not -(2**63) <= min(v) <= max(v) < 2**63:
            raise TypeMismatch("a value is beyond an int")
        return x.col, list(v), kind

    def test(self, e: Any, bare: bool = False) -> Column:
        """A boolean that's never null; bare: where null counts as false anyway, Spark's own form may stand."""
        if isinstance(e, Binary) and e.op == "and":
            return self.test(e.a, bare) & self.test(e.b, bare)
        if isinstance(e, Binary) and e.op == "or":
            return self.test(e.a, bare) | self.test(e.b, bare)
        if isinstance(e, Unary) and e.op == "not":
            return ~self.test(e.x)
        if isinstance(e, Unary) and e.op == "is null":
            return self.typed(e.x).col.isNull()
        if isinstance(e, InList):
            items = e.items
            if len(items) == 1 and isinstance(items[0], Param):
                v = self.value(items[0])
                items = tuple(Lit(x) for x in v) if isinstance(v, list | tuple) else items
            values = [self.value(i) if isinstance(i, Lit | Param) else None for i in items]
            x = self.typed(e.x)
            plain = x.kind in ("int", "text", "bool") and not x.nocase and all(isinstance(i, Lit | Param) for i in items)
            if plain and values and all(v is not None and literal(v).kind == x.kind for v in values):
                out = x.col.isin(*values)
                return out if bare else F.coalesce(out, F.lit(False))
            out = F.lit(False)
            for i in items:
                out = out | self.compare("=", x, self.typed(i), False)
            return out
        if isinstance(e, Binary) and e.op in ("=", "!=", "<", "<=", ">", ">="):
            near = self.near_point(e)
            return near if near is not None else self.compare(e.op, self.typed(e.a), self.typed(e.b), bare)
        if isinstance(e, Binary) and e.op == "~":
            a, b = self.typed(e.a), self.typed(e.b)
            if a.kind not in ("text", "json") or b.kind not in ("text", "json"):
                return F.lit(False)
            fold = text.casefold if a.nocase else F.lower
            out = fold(a.as_kind("text")).contains(fold(b.as_kind("text")))
            return out if bare else F.coalesce(out, F.lit(False))
        if isinstance(e, Binary) and e.op == "has":
            a, b = self.typed(e.a), self.typed(e.b)
            if a.kind not in ("list", "vector", "null"):
                return F.lit(False)
            if b.kind == "null":
                return F.coalesce(F.exists(a.col, lambda x: x.isNull()), F.lit(False))
            return F.coalesce(F.exists(a.col, lambda x: x.eqNullSafe(b.col)), F.lit(False))
        if isinstance(e, Call) and e.name in ("like", "ilike"):
            out = self.like(e)
            return out if bare else F.coalesce(out, F.lit(False))
        if isinstance(e, Call) and e.name == "within":
            if len(e.args) != 2:
                raise QueryError("within() takes a point and a box")
            box = self.value(e.args[1])
            if not isinstance(box, list | tuple) or len(box) != 4 or not (all(-180 <= x <= 180 for x in (box[0], box[2])) and -90 <= box[1] <= box[3] <= 90):
                raise TypeMismatch("within() needs four degrees: the west, south, east and north edges")
            return geo.within(self.point(e.args[0]), tuple(box))
        if isinstance(e, Lit):
            return F.lit(bool(e.value) and e.value == e.value)
        return self.truth(self.typed(e))

    @staticmethod
    def truth(t: Typed) -> Column:
        if t.kind == "bool":
            return F.coalesce(t.col, F.lit(False))
        if t.kind in ("int", "float"):
            return F.coalesce(t.col != 0, F.lit(False))
        if t.kind in ("text", "bytes", "json"):
            return F.coalesce(F.length(t.col) > 0, F.lit(False))
        if t.kind in ("list", "vector", "geo"):
            return F.coalesce(F.size(t.col) > 0, F.lit(False))
        return t.col.isNotNull() if t.kind != "null" else F.lit(False)

    def near_point(self, e: Binary) -> Column | None:
        """distance(field, point) <= metres: a box first, which prunes, then the exact test."""
        if e.op not in ("<", "<=") or not (isinstance(e.a, Call) and e.a.name == "distance" and isinstance(e.b, Lit | Param)):
            return None
        fields = [a for a in e.a.args if isinstance(a, Path)]
        points = [a for a in e.a.args if not isinstance(a, Path)]
        if len(fields) != 1 or len(points) != 1:
            return None
        metres = self.value(e.b)
        d = self.typed(e.a).col
        exact = F.coalesce(d < metres if e.op == "<" else d <= metres, F.lit(False))
        box = geo.box_around(tuple(self.value(points[0])), float(metres)) if metres >= 0 else None
        return exact if box is None else geo.within(self.field(fields[0]).col, box) & exact

    def like(self, e: Call) -> Column:
        a = self.typed(e.args[0])
        pattern = self.value(e.args[1])
        escape = self.value(e.args[2]) if len(e.args) == 3 else None
        if pattern is None:
            return F.lit(None).cast("boolean")
        if a.kind not in ("text", "json"):
            return F.lit(False)
        if escape is not None and len(escape) != 1:
            raise QueryError("an escape is one character")
        rx, k = [], 0
        while k < len(pattern):
            c = pattern[k]
            if escape and c == escape:
                k += 1
                if k == len(pattern):
                    raise QueryError("the pattern ends in its escape")
                rx.append(("text", pattern[k]))
            else:
                rx.append(("any", "") if c == "%" else ("one", "") if c == "_" else ("text", c))
            k += 1
        # Spark's own LIKE, with an escape that the pattern doesn't hold
        free = next(c for c in "\x01\x02\x03\x04" if c not in pattern)
        spark = "".join("%" if kind == "any" else "_" if kind == "one" else free + c if c in "%_" else c for kind, c in rx)
        column = a.as_kind("text")
        if e.name == "ilike" or a.nocase:
            column, spark = text.casefold(column), spark.casefold()
        return F.like(column, F.lit(spark), F.lit(free))

    def compare(self, op: str, a: Typed, b: Typed, bare: bool) -> Column:
        if "null" in (a.kind, b.kind):
            if op in ("=", "!="):
                other = b if a.kind == "null" else a
                out = other.col.isNull() if other.kind != "null" else F.lit(True)
                return out if op == "=" else ~out
            return F.lit(False)
        a, b = self.aligned(a, b)
        if a is None:  # kinds that have no common order: only their rank decides
            return b if bare else F.coalesce(b, F.lit(False))
        x, y = a.as_kind(b.kind), b.as_kind(a.kind)
        if a.nocase or b.nocase:
            x, y = text.casefold(x), text.casefold(y)
        nan = None
        for t, v in ((a, x), (b, y)):
            if t.nan:
                nan = F.isnan(v) if nan is None else nan | F.isnan(v)
        if op in ("=", "!="):
            # two fields, or a literal under `not`: null equals null
            out = x == y if bare and op == "=" and nan is None and self.constant(a, b) else x.eqNullSafe(y)
            if nan is not None:
                out = out | (F.coalesce(nan, F.lit(False)) & x.isNotNull() & y.isNotNull())
            return out if op == "=" else ~out
        collation = a.collate or b.collate
        if collation and a.kind == "text":
            x, y = (F.struct(F.collate(v, {"und": "UNICODE", "tr": "tr"}[collation]), v) for v in (x, y))
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if nan is not None:
            out = (out | nan) if "=" in op else (out & ~nan)
        return out if bare else F.coalesce(out, F.lit(False))

    @staticmethod
    def constant(a: Typed, b: Typed) -> bool:
        """Is a side a literal? Null counts as false then, whatever the field holds."""
        return a.literal or b.literal

    def aligned(self, a: Typed, b: Typed) -> tuple[Typed | None, Any]:
        """Both sides in kinds that compare; text against a time is read as one."""
        if a.kind == b.kind or "any" in (a.kind, b.kind) or {a.kind, b.kind} <= {"int", "float"} or {a.kind, b.kind} <= {"list", "vector", "geo"}:
            return a, b
        if "json" in (a.kind, b.kind):
            return a, b
        if {a.kind, b.kind} == {"timestamp", "text"}:
            t, s = (a, b) if a.kind == "timestamp" else (b, a)
            read = Typed(s.col.try_cast("timestamp_ntz" if t.ntz else "timestamp"), "timestamp", ntz=t.ntz, literal=s.literal)
            return (t, read) if a.kind == "timestamp" else (read, t)
        if {a.kind, b.kind} <= {"timestamp", "int", "float"}:
            ms = lambda t: Typed(F.unix_millis(t.col.cast("timestamp")), "int") if t.kind == "timestamp" else t
            return ms(a), ms(b)
        raise TypeMismatch(f"{a.kind} and {b.kind} don't compare")

    def sort_key(self, t: Typed, collate: str | None = None) -> list[Column]:
        """Columns that order as the value does."""
        column = t.as_kind("text")
        if t.nocase:
            column = text.casefold(column)
        if (collate or t.collate) and t.kind in ("text", "json"):
            return [F.collate(column, {"und": "UNICODE", "tr": "tr"}[collate or t.collate]), column]
        if t.kind == "json":
            # of mixed kinds numbers come before texts
            number = column.try_cast("double")
            return [F.when(column.isNull(), 0).when(number.isNotNull(), 1).otherwise(2), number, column]
        return [column]


def _div(x: Column, y: Column) -> Column:
    # x - x % y is a multiple of y, exact in 64 bits; the decimal quotient loses nothing
    return ((x - x % y).cast("decimal(38,0)") / y.cast("decimal(38,0)")).cast("bigint")


def sparse_value(v: Any) -> dict[int, float]:
    """A sparse vector: a mapping, or the text form {index:weight,...}/dimension with indexes from 1."""
    if isinstance(v, dict):
        return {int(k): float(w) for k, w in v.items()}
    if isinstance(v, str):
        try:
            body, _, dim = v.strip().partition("/")
            pairs = [p.split(":") for p in body.strip()[1:-1].split(",") if p.strip()]
            out = {int(k) - 1: float(w) for k, w in pairs}
            if any(not 0 <= k < int(dim) for k in out):
                raise ValueError
            return out
        except (ValueError, IndexError):
            raise TypeMismatch(f"no sparse vector: {v!r}") from None
    raise TypeMismatch("a sparse vector is a mapping or a text")
