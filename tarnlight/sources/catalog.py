"""Collections: a DataFrame, its id, and what its fields declare."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

#: Types of the declaration language, and what they are in Spark.
TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "text": "string", "bytes": "binary", "timestamp": "timestamp", "json": "string", "geo": "array<double>"}


def spark_type(name: str) -> str:
    if name.startswith("["):
        return f"array<{spark_type(name[1:-1])}>"
    if name.startswith("vector"):
        return "array<float>"
    if name.startswith("sparse"):
        return "struct<idx:array<int>,w:array<float>>"
    if name not in TYPES:
        raise QueryError(f"no type {name}")
    return TYPES[name]


def sql_type(declared: str) -> str:
    """A database's declared column type, as a type of the declaration language."""
    word = declared.strip().lower().split("(")[0].strip()
    if word.endswith("[]"):
        return f"[{sql_type(word[:-2])}]"
    for names, kind in (
        (("bool",), "bool"),
        (("timestamp", "datetime", "date"), "timestamp"),
        (("json", "jsonb"), "json"),
        (("bytea", "blob", "binary", "varbinary"), "bytes"),
        (("real", "double", "float", "numeric", "decimal", "money"), "float"),
        (("int", "serial", "bigint", "smallint", "tinyint", "bigserial"), "int"),
    ):
        if any(word == n or word.startswith(n) for n in names):
            return kind
    return "text"


def kind_of(t: T.DataType, json: bool = False, geo: bool = False) -> str:
    if json or isinstance(t, T.VariantType):
        return "json"
    if geo:
        return "geo"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "timestamp"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.StructType):
        return "sparse" if t.fieldNames() == ["idx", "w"] else "struct"
    if isinstance(t, T.ArrayType):
        return "vector" if isinstance(t.elementType, T.FloatType) else "list"
    return "text"


@dataclass(frozen=True)
class Collection:
    name: str
    df: DataFrame
    id: str = "id"
    json: frozenset[str] = frozenset()
    geo: frozenset[str] = frozenset()
    nocase: frozenset[str] = frozenset()
    collate: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    required: frozenset[str] = frozenset()
    ttl: tuple[str, int] | None = None  # a timestamp field, milliseconds
    metric: dict[str, str] = field(default_factory=dict)  # of vector fields
    text: dict[str, dict[str, Any]] = field(default_factory=dict)  # options of text indexes
    may_hold_nan: frozenset[str] = frozenset()
    hints: dict[str, list[str]] = field(default_factory=dict)
    text_index: dict[str, Any] = field(default_factory=dict)  # of these very rows
    vector_index: dict[str, Any] = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        """Declared fields; the id is one only under its own name."""
        return [c for c in self.df.columns if c != "id" or self.id != "id"]

    def kind(self, name: str) -> str:
        if name == "id":
            name = self.id
        return kind_of(self.df.schema[name].dataType, name in self.json, name in self.geo)

    def has(self, name: str) -> bool:
        return name == "id" or name in self.df.columns

    def with_rows(self, df: DataFrame) -> Collection:
        """Other rows: indexes are of the old ones."""
        return replace(self, df=df, text_index={}, vector_index={})

    def with_id(self) -> DataFrame:
        """The rows, with their id as `id`."""
        return self.df if self.id == "id" else self.df.withColumn("id", F.col(self.id))

    def alive(self, now: Column) -> Column | None:
        if self.ttl is None:
            return None
        at, ms = self.ttl
        return ~F.coalesce(F.col(at) <= now - F.make_dt_interval(secs=F.lit(ms / 1000).cast("decimal(18,6)")), F.lit(False))


class Catalog:
    """Names to collections, and functions that statements may call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}
        self.functions: dict[str, tuple[int | None, Callable[..., Column], str]] = {}
        self.hooks: list[tuple[str, Callable]] = []

    def register(self, name: str, df: DataFrame, id: str = "id", **declared: Any) -> Collection:
        if id not in df.columns:
            raise QueryError(f"{name} has no column {id}")
        for k in ("json", "geo", "nocase", "required", "may_hold_nan"):
            if k in declared:
                declared[k] = frozenset(declared[k])
        c = self.collections[name] = Collection(name, df, id, **declared)
        return c

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise QueryError(f"no collection {name}")
        return self.collections[name]

    # indexes
    def index_text(self, name: str, field_: str, folder: str) -> Collection:
        """Builds a text index of a field, which `match` reads from then on."""
        from ..operators import text_index

        c = self.get(name)
        built = text_index.build(c.with_id().select("id", field_), field_, folder, c.text.get(field_, {}))
        self.collections[name] = replace(c, text_index=c.text_index | {field_: built})
        return self.collections[name]

    def index_vectors(self, name: str, field_: str, folder: str, **options: Any) -> Collection:
        """Builds cells and codes of a vector field, which `near` reads from then on unless it says `exact` or filters."""
        from ..operators import ann

        c = self.get(name)
        built = ann.build(c.with_id(), field_, folder, **options)
        self.collections[name] = replace(c, vector_index=c.vector_index | {field_: built})
        return self.collections[name]

    # scalar functions and plugins
    PROTECTED = frozenset({"distance", "within"})

    def register_function(self, name: str, function: Callable[..., Column], arity: int | None = None, doc: str = "") -> None:
        """function takes and returns Columns. The same name is refused, another casing replaces it."""
        if name.lower() in self.PROTECTED:
            raise QueryError(f"{name}() can't be replaced")
        if name in self.functions:
            raise QueryError(f"{name}() is registered already")
        self.functions = {k: v for k, v in self.functions.items() if k.lower() != name.lower()} | {name: (arity, function, doc)}

    def function(self, name: str, n: int) -> Callable[..., Column] | None:
        for known, (arity, function, _) in self.functions.items():
            if known.lower() == name.lower():
                if arity is not None and arity != n:
                    raise QueryError(f"{name}() takes {arity} arguments, not {n}")
                return function
        return None

    def install(self, plugin: Any) -> None:
        """plugin.functions(): (name, function, arity, doc) rows; plugin.before / plugin.after: hooks of writes."""
        for row in getattr(plugin, "functions", lambda: ())():
            self.register_function(*row)
        for when in ("before", "after"):
            if hook := getattr(plugin, when, None):
                self.hooks.append((when, hook))


def parquet_catalog(spark: SparkSession, folder: str, ids: dict[str, str], names: Iterable[str] | None = None, **declared: dict[str, Any]) -> Catalog:
    """A catalog over folder/<name>.parquet; ids: name -> id column; declared: name -> options of register()."""
    out = Catalog(spark)
    for name in names or ids:
        out.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), ids[name], **declared.get(name, {}))
    return out
