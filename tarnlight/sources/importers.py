"""Other databases and files as collections, and answers as files."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from .catalog import Collection, kind_of, spark_type, sql_type

SAMPLED = 1000


class Source(Protocol):
    """A place that holds tables."""

    def tables(self) -> list[str]: ...

    def columns(self, table: str) -> list[tuple[str, str]]: ...

    def read(self, spark: SparkSession, table: str, *options) -> DataFrame: ...


def planned(columns: list[tuple[str, str]], key: str | None = None) -> tuple[dict[str, str], str | None]:
    """Declared columns to field types; an integer key becomes the id, and a column `id` that is none is renamed."""
    out: dict[str, str] = {}
    for name, declared in columns:
        out["id_" if name == "id" and name != key else name] = sql_type(declared)
    return out, key if key and out.get(key) == "int" else None


class SqliteSource:
    """A file of SQLite, read in batches by the driver's own library and staged for the executors."""

    def __init__(self, path: str):
        self.path = path

    def connection(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def tables(self) -> list[str]:
        with self.connection() as db:
            return [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]

    def columns(self, table: str) -> list[tuple[str, str]]:
        with self.connection() as db:
            found = [(r[1], r[2]) for r in db.execute(f'pragma table_info("{table}")')]
            sample = db.execute(f'select * from "{table}" limit {SAMPLED}').fetchall()
        if not found:
            raise QueryError(f"no table {table}")
        return [(name, declared or _inferred([r[k] for r in sample])) for k, (name, declared) in enumerate(found)]

    def read(self, spark: SparkSession, table: str, staged: str, batch: int = 50_000) -> DataFrame:
        """The table, staged as Parquet under a folder: the driver holds a batch at a time, and the plan none."""
        kinds = [(n, sql_type(d)) for n, d in self.columns(table)]
        schema = ", ".join(f"`{n}` {spark_type(k)}" for n, k in kinds)
        for rows in self.batches(table, batch):
            one = spark.createDataFrame([tuple(_value(v, k) for v, (_, k) in zip(r, kinds, strict=True)) for r in rows], schema)
            one.write.mode("append").parquet(staged)
        if not self.counted(table):
            spark.createDataFrame([], schema).write.mode("append").parquet(staged)
        return spark.read.schema(schema).parquet(staged)

    def counted(self, table: str) -> int:
        with self.connection() as db:
            return db.execute(f'select count(*) from "{table}"').fetchone()[0]

    def batches(self, table: str, batch: int) -> Iterator[list[tuple]]:
        with self.connection() as db:
            cursor = db.execute(f'select * from "{table}"')
            while rows := cursor.fetchmany(batch):
                yield rows


def _inferred(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    return "integer" if kinds == {int} else "real" if kinds and kinds <= {int, float} else "blob" if kinds == {bytes} else "text"


def _value(v, kind: str):
    if v is None:
        return None
    if kind == "timestamp":
        return dt.datetime.fromtimestamp(v / 1000, dt.UTC) if isinstance(v, int | float) else dt.datetime.fromisoformat(v).replace(tzinfo=dt.UTC)
    if kind == "bool":
        return bool(v)
    if kind == "float":
        return float(v)
    if kind == "json":
        return v if isinstance(v, str) else json.dumps(v)
    return str(v) if kind == "text" else v


class JdbcSource:
    """A database behind a JDBC url; reads are split over a numeric key."""

    def __init__(self, url: str, driver: str | None = None, **options: str):
        self.options = {"url": url, **({"driver": driver} if driver else {}), **options}

    def read(self, spark: SparkSession, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        reader = spark.read.format("jdbc").options(**self.options, dbtable=table, pushDownPredicate="true")
        if key and parts > 1:
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()


def json_documents(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A file of JSON lines, by declared types: nothing is inferred."""
    return spark.read.schema(", ".join(f"`{n}` {spark_type(t)}" for n, t in fields.items())).json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON text for each row, nested children in it."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def json_answer(answer) -> DataFrame:
    """An answer as JSON texts: part is "rows" or the path of a facet, place the text's order within it."""
    parts = {"rows": answer.df, **answer.facets}
    out = None
    for name, df in parts.items():
        # pages and facets are answers already: their order is kept by numbering the sorted rows' partitions
        one = json_rows(df).withColumn("place", F.monotonically_increasing_id()).select(F.lit(name).alias("part"), "place", "json")
        out = one if out is None else out.unionByName(one)
    return out


def clustered(df: DataFrame, path: str, *keys: str, partitions: int | None = None) -> None:
    """Writes Parquet in ranges of the keys, sorted within, so that later filters on them skip files and row groups."""
    n = [partitions] if partitions else []
    df.repartitionByRange(*n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


#: How the client languages name what JSON carries (int, float, text, bool, any, a list of).
CLIENT_TYPES = {
    "python": ("int", "float", "str", "bool", "Any", "list[{}]"),
    "typescript": ("number", "number", "string", "boolean", "unknown", "{}[]"),
    "go": ("int64", "float64", "string", "bool", "any", "[]{}"),
    "csharp": ("long", "double", "string", "bool", "object", "List<{}>"),
    "swift": ("Int64", "Double", "String", "Bool", "JSONValue", "[{}]"),
    "kotlin": ("Long", "Double", "String", "Boolean", "JsonElement", "List<{}>"),
    "dart": ("int", "double", "String", "bool", "dynamic", "List<{}>"),
}


def client_type(c: Collection, field: str, language: str) -> str:
    """A field's type as a row's JSON carries it: times and sparse vectors are texts, bytes a list of numbers."""
    whole, real, text, truth, anything, many = CLIENT_TYPES[language]
    kind, t = c.kind(field), c.df.schema[c.id if field == "id" else field].dataType
    plain = {"int": whole, "float": real, "text": text, "bool": truth, "timestamp": text, "sparse": text, "json": anything}
    if kind in ("vector", "geo"):
        return many.format(real)
    if kind == "bytes":
        return many.format(whole)
    if kind == "list":
        return many.format(plain.get(kind_of(t.elementType), anything))
    return plain.get(kind, anything)


def typed_declaration(c: Collection, language: str = "python") -> str:
    """A collection's rows as a type of a client language; fields that may be null say so, the id may not."""
    if language not in CLIENT_TYPES:
        raise QueryError(f"no client types for {language}")
    name = "".join(w.title() for w in c.name.split("_"))
    rows = [("id", client_type(c, "id", language), False)]
    rows += [(f, client_type(c, f, language), f not in c.required) for f in c.fields if f not in ("id", c.id)]
    anything = CLIENT_TYPES[language][4]
    if language == "python":
        return "\n".join([f"class {name}(TypedDict):", *(f"    {f}: {t} | None" if null and t != anything else f"    {f}: {t}" for f, t, null in rows)])
    if language == "typescript":
        return "\n".join([f"export interface {name} {{", *(f"  {f}: {t} | null;" if null and t != anything else f"  {f}: {t};" for f, t, null in rows), "}"])
    if language == "go":
        title = lambda f: "".join(w.title() for w in f.split("_"))
        return "\n".join([f"type {name} struct {{", *(f'\t{title(f)} {"*" if null and t != anything and not t.startswith("[]") else ""}{t} `json:"{f}"`' for f, t, null in rows), "}"])
    if language == "csharp":
        return "\n".join([f"public record {name}(", ",\n".join(f"    {t}{'?' if null else ''} {f}" for f, t, null in rows), ");"])
    optional = lambda t, null: f"{t}?" if null and t != "dynamic" else t
    if language == "swift":
        return "\n".join([f"struct {name}: Codable {{", *(f"    let {f}: {optional(t, null)}" for f, t, null in rows), "}"])
    if language == "kotlin":
        return "\n".join(["@Serializable", f"data class {name}(", ",\n".join(f"    val {f}: {optional(t, null)}" for f, t, null in rows), ")"])
    return "\n".join([f"class {name} {{", *(f"  final {optional(t, null)} {f};" for f, t, null in rows), f"  const {name}({{" + ", ".join(f"required this.{f}" for f, _, _ in rows) + "});", "}"])
