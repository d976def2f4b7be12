"""Changes as streams: the log itself, live answers, rollups, once-only ingest and expiry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import CHANGES
from ..plans.ast import Binary, Call, Lit, Path, walk
from ..sources.catalog import Collection


def change_stream(spark: SparkSession, folder: str, since: int = 0, collection: str | None = None) -> DataFrame:
    """The change log as a stream, after a sequence number. The checkpoint of the query that reads it is its cursor."""
    rows = spark.readStream.schema(CHANGES).parquet(f"{folder}/changes").filter(F.col("seq") > since).drop("commit")
    return rows.filter(F.col("collection") == collection) if collection else rows


def latest(changes: DataFrame) -> DataFrame:
    """State-based: of each id only its last change counts."""
    return changes.groupBy("collection", "id").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("doc", "seq").alias("doc"))


def follow(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Replays changes in batches: apply(puts, dels); applying a batch again changes nothing, as it holds last states."""

    def batch(df: DataFrame, _: int) -> None:
        df = latest(df).persist()
        try:
            apply(df.filter("op = 'put'"), df.filter("op = 'del'"))
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def difference(before: DataFrame, after: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(puts, dels) that lead from one answer to the next: rows that are new or other in any column, nulls included, and ids that have left."""
    maps = {c for c, t in after.dtypes if "map<" in t}
    plain = lambda df, c: F.to_json(df[c]) if c in maps else df[c]  # noqa: E731  maps have no equality
    old = before.select(F.col(id).alias("_id"), *(plain(before, c).alias(f"_was{k}") for k, c in enumerate(after.columns)), F.lit(True).alias("_held"))
    same = F.col("_held").isNotNull()
    for k, c in enumerate(after.columns):
        same = same & plain(after, c).eqNullSafe(F.col(f"_was{k}"))
    puts = after.join(old, F.col(id) == F.col("_id"), "left").filter(~same).select(*after.columns)
    dels = before.select(id).join(after.select(F.col(id).alias("_id")), F.col(id) == F.col("_id"), "left_anti")
    return puts, dels


def rollup(events: DataFrame, at: str, step: str, late: str | None, aggregates: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Counts and folds for each time bucket of a stream, final once the watermark has passed. aggregates: name -> SQL fold; late is None where a watermark is set already."""
    window = F.window(at, step)
    marked = events.withWatermark(at, late) if late else events
    out = marked.groupBy(window, *(by or [])).agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
    return out.select(F.col("window.start").alias("bucket"), *(by or []), *aggregates)


def once(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def swept(c: Collection, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(rows that live on, ids that have expired) at a time."""
    alive = c.alive(F.lit(now))
    return (c.df, c.df.filter("false").select(c.id)) if alive is None else (c.df.filter(alive), c.df.filter(~alive).select(c.id))


def next_expiry(c: Collection, now: dt.datetime) -> dt.datetime | None:
    """When the next row expires."""
    if c.ttl is None:
        return None
    at, ms = c.ttl
    first = c.df.filter(c.alive(F.lit(now))).agg(F.min(at)).head()[0]
    return None if first is None else first + dt.timedelta(milliseconds=ms)


def next_change(c: Collection, where, now: dt.datetime) -> dt.datetime | None:
    """When a filter's answer next changes by time alone: the least time ahead in a field that it compares with now()."""
    best = None
    for e in walk(where):
        if isinstance(e, Binary) and e.op in ("<", "<=", ">", ">="):
            field, other = (e.a, e.b) if isinstance(e.a, Path) else (e.b, e.a)
            if isinstance(field, Path) and any(isinstance(x, Call) and x.name == "now" for x in walk(other)):
                shift = 0
                if isinstance(other, Binary) and isinstance(other.b, Lit):
                    shift = other.b.value if other.op == "+" else -other.b.value
                found = c.df.filter(F.col(field.text) > F.lit(now + dt.timedelta(milliseconds=shift))).agg(F.min(field.text)).head()[0]
                if found is not None:
                    found -= dt.timedelta(milliseconds=shift)
                    best = found if best is None else min(best, found)
    return best
