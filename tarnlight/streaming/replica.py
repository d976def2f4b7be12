"""A database that follows another, or another system's log, by its changes.

Changes are applied in batches of last states, in one commit each with the number that they reach, so that a batch that
comes again changes nothing: what a failed run applied is passed over by its number.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import Database
from .changes import change_stream, latest


class Replica:
    """db follows a source under a name; collections that the catalog of db does not hold are passed over."""

    def __init__(self, db: Database, name: str = "replica"):
        self.db, self.name = db, f"applied:{name}"

    @property
    def reached(self) -> int:
        """The source's number up to which its changes are here."""
        return self.db.store.now.marks.get(self.name, 0)

    def apply(self, changes: DataFrame) -> int:
        """changes: seq, collection, op (put or del), id, doc (json). The number reached."""
        rows = latest(changes.filter(F.col("seq") > self.reached)).persist()
        try:
            top = rows.agg(F.max("seq")).head()[0]
            if top is None:
                return self.reached
            with self.db.block():
                for r in rows.select("collection").distinct().collect():  # names of collections
                    if r[0] in self.db.catalog.collections:
                        self._merge(r[0], rows.filter(F.col("collection") == r[0]))
                self.db.marks[self.name] = top
            return top
        finally:
            rows.unpersist()

    def _merge(self, name: str, rows: DataFrame) -> None:
        c = self.db.catalog.get(name)
        schema = c.with_id().schema
        put = rows.filter("op = 'put'").select(F.from_json("doc", schema).alias("d"), F.col("id").alias("_key")).select("d.*", "_key")
        put = put.withColumn(c.id, F.col("_key").cast(c.df.schema[c.id].dataType)).select(*c.df.columns)
        self.db.layered(c, rows.select("id"), put)

    def follow(self, folder: str, checkpoint: str) -> StreamingQuery:
        """Takes in what the change log under another database's folder holds by now; a checkpoint keeps the place."""
        return self._started(change_stream(self.db.spark, folder), checkpoint)

    def follow_rows(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """The same of any stream of seq, collection, op, id, doc: another system's log, as its connector gives it."""
        return self._started(stream, checkpoint)

    def _started(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        batch = lambda df, _: self.apply(df)
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claimed(db: Database, text: str, *params, wait: float = 0.0, every: float = 0.5, now: dt.datetime | None = None) -> Iterable:
    """Rows of a write that claims them (`set ... limit n returning ...`); with wait it is asked again until some are there."""
    import time

    until = time.monotonic() + wait
    while True:
        rows = db.run(text, *params, now=now).df.collect()
        if rows or time.monotonic() >= until:
            return rows
        time.sleep(min(every, max(0.0, until - time.monotonic())))
