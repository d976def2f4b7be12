"""What a database keeps under its folder: layers of rows, the change log, and manifests that name what counts.

A collection is a base and layers on top of it. A layer holds the rows that a write put and the ids that it replaced or
deleted (`gone`), which hide rows of the base and of earlier layers; so a write costs what it changes, not the collection.
A read merges them by an anti join on the ids of later layers. Beyond MOST_LAYERS a write makes a base of all.

A manifest is one small file for each commit, created exclusively: the highest number counts, two writers cannot take the
same one, and a reader that finds a torn last file takes the one before. Manifests hold the layers of each collection,
the numbers of the change log, answers by idempotency key, and the cursors of named consumers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, Gone, QueryError

MOST_LAYERS = 8
#: Keys whose answers are remembered.
MOST_KEYS = 1000


@dataclass(frozen=True)
class Layers:
    """base: a path, or None for the rows that the collection was registered with. parts: (gone, new) paths, the oldest first."""

    base: str | None = None
    schema: str = ""
    parts: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> set[str]:
        return {p for pair in self.parts for p in pair} | ({self.base} if self.base else set())


@dataclass(frozen=True)
class Manifest:
    n: int = 0
    seq: int = 0  # the last change
    floor: int = 0  # changes up to this one have been let go
    commits: tuple[tuple[int, int], ...] = ()  # (number, its last change) of the parts of the log that are kept
    collections: dict[str, Layers] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    cursors: dict[str, int] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)  # numbers of other logs that have been applied here

    def text(self) -> str:
        held = {name: {"base": x.base, "schema": x.schema, "parts": x.parts} for name, x in self.collections.items()}
        return json.dumps({"n": self.n, "seq": self.seq, "floor": self.floor, "commits": self.commits, "collections": held, "keys": self.keys, "cursors": self.cursors, "marks": self.marks})

    @staticmethod
    def read(text: str) -> Manifest:
        d = json.loads(text)
        held = {name: Layers(x["base"], x["schema"], tuple(map(tuple, x["parts"]))) for name, x in d["collections"].items()}
        return Manifest(d["n"], d["seq"], d["floor"], tuple(map(tuple, d["commits"])), held, d["keys"], d["cursors"], d["marks"])


class Folder:
    """Files of a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def fresh(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def children(self, kind: str) -> list[str]:
        fs, p = self._hadoop(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._hadoop(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not be there."""
        fs, p = self._hadoop(path)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str:
        rows = self.spark.read.option("wholetext", True).text(path).collect()  # one small file
        return rows[0][0] if rows else ""


class Store:
    """The manifests of a database, the latest of them, and the merged rows of its collections."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)
        self.now = self.latest()
        self.publish()  # of a writer that ended between its manifest and this

    def latest(self) -> Manifest:
        for name in reversed(self.folder.children("manifest")):
            try:
                return Manifest.read(self.folder.read(f"{self.folder.path}/manifest/{name}"))
            except (ValueError, KeyError):  # torn: its writer did not come to an end
                continue
        return Manifest()

    def publish(self) -> None:
        """Shows the log of commits whose manifest is there; it was written under a name that readers pass over."""
        for n, _ in self.now.commits[-1:]:
            hidden, shown = (f"{self.folder.path}/changes/{mark}commit={n}" for mark in ("_", ""))
            if self.folder.exists(hidden):
                fs, p = self.folder._hadoop(hidden)
                fs.rename(p, self.folder._hadoop(shown)[1])

    def swap(self, new: Manifest) -> None:
        new = replace(new, n=self.now.n + 1, keys=dict(list(new.keys.items())[-MOST_KEYS:]))
        if not self.folder.create(f"{self.folder.path}/manifest/{new.n:012d}.json", new.text()):
            raise Conflict("another writer has committed in between")
        self.now = new
        self.publish()

    # rows
    def merged(self, layers: Layers, origin: DataFrame, id: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(layers.schema)) if layers.schema else origin.schema
        out = None
        for k in range(-1, len(layers.parts)):
            if k < 0:
                df = self.spark.read.schema(schema).parquet(layers.base) if layers.base else origin
            else:
                df = self.spark.read.schema(schema).parquet(layers.parts[k][1])
            if later := [gone for gone, _ in layers.parts[k + 1 :]]:
                gone = self.spark.read.parquet(*later).select(F.col("id").alias("_gone"))
                df = df.join(gone, F.col(id) == F.col("_gone"), "left_anti")
            out = df if out is None else out.unionByName(df)
        return out

    def layered(self, layers: Layers, gone: DataFrame, new: DataFrame, kind: str) -> Layers:
        """The layers with one more on top. gone: ids as `id`; new: rows."""
        at, rows = self.folder.fresh(kind), self.folder.fresh(kind)
        gone.select("id").write.parquet(at)
        new.write.parquet(rows)
        return replace(layers, schema=json.dumps(new.schema.jsonValue()), parts=(*layers.parts, (at, rows)))

    def based(self, df: DataFrame, kind: str) -> Layers:
        """All rows as one base."""
        path = self.folder.fresh(kind)
        df.write.parquet(path)
        return Layers(path, json.dumps(df.schema.jsonValue()))

    # the change log
    def logged(self, log: DataFrame, n: int, last: int) -> tuple[int, int]:
        path = f"{self.folder.path}/changes/_commit={n}"
        if self.folder.exists(path):  # of a writer that did not come to its manifest
            self.folder.remove(path)
        log.write.parquet(path)
        return n, last

    def changes(self, schema: str, since: int = 0) -> DataFrame:
        """Changes after a number; those let go already are refused."""
        if since < self.now.floor and self.now.floor:
            raise Gone(f"changes up to {self.now.floor} have been let go: start from a snapshot")
        paths = [f"{self.folder.path}/changes/commit={n}" for n, last in self.now.commits if last > since]
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return out.filter(F.col("seq") > since) if since else out

    def trimmed(self, to: int) -> None:
        """Lets go of whole commits up to a number; consumers that are not there yet keep theirs."""
        to = min([to, *self.now.cursors.values()])
        old = [c for c in self.now.commits if c[1] <= to]
        if not old:
            return
        self.swap(replace(self.now, floor=old[-1][1], commits=tuple(c for c in self.now.commits if c not in old)))
        for n, _ in old:
            self.folder.remove(f"{self.folder.path}/changes/commit={n}")

    # named consumers
    def cursor(self, name: str) -> int:
        return self.now.cursors.get(name, 0)

    def advanced(self, name: str, to: int) -> int:
        """A consumer's place, which only moves forward. What it has not said to be done it is given again."""
        if to > self.now.seq:
            raise QueryError(f"there is no change {to} yet")
        at = max(self.cursor(name), to)
        if at != self.now.cursors.get(name):
            self.swap(replace(self.now, cursors=self.now.cursors | {name: at}))
        return at

    # garbage
    def collected(self, kinds: list[str], staged: set[str] = frozenset()) -> int:
        """Deletes what no manifest but the latest names, and older manifests. The number of folders deleted."""
        live = set().union(staged, self.now.keys.values(), *(x.paths for x in self.now.collections.values()))
        n = 0
        for kind in (*kinds, "answers"):
            for name in self.folder.children(kind):
                path = f"{self.folder.path}/{kind}/{name}"
                if path not in live:
                    self.folder.remove(path)
                    n += 1
        for name in self.folder.children("manifest"):
            if int(name.split(".")[0]) < self.now.n:
                self.folder.remove(f"{self.folder.path}/manifest/{name}")
        return n
