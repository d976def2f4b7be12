"""A text index on disk: postings clustered by term, so that a search reads its own terms' row groups only.

An index is a list of segments. A segment holds the postings (term, id, tf, length) of the rows that it was made of, a row
for each term (df, top_tf, least_length) and the lengths of its rows; `gone` holds ids that later writes replaced or
deleted, which hide the postings of earlier segments. Beyond MOST_SEGMENTS an update makes one segment of all.

Ranked reads are pruned as MaxScore does: the words of a query have upper bounds; once the k-th best score by the
strongest word alone is above the sum of the weakest words' bounds, a row that holds those weak words only cannot be
in the answer, so that their postings count for rows that hold a stronger word alone.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_SEGMENTS = 6
#: Terms, repeated ones too, whose postings are one block of each at most, or those of one row.
TOKENS = 4_000_000
#: Ids that are broadcast at most.
BROADCAST_IDS = 500_000


def with_beginnings(column: Column, options: dict) -> Column:
    """A list of terms, and where options ask for it their beginnings, marked by a caret, as further terms."""
    if not (longest := options.get("prefix")):
        return column
    least = options.get("prefix_min", 3)
    starts = lambda t: F.transform(F.sequence(F.lit(least), F.least(F.lit(longest), F.length(t) - 1)), lambda n: F.concat(F.lit("^"), F.substring(t, F.lit(1), n)))
    return F.concat(column, F.flatten(F.transform(column, lambda t: F.when(F.length(t) > least, starts(t)).otherwise(F.array().cast("array<string>")))))


@dataclass(frozen=True)
class TextIndex:
    """Paths of the segments, the oldest first; n and total: rows and terms that live."""

    folder: str
    segments: tuple[str, ...]
    n: int
    total: int
    options: dict = field(default_factory=dict)
    masked: bool = False

    @property
    def average(self) -> float:
        return max(1.0, self.total / self.n) if self.n else 1.0

    def live(self, spark: SparkSession, kind: str, test: Column | None = None) -> DataFrame:
        """Rows of a kind of file ("postings", "rows") that no later segment hides; test: of the term, reaches the scan."""
        out = None
        for k, path in enumerate(self.segments):
            df = spark.read.parquet(f"{path}/{kind}")
            df = df.filter(test) if test is not None else df
            if later := [f"{p}/gone" for p in self.segments[k + 1 :]]:
                df = df.join(spark.read.parquet(*later).withColumnRenamed("id", "_gone"), F.col("id") == F.col("_gone"), "left_anti")
            out = df if out is None else out.unionByName(df)
        return out

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df, top_tf, least_length; where segments hide rows of others these are upper bounds (lower, of lengths)."""
        df = spark.read.parquet(*(f"{p}/terms" for p in self.segments))
        if len(self.segments) == 1:
            return df
        return df.groupBy("term").agg(F.sum("df").alias("df"), F.max("top_tf").alias("top_tf"), F.min("least_length").alias("least_length"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, t: terms) the postings of each term as one block for some TOKENS, and a block without a term for all of their rows."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch["t"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, ends = 0, np.cumsum(lengths)
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + TOKENS, "right")))
            yield _block(batch["id"].slice(at, to - at), batch["t"].slice(at, to - at), lengths[at:to])
            at = to


def _block(ids: pa.Array, lists: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    n = len(lengths)
    tokens = lists.flatten().dictionary_encode()
    place = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    place, tfs = np.unique(place, return_counts=True)  # by term, then row
    row = np.concatenate([place % n, np.arange(n)])
    starts = np.searchsorted(place // n, np.arange(len(tokens.dictionary)))
    offsets = pa.array(np.append(starts, [len(place), len(row)]).astype(np.int32))
    terms = pa.concat_arrays([tokens.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    columns = [ids.take(pa.array(row)), pa.array(lengths[row].astype(np.int32)), pa.array(np.append(tfs, np.zeros(n)).astype(np.int32))]
    return pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(offsets, c) for c in columns)], ["term", "ids", "lengths", "tfs"])


def _segment(rows: DataFrame, field_: str, folder: str, options: dict, gone: DataFrame | None = None) -> tuple[str, int, int]:
    path = f"{folder}/{uuid.uuid4().hex}"
    spark = rows.sparkSession
    column = with_beginnings(terms_of(F.col(field_), bool(options.get("chars"))), options)
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.select("id", column.alias("t")).mapInArrow(_blocks, f"term string, ids array<{kind}>, lengths array<int>, tfs array<int>")
    counted.write.option("compression", "zstd").parquet(f"{path}/parsed")
    parsed = spark.read.parquet(f"{path}/parsed")
    parsed.filter("term is null").select(F.explode(F.arrays_zip("ids", "lengths")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.lengths").alias("length")).write.parquet(f"{path}/rows")
    # blocks are dealt and sorted, and taken apart after that; a frequent term's blocks spread over ranges of (term, first id)
    blocks = parsed.filter("term is not null").withColumn("_first", F.col("ids")[0]).repartitionByRange("term", "_first").sortWithinPartitions("term", "_first")
    each = blocks.select("term", F.explode(F.arrays_zip("ids", "lengths", "tfs")).alias("x"))
    each.select("term", F.col("x.ids").alias("id"), F.col("x.lengths").alias("length"), F.col("x.tfs").alias("tf")).write.option("compression", "zstd").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("top_tf"), F.min("length").alias("least_length")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    (gone if gone is not None else rows.filter("false").select("id")).write.parquet(f"{path}/gone")
    got = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
    _removed(spark, f"{path}/parsed")
    return path, got[0], got[1]


def _removed(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def build(rows: DataFrame, field_: str, folder: str, options: dict | None = None) -> TextIndex:
    """rows: id and the field. One segment under the folder."""
    options = options or {}
    path, n, total = _segment(rows, field_, folder, options)
    return TextIndex(folder, (path,), n, total, options)


def updated(index: TextIndex, gone: DataFrame, new: DataFrame, field_: str) -> TextIndex:
    """The index after a write. gone: ids that it replaced or deleted; new: id and the field of rows that it wrote."""
    spark = new.sparkSession
    path, n, total = _segment(new, field_, index.folder, index.options, gone.select("id").distinct())
    hidden = spark.read.parquet(f"{path}/gone")
    left = index.live(spark, "rows").join(hidden, "id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
    out = TextIndex(index.folder, (*index.segments, path), index.n - left[0] + n, index.total - left[1] + total, index.options, index.masked or left[0] > 0)
    return compacted(spark, out) if len(out.segments) > MOST_SEGMENTS else out


def compacted(spark: SparkSession, index: TextIndex) -> TextIndex:
    """The same postings as one segment."""
    path = f"{index.folder}/{uuid.uuid4().hex}"
    index.live(spark, "rows").write.parquet(f"{path}/rows")
    index.live(spark, "postings").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("top_tf"), F.min("length").alias("least_length")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    stored.filter("false").select("id").write.parquet(f"{path}/gone")
    return TextIndex(index.folder, (path,), index.n, index.total, index.options)


@dataclass
class Group:
    """Terms that stand for one word of a query: their weight, once their rows are counted, and what they give at most."""

    terms: list[str]
    weight: float = 0.0
    rows: int = 0
    bound: float = 0.0


def scored(spark: SparkSession, index: TextIndex, groups: list[Group], weigh, k1: float, b: float, allowed: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """id, _score of the rows that hold a term. weigh(groups): sets their weights from their rows. allowed: ids that may
    answer; k: only the k best are asked for, which lets weak words be pruned."""
    every = sorted({t for g in groups for t in g.terms})
    of = {t: [j for j, g in enumerate(groups) if t in g.terms] for t in every}
    known = {r["term"]: r for r in index.terms(spark).filter(F.col("term").isin(every)).collect()}  # the query's own terms
    postings = index.live(spark, "postings", F.col("term").isin(every))
    place = F.create_map(*(x for t in every for x in (F.lit(t), F.array(*map(F.lit, of[t])))))
    postings = postings.select("id", "length", "tf", F.explode(F.element_at(place, F.col("term"))).alias("g"))
    if index.masked or any(len(g.terms) > 1 for g in groups):
        counts = {r["g"]: r["n"] for r in postings.select("g", "id").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        counts = {j: known[g.terms[0]]["df"] for j, g in enumerate(groups) if g.terms[0] in known}
    for j, g in enumerate(groups):
        g.rows = counts.get(j, 0)
    weigh(groups)
    if allowed is not None:
        postings = postings.join(allowed.select(F.col("id").alias("_allowed")), F.col("id") == F.col("_allowed"), "left_semi")

    def gain(tf: Column, length: Column) -> Column:
        tf = tf.cast("double")
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / index.average))

    weights = F.element_at(F.array(*(F.lit(float(g.weight)) for g in groups)), F.col("g") + 1)

    def summed(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("id", "length", "g").agg(F.sum("tf").alias("tf")) if any(len(g.terms) > 1 for g in groups) else rows
        return each.groupBy("id").agg(F.sum(weights * gain(F.col("tf"), F.col("length"))).alias("_score"))

    weak = pruned(groups, known, index, k1, b, k, lambda j: summed(postings.filter(F.col("g") == j)))
    strong = [j for j in range(len(groups)) if j not in weak]
    if weak and sum(groups[j].rows for j in strong) <= BROADCAST_IDS:
        held = F.broadcast(postings.filter(F.col("g").isin(strong)).select(F.col("id").alias("_held")).distinct())  # counted
        postings = postings.join(held, F.col("id") == F.col("_held"), "left_semi")
    return summed(postings)


def pruned(groups: list[Group], known: dict, index: TextIndex, k1: float, b: float, k: int | None, alone) -> frozenset[int]:
    """The groups whose bounds together stay under the k-th best score of the strongest group alone."""
    if k is None or len(groups) < 2:
        return frozenset()
    for g in groups:
        found = [known[t] for t in g.terms if t in known]
        tf, length = sum(r["top_tf"] for r in found), min((r["least_length"] for r in found), default=0)
        g.bound = g.weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / index.average)) * (1 + 1e-9) if found else 0.0
    order = sorted(range(len(groups)), key=lambda j: groups[j].bound)
    first = order[-1]
    if groups[first].rows < k:
        return frozenset()
    best = alone(first).orderBy(F.desc("_score")).limit(k).agg(F.min("_score"), F.count(F.lit(1))).head()
    if best[1] < k:
        return frozenset()
    weak, total = [], 0.0
    for j in order[:-1]:
        total += groups[j].bound
        if not total < best[0] or math.isnan(total):
            break
        weak.append(j)
    return frozenset(weak)
