"""Exact deduplication by a content sort, in DataFrame operations only.

1. Sampled splitters deal the rows out by ranges of (head of the content, salt). The salt comes from doc_id and the
   input partition, one value for each range at least, so the copies of one text, however many, spread over all ranges
   that there are. Splitters hold heads only: what the driver samples does not grow with the length of texts.
2. In each range an external sort places equal contents side by side, and a sort aggregate compares
   each row's whole content with its neighbour's: a run of equals becomes one row (its best doc_id, its length).
3. The runs of one content meet by its SHA-256 digest. They are narrow rows, at most as many as there are salts.
4. Every row finds its group by that digest. The text does not move again. Groups of more than 1 / HOT_KEYS of all
   rows are fewer than HOT_KEYS, whatever the data: they are broadcast (a digest and two longs each), so that no key
   of the join that the other rows take holds more than that share.

Defined results: null text counts as empty; equal doc_ids count as separate rows of the group; a row with null
doc_id is a member and never the one that stays unless all are null; an empty table gives an empty result; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, hex_digest, met, partitions, saved, text_of, without

#: Ranges over which the copies of one content spread at least.
SALTS = 64
#: Characters of a content that the splitters compare.
HEAD = 48


def content_classes(docs: DataFrame, content: Column, doc_id: str = "doc_id", keep: str = "largest", salts: int | None = None) -> DataFrame:
    """One row for each distinct content: digest (binary), keep_id, group_size."""
    best = F.max if keep == "largest" else F.min
    salts = salts or max(SALTS, partitions(docs.sparkSession))
    rows = docs.select(F.col(doc_id).alias("_id"), content.alias("_content"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.lit(salts)).cast("int"))
    rows = rows.withColumn("_head", F.substring("_content", 1, HEAD))
    ranges = rows.repartitionByRange("_head", "_salt")
    # a struct cannot be updated in place, so Spark aggregates by sorting and comparing neighbours, with spill
    runs = ranges.groupBy("_head", "_content", "_salt").agg(best(F.struct("_id")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select(_digest(F.col("_content")).alias("digest"), F.col("_best._id").alias("_best"), "_n")
    return runs.groupBy("digest").agg(best("_best").alias("keep_id"), F.sum("_n").alias("group_size"))


def _digest(content: Column) -> Column:
    return F.unhex(hex_digest(content))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", hot_keys: int = HOT_KEYS) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. keep: "largest" or "smallest" doc_id."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    classes = saved(content_classes(docs, text_of(text), doc_id, keep), "dedup-classes")
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), _digest(text_of(text)).alias("digest")), "dedup-digests")
    out = met(rows, classes, ["digest"], "group_size", rows.count(), hot_keys)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """docs, of equal texts one row: that of the largest (smallest) doc_id, one of them where it is repeated. A null doc_id stays."""
    found = saved(exact_dedup(docs, doc_id, text, keep), "dedup")
    rest = without(docs, found.filter("not kept").select("doc_id"), doc_id)
    twice = saved(found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("_twice")).distinct(), "repeated-ids")
    if twice.isEmpty():
        return rest
    again = F.col(doc_id) == F.col("_twice")
    once = rest.join(twice, again, "left_semi").withColumn("_sha", hex_digest(text_of(text))).dropDuplicates([doc_id, "_sha"]).drop("_sha")
    return rest.join(twice, again, "left_anti").unionByName(once)


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
