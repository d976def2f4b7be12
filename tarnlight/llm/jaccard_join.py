"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, exact.

Shingles are 64-bit hashes; all else is exact on them. Two sets link when their Jaccard similarity is at least num / den.
In one total order of shingles, linked sets share a shingle among their first n - ceil(n * num / den) + 1 (their prefix).

1. Texts with equal sets make a class. Classes whose size and first shingles by hash (the zone: the prefix and some
   more) are equal make a group, which is indexed once.
2. Slots of the zones' shingles, a few rows each, are counted; shingles in slots of more than HOT rows come last in
   the order ("hot"), so that no indexed shingle has more rows.
   Groups whose zone keeps too few others ("dense") are read again in full, counted in full, and indexed member by member.
3. Index rows of one shingle pair up where sizes allow it, pairs are counted, and only those with as many common
   shingles as a link needs in both prefixes go on; groups are then expanded to their members and each pair of members
   is verified on whole sets.
4. Hot shingles in dense prefixes, and groups of many members with what they pair with, make families. A family's
   members are dealt into blocks of bounded size, those of families of more than one block by bands of set sizes, so
   that only blocks of one band and of bands side by side can hold links. Each such pair of blocks is verified at once,
   on whole sets, and returns links that connect what is linked: copies of a text by the thousand never make all their
   pairs, and a phrase that all documents share doesn't bring short ones and long ones together.
5. Links make components. A document's component_id is the least doc_id that links reach.

No partner, bucket or candidate is capped. What is broadcast is counted first (BROADCAST_ROWS).

Defined results: null and empty texts and texts of white space have no shingles, link with nothing and are components of
their own; fewer words than WORDS make one shingle; rows with null doc_id have a null component; rows of a repeated
doc_id are one document, with the links of all its rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, released, saved, text_of
from .components import components

WORDS = 5
NUM, DEN = 4, 5
#: Index rows of a slot of shingles beyond which they come last in the order.
HOT = 24
#: Members of a group that are paired one by one at most.
MEMBERS = 16
#: Rows (two longs each) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text in UTF-8 its set of hashed shingles, ascending."""
    if not 1 <= words <= len(_ODD):
        raise ValueError(f"words is 1 to {len(_ODD)}")
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    start, length = edge[::2], edge[1::2] - edge[::2]  # of words
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))]))
    # a word's value: its bytes, A-Z lowered, weighed by powers of an odd number
    kept = data[~white].astype(np.uint64)
    kept += np.where((kept >= 65) & (kept <= 90), np.uint64(33), np.uint64(1))
    first = np.cumsum(length) - length
    power = np.cumprod(np.full(int(length.max(initial=1)), _BASE, np.uint64))
    word = _mixed(np.add.reduceat(kept * power[np.arange(len(kept)) - np.repeat(first, length)], first)) if len(first) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        own = word[at : at + n]
        at += n
        k = min(words, n)
        if not k:
            out.append(np.zeros(0, np.int64))
            continue
        value = np.full(n - k + 1, n if n < words else 0, np.uint64)
        for j in range(k):
            value += own[j : n - k + 1 + j] * _ODD[j]
        out.append(np.unique(_mixed(value).view(np.int64)))
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(the rows of the first column, their sets), half a megabyte of text at a time."""
    for batch in batches:
        for part in pieces(batch, 1, 500_000):
            yield part, shingles(part.column(1).cast(pa.binary()).to_pylist(), words)


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def _zone(found: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(found)
    return found[: prefix(n, num, den) + 4 + n // 50]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def _digest(x: np.ndarray) -> bytes:
    return blake2b(x.tobytes(), digest_size=16).digest()


def _keys(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest(x) for x in found], pa.binary()), pa.array([_digest(_zone(x, num, den)) for x in found], pa.binary())], ["doc_id", "n", "set_key", "zone_key"])

    return run


def _zones(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _sets(batches, words):
            zones = [_zone(x, num, den) for x in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest(x) for x in zones], pa.binary()), _longs(zones)], ["doc_id", "n", "zone_key", "zone"])

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _sets(batches, words):
            more = [rows.column(k) for k in range(2, rows.num_columns)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *more, _longs(found)], ["doc_id", *rows.schema.names[2:], "tokens"])

    return run


def _connecting(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links that connect all that is linked between side 0 and side 1 (of one block with itself: side 2)."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(sets)), n)
    token, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(token), -1)
    column[shared] = np.arange(len(shared))
    at = column[inverse]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(at, [c, c + 4096])
        x, y = (np.zeros((len(s), min(4096, len(shared) - c)), dtype=np.float32) for s in (left, right))
        for m, p in ((x, place[0]), (y, place[1])):
            mine = p[owner[lo:hi]] >= 0
            m[p[owner[lo:hi]][mine], at[lo:hi][mine] - c] = 1
        common += x @ y.T
    linked = common.astype(np.int64) * (num + den) >= num * (n[left][:, None] + n[right][None, :])
    parent = list(range(len(sets)))

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    a, b = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        u, v = top(left[i]), top(right[j])
        if u != v:
            parent[u] = v
            a.append(int(ids[left[i]]))
            b.append(int(ids[right[j]]))
    return a, b


def _blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a: list[int] = []
            found_b: list[int] = []
            for row in range(batch.num_rows):
                members = batch.column(0)[row].values
                sets = members.field("tokens")
                values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
                a, b = _connecting(members.field("id").to_numpy(), [values[s:e] for s, e in zip(offsets, offsets[1:])], members.field("side").to_numpy(), num, den)
                found_a += a
                found_b += b
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is stored, with leave to broadcast it if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= most else df


class Join:
    """One run of the join; each method is a step of the plan in the module's description."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
        self.words, self.num, self.den = words, num, den

    def prefix(self, n: str) -> Column:
        return F.col(n) - F.ceil(F.col(n) * self.num / self.den) + 1

    def needed(self, a: str, b: str) -> Column:
        """Common shingles of a link between sets of these sizes."""
        return F.ceil((F.col(a) + F.col(b)) * self.num / (self.num + self.den))

    def run(self) -> DataFrame:
        keys = saved(self.docs.mapInArrow(released(_keys(self.words, self.num, self.den)), "doc_id long, n long, set_key binary, zone_key binary"), "shingle-keys")
        some = keys.filter("n > 0 and doc_id is not null")
        classes = saved(some.groupBy("set_key", "n", "zone_key").agg(F.min("doc_id").alias("rep")), "shingle-classes")
        groups = classes.groupBy("zone_key", "n").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
        members = saved(classes.join(groups, ["zone_key", "n"]).select("gid", "rep", "n", "members"), "shingle-members")
        links = self.links(members)
        found = components(links)
        labels = classes.join(found, F.col("rep") == F.col("node"), "left").select("set_key", "n", F.coalesce("component", "rep").alias("component_id"))
        out = keys.join(labels.withColumnRenamed("n", "_n"), (keys["set_key"] == labels["set_key"]) & (F.col("n") == F.col("_n")) & keys["doc_id"].isNotNull(), "left")
        return out.select(keys["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component_id", keys["doc_id"]).alias("component_id"))

    def indexed(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index rows (token, unit, n) of shingles that several units share; and (unit, token) of hot shingles in prefixes."""
        zones = self.docs.filter("doc_id is not null").mapInArrow(released(_zones(self.words, self.num, self.den)), "doc_id long, n long, zone_key binary, zone array<long>").filter("n > 0")
        zones = saved(zones.groupBy("zone_key", "n").agg(F.min("doc_id").alias("gid"), F.first("zone").alias("zone")).select("gid", "n", "zone"), "shingle-zones")
        rows = zones.select("gid", "n", F.posexplode("zone").alias("pos", "token"))
        total = zones.agg(F.sum(F.size("zone"))).head()[0] or 0
        slots = F.lit(1 << max(18, (total // 4).bit_length()))
        slot = F.pmod("token", slots)
        base = saved(rows.groupBy(slot.alias("slot")).count(), "slot-counts")
        # dense members count with all their shingles, which may make more slots hot and so more members dense, until none is
        whole = None
        while True:
            counts = base if whole is None else base.unionByName(whole.select(F.explode(F.slice("tokens", F.col("zone") + 1, F.size("tokens"))).alias("token")).groupBy(slot.alias("slot")).count()).groupBy("slot").agg(F.sum("count").alias("count"))
            heavy = saved(counts.filter(F.col("count") > HOT).select("slot"), "heavy-slots")
            here = small(heavy)
            hot = saved(rows.join(here, slot == F.col("slot")).groupBy("gid").agg(F.count(F.lit(1)).alias("hot")).withColumnRenamed("gid", "_gid"), "hot-counts")
            units = zones.join(small(hot), F.col("gid") == F.col("_gid"), "left").select("gid", "n", "zone", F.coalesce("hot", F.lit(0)).alias("hot"))
            lacks = F.size("zone") - F.col("hot") < self.prefix("n")
            self.dense = saved(members.join(units.filter(lacks).select(F.col("gid").alias("_gid"), F.size("zone").alias("zone")), F.col("gid") == F.col("_gid")).select("gid", "rep", "n", "zone"), "dense-members")
            new = self.dense.select(F.col("rep").alias("id"), "zone")
            if whole is not None:
                new = saved(new.join(whole.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti"), "dense-new")
            if new.isEmpty():
                break
            more = saved(self.sets(new), "dense-sets")
            whole = more if whole is None else whole.unionByName(more)
        if whole is None:
            whole = self.sets(new)
        # positions among the shingles that aren't hot lie between pos - hot and pos: the former keeps all that may count
        plain = units.filter(~lacks).select("gid", "n", "hot", F.posexplode("zone").alias("pos", "token")).filter(F.col("pos") - F.col("hot") < self.prefix("n"))
        plain = plain.join(here, slot == F.col("slot"), "left_anti").select("token", F.col("gid").alias("unit"), "n")
        hots = whole.select("id", F.explode("tokens").alias("token")).join(here, slot == F.col("slot")).groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("hots"))  # of one document
        hots = hots.withColumnRenamed("id", "_id")
        none = F.array().cast("array<bigint>")
        whole = whole.join(hots, F.col("id") == F.col("_id"), "left").select("id", F.size("tokens").cast("long").alias("n"), F.array_except("tokens", F.coalesce("hots", none)).alias("others"), F.coalesce("hots", none).alias("hots"))
        first = self.prefix("n").cast("int")
        whole = saved(whole.select("id", "n", F.slice("others", F.lit(1), first).alias("others"), F.slice("hots", F.lit(1), F.greatest(first - F.size("others"), F.lit(0))).alias("hots")), "dense-prefixes")
        rows = plain.unionByName(whole.select(F.explode("others").alias("token"), F.col("id").alias("unit"), "n"))
        index = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("df > 1")
        return saved(index, "shingle-index"), saved(whole.select(F.col("id").alias("unit"), F.explode("hots").alias("token")), "hot-prefixes")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """id, tokens of the wanted ids (a stored table of distinct ids, further columns are kept)."""
        more = [c for c in wanted.columns if c != "id"]
        rows = self.docs.join(small(wanted), F.col("doc_id") == F.col("id")).select("doc_id", "text", *more)
        kinds = dict(wanted.dtypes)
        schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in more), "tokens array<long>"])
        return rows.mapInArrow(released(_whole(self.words)), schema).withColumnRenamed("doc_id", "id")

    def links(self, members: DataFrame) -> DataFrame:
        """a, b: links that connect what is linked, between representatives of classes."""
        index, hot = self.indexed(members)
        dense = self.dense.select(F.col("rep").alias("_rep"))
        # of groups indexed as one: unit -> members; dense members are units by themselves
        grouped = members.join(self.dense.select(F.col("rep").alias("_rep")), F.col("rep") == F.col("_rep"), "left_anti").select(F.col("gid").alias("unit"), "rep", "members")
        units = saved(grouped.unionByName(dense.select(F.col("_rep").alias("unit"), F.col("_rep").alias("rep"), F.lit(1).cast("long").alias("members"))), "units")

        a, b = (index.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("unit", "n"))) for s in "ab")
        sizes = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("unit_a") < F.col("unit_b")))
        near = (F.col("n_a") * self.den >= F.col("n_b") * self.num) & (F.col("unit_a") != F.col("unit_b"))
        met = a.join(b, "token").filter(sizes & near).groupBy("unit_a", "unit_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"))
        # of the shingles that a link needs, so many may lie beyond a prefix; the rest is common to both prefixes
        beyond = F.ceil(F.greatest("n_a", "n_b") * self.num / self.den) - 1
        pairs = saved(met.filter(F.col("c") >= self.needed("n_a", "n_b") - beyond).select("unit_a", "unit_b"), "unit-pairs")

        big = units.filter(F.col("members") > MEMBERS)
        few = units.filter(F.col("members") <= MEMBERS)
        u, v = (few.select(F.col("unit").alias(f"unit_{s}"), F.col("rep").alias(s)) for s in "ab")
        crossed = pairs.join(u, "unit_a").join(v, "unit_b").select("a", "b")
        within = few.filter("members > 1")
        within = within.select("unit", F.col("rep").alias("a")).join(within.select("unit", F.col("rep").alias("b")), "unit").filter("a < b").select("a", "b")
        single = saved(crossed.unionByName(within).distinct(), "pairs")

        # families: units around one hot shingle, big groups and what they pair with
        around = hot.join(hot.groupBy("token").agg(F.min("unit").alias("least")), "token").select(F.col("unit").alias("a"), F.col("least").alias("b"))
        large = big.select(F.col("unit").alias("_big")).distinct()
        paired = pairs.join(large, F.col("unit_a") == F.col("_big"), "left_semi").unionByName(pairs.join(large, F.col("unit_b") == F.col("_big"), "left_semi"))
        edges = around.unionByName(paired.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")))
        families = components(edges).unionByName(large.select(F.col("_big").alias("node"), F.col("_big").alias("component")))
        families = families.groupBy("node").agg(F.min("component").alias("family"))  # a big group is in its component, if it has one
        sized = members.select(F.col("rep").alias("id"), "n")
        family = families.join(units, F.col("node") == F.col("unit")).select(F.col("rep").alias("id"), "family").distinct().join(sized, "id")
        found = self.in_blocks(saved(self.dealt(family), "families"))

        # pairs of one component travel together where each document then is sent less often than once for each pair
        cluster = self.dealt(components(single).select(F.col("node").alias("id"), F.col("component").alias("family")).join(sized, "id"))
        of_pairs = single.join(cluster.select("id", "family"), F.col("a") == F.col("id")).groupBy("family").agg(F.count(F.lit(1)).alias("pairs"))
        cluster = saved(cluster.join(of_pairs, "family").withColumn("together", F.col("docs") * F.col("whole") <= 2 * F.col("pairs")), "clusters")
        found = found.unionByName(self.in_blocks(cluster.filter("together")))
        apart = cluster.filter("not together").select("id")
        found = found.unionByName(self.verified(single.join(apart, F.col("a") == F.col("id"), "left_semi")))
        return saved(found, "jaccard-links")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link. Each document sends its set to its pairs."""
        roles = saved(pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b"), "pair-roles")
        both = self.sets(roles).groupBy("a", "b").agg(F.collect_list("tokens").alias("two"))  # of two documents
        x, y = F.element_at("two", 1), F.element_at("two", -1)
        common = F.size(F.array_intersect(x, y))
        return both.filter(common * (self.num + self.den) >= (F.size(x) + F.size(y)) * self.num).select("a", "b")

    def dealt(self, family: DataFrame) -> DataFrame:
        """family (id, family, n) with docs, whole (blocks that all of it would fill), band, block: families of one document go."""
        fill = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
        sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), fill().alias("whole")).filter("docs > 1")
        # linked sizes are a factor of den / num apart at most, less than the width of a band
        band = F.floor(F.log(F.col("n")) / math.log(self.den / self.num * 1.001)).cast("int") if self.num < self.den else F.col("n").cast("int")
        rows = saved(family.join(sizes, "family").withColumn("band", F.when(F.col("whole") > 1, band).otherwise(0)), "dealt")
        bands = rows.groupBy("family", "band").agg(fill().alias("blocks"))
        rows = rows.join(bands, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        near = [bands.select("family", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((1, "lower"), (-1, "upper"))]
        for other in near:
            rows = rows.join(other, ["family", "band"], "left")
        none = F.lit(0)
        return rows.select("id", "family", "docs", "whole", "band", "block", "blocks", F.coalesce("lower", none).alias("lower"), F.coalesce("upper", none).alias("upper"))

    def in_blocks(self, dealt: DataFrame) -> DataFrame:
        """Links within families, as dealt() gives them, that connect what is linked there."""
        up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

        def task(low: Column, i: Column, high: Column, j: Column, side: Column) -> Column:
            return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))

        band, block = F.col("band"), F.col("block")
        side = lambda x: F.when(block == x, 2).when(block < x, 0).otherwise(1)
        tasks = F.concat(
            F.transform(up_to("blocks"), lambda x: task(band, F.least(block, x), band, F.greatest(block, x), side(x))),
            F.transform(up_to("upper"), lambda x: task(band, block, band + 1, x, F.lit(0))),
            F.transform(up_to("lower"), lambda x: task(band - 1, x, band, block, F.lit(1))),
        )
        sets = self.sets(saved(dealt.select("id", "family", tasks.alias("tasks")), "block-tasks"))
        rows = sets.withColumn("t", F.explode("tasks")).select("family", "t.low", "t.i", "t.high", "t.j", F.struct("id", F.col("t.side").alias("side"), "tokens").alias("one"))
        pairs = rows.groupBy("family", "low", "i", "high", "j").agg(F.collect_list("one").alias("members"))  # two blocks
        return pairs.select("members").mapInArrow(released(_blocks(self.num, self.den)), "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id. Sets link at a Jaccard similarity of num / den or more."""
    return Join(docs, doc_id, text, words, num, den).run()


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS other FROM r GROUP BY 1) m ON m.node = d.doc_id
"""
