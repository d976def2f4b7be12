"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source gets the same fractional number of copies, target / size of the source, at most CAP. The whole
part is certain; the fractions are rounded dependently. Two fractional documents meet: words move from one to the other,
in a random direction chosen so that expectations hold, until one has 0 or 1 extra copy; the other goes on. The words
of a source so stay at its target exactly, but for the last fraction, which goes to the nearer whole: at most half
of one document's words are missed.

Distribution: documents are dealt by a hash of doc_id, and of their number among equal rows, into groups of about GROUP
within their source, whatever the share of a source or of one repeated (or null) doc_id. Each group is folded in one row of bounded length and leaves one fraction at most; the fractions are dealt into
groups again, until each source has one group: a reduction tree of log(n) / log(GROUP) levels. Draws are hashes of the
seed and the documents that meet, and groups are folded from the longest document to the shortest, so reruns agree. A
source's last group is drawn ATTEMPTS times, and the draw that leaves the fewest words to round stands.

Sources are ranked by code point over range partitions (no single task holds them all); weights repeat by rank.

Defined results: null text has size 0; null source is a source of its own, last; documents of size 0 take 0 words;
repeated rows count each; a source of size 0 has target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
GROUP = 100
SEED = 20240501
#: Draws of the last group of a source, of which the one with the least to round stands.
ATTEMPTS = 16
#: Fractions nearer than this to 0 or 1 are whole.
EPS = 1e-9


def sizes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size: the number of words."""
    body = text_of(text)
    # each word starts where white space, or nothing, stands before it
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point with null last: ranges are sorted each by itself, then offset by the rows before."""
    order = F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("~"))  # the order of UTF-8 bytes is that of code points
    rows = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    rows = saved(rows, "mix-sources")
    part = F.shiftright("_at", 33)
    # one row for each partition that holds sources: far fewer than sources
    parts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_part", part).join(before, "_part")
    return rows.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target, for each source."""
    rows = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    rows = saved(rows.select("source", "source_size", "n", weight.alias("weight")), "mix-targets")
    total = rows.agg(F.sum("source_size")).head()[0] or 0
    # sources whose share is above their cap stop there; what is left is shared by weight among the others, until none is above
    level, capped = None, 0
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * cap
        got = rows.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).head()
        if level is not None and (got[2] == capped or not got[1]):
            break
        capped = got[2]
        level = (share * total - (got[0] or 0.0)) / got[1] if got[1] else 0.0
    full = F.col("weight") * level > F.col("source_size") * cap
    return rows.select("source", "source_size", "n", F.when(full, F.col("source_size") * cap).otherwise(F.col("weight") * level).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / float(1 << 53)


def _put(x: Column, p: Column) -> Column:
    return F.struct(x["order"].alias("order"), x["draw"].alias("draw"), x["id"].alias("id"), x["size"].alias("size"), p.alias("p"))


def _met(carry: Column, other: Column, level: int, attempt: Column) -> Column:
    """The carried fraction meets another: struct(carry, done), done being whole."""
    # room to move words from the carried one (down) and to it (up)
    down = F.least(carry["p"] * carry["size"], (1.0 - other["p"]) * other["size"])
    up = F.least((1.0 - carry["p"]) * carry["size"], other["p"] * other["size"])
    # falls by `down` with chance up / (up + down): expectations hold
    falls = _uniform(carry["id"], carry["draw"], other["id"], other["draw"], F.lit(level), attempt) * (up + down) < up
    moved = F.when(falls, -down).otherwise(up)
    p = carry["p"] + moved / carry["size"]
    q = other["p"] - moved / other["size"]
    # the one nearer to whole is done
    first = F.least(F.abs(p), F.abs(1.0 - p)) * carry["size"] <= F.least(F.abs(q), F.abs(1.0 - q)) * other["size"]
    return F.when(first, F.struct(_put(other, q).alias("carry"), _put(carry, F.round(p)).alias("done"))).otherwise(F.struct(_put(carry, p).alias("carry"), _put(other, F.round(q)).alias("done")))


def _reduced(rows: DataFrame, level: int) -> DataFrame:
    """One level of the tree. rows: source, n, group, alone, order, draw, id, size, p. Gives source, n, group, done (array), carry."""
    item = F.struct("order", "draw", "id", "size", "p")
    groups = rows.groupBy("source", "n", "group", "alone").agg(F.array_sort(F.collect_list(item)).alias("items"))  # about GROUP of them
    none = F.array().cast("array<struct<order:double,draw:bigint,id:bigint,size:double,p:double>>")

    def attempt(r: Column) -> Column:
        def step(state: Column, other: Column) -> Column:
            carry = state["carry"]
            whole = (carry["p"] < EPS) | (carry["p"] > 1.0 - EPS)
            passed = F.struct(_put(other, other["p"]).alias("carry"), _put(carry, F.round(carry["p"])).alias("done"))
            # an aggregate over one element binds the outcome, so that it's evaluated once
            once = F.array(F.when(whole, passed).otherwise(_met(carry, other, level, r)))
            return F.aggregate(once, F.struct(carry.alias("carry"), state["done"].alias("done")), lambda s, d: F.struct(d["carry"].alias("carry"), F.array_append(s["done"], d["done"]).alias("done")))

        first = F.element_at("items", 1)
        return F.aggregate(F.slice("items", F.lit(2), F.size("items")), F.struct(_put(first, first["p"]).alias("carry"), none.alias("done")), step)

    # where the group is the whole of its source, the attempt that leaves the fewest words to round stands
    attempts = F.transform(F.sequence(F.lit(1), F.when(F.col("alone"), F.lit(ATTEMPTS)).otherwise(F.lit(1))), attempt)
    left = lambda s: F.least(s["carry"]["p"], 1.0 - s["carry"]["p"]) * s["carry"]["size"]
    best = F.array_min(F.transform(attempts, lambda s, k: F.struct(left(s).alias("left"), k.alias("k"), s.alias("state"))))
    return groups.select("source", "n", "group", best["state"].alias("state"))


def mix(sizes: DataFrame, shares: DataFrame, group: int = GROUP) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken.

    sizes: doc_id, source, size. shares: source, source_size, n, target, as targets() gives them.
    """
    shares = shares.select(F.col("source").alias("_source"), "source_size", "n", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    shares = shares.withColumn("floor", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.col("rate") - F.col("floor"), F.lit(0.0)))
    # equal rows are numbered, so that they part: which of them has which number makes no difference
    equal = sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    rows = equal.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    groups = F.ceil(F.col("n") / group)
    split = (F.col("size") > 0) & (F.col("p") > EPS)
    alone = lambda level: F.col("n") <= group ** (level + 1)
    item = rows.filter(split).select("source", "n", alone(0).alias("alone"), (-F.col("size")).cast("double").alias("order"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "again", F.lit(SEED)), groups).alias("group"), F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "again").alias("draw"), F.col("doc_id").cast("long").alias("id"), F.col("size").cast("double").alias("size"), "p")
    whole = rows.filter(~split).select("source", F.col("doc_id").cast("long").alias("doc_id"), "size", F.lit(0.0).alias("extra"))
    largest = shares.agg(F.max("n")).head()[0] or 0
    parts, level, left = [whole], 0, math.ceil(largest / group)
    while True:
        states = saved(_reduced(item, level), "mix-level")
        done = states.select("source", F.explode("state.done").alias("x"))
        parts.append(done.select("source", F.col("x.id").alias("doc_id"), F.col("x.size").cast("long").alias("size"), F.col("x.p").alias("extra")))
        carried = states.select("source", "n", "group", "state.carry.*")
        if left <= 1:
            break
        level, left = level + 1, math.ceil(left / group)
        item = carried.withColumns({"group": F.floor(F.col("group") / group), "alone": alone(level)})
    # the last fraction of a source: to the nearer whole
    parts.append(carried.select("source", F.col("id").alias("doc_id"), F.col("size").cast("long").alias("size"), F.round("p").alias("extra")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.join(shares.drop("n", "rate", "p"), F.col("source").eqNullSafe(F.col("_source")))
    copies = (F.col("floor") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """mix() for the documents themselves."""
    sizes = saved(sizes_of(docs, doc_id, text, source), "mix-sizes")
    return mix(sizes, targets(sizes))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs, each row as many times as mixed has copies of its doc_id (the most, where an id is repeated)."""
    taken = mixed.filter("copies > 0").groupBy(F.col("doc_id").alias("_of")).agg(F.max("copies").cast("int").alias("_copies"))
    rows = docs.join(taken, F.col(doc_id).eqNullSafe(F.col("_of")))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
