"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are integers. A block of candidates is indexed by impact: its posting segments are the components whose
magnitude has the same number of bits, for all dimensions. For a block of queries the segments are processed by
descending impact. While few bits are left, what is missing of a score is bounded either way: by the length of the rest
of the candidate times the length of the query over the dimensions of that rest (Cauchy-Schwarz). A candidate whose upper
bound stays under the k-th best lower bound (of this block or of results so far) cannot be a member.
Processing stops once few enough candidates are possible, which the bounds prove, and those are rescored exactly. Where
the bounds prove nothing, all segments are processed and the scores are exact by themselves.

Distribution: queries (a stated set) and candidates are dealt into blocks of bounded size, row by row, so repeated ids
do not gather. Each query block meets each slot of candidates once, in one task, to which both travel as single rows;
nothing is broadcast. Query blocks are the larger ones, since candidates travel once for each of them, and queries once
for each slot. A task keeps the queries of the block it is at, one block of candidates and the k best so far, so that it
returns k rows for each query and slot, and their best are ranked at the end.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
missing components of shorter vectors count as 0; rows with the query's own id are not its candidates; of repeated query
ids the least vector is asked; repeated candidates count each; ties go to the smaller id; fewer candidates than k give
all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, released, saved

K = 20
#: Candidates and queries of a block.
BLOCK, ASKED = 4096, 16_384
#: Queries scored at a time within a block.
STRIP = 512
#: Possible members are rescored once they are so small a share of a block.
FEW = 0.02
#: Bounds are asked for once no more than so many segments are left.
LATE = 2


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    v = F.col(embedding)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def segments(block: np.ndarray) -> list[np.ndarray]:
    """The block's components by descending bits of their magnitude; what is not in a segment is 0 there."""
    bits = np.ceil(np.log2(np.abs(block) + 1)).astype(np.int64)
    return [np.where(bits == b, block, 0) for b in range(int(bits.max(initial=0)), 0, -1) if (bits == b).any()]


def best(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int, stops: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place) the ids and exact scores of all that may be among its k best; floor: scores below it cannot.

    stops: "strips" and "stopped" count the strips of queries, and those that proved a stop before the last segment.
    """
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * block.shape[1]
    if largest >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    kind = np.float32 if largest < 2.0**24 else np.float64
    parts = segments(block)
    late = range(max(0, len(parts) - 1 - LATE), len(parts) - 1)
    rests = {}  # after a segment: the length of each candidate's rest, and the dimensions where it is
    for n in late:
        rest = sum(parts[n + 1 :]).astype(np.float32)
        rests[n] = np.sqrt((rest.astype(np.float64) ** 2).sum(1)).astype(np.float32) * np.float32(1.0001), (rest != 0).astype(np.float32).T
    parts = [p.astype(kind).T for p in parts]
    for at in range(0, len(queries), STRIP):
        q = queries[at : at + STRIP].astype(kind)
        squares = q.astype(np.float32) ** 2
        own = query_ids[at : at + STRIP, None] == ids[None, :]
        low = floor[at : at + STRIP].astype(np.float64)
        scores = np.zeros((len(q), block.shape[0]), kind)
        possible, whole = ~own, False
        for n, part in enumerate(parts):
            scores += q @ part
            if n in rests:
                length, where = rests[n]
                slack = np.sqrt(squares @ where) * np.float32(1.0001) * length + np.float32(1e-3)
                if len(ids) > k:
                    lower = np.where(own, -np.inf, scores - slack)
                    low = np.maximum(low, np.partition(lower, -k, axis=1)[:, -k])
                possible = ~own & (scores + slack >= low[:, None])
                if possible.mean() <= FEW:
                    break
        else:
            whole, possible = True, ~own
            if len(ids) > k:
                low = np.maximum(low, np.partition(np.where(own, -np.inf, scores), -k, axis=1)[:, -k])
        if stops is not None:
            stops["strips"] = stops.get("strips", 0) + 1
            stops["stopped"] = stops.get("stopped", 0) + (not whole)
        for j in range(len(q)):
            some = np.flatnonzero(possible[j] & (scores[j] >= low[j])) if whole else np.flatnonzero(possible[j])
            exact = block[some] @ queries[at + j]
            yield at + j, ids[some], exact


def _dense(lists: pa.ListArray) -> np.ndarray:
    """Rows of int64, padded by zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _joined(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all runs, padded to the widest."""
    if len(runs) == 1:
        return runs[0]
    width = max(x[1].shape[1] for x in runs)
    return np.concatenate([x[0] for x in runs]), np.concatenate([np.pad(x[1], ((0, 0), (0, width - x[1].shape[1]))) for x in runs])


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def _searched(k: int, size: int):
    """Over rows (q, slot, candidate, vec_id, v), each (q, slot) in one run with its queries first: the k best of each query in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        asked: list[tuple[np.ndarray, np.ndarray]] = []  # ids and vectors of the run's queries, as they come
        there: list[tuple[np.ndarray, np.ndarray]] = []  # of candidates that were not searched yet
        found: list[tuple[np.ndarray, np.ndarray]] = []  # for each query the ids and scores so far

        def search() -> None:
            nonlocal asked, there, found
            if asked and there:
                asked, there = [_joined(asked)], [_joined(there)]
                (query_ids, queries), (ids, block) = asked[0], there[0]
                found = found or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
                queries, block = _widened(queries, block)
                floor = np.array([x[1][-1] if len(x[1]) >= k else -(2**62) for x in found], dtype=np.int64)
                for j, some, scores in best(queries, query_ids, block, ids, floor, k):
                    some, scores = np.concatenate([found[j][0], some]), np.concatenate([found[j][1], scores])
                    order = np.lexsort((some, -scores))[:k]
                    found[j] = some[order], scores[order]
            there = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal asked, found
            search()
            if found:
                counts = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(asked[0][0], counts), pa.int64()), "vec_id": pa.array(np.concatenate([x[0] for x in found]), pa.int64()), "score": pa.array(np.concatenate([x[1] for x in found]), pa.int64())})
            asked, found = [], []

        for batch in batches:
            q, slot, candidate = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
            cuts = np.flatnonzero((np.diff(q) != 0) | (np.diff(slot) != 0) | (np.diff(candidate.astype(np.int8)) != 0)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(q)]):
                if to == at:
                    continue
                if place != (q[at], slot[at]):
                    yield from flush()
                    place = q[at], slot[at]
                while at < to:
                    n = min(to - at, size - sum(len(x[0]) for x in there)) if candidate[at] else to - at
                    rows = batch.slice(at, n)
                    (there if candidate[at] else asked).append((rows.column(3).to_numpy(), _dense(rows.column(4))))
                    at += n
                    if sum(len(x[0]) for x in there) >= size:
                        search()
        yield from flush()

    return run


def top_k(rows: DataFrame, asked: DataFrame, k: int = K, block: int = BLOCK, block_asked: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score. rows, asked: vec_id, v (array of long)."""
    spark = rows.sparkSession
    asked = saved(asked.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    rows = saved(rows, "topk-candidates")
    here, there = max(1, -(-asked.count() // block_asked)), max(1, -(-rows.count() // block))
    slots = min(there, max(1, partitions(spark) // here))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select(dealt(here).alias("q"), F.lit(False).alias("candidate"), "vec_id", "v").select("q", every(slots).alias("slot"), "candidate", "vec_id", "v")
    c = rows.select(dealt(slots).alias("slot"), F.lit(True).alias("candidate"), "vec_id", "v").select(every(here).alias("q"), "slot", "candidate", "vec_id", "v")
    # both sides travel as rows to the one task of their (q, slot)
    met = q.unionByName(c).repartitionById(here * slots, F.col("q") * slots + F.col("slot")).sortWithinPartitions("q", "slot", "candidate")
    found = met.mapInArrow(released(_searched(k, block)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
