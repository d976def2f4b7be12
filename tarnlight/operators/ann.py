"""Vector search over cells around sampled centres and codes of one and of eight bits a component, with exact rescoring of all that may be among the best.

The first candidates are the nearest cells' best by their codes ("int8", or "bit": the signs, compared by Hamming
distance). Every row whose eight-bit code leaves room for a score as good as the k-th of those is rescored exactly.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 16
SAMPLE = 20_000
#: Signs that one number holds.
SIGNS = 62
#: Queries asked in one pass over the rows, and the numbers that they hold at most; rows and queries scored at a time.
ASKED, NUMBERS, ROWS, STRIP = 8192, 1 << 20, 1024, 512


@dataclass(frozen=True)
class VectorIndex:
    """Where a field's codes are stored, and how a search goes about them."""

    path: str
    centres: np.ndarray
    probes: int = 4
    candidates: int = 100
    quant: str = "int8"


def build(rows: DataFrame, field: str, folder: str, cells: int = CELLS, **options) -> VectorIndex:
    """rows: id and the field. Rows are clustered by cell."""
    found = centres(rows, field, cells)
    path = f"{folder}/{uuid.uuid4().hex}"
    coded = indexed(rows.select("id", field).filter(F.col(field).isNotNull()), field, found)
    coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(path)
    return VectorIndex(path, found, **options)


def centres(rows: DataFrame, field: str, cells: int = CELLS, seed: int = 7) -> np.ndarray:
    """Centres by a few rounds of k-means over a bounded sample."""
    got = rows.select(field).filter(F.col(field).isNotNull()).orderBy(F.xxhash64(field)).limit(SAMPLE).collect()
    x = np.array([r[0] for r in got], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        near = np.argmin(((x[:, None, :] - c[None]) ** 2).sum(2), axis=1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def indexed(rows: DataFrame, field: str, found: np.ndarray) -> DataFrame:
    """Adds cell, the nearest centre, and code, the vector in steps of an eighth bit of its largest component."""
    v = F.col(field)
    far = F.array(*(F.struct(vectors.l2(v, F.array(*(F.lit(float(y)) for y in c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(found)))
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    code = F.transform(v, lambda x: F.when(top > 0, F.round(x / top * 127)).otherwise(0).cast("byte"))
    return rows.withColumns({"cell": F.array_min(far)["k"], "code": code, "scale": (top / 127).cast("float"), "signs": signs(v)})


def signs(v: Column) -> Column:
    """The signs of the components, SIGNS to a number."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / SIGNS).cast("int") - 1, F.lit(0))), lambda c: F.slice(v, c * SIGNS + 1, SIGNS))
    return F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, x: F.shiftleft(t, 1) + (x > 0).cast("bigint")))


def signs_of(v: np.ndarray) -> list[int]:
    return [int("".join("1" if x > 0 else "0" for x in v[k : k + SIGNS]) or "0", 2) for k in range(0, len(v), SIGNS)]


def search(rows: DataFrame, field: str, found: np.ndarray, query: list[float], k: int, probes: int = 4, candidates: int = 100, metric: str = "cosine", complete: bool = True, quant: str = "int8") -> DataFrame:
    """id, _score of the k best: the nearest cells, their best by code, rescored exactly; then every row, of any cell, whose code leaves room for a score as good as the k-th of those. complete=False stops before that and may miss some. rows: as indexed() gives them."""
    q = np.array(query, dtype=np.float64)
    cells = [int(c) for c in np.argsort(((found - q) ** 2).sum(1))[:probes]]
    column = F.array(*(F.lit(float(x)) for x in query))
    better = (lambda c: F.asc(c)) if metric == "l2" else (lambda c: F.desc(c))
    coded = F.transform("code", lambda x: x * F.col("scale"))
    exact = vectors.SCORES[metric](F.col(field), column).alias("_score")
    rows = rows.filter(F.col(field).isNotNull()).withColumn("_rough", vectors.SCORES[metric](coded, column))
    some = rows.filter(F.col("cell").isin(cells))
    if quant == "bit":
        own = F.array(*(F.lit(x).cast("bigint") for x in signs_of(q)))
        apart = F.aggregate(F.zip_with("signs", own, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        some = some.orderBy(apart, "id").limit(max(candidates, k))
    else:
        some = some.orderBy(better("_rough"), "id").limit(max(candidates, k))
    some = some.select("id", exact).orderBy(better("_score"), "id").limit(k)
    if not complete:
        return some
    # a component is at most half a step from its code; the last factor is for rounding
    off = F.sqrt(F.size("code").cast("double")) * F.col("scale") * 0.5001
    if metric == "cosine":  # two unit vectors' distance; a vector that is all but its own error may have any score
        size = vectors.norm(coded)
        room = F.when(size > off, 2 * off / (size - off)).otherwise(2.0) + 1e-9
    else:
        room = off * (float(np.linalg.norm(q)) if metric == "dot" else 1.0) + 1e-9 * (F.abs("_rough") + 1)
    worst = some.agg((F.max if metric == "l2" else F.min)("_score").alias("_kth"), F.count("_score").alias("_n"))
    may = (F.col("_rough") - room <= F.col("_kth")) if metric == "l2" else (F.col("_rough") + room >= F.col("_kth"))
    rest = rows.crossJoin(F.broadcast(worst)).filter((F.col("_n") < k) | F.coalesce(may, F.lit(True)))  # one row
    return rest.select("id", exact).orderBy(better("_score"), "id").limit(k)


def recall(exact: DataFrame, found: DataFrame) -> float:
    """The share of exact ids that were found."""
    n = exact.count()
    return exact.join(found, "id", "left_semi").count() / n if n else 1.0


# many queries
class Best:
    """The k best rows of each of n queries (the highest key, then the least id) of pairs that come in portions."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)  # a key below it is not among the k best
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, q: np.ndarray, ids: np.ndarray, key: np.ndarray, exact: np.ndarray) -> None:
        self.new.append((q, ids, key, exact))
        self.waiting += len(q)
        if self.waiting > self.n * self.k:
            self.settle()

    def settle(self) -> tuple:
        q, ids, key, exact = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -key, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], np.arange(self.n))[q[order]]
        last = order[place == self.k - 1]
        self.floor[q[last]] = key[last]
        order = order[place < self.k]
        self.held, self.new, self.waiting = (q[order], ids[order], key[order], exact[order]), [], 0
        return self.held


class Vectors:
    """Vectors of one size: their lengths, added up in the order of the components as the column expressions do."""

    def __init__(self, x: np.ndarray):
        self.x, self.t = x, np.ascontiguousarray(x.T)
        self.square = np.zeros(len(x))
        for c in self.t:
            self.square += c * c
        self.norm = np.sqrt(self.square)

    def keys(self, other: Vectors, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
        """The scores of the pairs of rows i and the other's rows j, as vectors.SCORES gives them; of l2 their negative. NaN is the largest score."""
        total = np.zeros(len(i))
        for a, b in zip(self.t, other.t, strict=True):
            total += (a[i] - b[j]) ** 2 if metric == "l2" else a[i] * b[j]
        if metric == "l2":
            return np.nan_to_num(-np.sqrt(total), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        if metric == "cosine":
            size = self.norm[i] * other.norm[j]
            total = np.where(size == 0, 0.0, total / np.where(size == 0, 1.0, size))
        return np.nan_to_num(total, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def bounds(self, other: Vectors, strip: slice, metric: str) -> np.ndarray:
        """For every row and the other's rows of a strip at least the key, and hardly more: a product adds up in another order. NaN where that says nothing."""
        total = self.x @ other.t[:, strip]
        if metric == "l2":
            both = self.square[:, None] + other.square[None, strip]
            return -np.sqrt(np.maximum(both * (1 - 1e-12) - 2 * total, 0))
        size = self.norm[:, None] * other.norm[None, strip]
        if metric == "dot":
            return total + 1e-12 * size
        return np.where(size == 0, 0.0, total / np.where(size == 0, 1.0, size)) + 1e-12


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if len(column) and pa.compute.min_max(pa.compute.list_value_length(column)).as_py() != {"min": size, "max": size}:
        raise ValueError("vectors of different dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _best(rows: DataFrame, field: str, asked: np.ndarray, k: int, metric: str, probed: np.ndarray | None = None, least: np.ndarray | None = None) -> DataFrame:
    """place (of a query), id, key, exact of its k best rows, in one pass that holds k rows for each query in a task.

    probed: by query and cell, whether its rows count; they are ranked by their codes. least: by query, the key that a row's
    code has to leave room for. Without both every row is ranked by its vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = Vectors(asked), Best(len(asked), k)
        size = asked.shape[1]
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    ids = some["id"].to_numpy(zero_copy_only=False)
                    own = Vectors(_matrix(some[field], size).astype(np.float64))
                    coded = own
                    if probed is not None or least is not None:
                        scale = some["scale"].to_numpy(zero_copy_only=False)
                        coded = Vectors(_matrix(some["code"], size).astype(np.float64) * scale.astype(np.float64)[:, None])
                    for to in range(0, len(asked), STRIP):
                        strip = slice(to, to + STRIP)
                        bound = coded.bounds(queries, strip, metric)
                        if least is not None:
                            may = ~(bound + _room(coded.norm, scale.astype(np.float64), size, bound, queries.norm[None, strip], metric) < least[None, strip])
                        else:
                            may = ~(bound < best.floor[None, strip])
                        if probed is not None:
                            may &= probed[strip][:, some["cell"].to_numpy(zero_copy_only=False)].T
                        i, j = np.nonzero(may)
                        j += to
                        exact = own.keys(queries, i, j, metric)
                        key = exact if probed is None else coded.keys(queries, i, j, metric)
                        fit = key >= best.floor[j]
                        best.add(j[fit], ids[i[fit]], key[fit], exact[fit])
            q, ids, key, exact = best.settle()
        for at in range(0, len(q), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(q[part].astype(np.int32)), pa.array(ids[part]), pa.array(key[part]), pa.array(exact[part])], ["place", "id", "key", "exact"])

    columns = ["id", field, *(["code", "scale"] if probed is not None or least is not None else []), *(["cell"] if probed is not None else [])]
    rows = rows.filter(F.forall(field, lambda x: x.isNotNull())).select(*columns)
    kind = rows.schema["id"].dataType.simpleString()
    return ranked(rows.mapInArrow(run, f"place int, id {kind}, key double, exact double"), "key", k)


def _room(norm: np.ndarray, scale: np.ndarray, size: int, bound: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """What an exact score may differ from that of the code; see search()."""
    off = (np.sqrt(size) * scale * 0.5001)[:, None]
    if metric == "cosine":
        norm = norm[:, None]
        return np.where(norm > off, 2 * off / np.where(norm > off, norm - off, 1.0), 2.0) + 1e-9
    return off * (queries if metric == "dot" else 1.0) + 1e-9 * (np.abs(bound) + 1)


def ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc(key), "id")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def _portions(asked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, min(ASKED, NUMBERS // max(1, asked.shape[1])))
    for at in range(0, len(asked), step):
        yield at, asked[at : at + step]


def _over(asked: np.ndarray, one: Callable[[np.ndarray], DataFrame], metric: str) -> DataFrame:
    """query (its place in asked), id, _score of the passes over portions of the queries."""
    out = None
    for at, some in _portions(asked):
        score = -F.col("exact") if metric == "l2" else F.col("exact")
        part = one(some).select((F.col("place") + F.lit(at)).alias("query"), "id", score.alias("_score"))
        out = part if out is None else out.unionByName(part)
    return out


def search_many(rows: DataFrame, field: str, found: np.ndarray, asked: np.ndarray, k: int, probes: int = 4, candidates: int = 100, metric: str = "cosine", complete: bool = True) -> DataFrame:
    """query, id, _score: what search() finds for each vector of asked, by the eight-bit codes.

    The rows are passed over twice for each portion of the queries (ASKED), once where complete is False; the k-th scores
    of a portion come to the driver in between. Vectors that hold a null take no part.
    """

    def one(q: np.ndarray) -> DataFrame:
        cells = np.array([np.argsort(((found - x) ** 2).sum(1))[:probes] for x in q])
        probed = np.zeros((len(q), len(found)), bool)
        np.put_along_axis(probed, cells, True, 1)
        some = ranked(_best(rows, field, q, max(candidates, k), metric, probed=probed), "exact", k)
        if not complete:
            return some
        least = np.full(len(q), -np.inf)
        for r in some.groupBy("place").agg(F.min("exact").alias("kth"), F.count("exact").alias("n")).collect():  # a row for each query of the portion
            if r.n >= k:
                least[r.place] = r.kth
        return _best(rows, field, q, k, metric, least=least)

    return _over(asked, one, metric)


def exact_many(rows: DataFrame, field: str, asked: np.ndarray, k: int, metric: str = "cosine") -> DataFrame:
    """query, id, _score: the k best of all rows for each vector of asked, by their vectors alone."""
    return _over(asked, lambda q: _best(rows, field, q, k, metric), metric)
