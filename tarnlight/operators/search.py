"""Ranked reads: BM25, exact and sparse vectors, points, reciprocal rank fusion and reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError, TypeMismatch
from ..functions import geo, vectors
from ..functions.text import allowed, counts_of, edits, terms, terms_of
from ..plans.ast import Fuse, Match, Near, Rerank
from ..plans.expr import Scope, sparse_value
from . import ann, text_index

#: Fixed values of the ranking: saturation, length norm, weights of variants by distance, the share of a word's own floor.
K1, B = 0.9, 0.4
VARIANT_WEIGHTS = (1.0, 1.0, 0.25)
BELOW = 0.99
MOST_VARIANTS = 10_000


@dataclass
class Ranked:
    rows: DataFrame  # id, _score
    best_first: bool  # is a higher score better?
    terms: set[str]


def bm25(scope: Scope, collection: DataFrame, allowed_rows: DataFrame | None, m: Match, within: bool = False, k: int | None = None) -> Ranked:
    """id, _score of the rows that hold a term. collection: all rows, over which statistics are made; allowed_rows: ids that may answer.

    k: only the k best are asked for. An index of the field answers, unless the statistics are of allowed rows only.
    """
    query = scope.value(m.text)
    if not isinstance(query, str):
        raise TypeMismatch("match takes a text")
    options = scope.collection.text.get(m.field.text, {})
    single = bool(options.get("chars"))
    k1, b = options.get("k1", K1), options.get("b", B)
    words = terms(query, single)
    if not words:
        raise QueryError("the text holds no term")
    if within and allowed_rows is not None:
        collection = collection.join(allowed_rows, "id", "left_semi")
    index = None if within else scope.collection.text_index.get(m.field.text)
    parsed_of = lambda: text_index.with_beginnings(terms_of(F.col("_text"), single), options)
    wanted: dict[str, list[tuple[str, int]]] = {}  # a query word -> its variants and their distances
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w in counts:
        wanted[w] = [(w, 0)]
    last = words[-1] if m.prefix else None
    if last and options.get("prefix") and options.get("prefix_min", 3) <= len(last) <= options["prefix"]:
        # the index holds beginnings as terms: no dictionary is walked
        wanted[last].append((f"^{last}", 1))
        last = None
    spark = collection.sparkSession
    if m.fuzzy or last:
        dictionary = index.terms(spark).select(F.col("term").alias("t")) if index else spread(collection.select("id", scope.field(m.field).as_kind("text").alias("_text"))).select(F.explode(parsed_of()).alias("t")).distinct()
        for w, more in _variants(dictionary, counts, last, m.fuzzy or 0).items():
            wanted[w] += more
    # a word's variants of one distance count as one
    groups = [(w, d, text_index.Group(sorted(t for t, e in wanted[w] if e == d))) for w in counts for d in sorted({e for _, e in wanted[w]})]
    found = {t for _, _, g in groups for t in g.terms}

    def weigh(n: int) -> None:
        idf = lambda g: math.log(1 + (n - g.rows + 0.5) / (g.rows + 0.5))
        for w, d, g in groups:
            g.weight = counts[w] * idf(g) * VARIANT_WEIGHTS[d]
            own = next(x for v, e, x in groups if v == w and e == 0)
            if d and own.rows:  # a variant stays below what the word itself gives at its least
                g.weight = min(g.weight, counts[w] * idf(own) * VARIANT_WEIGHTS[d] * BELOW)

    if index:
        only = [g for _, _, g in groups]
        return Ranked(text_index.scored(spark, index, only, lambda _: weigh(index.n), k1, b, allowed_rows, k), True, found)
    texts = spread(collection.select("id", scope.field(m.field).as_kind("text").alias("_text")))
    only = [g.terms for _, _, g in groups]

    def counted(holding: bool) -> DataFrame:
        if not options.get("prefix"):
            return counts_of(texts, only, single, holding)
        parsed = texts.select("id", parsed_of().alias("_terms"))
        return parsed.select("id", F.size("_terms").alias("_length"), *(F.size(F.filter(F.col("_terms"), _among(g))).alias(f"_f{j}") for j, g in enumerate(only)))

    # statistics are of all rows; scores then of those that may hold a term
    stats = counted(False).agg(F.count(F.lit(1)).alias("n"), F.avg("_length").alias("avg"), *(F.count(F.when(F.col(f"_f{j}") > 0, 1)).alias(f"d{j}") for j in range(len(groups)))).head()
    rows = counted(True)
    average = max(1.0, stats["avg"] or 1.0)
    for j, (_, _, g) in enumerate(groups):
        g.rows = stats[f"d{j}"]
    weigh(stats["n"])
    total, held = F.lit(0.0), F.lit(False)
    for j, (_, _, g) in enumerate(groups):
        tf = F.col(f"_f{j}").cast("double")
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_length") / average))
        total = total + F.when(F.col(f"_f{j}") > 0, F.lit(g.weight) * gain).otherwise(0.0)
        held = held | (F.col(f"_f{j}") > 0)
    out = rows.filter(held).select("id", total.alias("_score"))
    if allowed_rows is not None and not within:
        out = out.join(allowed_rows, "id", "left_semi")
    return Ranked(out, True, found)


#: Bytes of files for each core up to which a scan of texts is dealt over the cores.
SPREAD_BYTES = 8_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows with work for each core: files of some megabytes may be one split, which one core would work off. Beyond
    SPREAD_BYTES a core splits are many, and nothing is shuffled for it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return rows.repartition(cores) if size < SPREAD_BYTES * cores else rows


def _among(wanted: list[str]):
    return lambda t: t.isin(wanted)


def _variants(dictionary: DataFrame, words: dict[str, int], prefix: str | None, fuzzy: int) -> dict[str, list[tuple[str, int]]]:
    """Terms of the dictionary (t) near the query's words. Lengths bound what reaches the driver; more than MOST_VARIANTS is refused."""
    test = F.lit(False)
    for w in words:
        most = allowed(w, fuzzy)
        if most:
            # all but a bounded number of characters agree: lengths are near, and Spark's distance is at most twice as large
            test = test | (F.length("t").between(len(w) - most, len(w) + most) & F.levenshtein(F.col("t"), F.lit(w), 2 * most).between(0, 2 * most))
        if w == prefix:
            test = test | F.col("t").startswith(w)
    found = [r[0] for r in dictionary.filter(test).limit(20 * MOST_VARIANTS + 1).collect()]
    if len(found) > 20 * MOST_VARIANTS:
        raise QueryError(f"a word stands for {MOST_VARIANTS} terms at most")
    out: dict[str, list[tuple[str, int]]] = {}
    for w in words:
        most = allowed(w, fuzzy)
        near = []
        for t in found:
            if t == w or t.startswith("^"):
                continue
            if w == prefix and t.startswith(w):
                near.append((t, 1))
            elif most and (d := edits(w, t, most)) <= most:
                near.append((t, d))
        if len(near) > MOST_VARIANTS:
            raise QueryError(f"a word stands for {MOST_VARIANTS} terms at most")
        out[w] = near
    return out


def near(scope: Scope, rows: DataFrame, n: Near, whole: bool = False, k: int | None = None) -> Ranked:
    """id, _score over the rows given: exact by construction, whatever filter made them.

    whole: they are the whole collection; the k best of these come from an index, if there is one and `exact` is not said.
    """
    t = scope.field(n.field)
    v = scope.value(n.vector)
    if t.kind == "sparse":
        score = vectors.sparse_dot(t.col, sparse_value(v))
        return Ranked(rows.select("id", score.alias("_score")).filter("_score is not null"), True, set())
    if isinstance(v, str):
        import json

        v = json.loads(v)
    if v is None:
        return Ranked(rows.filter("false").select("id", F.lit(None).cast("double").alias("_score")), True, set())
    if t.kind == "geo":
        score = geo.distance(t.col, scope.point(n.vector))
        return Ranked(rows.select("id", score.alias("_score")).filter("_score is not null"), False, set())
    if t.kind not in ("vector", "list"):
        raise TypeMismatch(f"{n.field.text} is no vector")
    metric = scope.collection.metric.get(n.field.text, "cosine")
    index = scope.collection.vector_index.get(n.field.text)
    if index is not None and not n.exact and whole and k is not None:
        found = ann.search(rows.sparkSession.read.parquet(index.path), n.field.text, index.centres, [float(x) for x in v], k, index.probes, max(n.ef or index.candidates, k), metric, quant=index.quant)
        return Ranked(found, metric != "l2", set())
    query = F.array(*(F.lit(float(x)) for x in v))
    score = vectors.SCORES[metric](t.col, query)
    return Ranked(rows.filter(t.col.isNotNull()).select("id", score.alias("_score")), metric != "l2", set())


def top(r: Ranked, k: int) -> DataFrame:
    return r.rows.orderBy(F.desc("_score") if r.best_first else F.asc("_score"), "id").limit(k)


def ranks(r: Ranked, k: int, name: str) -> DataFrame:
    """id and rank from 1 of the k best: k rows, numbered in one task."""
    order = Window.orderBy(F.desc("_score") if r.best_first else F.asc("_score"), "id")
    return top(r, k).select("id", F.row_number().over(order).alias(name))


def fused(a: Ranked, b: Ranked, f: Fuse, page: int) -> Ranked:
    """Reciprocal rank fusion of the candidates of both sides."""
    k = max(f.candidates, page)
    x, y = ranks(a, k, "_ra"), ranks(b, k, "_rb")
    share = lambda c: F.coalesce(1.0 / (F.lit(float(f.k)) + F.col(c)), F.lit(0.0))
    return Ranked(x.join(y, "id", "full_outer").select("id", (share("_ra") + share("_rb")).alias("_score")), True, a.terms)


def reranked(scope: Scope, rows: DataFrame, found: Ranked, r: Rerank, page: int) -> Ranked:
    """The match's best candidates in the exact order of a vector."""
    candidates = top(found, max(r.candidates, page)).select("id")
    out = near(scope, rows.join(F.broadcast(candidates), "id", "left_semi"), Near(r.field, r.vector))  # a counted number of ids
    return Ranked(out.rows, out.best_first, found.terms)
