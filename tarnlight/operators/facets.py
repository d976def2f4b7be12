"""Facets: counts of a field's values over all matched rows, before any page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.ast import Binary, Case, Facet, InList, Path, Unary, conjoined, conjuncts, walk
from ..plans.expr import Scope


def without(where, path: Path):
    """The filter less the conjuncts that read the facet's field and nothing else."""

    def own(e) -> bool:
        found = {x for x in walk(e) if isinstance(x, Path)}
        return found == {path} and isinstance(e, Binary | InList | Unary | Case)

    return conjoined([e for e in conjuncts(where) if not own(e)])


def facet(scope: Scope, rows: DataFrame, f: Facet) -> DataFrame:
    """value, count: most first, ties by value; with ranges: low, high, count, in order, empty ones too."""
    t = scope.typed(f.path)
    if f.ranges is not None:
        bounds = [float(b) for b in f.ranges]
        x = scope.number(t).cast("double")
        pairs = list(zip(bounds, bounds[1:], strict=False))
        place = F.when(x.isNull(), None)
        for k, (low, high) in enumerate(pairs):
            place = place.when((x >= low) & (x < high), k)
        counts = rows.select(place.alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        table = rows.sparkSession.createDataFrame([(k, low, high) for k, (low, high) in enumerate(pairs)], "k int, low double, high double")
        out = table.join(F.broadcast(counts), "k", "left")  # at most a row for each range
        return out.orderBy("k").select("low", "high", F.coalesce("n", F.lit(0)).alias("count"))
    column = t.as_kind("text")
    if t.kind in ("list",):
        rows = rows.select("id", F.explode_outer(F.array_distinct(column)).alias("value"))
    else:
        rows = rows.select("id", column.alias("value"))
    if t.nocase:
        counts = rows.groupBy(text.casefold(F.col("value")).alias("_fold")).agg(F.min_by("value", "id").alias("value"), F.count(F.lit(1)).alias("count")).drop("_fold")
    else:
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.orderBy(F.desc("count"), "value")
    return counts.limit(scope.whole(f.top, "top")) if f.top is not None else counts
