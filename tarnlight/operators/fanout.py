"""One question over many tenants: rows side by side, merged in order, or folded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError


def concatenated(parts: dict[str, DataFrame]) -> DataFrame:
    """All tenants' rows with a `tenant` column in front."""
    out = None
    for tenant, df in parts.items():
        one = df.select(F.lit(tenant).alias("tenant"), *df.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise QueryError("no tenant is asked")
    return out


def ordered(rows: DataFrame, order: list[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """The first rows of all tenants in one order; order: (column, descending). Ties go by tenant and every column."""
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    rest = [F.col(c) for c in rows.columns if c not in {k for k, _ in order}]
    return rows.orderBy(*keys, *rest).offset(offset).limit(limit)


FOLDS: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max}


def folded(rows: DataFrame, group: list[str], folds: dict[str, str]) -> DataFrame:
    """Tenants' groups folded into one: folds: column -> sum, min or max."""
    for f in folds.values():
        if f not in FOLDS:
            raise QueryError(f"tenants' answers don't fold by {f}")
    return rows.groupBy(*group).agg(*(FOLDS[f](c).alias(c) for c, f in folds.items()))


def gathered(ask: Callable[[str], DataFrame], tenants: list[str], partial: bool = False, rows: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Asks each tenant; a failure fails all, or with partial is told beside the rest. More than rows rows are refused."""
    parts, failures = {}, {}
    for t in tenants:
        try:
            parts[t] = ask(t)
        except Exception as e:
            if not partial:
                raise
            failures[t] = str(e)
    out = concatenated(parts)
    if rows is not None and out.limit(rows + 1).count() > rows:
        raise QueryError(f"the answer has more than {rows} rows")
    return out, failures
