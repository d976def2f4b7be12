"""Positions of regular-expression matches, in DataFrame functions only.

Spark returns the matches of a pattern and, by split(), the gaps between them. Gaps and matches alternate, so running
sums of their lengths are the offsets, in code points. The sums go by chunks: work stays linear in the matches.

Patterns must be in a form whose search is linear: possessive repeats, and a look-behind (or \\G, the end of the match
before) where a match can only begin at the start of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128


def _ends(sizes: str) -> Column:
    """Running sums of an int array column."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(F.col(sizes), c * CHUNK + 1, CHUNK))
    last = lambda xs: F.element_at(xs, -1)
    parts = F.aggregate(chunks, F.array(F.array(F.lit(0))), lambda done, c: F.array_append(done, F.aggregate(c, F.array(last(last(done))), lambda xs, x: F.array_append(xs, last(xs) + x))))
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(sizes)), lambda p: F.slice(p, F.lit(2), F.size(p))))


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]], near: int = 0) -> DataFrame:
    """Adds for each name an array column of struct(start, end, hit, before, after), null where nothing matches.

    patterns: name -> (pattern, guard); rows for which guard is not true have no match. before and after: up to near
    characters of the gaps beside a match.
    """
    keep = df.columns
    first, second, third = [], [], []
    for k, (pattern, guard) in patterns.items():
        some = F.col(text).rlike(pattern) if guard is None else guard & F.col(text).rlike(pattern)
        first += [F.when(some, F.split(F.col(text), pattern, -1)).alias(f"_gaps_{k}"), F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"_hits_{k}")]
        second.append(F.zip_with(F.slice(F.col(f"_gaps_{k}"), F.lit(1), F.size(f"_hits_{k}")), f"_hits_{k}", lambda g, h: F.length(g) + F.length(h)).alias(f"_sizes_{k}"))
        third.append(F.when(F.col(f"_sizes_{k}").isNotNull(), _ends(f"_sizes_{k}")).alias(f"_ends_{k}"))
    made = [f"_{what}_{k}" for what in ("gaps", "hits") for k in patterns]
    df = df.select(*keep, *first)
    df = df.select(*keep, *made, *second)
    df = df.select(*keep, *made, *third)

    def matches(k: str) -> Column:
        def one(hit: Column, i: Column) -> Column:
            end = F.get(F.col(f"_ends_{k}"), i)
            fields = [(end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")]
            if near:
                fields += [F.right(F.get(F.col(f"_gaps_{k}"), i), F.lit(near)).alias("before"), F.left(F.get(F.col(f"_gaps_{k}"), i + 1), F.lit(near)).alias("after")]
            return F.struct(*fields)

        return F.transform(F.col(f"_hits_{k}"), one)

    return df.select(*keep, *(matches(k).alias(k) for k in patterns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; spans: array of struct(start, rank, end, kind, ...)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
