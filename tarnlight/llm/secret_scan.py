"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression is parsed, and a Boolean query of the trigrams that every match must hold is derived.
2. index() reads the texts once and stores the postings (trigram, doc_id) of the trigrams that the rules name, of
   ASCII-lowered text, as posting lists clustered by trigram. Rules added later read the texts again for new
   trigrams alone (extended()), and not at all where the lists have theirs.
3. The lists of each rule's trigrams are intersected for AND and united for OR: they meet by doc_id.
4. A second pass verifies each rule on its candidates by the pattern itself. Rules without mandatory trigrams scan
   every text in that pass.

The candidates (doc_id, rules) are written to the shared folder. They are broadcast only where their counted rows are
at most BROADCAST_ROWS; beyond that the texts are joined with them by doc_id.

Defined results: null text counts as empty and has no spans; offsets are code points, end exclusive; a repeated doc_id
is decided row by row; null doc_ids too; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

try:
    import re._constants as _sre
    import re._parser as _parser
except ImportError:  # before Python 3.11
    import sre_constants as _sre
    import sre_parse as _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_digest, saved, text_of
from .spans import counted, joined, with_matches

#: Candidates that are broadcast at most: rows of two longs, some 20 MB.
BROADCAST_ROWS = 500_000
#: Strings that a rule's literals may stand for at most; beyond that the analysis cuts the sequence there.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """pattern: what counts as a match. search: the same for Spark's engine in a linear form. least: (group, characters) that a match needs."""

    kind: str
    pattern: str
    search: str
    least: tuple[int, int] | None = None
    ignore_case: bool = False
    base: bool = field(default=False)


#: The base rules in order, then further ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", (2, 6), True, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}+", base=True),
    Rule("hex", r"[0-9a-f]+", r"(?<![0-9a-f])[0-9a-f]{24,}+", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{20,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
)

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).


def _all(*queries):
    parts = frozenset(x for q in queries if q is not True for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,)))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(*queries):
    if any(q is True for q in queries):
        return True
    parts = frozenset(queries)
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _held(strings) -> object:
    """The condition that one of the strings is in a text."""
    return _any(*(_all(*(s[k : k + 3] for k in range(len(s) - 2))) if len(s) >= 3 else True for s in {s.lower() for s in strings}))


def _analysed(items) -> tuple[frozenset[str] | None, object]:
    """The strings that a parsed sequence stands for, or None for too many; and a condition on any text that it matches in."""
    run, query, exact = frozenset([""]), True, True

    def cut() -> None:
        nonlocal run, query, exact
        query, run, exact = _all(query, _held(run)), frozenset([""]), False

    for op, value in items:
        strings, more = None, True
        if op is _sre.LITERAL:
            strings = frozenset([chr(value)])
        elif op is _sre.IN and all(k is _sre.LITERAL for k, _ in value) and len(value) <= 8:
            strings = frozenset(chr(v) for _, v in value)
        elif op is _sre.SUBPATTERN:
            strings, more = _analysed(value[-1])
        elif op is _sre.BRANCH:
            found = [_analysed(x) for x in value[1]]
            if all(s is not None for s, _ in found):
                strings = frozenset().union(*(s for s, _ in found))
            else:
                more = _any(*(_all(q, True if s is None else _held(s)) for s, q in found))
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            s, q = _analysed(inner)
            if s is not None and most == 1:
                strings = s | ({""} if least == 0 else set())
            elif least:
                more = _all(q, True if s is None else _held(s))
        elif op in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT):
            continue
        if strings is not None and len(strings) * len(run) <= ALTERNATIVES:
            run = frozenset(a + b for a, b in product(run, strings))
        else:
            cut()
            query = _all(query, more)
            if strings is not None and len(strings) <= ALTERNATIVES:
                run = strings
    if exact:
        return run, True
    cut()
    return None, query


def trigram_query(pattern: str):
    """The Boolean query of mandatory trigrams (ASCII-lowered), True where there are none."""
    strings, query = _analysed(_parser.parse(pattern))
    return query if strings is None else _held(strings)


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _evaluated(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    out = None
    for part in sorted(query[1], key=repr):
        one = _evaluated(part, has)
        out = one if out is None else out & one if query[0] == "and" else out | one
    return out


@dataclass(frozen=True)
class Index:
    """Posting lists (trigram, doc_id), and the trigrams that have one, be it empty."""

    lists: DataFrame
    trigrams: frozenset[str]


def needed(rules: tuple[Rule, ...]) -> frozenset[str]:
    """The trigrams that the rules' queries name."""
    return frozenset().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules))


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, doc_id) of each named trigram that a text holds."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.col("_low").contains(t), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The posting lists of the rules' trigrams, stored in the shared folder; a file's rows are in order of trigram."""
    trigrams = needed(rules)
    return Index(saved(postings(docs, sorted(trigrams), doc_id, text).sortWithinPartitions("trigram"), "trigram-postings"), trigrams)


def extended(known: Index, docs: DataFrame, rules: tuple[Rule, ...], doc_id: str = "doc_id", text: str = "text") -> Index:
    """known with the lists that further rules need; the texts are read for trigrams that have none yet."""
    new = needed(rules) - known.trigrams
    if not new:
        return known
    more = saved(postings(docs, sorted(new), doc_id, text).sortWithinPartitions("trigram"), "trigram-postings")
    return Index(known.lists.unionByName(more), known.trigrams | new)


def candidates(known: Index, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules: bits of the indexed rules whose query the posting lists satisfy."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    wanted = sorted(needed(rules))
    if lacking := set(wanted) - known.trigrams:
        raise ValueError(f"the index has no list of {', '.join(sorted(lacking))}")
    place = {t: k for k, t in enumerate(wanted)}
    at = F.element_at(F.create_map(*(F.lit(x) for t, k in place.items() for x in (t, k))), F.col("trigram"))
    lists = known.lists.filter(F.col("trigram").isin(wanted)).select("doc_id", at.alias("_at"))
    words = [F.bit_or(F.when(F.floor(F.col("_at") / 60) == w, F.expr("shiftleft(1L, _at % 60)")).otherwise(F.lit(0))).alias(f"_w{w}") for w in range(len(wanted) // 60 + 1)]
    met = lists.groupBy("doc_id").agg(*words)

    def has(t: str) -> Column:
        return F.col(f"_w{place[t] // 60}").bitwiseAND(F.lit(1 << place[t] % 60)) != 0

    bits = F.lit(0).cast("long")
    for k, q in queries.items():
        bits = bits + F.when(_evaluated(q, has), F.lit(1 << k)).otherwise(F.lit(0))
    return met.select("doc_id", bits.alias("rules")).filter("rules != 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, known: Index | None = None) -> DataFrame:
    """A row for each document: doc_id, spans, an array of struct(start, rank, end, kind) in order. known: an index of these documents, if there is one."""
    known = extended(known, docs, rules, doc_id, text) if known else index(docs, rules, doc_id, text)
    found = saved(candidates(known, rules).withColumnRenamed("doc_id", "_of"), "secret-candidates")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).join(found, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    rows = rows.select("doc_id", "_text", F.coalesce("rules", F.lit(0).cast("long")).alias("_rules"))
    indexed = [trigram_query(r.pattern) is not True for r in rules]
    rows = with_matches(rows, "_text", {r.kind: (r.search, F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0 if indexed[k] else None) for k, r in enumerate(rules)})

    def spans(k: int, rule: Rule) -> Column:
        kept = F.col(rule.kind)
        if rule.least:
            kept = F.filter(kept, lambda m: F.length(F.regexp_extract(m["hit"], rule.search, rule.least[0])) >= rule.least[1])
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return rows.select("doc_id", F.array_sort(F.concat(*(F.coalesce(spans(k, r), none) for k, r in enumerate(rules)))).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans."""
    kinds = [r.kind for r in rules if r.base]
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *(counted(F.col("spans"), k).alias(f"n_{k}") for k in kinds), hex_digest(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
