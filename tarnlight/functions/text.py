"""Terms of a text, case folding, edit distance and marked spans."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Scripts written without spaces: their runs give overlapping parts of so many characters.
PARTS = ((re.compile("[⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0003ffff]+"), 2), (re.compile("[฀-໿က-႟ក-៿]+"), 3))
#: All forms of i are one, a dot above is dropped.
FORMS_OF_I = {ord("I"): "i", ord("İ"): "i", ord("ı"): "i", 0x307: None}
WORDS = re.compile(r"[^\W_]+")
ASCII = r"^\p{ASCII}*$"
#: Texts whose terms the JVM finds as Python does: Latin letters but the dotted and dotless I, punctuation, currency signs.
LATIN = r"^[\x{0}-\x{12F}\x{132}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*+$"
LATIN_WORDS = r"[\p{L}\p{N}]++"


FULL_WIDTH = re.compile("[！-～]")
UNSPACED = re.compile("|".join(script.pattern for script, _ in PARTS))
RUNS = re.compile(r"(?:[^\W_]|[̀-ͯะ-๎က-႟឴-៓])+")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = text.translate(FORMS_OF_I)
    text = FULL_WIDTH.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)
    # letter by letter where a letter's place in the word would matter
    low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return low.replace("̇", "")


def spans(text: str, single: bool = False) -> list[tuple[str, int, int]]:
    """(term, start, end) of each term, in order; single: the characters of unspaced scripts are terms too."""
    out = []
    for m in RUNS.finditer(text):
        at, run = m.start(), m.group()
        if run.isascii() or not UNSPACED.search(run):
            if term := folded(run):
                out.append((term, at, m.end()))
            continue
        k = 0
        while k < len(run):
            for script, n in PARTS:
                if part := script.match(run, k):
                    piece = part.group()
                    if single and n > 1:
                        out += [(folded(c), at + k + j, at + k + j + 1) for j, c in enumerate(piece)]
                    if len(piece) <= n:
                        out.append((folded(piece), at + k, at + k + len(piece)))
                    else:
                        out += [(folded(piece[j : j + n]), at + k + j, at + k + j + n) for j in range(len(piece) - n + 1)]
                    k = part.end()
                    break
            else:
                to = k
                while to < len(run) and not any(s.match(run, to) for s, _ in PARTS):
                    to += 1
                if term := folded(run[k:to]):
                    out.append((term, at + k, at + to))
                k = to
    return out


def terms(text: str, single: bool = False) -> list[str]:
    if not UNSPACED.search(text):
        return [t for w in RUNS.findall(text) if (t := folded(w))]
    return [t for t, _, _ in spans(text, single)]


def terms_of(text: Column, single: bool = False) -> Column:
    """The terms of a text column: Latin texts stay in the JVM, others go through one Arrow batch function."""

    @F.pandas_udf("array<string>")
    def full(s: pd.Series) -> pd.Series:
        return s.map(lambda t: terms(t, single) if t is not None else [])

    plain = F.regexp_extract_all(F.lower(text), F.lit(LATIN_WORDS), F.lit(0))
    empty = F.array().cast("array<string>")
    # a Python function is run for all rows, whatever branch it stands in: Latin texts reach it as nulls
    return F.when(text.isNull(), empty).when(text.rlike(LATIN), plain).otherwise(full(F.when(~text.rlike(LATIN), text)))


#: Terms up to which texts are looked through for any of them before they are taken apart.
FEW_TERMS = 20


def counts_of(rows: DataFrame, groups: list[list[str]], single: bool = False, holding: bool = False) -> DataFrame:
    """id, _length, _f0.. of rows (id, _text): the terms of each text, and how many are of each group.

    Latin texts are taken apart once, in the JVM; of others only counts come back from Python. holding: rows that hold no
    term may be left out.
    """
    place: dict[str, list[int]] = {}
    for k, g in enumerate(groups, 1):
        for t in g:
            place.setdefault(t, []).append(k)
    width = len(groups) + 1

    @F.pandas_udf("array<int>")
    def full(s: pd.Series) -> pd.Series:
        def one(t):
            out = [0] * width
            if t is not None:
                found = terms(t, single)
                out[0] = len(found)
                for w in found:
                    for k in place.get(w, ()):
                        out[k] += 1
            return out

        return s.map(one)

    latin = F.coalesce(F.col("_text").rlike(LATIN), F.lit(False))
    rows = rows.select("id", "_text", latin.alias("_latin"))
    low = F.lower("_text")
    if holding and len(place) <= FEW_TERMS:
        some = F.lit(False)
        for t in place:
            some = some | low.contains(t)
        rows = rows.filter(~F.col("_latin") | some)
    rows = rows.select("id", F.when(F.col("_latin"), F.regexp_extract_all(low, F.lit(LATIN_WORDS), F.lit(0))).alias("_w"), F.when(~F.col("_latin"), F.col("_text")).alias("_other"))
    rows = rows.select("id", "_w", full.asNondeterministic()("_other").alias("_n"))

    def among(g: list[str]) -> Column:
        if len(g) == 1:
            return F.size("_w") - F.size(F.array_remove("_w", g[0]))
        return F.size(F.filter("_w", lambda t: t.isin(g)))

    here = F.col("_w").isNotNull()
    # filters on the counts stay above them: below, each would take the texts apart again
    each = [F.when(here, c).otherwise(F.get("_n", F.lit(k))) for k, c in enumerate([F.size("_w"), *map(among, groups)])]
    return rows.select("id", each[0].alias("_length"), *(c.alias(f"_f{k}") for k, c in enumerate(each[1:])))


def casefold(text: Column, turkish: bool = False) -> Column:
    """Full Unicode folding: ASCII in the JVM, the rest by Python's own table."""

    @F.pandas_udf("string")
    def full(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else (t.replace("I", "ı").replace("İ", "i") if turkish else t).casefold())

    if turkish:
        return full(text)
    return F.when(text.rlike(ASCII), F.lower(text)).otherwise(full(F.when(~text.rlike(ASCII), text)))


def edits(a: str, b: str, most: int) -> int:
    """Restricted Damerau distance in which an edit of the first character counts two; most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, [0] + [k + 1 for k in range(1, len(b) + 1)]
    for i in range(1, len(a) + 1):
        now = [i + 1]
        for j in range(1, len(b) + 1):
            heavy = 2 if i == 1 or j == 1 else 1
            cost = 0 if a[i - 1] == b[j - 1] else heavy
            best = min(row[j - 1] + cost, row[j] + (heavy if i == 1 else 1), now[j - 1] + (heavy if j == 1 else 1))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                best = min(best, before[j - 2] + (2 if i == 2 or j == 2 else 1))
            now.append(best)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(term: str, fuzzy: int) -> int:
    """Edits allowed a term of this length."""
    return min(fuzzy, 0 if len(term) < 5 else 1 if len(term) < 9 else 2)


def utf16(text: str) -> list[int]:
    """For each code point its offset in UTF-16 units, and the end."""
    out = [0]
    for c in text:
        out.append(out[-1] + (2 if ord(c) > 0xFFFF else 1))
    return out


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def marked_spans(text: str, wanted: frozenset[str], single: bool = False) -> list[tuple[int, int]]:
    return merged([(s, e) for t, s, e in spans(text, single) if t in wanted])


def tagged(text: str, found: list[tuple[int, int]], pre: str, post: str) -> str:
    out, at = [], 0
    for s, e in found:
        out += [text[at:s], pre, text[s:e], post]
        at = e
    return "".join([*out, text[at:]])


def snippet(text: str, wanted: frozenset[str], n: int, ellipsis: str, pre: str, post: str) -> str:
    """At most n characters: the window with the most marked spans, centred on them."""
    found = marked_spans(text, wanted)
    if len(text) <= n:
        return tagged(text, found, pre, post)
    best, first, last = 0, 0, 0
    ends = [e for _, e in found]
    for k, (s, _) in enumerate(found):
        j = bisect_right(ends, s + n)
        if j - k > best:
            best, first, last = j - k, s, ends[j - 1]
    start = max(0, min(len(text) - n, first - max(0, (n - (last - first)) // 2)))
    end = start + n
    inside = [(s - start, e - start) for s, e in found if s >= start and e <= end]
    return (ellipsis if start else "") + tagged(text[start:end], inside, pre, post) + (ellipsis if end < len(text) else "")


def highlight_of(text: Column, wanted: set[str]) -> Column:
    """Spans [start, end] in UTF-16 units."""
    words = frozenset(wanted)

    @F.pandas_udf("array<array<int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            at = utf16(t)
            return [[at[a], at[b]] for a, b in marked_spans(t, words)]

        return s.map(one)

    return run(text)


def tagged_of(text: Column, wanted: set[str], pre: str, post: str) -> Column:
    words = frozenset(wanted)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else tagged(t, marked_spans(t, words), pre, post))

    return run(text)


def snippet_of(text: Column, wanted: set[str], n: int, ellipsis: str, pre: str, post: str) -> Column:
    words = frozenset(wanted)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else snippet(t, words, n, ellipsis, pre, post))

    return run(text)


