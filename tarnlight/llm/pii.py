"""Personal data: patterns propose spans, checksums and ranges confirm them, context words adjust a score.

DataFrame functions only; each row is decided by itself, so nothing is shuffled.

Base kinds: email, ip, card, phone, found leftmost and non-overlapping for each kind; what fails its check is dropped
and not tried again. Base spans always stay; their score is shown. Further kinds count where their score reaches
THRESHOLD: iban (mod 97 confirms it), ssn (only beside context words).

Defined results: null text counts as empty and has no spans; offsets are code points, end exclusive; spans of one
start are in the order of the kinds; repeated rows give repeated results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_digest, text_of
from .spans import counted, joined, with_matches

#: Kinds in order, patterns (each in its linear form), first scores, context words.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id",
}
BONUS = 0.35
NEAR = 40
THRESHOLD = 0.7


def luhn(digits: Column) -> Column:
    """Does the check digit of a string of digits hold?"""

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does ISO 7064 mod 97-10 hold, the first four characters moved to the end and letters read as 10 to 35?"""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        compact = F.regexp_replace(hit, "\x20", "")
        return F.length(compact).between(15, 34) & mod97(compact)
    return F.lit(True)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, spans, an array of struct(start, rank, end, kind, score) in order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    guards = {"email": F.col("_text").contains("@"), "phone": F.col("_text").contains("+")}
    rows = with_matches(rows, "_text", {k: (PATTERNS[k], guards.get(k)) for k in KINDS}, NEAR)

    def spans(kind: str) -> Column:
        def one(m: Column) -> Column:
            beside = F.lower(F.concat_ws(" ", m["before"], m["after"])).rlike(CONTEXT[kind])
            score = F.round(F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(beside, F.lit(BONUS)).otherwise(F.lit(0.0))), 2)
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        kept = F.transform(F.filter(F.col(kind), lambda m: _confirmed(kind, m["hit"])), one)
        return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= THRESHOLD)

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return rows.select("doc_id", F.array_sort(F.concat(*(F.coalesce(spans(k), none) for k in KINDS))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans, scores (of the spans, in order)."""
    base = F.filter(F.col("spans"), lambda s: s["rank"] < len(BASE))
    counts = [counted(F.col("spans"), k).alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, hex_digest(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with every span replaced by <KIND>; of spans that overlap the earlier stands. doc_id must be unique."""
    found = find(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).join(found, "doc_id")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        piece = F.concat(done["out"], F.substring(F.col("_text"), done["at"] + 1, s["start"] - done["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(done)

    whole = F.aggregate("spans", start, step, lambda done: F.concat(done["out"], F.substring(F.col("_text"), done["at"] + 1, F.length("_text"))))
    return rows.select("doc_id", whole.alias("text"))
