"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make document scores and offsets.

Training, on the driver, from a bounded sample of labelled rows (TRAIN_DOCS of each class, the least by a hash of
doc_id, texts of up to TRAIN_CHARS; rows that are held out are never among them): document labels become token labels
where a word or a word beginning stands in so many more contexts of toxic texts than of clean ones that chance would
not give one such mark among all that are tested (a likelihood-ratio test; copies of a text count once, since their
contexts are the same). How sure the test is and how many times the clean rate a mark needs are chosen by
cross-validation among the training rows. The field has hashed features of the word, its beginnings, its shape and its
two neighbours, and two tags; emissions and transitions are learned together, by full-batch adaptive gradient steps on
the likelihood over forward-backward marginals. A logistic function of two sums over a document's marginals, fitted on
the sample's documents, turns them into a score.

Scoring, in Arrow batches: every token of every whole text; forward-backward over each document's chain, all documents
of a batch at a time. Texts are not shuffled. The model is of a fixed size (2**HASH_BITS weights).

Defined results: null and empty texts have no tokens and score as a document without toxic tokens does; without both
classes among the training rows every score is 0; repeated rows score alike; several labels of one doc_id count as their
largest, null labels not at all; of several rows of one labelled doc_id the least text is learned from; other columns are
ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, released, text_of

#: Labelled documents that are learned from at most, clean and toxic ones, and characters of one.
TRAIN_DOCS = (2000, 1000)
TRAIN_CHARS = 100_000
HASH_BITS = 18
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS = 30
RATE = 0.6
L2 = 1e-4
#: Choices of cross-validation, the strictest first: false marks that chance may give among all words and beginnings, and
#: how many times its rate in clean texts a mark has in toxic ones.
FALSE_MARKS = (0.001, 0.01, 0.1, 1.0)
RATIOS = (40.0, 10.0)
FOLDS = 3
PREDICTED = 0.7
SPAN = 0.5
#: Tokens that a worker remembers at most.
CACHED = 200_000
BATCH_BYTES = 2_500_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature
    bias: float
    moves: np.ndarray  # 2 x 2, from tag to tag
    score: np.ndarray  # of 1, the sum and the peak


def features(token: str) -> list[int]:
    """Hashed features of a token itself."""
    word = token.lower()
    out = [_feature("=" + word), _feature("?" + ("u" if token.isupper() else "t" if token[:1].isupper() else "l") + str(min(len(token), 9)))]
    return out + [_feature("^" + word[:n]) for n in BEGINNINGS if len(word) >= n]


def beside(token: str) -> tuple[int, int]:
    """Hashed features that a token gives to the one after it, and to the one before it."""
    word = token.lower()
    return _feature("<" + word), _feature(">" + word)


def _feature(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << HASH_BITS) - 1)


def emissions(kinds: np.ndarray, inner: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The tokens' scores. kinds: of the tokens, document after document; inner: places of tokens that follow another of
    their document; own, before, after: what a kind gives to itself, to the token after it and to the one before it."""
    out = own[kinds]
    out[inner] += before[kinds[inner - 1]]
    out[inner - 1] += after[kinds[inner]]
    return out


def followers(lengths: np.ndarray) -> np.ndarray:
    """The places, document after document, of all tokens but the first of each document."""
    both = np.ones(int(lengths.sum()), dtype=bool)
    some = lengths[lengths > 0]
    both[np.cumsum(some) - some] = False
    return np.flatnonzero(both)


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of each token; emission: the tokens' scores, document after document; each document is a chain.

    edges: to this 2 x 2 array the expected numbers of moves from tag to tag are added.
    """
    out = np.zeros(len(emission))
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    left = lengths[order]
    if not len(left) or left[0] == 0:
        return out
    # documents alive at each step: those before the first one that is too short
    alive = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")
    m = np.exp(moves - moves.max())
    odds = np.exp(np.clip(emission, -30, 30))
    forward = np.zeros(len(emission))
    a = odds[first] / (1 + odds[first])
    forward[first] = a
    for t in range(1, left[0]):
        n = alive[t]
        at = first[:n] + t
        p = a[:n]
        one = (p * m[1, 1] + (1 - p) * m[0, 1]) * odds[at]
        a = one / (one + p * m[1, 0] + (1 - p) * m[0, 0])
        forward[at] = a
    b = np.full(len(left), 0.5)  # share of tag 1 in the backward message
    for t in range(left[0] - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        p, q = forward[at], b[:n]
        one = p * q
        out[at] = one / (one + (1 - p) * (1 - q))
        up = odds[at] * q
        down = 1 - q
        if edges is not None and t:
            a = forward[at - 1]
            pairs = np.array([[(1 - a) * m[0, 0] * down, (1 - a) * m[0, 1] * up], [a * m[1, 0] * down, a * m[1, 1] * up]])
            edges += (pairs / pairs.sum((0, 1))).sum(2)
        one, zero = m[1, 1] * up + m[1, 0] * down, m[0, 1] * up + m[0, 0] * down
        b[:n] = one / (one + zero)
    return out


def document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, log of the expected surprise that it's clean, logit of its peak."""
    out = np.zeros((len(lengths), 3))
    out[:, 0], out[:, 2] = 1, -7
    some = np.flatnonzero(lengths)
    if len(some):
        at = (np.cumsum(lengths) - lengths)[some]
        p = np.clip(p, 1e-3, 1 - 1e-3)
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.02, -np.log1p(-p), 0), at))
        peak = np.maximum.reduceat(p, at)
        out[some, 2] = np.log(peak / (1 - peak))
    return out


def _least_evidence(tests: int, false_marks: float) -> float:
    """The likelihood ratio that chance exceeds in so many of the tests (half a chi-squared tail of one degree)."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tests * erfc(sqrt(mid / 2)) / 2 > false_marks else (low, mid)
    return high


class _Evidence:
    """Contexts of words and word beginnings in clean and toxic texts, for each fold of the training rows."""

    def __init__(self, words: list[str], kinds: np.ndarray, toxic: np.ndarray, fold: np.ndarray):
        """kinds: the words' places, text after text, each followed by -1; toxic, fold: of each of these places."""
        before, after = np.roll(kinds, 1), np.roll(kinds, -1)
        contexts = kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for other, odd in ((before, 0xC2B2AE3D27D4EB4F), (after, 0x165667B19E3779F9)):
            contexts = (contexts ^ (contexts >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + other.astype(np.uint64) * np.uint64(odd)
        self.counts = np.zeros((FOLDS + 1, 2, len(words)))  # the last: of all folds, a context once
        for f, y in product(range(FOLDS + 1), (0, 1)):
            own = np.flatnonzero((toxic == y) & ((fold == f) | (f == FOLDS)) & (kinds >= 0))
            _, first = np.unique(contexts[own], return_index=True)
            self.counts[f, y] = np.bincount(kinds[own[first]], minlength=len(words))
        self.heads, self.tests = [], len(words)
        for n in BEGINNINGS:
            heads: dict[str, int] = {}
            head = np.array([heads.setdefault(w[:n], len(heads)) if len(w) >= n else -1 for w in words], dtype=np.int64)
            if heads:
                self.heads.append((head, len(heads)))
                self.tests += len(heads)

    def marked(self, false_marks: float, ratio: float, without: int | None = None) -> np.ndarray:
        """Which words are toxic, by all folds (but one)."""
        clean, bad = self.counts[FOLDS] if without is None else sum(self.counts[f] for f in range(FOLDS) if f != without)
        share = (bad.sum() + 1) / (clean.sum() + bad.sum() + 2)
        least = _least_evidence(self.tests, false_marks)

        def told(clean: np.ndarray, bad: np.ndarray) -> np.ndarray:
            n = clean + bad
            with np.errstate(divide="ignore", invalid="ignore"):
                g = 2 * (np.where(bad > 0, bad * np.log(bad / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))
            return (g >= least) & ((bad + 0.1) * (1 - share) >= ratio * (clean + 0.1) * share)

        out = told(clean, bad)
        for head, size in self.heads:
            long = head >= 0
            out[long] |= told(*(np.bincount(head[long], c[long], size) for c in (clean, bad)))[head[long]]
        return out


def _chosen(evidence: _Evidence, kinds: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """The choices under which marks made of the other folds tell the toxic texts of each fold best (F1; the strictest of equals)."""
    best, out = -1.0, (FALSE_MARKS[0], RATIOS[0])
    some = np.flatnonzero(lengths)
    at = (np.cumsum(lengths) - lengths)[some]
    for choice in product(FALSE_MARKS, RATIOS):
        hit = np.zeros(len(lengths), dtype=bool)
        for f in range(FOLDS):
            if len(some):
                marked = evidence.marked(*choice, without=f)
                hit[some] |= np.logical_or.reduceat(marked[kinds], at) & (fold[some] == f)
        right = np.count_nonzero(hit & (toxic == 1))
        f1 = 2 * right / max(1, np.count_nonzero(hit) + np.count_nonzero(toxic == 1))
        if f1 > best + 1e-9:
            best, out = f1, choice
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """toxic: 0 or 1 for each text; both must occur."""
    y = np.array(toxic)
    place: dict[str, int] = {}
    runs = [np.array([place.setdefault(w, len(place)) for w in TOKEN.findall(t)], dtype=np.int32) for t in texts]
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    kinds = np.concatenate([*runs, np.zeros(0, np.int32)])
    del runs
    tokens = list(place)
    # marks are of words, whatever their case; copies of a text are in one fold
    lowered: dict[str, int] = {}
    low = np.array([lowered.setdefault(w.lower(), len(lowered)) for w in tokens], dtype=np.int32)
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) // 7 % FOLDS for t in texts])
    words = low[kinds] if len(kinds) else kinds
    fenced = np.insert(words, np.cumsum(lengths), -1)
    evidence = _Evidence(list(lowered), fenced, np.repeat(y, lengths + 1), np.repeat(fold, lengths + 1))
    del fenced
    choice = _chosen(evidence, words, lengths, y, fold)
    truth = evidence.marked(*choice)[words].astype(float) * np.repeat(y, lengths)
    del evidence, words

    each, columns, sides = array("q"), array("q"), array("q")
    for w in tokens:
        found = features(w)
        each.append(len(found))
        columns.extend(found)
        sides.extend(beside(w))
    rows, columns = np.repeat(np.arange(len(tokens)), np.frombuffer(each, dtype=np.int64)), np.frombuffer(columns, dtype=np.int64)
    before, after = np.frombuffer(sides, dtype=np.int64).reshape(-1, 2).T
    size, n = 1 << HASH_BITS, len(tokens)
    rate = min(max(truth.mean() if len(truth) else 0, 1e-4), 0.5)
    model = Model(np.zeros(size, dtype=np.float64), float(np.log(rate / (1 - rate))), np.zeros((2, 2)), np.array([-2.0, 0.0, 0.0]))
    inner = followers(lengths)
    emission = lambda: emissions(kinds, inner, np.bincount(rows, model.weights[columns], n) + model.bias, model.weights[before], model.weights[after])
    # long chains are cut for learning alone, so that a step handles them side by side
    cuts = np.concatenate([[min(256, k - a) for a in range(0, k, 256)] for k in lengths if k] or [[]]).astype(np.int64)
    linked = followers(cuts)
    a, b = truth[linked - 1], truth[linked]
    moved = np.array([[np.sum((1 - a) * (1 - b)), np.sum((1 - a) * b)], [np.sum(a * (1 - b)), np.sum(a * b)]])
    scale = max(1.0, truth.sum())
    grown, grown_bias, grown_moves = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(STEPS if len(truth) and truth.any() else 0):
        expected = np.zeros((2, 2))
        off = (marginals(emission(), cuts, model.moves, expected) - truth) / scale
        slope = np.bincount(columns, np.bincount(kinds, off, n)[rows], size) + L2 * model.weights
        slope += np.bincount(before, np.bincount(kinds[inner - 1], off[inner], n), size) + np.bincount(after, np.bincount(kinds[inner], off[inner - 1], n), size)
        grown += slope**2
        model.weights -= RATE * slope / np.sqrt(grown)
        grown_bias += off.sum() ** 2
        model.bias -= 0.2 * RATE * off.sum() / np.sqrt(grown_bias)
        slope = (expected - moved) / scale + L2 * model.moves
        grown_moves += slope**2
        model.moves -= 0.2 * RATE * slope / np.sqrt(grown_moves)
    x = document_features(marginals(emission(), lengths, model.moves) if len(kinds) else np.zeros(0), lengths)
    w = model.score
    for _ in range(50):  # Newton steps with a small penalty
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (s - y) + 0.05 * w)
    model.score = w
    model.weights = model.weights.astype(np.float32)
    return model


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


class _Scorer:
    """A worker's copy of the model, with the tokens it has met."""

    def __init__(self, model: Model | None):
        self.model, self.cache, self.parts = model, {}, array("d")  # of each token: for itself, the next and the one before

    def _met(self, token: str) -> int:
        weights, (before, after) = self.model.weights, beside(token)
        self.parts.extend((self.model.bias + float(weights[features(token)].sum()), weights[before], weights[after]))
        k = self.cache[token] = len(self.cache)
        return k

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores; the tokens' marginals, text after text; their number in each text."""
        lengths = np.zeros(len(texts), dtype=np.int64)
        if self.model is None:
            return np.zeros(len(texts)), np.zeros(0), lengths
        if len(self.cache) > CACHED:
            self.cache.clear()
            del self.parts[:]
        kinds: list[int] = []
        get, met = self.cache.get, self._met
        for k, t in enumerate(texts):
            found = TOKEN.findall(t)
            lengths[k] = len(found)
            kinds += [n if (n := get(w)) is not None else met(w) for w in found]
        own, before, after = np.array(self.parts).reshape(-1, 3).T
        emission = emissions(np.array(kinds, dtype=np.int64), followers(lengths), own, before, after)
        p = marginals(emission, lengths, self.model.moves)
        return 1 / (1 + np.exp(-np.clip(document_features(p, lengths) @ self.model.score, -30, 30))), p, lengths


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for part in pieces(batch, 1, BATCH_BYTES):
                texts = part.column(1).to_pylist()
                score, p, lengths = scorer(texts)
                spans: list = [[] for _ in texts]
                ends = np.cumsum(lengths)
                for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= SPAN), side="right")):
                    own = p[ends[k] - lengths[k] : ends[k]]
                    spans[k] = [{"start": m.start(), "end": m.end(), "p": round(float(q), 6)} for m, q in zip(TOKEN.finditer(texts[k]), own, strict=True) if q >= SPAN]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= PREDICTED).astype(np.int32), pa.int32()), pa.array(spans, SPANS)], ["doc_id", "score", "predicted", "spans"])

    return run


def _cleaned(model: Model | None, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            column = batch.schema.get_field_index(text)
            for part in pieces(batch, column, BATCH_BYTES):
                yield part.filter(pa.array(scorer([t or "" for t in part.column(column).to_pylist()])[0] < PREDICTED))

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, train_docs: tuple[int, int] = TRAIN_DOCS) -> Model | None:
    """From labelled rows that aren't held out. The sample is chosen among the labels, so texts are not shuffled for it."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.filter(~held_out()).withColumn("_at", F.xxhash64("doc_id"))
    classes = [known.filter(F.col("_toxic") == y).orderBy("_at", "doc_id").limit(train_docs[y]) for y in (0, 1)]
    sample = F.broadcast(classes[0].unionByName(classes[1]).withColumnRenamed("doc_id", "_of"))  # sum(train_docs) rows at most
    rows = docs.select(F.col("doc_id"), text_of().alias("_text")).filter(F.length("_text") <= TRAIN_CHARS)
    # a row for each labelled id, however many rows have it
    rows = rows.join(sample, F.col("doc_id") == F.col("_of")).groupBy("_at", "doc_id", "_toxic").agg(F.min("_text").alias("_text"))
    got = sorted((r["_at"], r["doc_id"], r["_text"], int(r["_toxic"])) for r in rows.collect())
    if len({x[3] for x in got}) < 2:
        return None
    return fit([x[2] for x in got], [x[3] for x in got])


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, score, predicted, spans (array of start, end, p)."""
    schema = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(released(_scored(model)), schema)


def clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic. Nothing is shuffled."""
    return docs.mapInArrow(released(_cleaned(model, text)), docs.schema)
