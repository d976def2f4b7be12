"""SentencePiece encoding of merge-type vocabularies, and decoding.

A text is normalised as the model does it (white space escaped, dummy prefix), cut where no piece can span the cut,
and each part is merged by an agenda of adjacent symbol pairs: the pair with the best score goes first, the leftmost
among equals; a popped pair whose symbols have changed since is passed over. Short parts are merged many at a time, their
agendas being the rows of a matrix. Parts recur, so their ids are kept in a bounded cache for each task. In each Arrow
batch every part that was merged, and if asked every whole text, is held against the sentencepiece library; a difference
raises.

The model file is public reference data of a fixed size. Its bytes travel with the function.

Defined results: null counts as empty; the empty text has no tokens and decodes to ''; characters outside the vocabulary
become byte pieces, or the unknown id where the model has none; repeated rows are encoded each; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, released, text_of

SPACE = "▁"
#: Marks before which a text is cut if the vocabulary allows it.
MARKS = ",.;:!?|%&*#$)\"'"
#: Parts that a worker remembers at most, in two halves: when the younger is full, the elder goes, but for what was met since.
CACHED = 220_000
#: Characters of a part up to which its agenda is a plain list, or a row of a matrix.
SHORT = 24
#: Characters of a part up to which it is remembered.
REMEMBERED = 64
#: Rows of a matrix of agendas, and parts of a line that is held against the library.
ROWS, LINE = 4096, 32
NONE = float("-inf")
#: Bytes of text that are encoded and checked at a time.
BATCH_BYTES = 1_000_000


class Remembered(dict):
    """Parts and what they become: (ids, their decimal forms joined by commas). What is asked for and not known is new, or comes from the elder."""

    def __init__(self, elder: dict | None = None):
        self.elder, self.new = elder or {}, []

    def __missing__(self, part: str):
        got = self.elder.get(part)
        if got is None:
            got = [(), ""]  # filled in later, before anyone reads it
            self.new.append(part)
        self[part] = got
        return got


class Merger:
    """Encodes with a merge-type model, from its list of pieces and scores alone."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        self.scores, self.ids, self.bytes = {}, {}, {}
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif sp.is_unused(i):
                raise ValueError("a vocabulary with unused pieces needs resegmentation, which is not offered")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
        self.unknown = sp.unk_id()
        longer = [p for p in self.ids if len(p) > 1]
        # a text may be cut before a space and around a line feed: no piece spans these cuts
        probe = sp.encode("a  b ", out_type=str)
        if "".join(probe) != f"{SPACE}a{SPACE}{SPACE}b{SPACE}" or any("\n" in p for p in longer) or any(b == SPACE != a for p in longer for a, b in zip(p, p[1:])):
            raise ValueError("the model normalises or joins texts in a way that is not offered")
        # and before these marks, where a letter or digit stands before them
        joint = {b for p in longer for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = "".join(re.escape(c) for c in MARKS if c not in joint)
        self.cache = Remembered()
        rest = f"[^{SPACE}\n]*+\n?"
        self.parts = re.compile(f"{SPACE}*+(?:[^\\W_]++(?:(?=[{marks}])|{rest})|{rest})" if marks else f"{SPACE}*+{rest}")
        #: parts that were merged since the last check
        self.fresh: list[str] = []
        # for matrices: the pieces of characters, and what pairs of pieces join to, by left * (n + 1) + right; n stands for none
        self.none, self.names = n, [str(i) for i in range(n)]
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        get = self.ids.get
        joins = sorted((a * (n + 1) + b, i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := get(p[:k])) is not None and (b := get(p[k:])) is not None)
        self.keys = np.array([x[0] for x in joins] + [2**62], np.int64)
        self.joins = np.array([x[1] for x in joins] + [n], np.int32)
        # places of the scores: equal ones have the same, and the best is the largest
        place = {s: k for k, s in enumerate(sorted(set(self.scores.values())))}
        places = np.full(n + 1, -1, np.int32)
        for p, i in self.ids.items():
            places[i] = place[self.scores[p]]
        self.places = places

    def merged(self, part: str) -> list[int]:
        """The ids of one part."""
        symbols = list(part)
        if len(symbols) > 1:
            symbols = self.few(symbols) if len(symbols) <= SHORT else self.many(symbols)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in s.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of pieces join to, or none."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.joins[at], self.none)

    def together(self, parts: list[str]) -> list[list[int]]:
        """The ids of each of many parts: a row of the agenda for each, from which every round takes the best pair, the leftmost among equals."""
        out: list[list[int] | None] = [None] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        short = np.argsort(sizes, kind="stable")[: np.count_nonzero(sizes <= SHORT)]
        for at in range(0, len(short), ROWS):
            rows = short[at : at + ROWS]
            some = [parts[k] for k in rows.tolist()]
            lengths = sizes[rows]
            symbols = np.full((len(some), lengths.max() + 1), self.none, np.int32)
            symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = self.chars[np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)]
            known = (symbols >= 0).all(1)  # other parts have characters that are no pieces
            symbols, lengths, rows = symbols[known], lengths[known], rows[known]
            agenda = self.places[self.joined(symbols[:, :-1], symbols[:, 1:])]
            while len(rows):
                best = agenda.argmax(1)
                each = np.arange(len(rows))
                go = agenda[each, best] >= 0
                if not go.all():
                    done = ~go
                    for k, n, row in zip(rows[done].tolist(), lengths[done].tolist(), symbols[done].tolist()):
                        out[k] = row[:n]
                    symbols, agenda, lengths, rows, best = symbols[go], agenda[go], lengths[go], rows[go], best[go]
                    each = np.arange(len(rows))
                symbols[each, best] = self.joined(symbols[each, best], symbols[each, best + 1])
                past = np.arange(symbols.shape[1] - 1) - best[:, None]
                symbols = np.where(past > 0, symbols[:, 1:], symbols[:, :-1])
                agenda = np.where(past[:, :-1] >= 0, agenda[:, 1:], agenda[:, :-1])
                lengths = lengths - 1
                # the joined symbol's pairs to either side, where there are such
                left, right = best > 0, best < agenda.shape[1]
                for where, first in ((left, best - 1), (right, best)):
                    e, f = each[where], first[where]
                    agenda[e, f] = self.places[self.joined(symbols[e, f], symbols[e, f + 1])]
                if not agenda.shape[1]:
                    for k, n, row in zip(rows.tolist(), lengths.tolist(), symbols.tolist()):
                        out[k] = row[:n]
                    break
        rest = [k for k, x in enumerate(out) if x is None]
        lines = [k for k in rest if len(parts[k]) > 1 and parts[k][-1] == "\n"]  # no piece spans the cut before it
        if lines:
            end = self.merged("\n")
            for k, ids in zip(lines, self.together([parts[k][:-1] for k in lines])):
                out[k] = ids + end
        return [self.merged(p) if x is None else x for p, x in zip(parts, out)]

    def checked(self) -> None:
        """Holds every part merged since the last check against the library, in lines of some parts each; raises at a difference."""
        line, space = tuple(self.merged("\n")), self.merged(SPACE)
        for at in range(0, len(self.fresh), 100_000):
            parts = self.fresh[at : at + 100_000]
            get, elder = self.cache.get, self.cache.elder
            found = [got[0] if (got := get(p) or elder.get(p)) else tuple(self.merged(p)) for p in parts]
            lines = range(0, len(parts), LINE)
            ids = [[*space, *chain.from_iterable(chain.from_iterable(zip(repeat(line), found[k : k + LINE])))] for k in lines]
            if self.library.encode(["\n" + "\n".join(parts[k : k + LINE]) for k in lines], num_threads=1) != ids:
                raise ValueError("the ids differ from the library's")
        for part in self.fresh:
            if len(part) > REMEMBERED:
                self.cache.pop(part, None)
                self.cache.elder.pop(part, None)
        self.fresh.clear()

    def few(self, symbols: list[str]) -> list[str]:
        """The agenda as a plain list beside the symbols: the quickest form for a short part."""
        get = self.scores.get
        agenda = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > NONE:
            k = agenda.index(best)
            symbols[k : k + 2] = [joined := symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = get(joined + symbols[k + 1], NONE)
            if k:
                agenda[k - 1] = get(symbols[k - 1] + joined, NONE)
        return symbols

    def many(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap: n log n for a part of any length."""
        n, get = len(symbols), self.scores.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score, k, k + 1, joined) for k in range(n - 1) if (score := get(joined := symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if not symbols[a] or after[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (score := get(longer := joined + symbols[c])) is not None:
                    heapq.heappush(agenda, (-score, a, c, longer))
            if (c := before[a]) >= 0 and (score := get(longer := symbols[c] + joined)) is not None:
                heapq.heappush(agenda, (-score, c, a, longer))
        return [s for s in symbols if s]

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and their decimal forms joined by commas."""
        return self.encoded([text])[0]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text the ids, and their decimal forms joined by commas."""
        if len(self.cache) > CACHED // 2:
            self.cache.elder = {}
            self.cache = Remembered(self.cache)
        cache, names = self.cache, self.names
        parts = (self.parts.findall(SPACE + t.replace(" ", SPACE))[:-1] if t else [] for t in texts)  # the last is empty
        found = [list(map(cache.__getitem__, own)) for own in parts]
        for part, ids in zip(cache.new, self.together(cache.new)):
            cache[part][:] = tuple(ids), ",".join([names[i] for i in ids])
        self.fresh += cache.new
        cache.new.clear()
        return [(list(chain.from_iterable(map(itemgetter(0), got))), ",".join(map(itemgetter(1), got))) for got in found]


def _digests(model: bytes, keep_ids: bool, verify: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(model)
        gc.disable()  # the cache holds no cycles, and walking it costs time

        def flush(keys: list, texts: list[str]) -> pa.RecordBatch:
            found = merger.encoded(texts)
            ids = [x[0] for x in found]
            merger.checked()
            if verify == "texts" and (theirs := merger.library.encode(texts, num_threads=1)) != ids:
                bad = next(k for k, (a, b) in enumerate(zip(ids, theirs, strict=True)) if a != b)
                raise ValueError(f"doc_id {keys[bad]}: the ids differ from the library's")
            decoded = [merger.library.decode(x) if x else "" for x in ids]
            sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            columns = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x[1]) for x in found], pa.string()), "decoded_sha256": pa.array([sha(x) for x in decoded], pa.string())}
            if keep_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for part in pieces(batch, 1, BATCH_BYTES):
                yield flush(part.column(0).to_pylist(), part.column(1).to_pylist())

    return run


def encode_decode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, verify: str = "parts") -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded.

    verify: "parts" holds each distinct part of a batch against the library, "texts" each whole text besides.
    """
    with open(model_path, "rb") as f:  # the driver's own copy of a public vocabulary
        model = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(released(_digests(model, keep_ids, verify)), schema)
