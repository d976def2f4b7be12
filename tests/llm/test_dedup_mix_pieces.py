import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from tarnlight.llm import exact_dedup, sentencepiece_bpe, source_mix
from tarnlight.llm.queries import model_path

from .conftest import EDGES


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_edges(docs):
    got = exact_dedup.exact_dedup(docs(EDGES)).collect()
    groups = defaultdict(list)
    for i, t in EDGES:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in EDGES:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        want[(i, best, len(ids), i == best, sha(t))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_smallest_and_empty(docs):
    got = exact_dedup.exact_dedup(docs([(3, "a"), (1, "a"), (2, "b")]), keep="smallest").collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(3, 1), (1, 1), (2, 2)}
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs([]), keep="none")


def test_deduplicated_keeps_columns_and_one_of_repeats(docs):
    d = docs([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    out = exact_dedup.deduplicated(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, "a"), (3, "b"), (5, "")]


def test_exact_dedup_many_copies_spread(docs):
    got = exact_dedup.exact_dedup(docs([(k, "copy") for k in range(500)] + [(1000 + k, f"own {k}") for k in range(50)])).collect()
    assert {r.keep_id for r in got if r.doc_id < 500} == {499}
    assert sum(r.kept for r in got) == 51


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_mix_targets_sizes_and_bounds(docs, n):
    rows = [(k, " ".join(["w"] * (k * 7 % 50 + 1)), ["a", "b", "é", None, "B"][k % 5]) for k in range(n)]
    if n > 5:
        rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t ", None), (3, "w w", "a")]
    d = docs(rows)
    got = source_mix.mix_documents(d).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = wanted_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for r in got:
        largest[r.source] = max(largest[r.source], r["size"])
    for s in taken:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = source_mix.mix_documents(d.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_tree_of_several_levels(docs):
    rows = [(k, "w " * (k % 13 + 1), "hot" if k % 3 else "b") for k in range(600)]
    sizes = source_mix.sizes_of(docs(rows))
    shares = source_mix.targets(sizes)
    got = source_mix.mix(sizes, shares, group=6).collect()
    assert len(got) == 600
    for s in ("hot", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
    assert len({r.copies for r in got}) > 1


def test_repeated(docs):
    d = docs([(1, "a b"), (2, "c d e"), (3, "f")])
    mixed = d.selectExpr("doc_id", "doc_id - 1 as copies")
    assert sorted(r.doc_id for r in source_mix.repeated(d, mixed).collect()) == [2, 3, 3]


def test_pieces_against_the_library(docs, spark):
    import sentencepiece

    texts = ["", " ", "  a  b ", "a<s>b\n\n▁x", "日本語 \U0001f600 é", "\x00\t<0x0A>", "word," * 50, "z" * 3000, "Étran-ge; \"x\" (y), z."]
    rows = list(enumerate(texts)) + [(100, None), (100, None)]
    got = sentencepiece_bpe.encode_decode(docs(rows), model_path(), keep_ids=True, verify="texts").collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ids = sp.encode(text[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode() if ids else b"").hexdigest()
    assert sentencepiece_bpe.encode_decode(docs([]), model_path()).count() == 0


def test_pieces_fuzz():
    import random

    merger = sentencepiece_bpe.Merger(open(model_path(), "rb").read())
    rng = random.Random(5)
    for k in range(3000):
        t = "".join(rng.choice("ab  \n▁é<0x>A0.,本the ing\x00\t" if k % 2 else "theinga ") for _ in range(rng.randint(0, 80)))
        assert merger.encode(t)[0] == merger.library.encode(t), repr(t)
    merger.checked()


def test_pieces_check_raises():
    merger = sentencepiece_bpe.Merger(open(model_path(), "rb").read())
    merger.encode("hello world")
    merger.cache["▁world"] = ((1,), "1")
    with pytest.raises(ValueError):
        merger.checked()


def test_agendas_agree():
    import random

    merger = sentencepiece_bpe.Merger(open(model_path(), "rb").read())
    rng = random.Random(6)
    for _ in range(500):
        s = ["▁", *(rng.choice("theinrsao") for _ in range(rng.randint(1, 40)))]
        assert merger.few(list(s)) == merger.many(list(s))


def test_pieces_merged_together(monkeypatch):
    """Short parts were merged one by one in Python, and the whole cache went when it was full: the query went beyond its time."""
    import random

    merger, rng = sentencepiece_bpe.Merger(open(model_path(), "rb").read()), random.Random(8)
    parts = ["".join(rng.choice("▁theinrsao.,é本\n" if k % 3 else "theina") for _ in range(rng.randint(1, 40))) for k in range(6000)]
    parts = [p[: p.find("\n") + 1] or p for p in parts] + ["\n", "▁"]
    assert merger.together(parts) == [merger.merged(p) for p in parts] and merger.together([]) == []
    calls = []
    monkeypatch.setattr(merger, "few", lambda symbols, few=merger.few: calls.append(symbols) or few(symbols))
    words = ["".join(rng.choice("theinrsao") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    text = " ".join(words) + "\n"
    assert merger.encode(text)[0] == merger.library.encode(text) and not calls
    monkeypatch.setattr(sentencepiece_bpe, "CACHED", 100)
    for at in range(0, 3000, 30):
        text = " ".join(words[at : at + 30] + words[:10])
        assert merger.encode(text)[0] == merger.library.encode(text)
        merger.checked()
    assert len(merger.cache) + len(merger.cache.elder) <= 200 and not merger.cache.elder.elder


class Twin:
    """The rounding, plainly, one document after another; its draws are the same hashes."""

    def __init__(self, group):
        self.group, self.seed = group, source_mix.SEED

    @staticmethod
    def hashed(*parts):
        h = 42
        for kind, v in parts:
            if v is not None:
                h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed=h)
        return h

    @staticmethod
    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def fold(self, items, level, attempt):
        carry, done = items[0], []
        for other in items[1:]:
            if carry["p"] < source_mix.EPS or carry["p"] > 1 - source_mix.EPS:
                done.append(carry | {"p": round(carry["p"])})
                carry = other
                continue
            down = min(carry["p"] * carry["size"], (1 - other["p"]) * other["size"])
            up = min((1 - carry["p"]) * carry["size"], other["p"] * other["size"])
            u = (self.hashed(("i", self.seed), ("q", carry["id"]), ("q", carry["draw"]), ("q", other["id"]), ("q", other["draw"]), ("i", level), ("i", attempt)) >> 11) / float(1 << 53)
            moved = -down if u * (up + down) < up else up
            p, q = carry["p"] + moved / carry["size"], other["p"] - moved / other["size"]
            if min(abs(p), abs(1 - p)) * carry["size"] <= min(abs(q), abs(1 - q)) * other["size"]:
                done.append(carry | {"p": math.floor(p + 0.5)})
                carry = other | {"p": q}
            else:
                done.append(other | {"p": math.floor(q + 0.5)})
                carry = carry | {"p": p}
        return carry, done

    def copies(self, rows, target, levels):
        """rows: (doc_id, size) of one source. A multiset of (doc_id, size, copies)."""
        total, n = sum(s for _, s in rows), len(rows)
        rate = target / total if total else 0.0
        floor = math.floor(rate + source_mix.EPS)
        p, out, groups, seen = max(rate - floor, 0.0), [], defaultdict(list), Counter()
        for i, s in rows:
            seen[i, s] += 1
            if not (s > 0 and p > source_mix.EPS):
                out.append((i, s, floor))
                continue
            again = seen[i, s]
            group = self.signed(self.hashed(("q", i), ("q", again), ("i", self.seed))) % math.ceil(n / self.group)
            groups[group].append({"order": -float(s), "draw": self.signed(self.hashed(("i", self.seed), ("q", i), ("q", again))), "id": i, "size": float(s), "p": p})
        for level in range(levels):
            carried = defaultdict(list)
            for g, items in groups.items():
                items.sort(key=lambda x: (x["order"], x["draw"], x["id"] is not None, x["id"], x["size"], x["p"]))
                tries = [self.fold(items, level, r) for r in range(1, source_mix.ATTEMPTS + 1 if n <= self.group ** (level + 1) else 2)]
                carry, done = min(tries, key=lambda t: min(t[0]["p"], 1 - t[0]["p"]) * t[0]["size"])
                out += [(x["id"], int(x["size"]), floor + x["p"]) for x in done]
                carried[g // self.group].append(carry)
            groups = carried
        return Counter(out + [(x["id"], int(x["size"]), floor + math.floor(x["p"] + 0.5)) for items in groups.values() for x in items])


@pytest.mark.parametrize("group", [5, 100])
def test_mix_against_a_plain_twin(docs, group):
    import random

    rng = random.Random(group)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["hot", "hot", "hot", "b", None])) for k in range(300)]
    rows += [(7, "w w w", "hot")] * 60 + [(None, "w " * 9, "hot")] * 40  # repeated and null ids
    sizes = source_mix.sizes_of(docs(rows))
    got = source_mix.mix(sizes, source_mix.targets(sizes), group=group).collect()
    of = defaultdict(list)
    for i, t, s in rows:
        of[s].append((i, len(WORD.findall(t))))
    want = wanted_targets({s: sum(n for _, n in x) for s, x in of.items()})
    levels, left = 1, math.ceil(max(map(len, of.values())) / group)
    while left > 1:
        levels, left = levels + 1, math.ceil(left / group)
    shares = {r.source: r.target for r in got}
    for s, x in of.items():
        assert shares[s] == pytest.approx(want[s])
        assert Counter((r.doc_id, r["size"], r.copies) for r in got if r.source == s) == Twin(group).copies(x, shares[s], levels), s


def test_mix_parts_rows_of_one_id(docs):
    rows = [(1, "w " * 10, "a")] * 400 + [(None, "w " * 10, "a")] * 400 + [(k + 2, "w " * 10, "b") for k in range(400)]
    sizes = source_mix.sizes_of(docs(rows))
    got = source_mix.mix(sizes, source_mix.targets(sizes), group=50).collect()
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5.1
