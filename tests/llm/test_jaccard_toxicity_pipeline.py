import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnlight.llm import components, jaccard_join, toxicity
from tarnlight.llm import queries as llm_queries

from .conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(some)):
        for b in range(a):
            x, y = some[a][1], some[b][1]
            if 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((top(some[a][0]), top(some[b][0])))
                parent[v] = u
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(12))
    out, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(6)]
    for k in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        t = " ".join(w) + (" " + passage if rng.random() < 0.4 else "")
        out.append((k * 3 + 1, t.upper() if rng.random() < 0.1 else t))
    return out


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("hot", "members", "docs_of_block", "broadcast"), [(24, 16, 1024, 500_000), (3, 1, 8, 500_000), (8, 2, 16, -1)])
def test_join_against_brute_force(docs, monkeypatch, hot, members, docs_of_block, broadcast):
    for k, v in (("HOT", hot), ("MEMBERS", members), ("BLOCK_DOCS", docs_of_block), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(jaccard_join, k, v)
    monkeypatch.setattr(jaccard_join.small, "__defaults__", (broadcast,))
    rows = corpus(hot, 160)
    assert result(jaccard_join.join(docs(rows))) == brute(rows)


def test_join_edges(docs):
    rows = [*EDGES, (20, "one two three"), (21, "ONE\ttwo three"), (22, "one two three four"), (23, "\xa0 x")]
    got = result(jaccard_join.join(docs(rows)))
    assert got == brute(rows)
    assert jaccard_join.join(docs([])).count() == 0
    assert result(jaccard_join.join(docs([(1, None), (2, "")]))) == Counter({(1, 0, 1): 1, (2, 0, 2): 1})


def test_threshold_is_inclusive(docs):
    base = [f"a{k}" for k in range(40)]
    # 36 shingles; dropping four words at the end leaves 32 of 36: 8 / 9; eight leave 28 of 36 = 7 / 9
    rows = [(1, " ".join(base)), (2, " ".join(base[:36])), (3, " ".join(base[:32]))]
    assert result(jaccard_join.join(docs(rows))) == brute(rows)
    four = [(1, " ".join(base[:9])), (2, " ".join(base[:8]))]  # 4 of 5 shingles: exactly 0.8
    assert result(jaccard_join.join(docs(four))) == Counter({(1, 5, 1): 1, (2, 4, 1): 1})


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    parent = {x: x for l in links for x in l}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        u, v = sorted((top(a), top(b)))
        parent[v] = u
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1])
    e, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    edges = np.zeros((2, 2))
    got = toxicity.marginals(e, lengths, moves, edges)
    at, moved = 0, np.zeros((2, 2))
    for n in lengths:
        total, on, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + k] for k, y in enumerate(tags) if y) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                own[a, b] += w
        assert np.allclose(got[at : at + n], on / total)
        moved += own / total
        at += n
    assert np.allclose(edges, moved)


def toxic_corpus(n):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zzbad", "zzbadly", "qqvile", "qqvilest"])
        rows.append((k, " ".join(w) + "."))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(docs, spark):
    rows, labels = toxic_corpus(400)
    d = docs(rows + [(900, None), (901, ""), (902, "x" * 50_000), (None, "zzbad thing")])
    known = spark.createDataFrame(labels + [(1, None, None), (900, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, known)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(got) == 404
    held = {r.doc_id for r in d.select("doc_id").filter(toxicity.held_out()).collect()}
    assert held
    right = [(got[k].predicted == y) for k, _, y in labels if k in held]
    assert sum(right) / len(right) > 0.97
    assert 0 <= got[900].score < 0.5 and got[900].score == got[901].score
    spans = got[0].spans
    text = dict(rows)[0]
    assert spans and all(text[s.start : s.end].startswith(("zz", "qq")) for s in spans)
    clean = toxicity.clean(d, model)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.predicted}


def test_scores_against_enumeration(docs, spark):
    from itertools import product
    from math import exp, log

    rows, labels = toxic_corpus(200)
    model = toxicity.fit([t for _, t in rows], [y for _, _, y in labels])
    assert abs(model.moves).max() > 0
    texts = [(k, " ".join(t.split()[:n])) for n, (k, t) in zip([1, 2, 5, 9, 9, 8, 7] * 4, rows)] + [(700, "Zzbad QQVILE, zzbad!"), (701, None), (702, "...")]
    got = {r.doc_id: r for r in toxicity.score(docs(texts), model).collect()}
    for i, t in texts:
        words = toxicity.TOKEN.findall(t or "")
        e = []
        for k, w in enumerate(words):
            found = list(toxicity.features(w))
            found += [toxicity.beside(words[k - 1])[0]] if k else []
            found += [toxicity.beside(words[k + 1])[1]] if k + 1 < len(words) else []
            e.append(model.bias + sum(float(model.weights[f]) for f in found))
        total, on = 0.0, [0.0] * len(words)
        for tags in product((0, 1), repeat=len(words)):
            weight = exp(sum(x for x, y in zip(e, tags) if y) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            for k, y in enumerate(tags):
                on[k] += weight * y
        p = [min(max(x / total, 1e-3), 1 - 1e-3) for x in on]
        peak = max(p, default=None)
        x = (1.0, log(1 + sum(-log(1 - q) for q in p if q > 0.02)) if p else 0.0, log(peak / (1 - peak)) if p else -7.0)
        want = 1 / (1 + exp(-sum(a * b for a, b in zip(x, model.score))))
        assert abs(got[i].score - want) < 1e-5, t
        assert len(got[i].spans) == sum(q / total >= toxicity.SPAN for q in on)


def test_marks_do_not_depend_on_the_size_of_the_sample():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(3000)]

    def sample(n, toxic):
        out = [[rng.choice(words) for _ in range(60)] for _ in range(n)]
        for k in range(14):  # a rare word, on as many toxic texts whatever their number
            if toxic:
                out[k][rng.randrange(60)] = "vexblort"
        return [" ".join(w) for w in out]

    for n in (60, 400):
        clean, bad = sample(2 * n, False), sample(n, True)
        for k in range(15, n):
            bad[k] += " " + rng.choice(words) + " qqvile " + rng.choice(words)
        model = toxicity.fit(clean + bad, [0] * len(clean) + [1] * len(bad))
        score, p, _ = toxicity._Scorer(model)([f"{words[1]} vexblort {words[2]}", f"{words[1]} {words[2]}"])
        assert p[1] > 0.5 and max(p[0], *p[2:]) < 0.5, n
        assert score[0] > score[1]


def test_repeated_labelled_ids_are_one_text(docs, spark):
    rows, labels = toxic_corpus(120)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    again = [(0, rows[0][1] + " longer")] * 300
    a, b = toxicity.learn(docs(rows), known), toxicity.learn(docs(rows + again), known)
    assert np.array_equal(a.weights, b.weights)


def test_toxicity_without_both_classes(docs, spark):
    known = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs([(1, "a b"), (2, None)])
    assert toxicity.learn(d, known) is None
    assert [(r.score, r.predicted) for r in toxicity.score(d, None).collect()] == [(0.0, 0)] * 2
    assert toxicity.score(docs([]), None).count() == 0


def test_labels_held_out_are_not_learned_from(docs, spark):
    rows, labels = toxic_corpus(200)
    d = docs(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = known.withColumn("toxic", (known.toxic + toxicity.held_out().cast("int")) % 2)
    a, b = toxicity.learn(d, known), toxicity.learn(d, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.score, b.score)


def test_toxicity_on_the_test_tables(spark):
    import duckdb

    got = {r.doc_id: r for r in llm_queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    known = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i].predicted, y) for i, y in known if got[i].held_out]
    assert sum(p for p, y in held if not y) <= 2
    assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held)


def test_pipeline_against_brute_force(spark, tmp_path):
    import hashlib

    import corpus_pipeline
    import sentencepiece

    rows, labels = toxic_corpus(160)
    extra = corpus(1, 60)
    texts = rows + [(1000 + i, t) for i, t in extra] + [(5000 + i, t) for i, t in rows[1:30]] + [(9000, None), (9001, ""), (9002, "lone")]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == df.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept[name] = Counter((r.doc_id, r["text"] if k < 4 else r.ids_sha256) for r in docs.collect())
    bad = {k for k, _, y in labels if y}
    stay = Counter(x for x in texts if not (x[1] and re.search(r"\b(zzbad|qqvile)", x[1])))
    assert kept["toxicity"] == stay and bad
    best = {}
    for i, t in stay:
        best[t or ""] = max(best.get(t or "", i), i)
    one = Counter(x for x in stay if best[x[1] or ""] == x[0])
    assert kept["exact dedup"] == one
    reached = {i: c for i, _, c in brute(list(one))}
    near = Counter(x for x in one if reached[x[0]] == x[0])
    assert kept["n-gram Jaccard join"] == near
    mixed = kept["mixing sources"]
    assert set(mixed) <= set(near) and max(mixed.values()) <= 2
    total = sum(len(WORD.findall(t or "")) for _, t in near)
    assert abs(sum(n * len(WORD.findall(x[1] or "")) for x, n in mixed.items()) - 1.5 * total) < 0.15 * total
    sp = sentencepiece.SentencePieceProcessor(model_file=llm_queries.model_path())
    sha = lambda t: hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest()
    assert kept["sentencepiece"] == Counter({(i, sha(t)): n for (i, t), n in mixed.items()})
