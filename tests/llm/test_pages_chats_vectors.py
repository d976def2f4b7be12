import html as html_lib
from collections import defaultdict

import numpy as np
import pytest

from tarnlight.llm import chat_format, exact_topk, html_template


def page(body, nav="<nav><a>Home</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{nav}{body}<footer>f</footer></body></html>"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, key int").repartition(3)

    return make


CASES = [
    ("<article><h1>A &amp; B</h1><p>one\n two<b>bold</b><p>three<br>four</article>", "A & B one twobold three four"),
    ("<article><p>x&nbsp;y &#233;&copy</p><aside>no</aside><div class='comments'>no</div><form>no</form></article>", "x y é©"),
    ("<main><p>main</p></main><p>out</p>", "main"),
    ("<p>plain</p><div class=ad>no</div><ul><li>a<li>b</ul>", "plain a b"),
    ("<article><p>a</p><!-- <p>no</p> --><script>no</script><article class='comment'>no</article></article>", "a"),
    ("<article><header><h1>T</h1></header><p>a</i></p></div><table><tr><td>1<td>2</table>", "T a 1 2"),
    ("", ""),
    ("text <b>only", "text only"),
]


@pytest.mark.parametrize(("body", "want"), CASES)
def test_main_text(body, want):
    assert html_template.parse(page(body))[0] == want


def test_extract_edges(pages):
    rows = [(k, f"http://h{k}.com/x", page(b)) for k, (b, _) in enumerate(CASES)] + [(50, None, None), (51, "nonsense", ""), (51, "nonsense", ""), (52, "http://e.com", "<div>" * 20_000 + "deep"), (53, "http://e.com", "<p>w</p>" * 20_000)]
    got = html_template.extract(pages(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    for k, (_, want) in enumerate(CASES):
        assert by[k] == {want}
    assert by[50] == by[51] == {""} and by[52] == {"deep"}
    assert html_template.extract(pages([])).count() == 0


@pytest.mark.parametrize("most", [100_000, -1])
def test_templates_of_a_host_go(pages, most):
    site = "<div id=box><p>Sign our guest book</p></div>"
    rows = [(k, "http://one.com/a", page(f"<p>story {k}</p>{site}")) for k in range(8)]
    rows += [(100 + k, "http://two.com/a", page(f"<p>other {k}</p>{site}")) for k in range(3)]
    rows += [(200 + k, "http://art.com/a", page(f"<article><p>the same passage</p><p>{k}</p></article>")) for k in range(9)]
    rows += [(300 + k, "http://copy.com/a", page("<p>same page</p><div>in all copies</div>")) for k in range(9)]
    got = {r.page_id: r.text for r in html_template.extract(pages(rows), broadcast_rows=most).collect()}
    assert got[3] == "story 3"  # recurs on eight pages of its host
    assert got[101] == "other 1 Sign our guest book"  # on three only
    assert got[204] == "the same passage 4"  # content of articles is kept
    assert got[305] == "same page in all copies"  # copies of one page count once


def test_article_of_the_test_tables():
    import re

    import duckdb

    for (h,) in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want = html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body)))
        assert html_template.parse(h)[0] == " ".join(want.split())


def brute_chats(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t, role or "", text or ""))
    seq = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0]))) for c, v in turns.items()}
    out = {}
    for c, s in seq.items():
        same = [d for d in seq if seq[d] == s]
        if c == min(same, key=lambda d: (d is not None, d)) and not any(len(t) > len(s) and t[: len(s)] == s for t in seq.values()):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s))
    return out


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, None, None), (6, 0, "user", ""), (6, 1, "user", "x" * 50_000), (7, None, "user", "n"), (7, 2, "user", "m"), (None, 0, "user", "hi"), (8, 0, "userh", "i")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as k", "2 as p1", "'z' as last").repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.render(df).collect()}
    assert got == brute_chats(rows)
    assert chat_format.render(df.limit(0)).count() == 0


def brute_topk(vectors, k):
    out = []
    for q, a in vectors:
        if q % 20 == 0:
            scored = sorted(((-int(np.dot(a, b)), i) for i, b in vectors if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(0, 64), (15, 64), (300, 64), (300, 4096)])
def test_topk(spark, n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    if n > 100:
        x[50:80] = x[50]  # ties
    rows = [(k, [float(v) for v in x[k]]) for k in range(n)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 16), (1060, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as q", "2 as slot").repartition(3)
    v = exact_topk.integers(df)
    got = exact_topk.top_k(v, v.filter("vec_id % 20 = 0"), block=block).collect()
    want = brute_topk([(k, np.floor(64 * x[k].astype(float)).astype(np.int64)) for k in range(n)], 20)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_topk_stops_on_proof_and_rescores():
    rng = np.random.default_rng(1)
    block = rng.integers(-2, 3, size=(3000, 8))
    block[:40] = rng.integers(200, 250, size=(40, 8))
    q = np.full((2, 8), 9)
    found = {j: (ids, s) for j, ids, s in exact_topk.best(q, np.array([-1, 5]), block, np.arange(3000), np.full(2, -(2**62)), 20)}
    assert len(found[0][0]) < 100
    for j, own in ((0, -1), (1, 5)):
        exact = block @ q[j]
        want = set(sorted((i for i in range(3000) if i != own), key=lambda i: (-exact[i], i))[:20])
        assert want <= set(found[j][0]) and (exact[found[j][0]] == found[j][1]).all()


@pytest.mark.parametrize("few", [1, 64])
def test_topk_null_and_repeated_ids(spark, few):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, size=(90, 8)).astype(float)
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(None, x[0].tolist())] * 5 + [(33, x[33].tolist())] * 60 + [(20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = exact_topk.integers(df, scale=1.0)
    got = exact_topk.top_k(v, v.filter("vec_id % 20 = 0"), block=few * 4, block_asked=few).collect()
    known = [(i, np.array(e).astype(int)) for i, e in rows if i is not None]
    asked = {i: e for i, e in known if i % 20 == 0}
    want = []
    for q, a in asked.items():
        best = sorted((-int(a @ b), i) for i, b in known if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert exact_topk.top_k(v.filter("false"), v.filter("false")).count() == 0


def test_topk_broadcasts_no_table(spark):
    """Blocks of queries were broadcast once for each slot: their vectors came to the driver, more of them the larger the table."""
    rng = np.random.default_rng(11)
    x = rng.integers(-9, 10, size=(400, 8))
    v = exact_topk.integers(spark.createDataFrame([(k, a) for k, a in enumerate(x.astype(float).tolist())], "vec_id long, embedding array<double>"), scale=1.0)
    found = exact_topk.top_k(v, v.filter("vec_id % 20 = 0"), block=16, block_asked=8)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == brute_topk(list(enumerate(x)), 20)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_topk_proves_stops_on_the_test_tables():
    import duckdb

    got = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' where embedding is not null").fetchall()
    ids, x = np.array([g[0] for g in got]), np.floor(64 * np.array([g[1] for g in got], dtype=np.float32).astype(float)).astype(np.int64)
    stops, asked = {}, ids % 20 == 0
    for _ in exact_topk.best(x[asked], ids[asked], x, ids, np.full(int(asked.sum()), -(2**62)), 20, stops):
        pass
    print(stops)
    assert stops["stopped"] > 0
