import re
from collections import defaultdict
from html import unescape

import duckdb
import pytest

from tarnlight.llm import html_template


def test_a_template_goes_at_any_size_of_its_host(spark):
    box = "<div><p>About the author</p></div>"
    rows = [(k, "http://small.com/a", f"<body><p>story {k}</p>{box if k < 8 else ''}</body>") for k in range(20)]
    rows += [(1000 + k, "http://huge.com/a", f"<body><p>story {k}</p>{box if k < 8 else ''}</body>") for k in range(2000)]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == got[1003] == "story 3"  # on eight pages, of 20 and of 2,000
    assert len(got) == len(rows) and not any("author" in t for t in got.values())


def test_blocks_without_a_telling_name_go_by_their_count(spark):
    related = "<div class=related><ul><li>One more story</ul></div>"
    rows = [(k, "http://a.com/x", f"<body><article><p>story {k}</p>{related}</article></body>") for k in range(9)]
    rows += [(100 + k, "http://b.com/x", f"<body><article><p>tale {k}</p><div class=related>see {k}</div></article></body>") for k in range(9)]
    got = {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].text == "story 4" and got[4].template_chars == len("One more story")
    assert got[104].text == "tale 4 see 4" and got[104].template_chars == got[104].markup_chars == 0


def article(html):
    """The text of the test tables' articles, by their own plain form."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", found[1]))).split()) if found else ""


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_counts_against_brute_force(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()
    beside = defaultdict(set)
    for _, url, html in rows:
        text, found, _, _ = html_template.parse(html or "")
        for h in found:
            beside[re.match(r"[a-z]+://([^/?#:]*)", url)[1], h].add(text)
    want = {k: len(texts) for k, texts in beside.items() if len(texts) >= html_template.LEAST_PAGES}
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert {(r.host, r.hash): r.n for r in html_template.templates(html_template.features(pages)).collect()} == want
    got = html_template.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == {i: article(html) for i, _, html in rows}
    by_templates, by_markup = (sum(r[c] for r in got) for c in ("template_chars", "markup_chars"))
    print(f"sf {sf}: {len(want)} templates; characters deleted by templates {by_templates}, by markup {by_markup}")
    assert (by_templates > 0) == bool(want) and by_markup > 0
    if sf == "0.1":
        assert by_templates > 10_000
