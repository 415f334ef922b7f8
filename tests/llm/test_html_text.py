import html as references
import re
import time

import pytest
from pyspark.sql import functions as F

from surfaceworks.llm import html_text
from surfaceworks.llm.html_text import Page, choose
from surfaceworks.llm.queries import op12_html_text

PAGES = "page_id long, url string, html string, text int, path string, host string"
LONG = "A sentence of prose that is long enough to count as such, really."


def text(page):
    return choose(Page(page), [])[0]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("<", "<"), ("</", ""), ("<p>x<!-- y", "x"), ("1 < 2 &amp; 3 &lt;p&gt; &#233;&eacute;&nbsp;z", "1 < 2 & 3 <p> éé z"), ("<script>x", ""), ("<a b='>' c>t</a>u", "tu"), ("<p a=\"x>y<p>z", "y\n\nz"),
        ("<p> a \n\t b<br>c </p>d<div>e</div>", "a b c\n\nd\n\ne"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"), ("<p>a<svg><text>no</text></svg>b", "ab"), ("<P>A<TITLE>t</TITLE><STYLE>s</STYLE>", "A"),
        (f"<body class=has-sidebar><div class=site-header><h1>Site</h1></div><div class='post-12 entry-content'><h2>T</h2><p>{LONG}<div class=comments><article>{LONG} {LONG}</article></div><form>f</form></div><div id=sidebar>{LONG}</div><footer>c</footer>", f"T\n\n{LONG}"),
        (f"<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><section><p>{LONG}</section><section><p>{LONG}</section><footer>x</footer></article><aside>{LONG}</aside>", f"T\n\n{LONG}\n\n{LONG}"),
        (f"<nav>m</nav><main><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><div role=alert>n</div><div hidden>h</div></main>", LONG),
        (f"<div class=ad-wrap><main><p>{LONG}</p></main></div>", LONG),
    ],
)
def test_text(page, want):
    assert text(page) == want


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "deep", "<a \"" * 100_000, "</nav>" * 100_000, "<div>" * 20_000 + "</nav><li>" * 20_000, "<p>" * 100_000, "<!--" * 100_000, "&" * 200_000, "<svg>" * 100_000, "<title>" * 100_000, "<td>" * 100_000):
        choose(Page(page), [b"x" * 16])
    assert time.time() - began < 30


def by_hand(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(x for x in blocks if x)


def test_query_against_the_template_by_hand(spark):
    d = "/root/testdata/sf0.01"
    want = {r.page_id: by_hand(r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op12_html_text(spark, d).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def site(i, column="col-b"):
    """Pages whose classes say nothing; on every seventh the other column is longer."""
    other = LONG * (40 if i % 7 == 0 else 1)
    return f"<body><div class='col-a'><p>{other}</p></div><div class='{column} k{i}'><p>{LONG} {LONG} {LONG} {LONG} own {i}.</p><p>{LONG} {LONG}</p></div></body>"


@pytest.mark.parametrize("most_hosts", [html_text.MOST_HOSTS, 0])
def test_winning_paths_decide(spark, most_hosts):
    """Pages that would choose another container follow their host's; those of another template keep their own."""
    rows = [(i, f"https://one.example/{i}", site(i), 1, "p", "h") for i in range(40)] + [(100, "https://one.example/x", f"<main><p>{LONG}</main>", 1, "p", "h"), (101, None, None, None, None, None), (102, "no address", "", 1, "p", "h")]
    rows += [rows[3], (103, "https://two.example/", site(7), 1, "p", "h")]
    out = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(5), most_hosts=most_hosts)
    assert sorted(out.columns) == sorted(["page_id", "url", "text", "path", "host", "n_chars"])
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(f"own {i}." in got[i].text and (LONG * 2).strip() not in got[i].text and got[i].path == "body/div.col-b.k#" for i in range(40))
    assert got[100].text == LONG and got[101].text == got[102].text == "" and got[101].n_chars == 0
    assert "own" not in got[103].text  # alone on its host


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_votes_are_shares_of_a_host(spark):
    pages = spark.createDataFrame([(i, "https://h/", site(i, f"c{'x' * (i % 30)}"), 1, "p", "h") for i in range(60)], PAGES)
    won = html_text.winners(pages, F.lit("h")).collect()
    assert len(won) == 1 and 1 <= len(won[0]["keys"]) <= 20
