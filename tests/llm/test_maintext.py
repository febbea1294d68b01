"""Main text of the given pages against their plain layout, and of pages with the faults that real ones have."""

import random
import re
from html import unescape

import pytest

from ledgerloom.llm import maintext
from ledgerloom.llm.maintext import Paths, ballot, main_text, parse

PAGES = "page_id long, url string, html string, host string, path string, paths string"
ONE, TWO, THREE = ("A first paragraph of the story, long enough.", "A second one, which goes on & on.", "And a third that ends it.")


def plain(html):
    """The text of the given pages, whose layout is known: all blocks of the one article."""
    article = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = [unescape(re.sub("</?b>", "", part.replace("<br>", " "))) for part in re.split("</?(?:p|h1)>", article)]
    return "\n".join(p for p in (" ".join(part.split()) for part in parts) if p)


def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r for r in maintext.extract(pages.repartition(5)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        found = got[r["page_id"]]
        assert (found["url"], found["text"], found["n_chars"]) == (r["url"], plain(r["html"]), len(plain(r["html"])))


def text_of(html, ranked=()):
    return main_text(html, Paths(), ranked)[0]


@pytest.mark.parametrize(("html", "want"), [
    (f"<html><body><nav>Home <a>x</a></nav><article><h1>T</h1><p>{ONE}<p>{TWO}</article><footer>c 2020</footer>", ["T", ONE, TWO]),
    (f"<div id='wrap' class='page with-sidebar'><div class=content><p>{ONE}</p><p>{TWO}</p></div><div class='sidebar'><p>Latest</p></div></div>", [ONE, TWO]),
    (f"<form action=x><div><p>{ONE}</p><p>{TWO}</p><input><select><option>a</select><button>Go</button></div></form>", [ONE, TWO]),
    (f"<main><article><header><h1>T</h1><p>By a writer</p></header><p>{ONE}</p><footer>tags</footer></article>"
     f"<section class=comments><article class=comment><p>{TWO * 30}</p></article></section></main>", ["T", ONE]),
    (f"<article><p>{ONE}</p><div class='ad-slot'>Buy</div><aside>More</aside><p>{TWO}</p><script>if (a</p>b) '<p>x'</script></article>", [ONE, TWO]),
    (f"<article><p>{ONE}</p><!-- <p>no</p> --><p>a &lt;b&gt; &eacute;&#233;&nbsp; c<br>d<p hidden>no</p></article>", [ONE, "a <b> éé c d"]),
    (f"<body><p>{ONE}</p><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", [ONE, "x", "y", "1 2", "3"]),
    (f"<table><tr><td><a href=a>one</a> <a href=b>two</a></td><td class=text><p>{ONE}</p><p>{TWO}</p></td></tr></table>", [ONE, TWO]),
    (f"<p>{ONE}", [ONE]), (ONE, [ONE]), ("", []), ("<", ["<"]), ("a < b and 3 <4", ["a < b and 3 <4"]), ("<html><body></body>", []),
    (f"<article><p title='a > b' data-x=\"</p>\">{ONE}</p></i></div></article></article>", [ONE]),
    (f"<ARTICLE><P CLASS=x>{ONE}</P></ARTICLE><DIV CLASS='Cookie-Notice'><P>{TWO * 9}</P></DIV>", [ONE]),
    (f"<nav><ul><li><a>x</a></ul><div><p>{ONE}</p><p>{TWO}</p></div>", [ONE, TWO]),
])
def test_layouts(html, want):
    assert text_of(html) == "\n".join(" ".join(unescape(w).split()) if w in (ONE, TWO) else w for w in want)


def test_pages_of_a_host_agree(spark):
    """A short article beside a long notice without a telling name, and a page of another layout."""
    notice = f"<div class='n7'><p>{'We have changed how we look. ' * 8}</p></div>"
    page = "<html><body>{}<div class='text'><p>{}</p><p>{}</p></div></body></html>"
    rows = [(i, f"http://x.org/{i}", page.format(notice if i % 4 == 0 else "", ONE * 9, THREE * i)) for i in range(1, 40)]
    rows += [(100, "https://X.org:80/s", page.format(notice, "Short.", "So it is.")), (101, "//u@x.org./t", f"<body><section><p>{TWO}</p></section>")]
    rows += [(102, None, page.format(notice, "Short.", "So it is.")), (102, None, None), (102, "no address", "")]
    got = maintext.extract(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(4)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[4]["text"] == f"{ONE * 9}\n{THREE * 4}"
    assert by[100]["text"] == "Short.\nSo it is." and by[101]["text"] == " ".join(TWO.split())
    alone = [r for r in got if r["page_id"] == 102]
    assert {r["text"] for r in alone} == {"", " ".join(("We have changed how we look. " * 8).split())}


def test_hosts(spark):
    urls = ["http://A.b/c", "//u:p@h.i:8/x", "https://x.org.", "http://[::1]:80/", "mailto:a@b", "", None, "h.i/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(maintext.host_of(df["url"])).collect()] == ["a.b", "h.i", "x.org", "[::1]", None, None, None, None]


def test_paths_leave_numbers_out():
    paths = Paths()
    pages = [parse(f"<body><div class='post-{i} post{i}x entry'><p>{ONE}</p></div>", paths) for i in (1, 22)]
    assert {ballot(p, paths)[0][0] for p in pages} == {"page>body>div.entry.post-.postx"}


def test_any_markup_is_read_in_reasonable_time():
    for html in ["<div>" * 50_000 + ONE, "<p " * 50_000, '<a href="' * 50_000, "<!--" * 50_000, "</div>" * 50_000, "<b" + " x='y'" * 50_000, "<li>" * 50_000]:
        text_of(html)
    r = random.Random(1)
    bits = ["<div>", "</div>", "<p>", "</p>", "<td>", "<tr>", "</tr>", "<table>", "<li class=ad>", "</li>", "<a>", "</a>", "text ", "&amp;", "<", ">", '"', "<!--", "-->",
            "<script>", "</script>", "<article>", "</article>", "<header>", "</header>", "<h2>", "<br/>", "<svg/>", "<x-y>"]
    for _ in range(3000):
        text_of("".join(r.choice(bits) for _ in range(r.randint(0, 60))))


def test_empty_table(spark):
    assert maintext.extract(spark.createDataFrame([], PAGES)).count() == 0
