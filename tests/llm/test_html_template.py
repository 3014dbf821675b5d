import re
import time
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.llm import html_template
from papyrion.llm.html_template import main_text

SCHEMA = "page_id long, url string, html string, host string, template int"


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<p>a <b>b</b>c\n\t d</p><p>e<br>f</p>", "a bc d\ne f"),
        ("<nav>menu</nav><article><h1>T</h1><p>x&nbsp;y &#233;&#x263A;</p></article><footer>f</footer>", "T\nx y é☺"),
        ("<body><div class='side-bar sidebar'>s</div><div id=main><p>kept</p></div><aside>a</aside></body>", "kept"),
        ("<article><p>one<script>var a='</p>';</script> two</p><style>p{}</style><!-- <p>no</p> --></article>", "one two"),
        ("<article><p>post</p><section class='comments'><article class='comment'><p>reader</p></article></section></article>", "post"),
        ("<div class=cookie-notice>We use cookies</div><main><p>body</p><form><label>name</label></form></main>", "body"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<article><p>never closed <b>bold", "never closed bold"),
        ("<article><p title='a > b'>q</p><p hidden>h</p><p style='display: none'>n</p></article>", "q"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_one_page(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "piece, frame",
    [*((p, "{}") for p in ("<script ", "<a x='", "<a ", "<b><h1>", "<b></i>", "<li><ul>")), *((p, "<p><td>{}>") for p in ("<b><h1>", "<a '>'", "<script ", "<"))],
)
def test_hostile_pages_take_linear_time(piece, frame):
    def seconds(size):
        page = frame.format(piece * (size // len(piece)))
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(1_000_000) < max(4, 40 * seconds(100_000))


def page(i, body, host="h.example"):
    return (i, f"http://{host}/{i}?x=1", f"<html><body><div><span>Daily News</span><p>Home of all news</p><p>Call us</p></div><div><h1>Title {i}</h1><p>{body}</p></div><p>All rights reserved</p></body></html>", "x", 1)


def test_template_of_a_host_goes(spark):
    rows = [page(i, f"Story number {i}.") for i in range(30)]
    got = extracted(spark, rows)
    assert got == {i: f"Title {i}\nStory number {i}." for i in range(30)}


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_two_different_pages_make_a_template(spark, n):
    rows = [page(i, f"Story {i}.") for i in range(n)]
    got = extracted(spark, rows + [(100 + i, *row[1:]) for i, row in enumerate(rows)])
    frame = ("Daily News\nHome of all news\nCall us\n", "\nAll rights reserved") if n == 1 else ("", "")
    assert got == {k + i: f"Title {i}\nStory {i}.".join(frame) for i in range(n) for k in (0, 100)}


def test_a_passage_that_two_pages_share_stays(spark):
    """Two pages of a host have a passage in common, of less than half their text."""
    rows = [page(i, f"Story {i}. " + f"word{i} " * 30 + "</p><p>shared one</p><p>shared two</p><p>shared three") for i in range(2)]
    assert all(t.endswith("shared one\nshared two\nshared three") and t.startswith("Title") for t in extracted(spark, rows).values())


@pytest.mark.parametrize("wide", [100, 0])
def test_a_host_of_many_pages_is_salted(spark, monkeypatch, wide):
    monkeypatch.setattr(html_template, "SALTED", 7)
    monkeypatch.setattr(html_template, "MOST_WIDE", wide)
    rows = [page(i, f"Story number {i}.") for i in range(30)] + [page(100 + i, f"Other {i}.", "o.example") for i in range(3)]
    assert extracted(spark, rows) == {i: f"Title {i}\nStory number {i}." for i in range(30)} | {100 + i: f"Title {100 + i}\nOther {i}." for i in range(3)}


def test_one_page_under_many_addresses_keeps_its_text(spark):
    html = "<body><article><h1>Only</h1><p>one</p><p>two</p><p>three</p></article></body>"
    rows = [(i, f"http://h.example/{i}", html, None, None) for i in range(40)] + [(99, "http://h.example/z", "<body><article><p>else</p></article></body>", None, None)]
    got = extracted(spark, rows)
    assert got[7] == "Only\none\ntwo\nthree" and got[99] == "else"


def test_shared_passages_of_some_pages_stay(spark):
    rows = [page(i, f"Story {i}.</p><p>A licence line</p><p>and one more" if i % 2 else f"Story {i}.") for i in range(30)]
    got = extracted(spark, rows)
    assert got[3] == "Title 3\nStory 3.\nA licence line\nand one more" and got[4] == "Title 4\nStory 4."


def test_versions_of_one_article_keep_their_text(spark):
    body = "</p><p>".join(f"Paragraph {k} of the article, the same in each version." for k in range(6))
    rows = [page(i, f"Version {i}.</p><p>{body}") for i in range(20)]
    got = extracted(spark, rows)
    assert got[3] == "Title 3\nVersion 3.\n" + body.replace("</p><p>", "\n")


def test_slots_of_a_host_with_opaque_names(spark):
    """A page's menu, advert and comments come before or after the article in boxes of the same kind."""
    def opaque(i):
        menu = "".join(f"<li><a href=/{k}>to {k} {i}</a></li>" for k in range(4))
        advert = f"<div class=q3><p>Buy {i} now</p></div>" if i % 7 else ""
        return f"<body><div class=q1><ul>{menu}</ul></div>{advert}<div class=q7><div class=q8><h1>T {i}</h1><p>By us</p></div><div class=q9><p>Body {i} " + "of words " * (5 + i) + f"</p></div></div><div class=q4><p>Copyright {i}</p></div></body>"

    got = extracted(spark, [(i, f"http://h.example/{i}", opaque(i), None, None) for i in range(40)])
    assert got == {i: f"T {i}\nBody {i} " + "of words " * (4 + i) + "of words" for i in range(40)}


def test_classes_are_those_of_occurrence_vectors(spark):
    pages = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i, f"Story {i}." + "</p><p>more" * (i % 3 == 0))[2]) for i in range(40)]
    vectors = defaultdict(lambda: defaultdict(Counter))
    for i, url, html in pages:
        for token in html_template.parse(html):
            if token[0] >= 0:
                vectors[url[7]][html_template.token_hash(token)][i] += 1
    want = {}
    for host, tokens in vectors.items():
        classes = defaultdict(set)
        for token, vector in tokens.items():
            if len(vector) * 100 >= 20 * html_template.LEAST_PERCENT:
                classes[frozenset(vector.items())].add(token)
        want[host] = {frozenset(c) for c in classes.values() if len(c) >= html_template.LEAST_TOKENS}
    df = spark.createDataFrame(pages, "page long, url string, html string").withColumn("content", F.xxhash64("html"))
    found = html_template.templates(df.withColumn("host", F.ascii(F.substring("url", 8, 1)).cast("long"))).collect()
    got = {}
    for r in found:
        classes = defaultdict(set)
        for c, token in np.frombuffer(r.template, "<i8").reshape(-1, 2).tolist():
            classes[c].add(token)
        got[chr(r.host)] = {frozenset(c) for c in classes.values()}
    assert got == want and all(want.values())


def test_edges(spark):
    rows = [(1, None, "<p>a</p>", "x", 1), (2, "not a url", None, None, None), (3, "http://h/", "", "x", 1), (None, "http://h/", "<p>b</p>", "x", 1), (4, "http://h/", "<p>" + "w " * 300000 + "</p>", "x", 1), (5, "http://h/5", "<p>same</p>", "x", 1), (5, "http://h/5", "<p>same</p>", "x", 1)]
    out = html_template.extract(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "text"] and out.count() == len(rows)
    got = extracted(spark, rows)
    assert (got[1], got[2], got[3], got[None], got[5], len(got[4])) == ("a", "", "", "b", "same", 599999)
    assert html_template.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def simple(html):
    """The blocks of the article, for pages that nest nothing that is not main text in it."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


def test_query_is_the_article_of_every_page(spark):
    from papyrion.llm.queries import op2_html_extract

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r for r in op2_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert {i: (r.url, r.text) for i, r in got.items()} == {i: (p.url, simple(p.html)) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("most", [10**6, 7, 3, 2])
def test_template_alone_finds_the_article(spark, most):
    """Pages without semantic elements and without class names, at most so many of a host: only the
    template tells the article."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    pages = pages.withColumn("k", F.row_number().over(Window.partitionBy(F.regexp_extract("url", "//([^/]+)", 1)).orderBy("page_id"))).where(F.col("k") <= most)
    frame = "article|nav|footer|header|aside|main"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", rf"<({frame})\b[^>]*>", "<div>"), f"</({frame})>", "</div>"), ' class="[^"]*"', "")
    rows = html_template.extract(pages.withColumn("whole", F.col("html")).withColumn("html", bare)).collect()
    assert sum(r.text != simple(r.whole) for r in rows) == 0
    assert all(main_text(r.html) != r.text for r in rows)
