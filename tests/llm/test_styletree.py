"""Article texts: known templates, broken markup, repeated branches of a site, edge rows."""

import html
import re

from folioscope.llm import queries, styletree


def article(page):
    """The article of the test tables' pages: a heading and paragraphs inside <article>."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
    blocks = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_html_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for row in rows:
        want = article(pages[row.page_id].html)
        assert (row.text, row.n_chars, row.url) == (want, len(want), pages[row.page_id].url)


def test_broken_and_rich_markup():
    page = """<html><body class="has-sidebar"><header>Top</header><div class="wrap"><article class="post">
      <header><h1>T &amp; x</h1></header><p>One<br>two <b>three</p><p>four&nbsp;five<ul><li>a<li>b</ul>
      <div class="comments"><p>bad</p></div><table><tr><td>1<td>2</table><form>f</form>
      <div id="cookieNotice">q</div></article></div><aside>s</aside><footer>f</footer>
      <script>var x="<p>no"</script><!-- <p>c</p> --></body>"""
    assert styletree.main_text(page, set()) == "T & x\n\nOne two three\n\nfour five\n\na\n\nb\n\n1 2"
    for odd in ("", "<", "<a href=\"x>bro", "</p>", "<!--", "<script>", "plain &lt;", "<p><p></div>"):
        assert isinstance(styletree.main_text(odd, set()), str)
    assert styletree.main_text("<div class='ad'>x</div><p>y", set()) == "y"


def test_repeated_branches_of_a_site_go(spark):
    rows = [
        (i, f"http://a.com/{i}", f"<body><div class='x1'><p>Same line</p></div><div class='x2'><p>Own text {i} of the page</p></div></body>")
        for i in range(12)
    ] + [(100, "http://b.com/", "<body><div class='x1'><p>Same line</p></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in styletree.extract(pages).collect()}
    assert got == {i: f"Own text {i} of the page" for i in range(12)} | {100: "Same line"}


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://a.com/", "<body><article><p>Copy</p></article></body>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in styletree.extract(pages).collect()} == {"Copy"}


def test_edge_rows(spark):
    rows = [
        (1, None, None, "c"), (2, None, "", "c"), (3, "no host", "<p>x", "c"), (3, "no host", "<p>x", "c"),
        (4, "http://h/", "<p>" + "long words " * 50000, "c"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.row.page_id, r.text[:10]) for r in styletree.extract(pages).collect())
    assert got == [(1, ""), (2, ""), (3, "x"), (3, "x"), (4, "long words")]
    assert styletree.extract(pages.where("false")).count() == 0


def test_salted_pages_give_the_same_texts(spark, monkeypatch):
    rows = [
        (i, "http://a.com/", f"<body><div class='one'><p>Same line</p></div><div class='two'><p>Own {i}</p></div></body>")
        for i in range(20)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r.row.page_id, r.text) for r in styletree.extract(pages).collect())
    assert want == [(i, f"Own {i}") for i in range(20)]
    monkeypatch.setattr(styletree, "BROADCAST_NODES", -1)
    assert sorted((r.row.page_id, r.text) for r in styletree.extract(pages).collect()) == want


def test_marked_articles_keep_what_recurs(spark):
    page = "<body><article><h1>Title {0}</h1><h2>Introduction</h2><p>Own text {0}</p><h2>Results</h2></article></body>"
    copy = "<body><main><h1>Title {0}</h1><p>The same paragraph</p></main></body>"
    rows = [(i, "http://a.com/", page.format(i)) for i in range(12)]
    rows += [(100 + i, "http://b.com/", copy.format(i)) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in styletree.extract(pages).collect()}
    want = {i: f"Title {i}\n\nIntroduction\n\nOwn text {i}\n\nResults" for i in range(12)}
    assert got == want | {100 + i: f"Title {i}\n\nThe same paragraph" for i in range(10)}


def test_copies_of_a_page_are_no_repetition(spark):
    copy = "<body><div class='x1'><p>Only here</p></div><div class='x2'><p>Copied</p></div></body>"
    rows = [(i, "http://a.com/", copy) for i in range(10)]
    rows += [(10 + i, "http://a.com/", f"<body><div class='x2'><p>Own {i}</p></div></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in styletree.extract(pages).collect()}
    assert got == {i: "Only here\n\nCopied" for i in range(10)} | {10 + i: f"Own {i}" for i in range(20)}


def test_the_right_region_is_read():
    def text(body):
        return styletree.main_text(f"<body>{body}</body>", set())

    reader = "<article class='comment'><p>reader</p></article>"
    assert text(f"<main><h1>T</h1><p>Body one.</p>{reader}</main>") == "T\n\nBody one."
    assert text("<main><h1>T2</h1><article><p>x</p></article><p>after</p></main>") == "T2\n\nx\n\nafter"
    cards = "".join(f"<article class='card'><h3>Card {k}</h3></article>" for k in range(9))
    long = "<p>" + "The long body of the page. " * 3 + "</p>"
    assert text(f"<main><h1>T3</h1>{long}</main>{cards}").startswith("T3\n\nThe long body")
    assert "Card" not in text(f"{cards}<main>{long}</main>")
    # A main that holds next to nothing is not the article.
    assert text(f"<main><p>Search</p></main><article><h1>A</h1>{long}</article>").startswith("A\n\nThe long")
    assert text(f"<article><h1>A</h1>{long}</article>{reader}{reader}").count("reader") == 0
    assert text("<article> </article><p>menu like</p>") == ""
    assert text("<div><p>No region</p></div>") == "No region"


def test_the_tree_decides_beside_an_article(spark):
    page = (
        "<body><main><div class='crumbs'><p>Home and away</p></div><article><h1>Title {0}</h1><p>Same words</p></article>"
        "<div class='note'><p>Note of page {0}</p></div></main></body>"
    )
    rows = [(i, "http://a.com/", page.format(i)) for i in range(12)] + [(50, "http://b.com/", page.format(50))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in styletree.extract(pages).collect()}
    # What every page of the host has beside the article goes, not what stands in it.
    want = {i: f"Title {i}\n\nSame words\n\nNote of page {i}" for i in range(12)}
    assert got == want | {50: "Home and away\n\nTitle 50\n\nSame words\n\nNote of page 50"}
