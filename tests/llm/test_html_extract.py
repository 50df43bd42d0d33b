import re
import zlib

from pyspark.sql import functions as F

from metaspan.llm import html_extract as h


def page(k, body, lead="", tail=""):
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>T{k}</title><style>p{{margin:0}}</style><script>var t="</p>";x({k});</script></head><body>'
        f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad {k} --><div class="ad">Buy {k}</div>{lead}{body}{tail}'
        f"<footer>&copy; host &middot; text {k}</footer></body></html>"
    )


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS text", "2 AS slots")
    return {r.page_id: r for r in h.extract_pages(df.repartition(3)).collect()}


def test_articles(spark):
    extra = '<aside>side</aside><div id="cookie-notice">We use cookies</div><form><label>Name</label></form>'
    tail = '<section class="comments"><p>First!</p></section><div class="newsletter">Join</div>'
    rows = [(k, f"http://h.example.com/{k}", page(k, f"<article><h1>Title {k}</h1><p><b>One &amp; {k}\n\n  two.<br><p>Three <a href=x>link</a> {k} &lt;b&gt;</p></article>", extra, tail)) for k in range(8)]
    got = run(spark, rows)
    for k in range(8):
        assert got[k].text == f"Title {k}\n\nOne & {k} two.\n\nThree link {k} <b>"
        assert got[k].n_chars == len(got[k].text) and got[k].url == rows[k][1]


def test_template_without_article_tags(spark):
    """Slots that hold links or one text on nearly all pages are template, the others are extracted."""
    rows = [
        (k, "http://x.example.org/", page(k, f'<div class="c{0}"><div>Sign in to read more</div><div class="q"><a href=1>One</a> <a href=2>Two</a></div><div class="body"><p>Text {k}</p><p>More</p></div></div>'))
        for k in range(12)
    ]
    got = run(spark, rows)
    assert all(got[k].text == f"Text {k}\n\nMore" for k in range(12))


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "http://a/", ""), (3, "no scheme", "plain text  only"), (4, "http://b/", "<p>a<p>b < c <br> d &nbsp; e<script>x"), (5, "http://b/", "<div title='a>b'>x</div><div class=\"y>z"),
        (6, "http://c/", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (7, "http://d/", "<!-- never ends <p>x"), (8, "http://e/", "<div>" * 30_000 + "deep<nav>menu"),
    ]
    got = run(spark, rows + [(2, "http://a/", "")])
    assert [got[k].text for k in (1, 2, 3, 4, 7, 8)] == ["", "", "plain text only", "a\n\nb < c d e", "", "deep"]
    assert got[5].text.startswith("x") and got[6].text.count("\n\n") == 19_999
    assert h.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_table(spark):
    """On the given pages the articles' blocks are all there is."""
    rows = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = h.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"(?s)<article>(.*)</article>", rows[r.page_id].html)[1]
        parts = [" ".join(h.entities.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text.split("\n\n") == [p for p in parts if p]


def test_fixed_text_inside_articles(spark):
    """A notice with a slot of its own is template inside an article too; titles, stories and copies of pages stay."""
    rows = [(k, f"http://n.example.com/{k}", f'<html><body><article><h1>Same title</h1><p>Story {k}</p><div class="c3"><h4>Please note</h4><p>All prices may change</p></div><p>End {k}</p></article></body></html>') for k in range(8)]
    copies = [(20 + k, f"http://m.example.com/{k}", "<html><body><article><h1>Title</h1><div>One</div><p>Two words more</p></article></body></html>") for k in range(8)]
    got = run(spark, rows + copies)
    assert all(got[k].text == f"Same title\n\nStory {k}\n\nEnd {k}" and got[20 + k].text == "Title\n\nOne\n\nTwo words more" for k in range(8))


def test_classes_decide():
    """Text of a menu's heading closes with the menu only if both stand in one box of one class."""
    def members(v):
        return [
            h.Member("/body", 20, 1, 1, 0, 0, False), h.Member("/body/p", 20, 2, 2, 900, 0, False), h.Member("/body/div", 8, v, 7, 0, 0, False),
            h.Member("/body/div/h4", 8, 5, 7, 80, 0, True), h.Member("/body/div/ul", 8, 5, 7, 300, 300, False),
        ]

    assert h.template(members(5), 20)[1] == {"/body/div/h4", "/body/div/ul"}
    assert h.template(members(6), 20)[1] == {"/body/div/ul"}
    # a class with a path outside the template is no class of the template
    assert h.template([h.Member("/a", 9, 1, 1, 5, 0, False), h.Member("/x/b", 9, 1, 1, 5, 0, False), h.Member("/y", 9, 2, 2, 5, 0, False)], 9)[0] == {"/y"}


def test_layout_names_are_no_parts(spark):
    """Names of html, body, main and article, and of elements that hold most of a host's text, drop nothing; named parts inside still go."""
    shapes = [
        '<html class="has-header"><body class="home has-sidebar"><p>Story {k}</p>{rest}', '<body class="no-sidebar"><main class="with-header"><p>Story {k}</p></main>{rest}',
        '<body><main id="social"><article class="post alert banner"><p>Story {k}</p></article></main>{rest}',
        '<body class="nav sidebar"><div class="content-sidebar-wrap"><p>Story {k}, which is long enough to be most of the page</p></div>{rest}', '<body><div class="page has-sidebar with-comments"><p>Story {k}</p></div>{rest}',
    ]
    rest = '<div class="sidebar-left">Tags</div><div class="comments"><p>A reader wrote this, and it is longer than all of the story itself, by far.</p><p>So did another.</p></div>'
    rows = [(10 * n + k, f"http://s{n}.example.com/{k}", shape.format(k=k, rest=rest)) for n, shape in enumerate(shapes) for k in range(3)]
    got = run(spark, rows)
    for key, r in got.items():
        assert r.text == f"Story {key % 10}" + (", which is long enough to be most of the page" if key // 10 == 3 else ""), key


def test_articles_are_chosen_by_the_template(spark):
    """Cards in article elements do not displace a story in a div; a story in an article displaces what stands around it."""
    story = "<div class=\"story\"><p>The story of page {k} that people come for</p></div>"
    card, two = "<article class=\"card\"><p>Card {k}</p></article>", "<article class=\"card\"><p>Card {k} is longer than the whole story, so that it holds most text</p></article>" * 2
    shapes = [story + card, story + two, "<article><p>The story of page {k} that people come for</p></article><div>Seen {k}</div>"]
    rows = [(10 * n + k, f"http://a{n}.example.com/{k}", f"<html><body>{shape.format(k=k)}") for n, shape in enumerate(shapes) for k in range(4)]
    got = run(spark, rows)
    for key, r in got.items():
        assert r.text.split("\n\n")[0] == f"The story of page {key % 10} that people come for", key
        assert key < 20 or "Seen" not in r.text


def test_small_hosts_have_templates(spark):
    """Link lists and notices without telling names go from hosts with two to four pages too."""
    rows = [
        (10 * n + k, f"http://b{n}.example.com/{k}", f'<html><body><div class="x"><a href=1>One</a> <a href=2>Two {k}</a></div><div class="y">Sign in to read more</div><div class="z"><p>Text {k}</p></div>')
        for n in (2, 3, 4) for k in range(n)
    ]
    got = run(spark, rows)
    assert all(r.text == f"Text {key % 10}" for key, r in got.items())


def test_large_templates_are_joined_without_broadcast(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None)], "page_id long, url string, html string"), allowMissingColumns=True)
    expected = sorted((r.page_id, r.text) for r in h.extract_pages(pages).collect())
    monkeypatch.setattr(h.frames, "SMALL", -1)
    assert sorted((r.page_id, r.text) for r in h.extract_pages(pages).collect()) == expected


def test_hosts_with_many_pages(spark):
    """A text on every page whose hash is near 2^32: its squares exceed 64 bits on some 32,768 pages. It is a notice; that a text is the same everywhere but on one page shows too."""
    notice = next(f"Notice {k}" for k in range(100_000) if zlib.crc32(f"Notice {k}".encode()) >= 0xFFF0_0000)
    said = F.when(F.col("id") == 7, "Other").otherwise("Same")
    html = F.concat(F.lit(f"<html><body><div class=x>{notice}</div><div class=y>"), said, F.lit("</div><p>Story "), F.col("id").cast("string"), F.lit("</p>"))
    found = h.deduce_templates(spark.range(34_000).select(F.lit("a.example.com").alias("host"), F.col("id").alias("page_id"), html.alias("html"))).first()
    assert set(found.closed) == {"/html/body/div[class=x]"}
