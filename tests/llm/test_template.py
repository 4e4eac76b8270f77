import random
import re
from html import escape, unescape

from tallyframe.llm import template


def reference(html):
    """Main text of the table's page layout, by its own marks."""
    inner = html.split("<article>", 1)[1].rsplit("</article>", 1)[0]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    out = template.extract(pages).collect()
    assert len(out) == len(html)
    for r in out:
        assert r.text == reference(html[r.page_id]) and r.n_chars == len(r.text)


def page(title, paragraphs, i, kind):
    body = "".join(f"<p>{escape(p)}</p>" for p in paragraphs)
    menu = "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul></nav>"
    if kind == "article":
        main = f"<main><article><header><h1>{title}</h1></header>{body}<aside>See also this</aside><section class='comments'><p>First! great post {i}</p></section></article></main><div id=sidebar>Popular: {i} items are listed here</div>"
    else:
        main = f"<div class='wrap'><div class='box-{1 if kind == 'div' else i}'><h2>{title}</h2>{body}<form><p>Your mail {i}</p><input></form></div><div class='cookie-notice'>We use cookies</div></div>"
    return f"<!doctype html><html><head><title>{title} - Site</title><style>p > a {{}}</style></head><body><div class=top-banner>Buy now {i}</div>{menu}{main}<footer>All rights {i}</footer><script>if (a < b) document.write('<p>no</p>')</script></body></html>"


def test_templates_of_several_hosts(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)] + ["a&b", "x<y", "é"]
    rows, want = [], {}
    for h, kind in enumerate(["article", "div", "single", "odd"]):
        for i in range({"single": 1}.get(kind, 9)):
            title, paragraphs = f"Title {h} {i}", [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(4)]
            n = 100 * h + i
            rows.append((n, f"http://user@Host{h}.example:80/p{i}", page(title, paragraphs, i, kind)))
            want[n] = "\n\n".join([title, *paragraphs])
    rows += [(900, None, None), (901, "http://host1.example/e", ""), (902, "nonsense", "just <b>te</b>xt &amp; more\n  here"), (None, None, "<p>x"), (100, rows[9 + 0][1], rows[9][2])]
    df = spark.createDataFrame([(*r, "c", "s", 1) for r in rows], "page_id bigint, url string, html string, text string, slot string, host int")
    out = template.extract(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    for n, text in want.items():
        assert got[n] == text, n
    assert got[900] == got[901] == "" and got[902] == "just text & more here" and got[None] == "x"
    assert template.extract(df.filter("false")).count() == 0


def test_classes_and_slots(spark):
    rows = [(i, "http://h/", f"<body><div class=m><p>fixed text</p></div><div class=c><p>own {i} words here and there</p></div></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    tokens = template.occurrences(df).collect()
    everywhere = {(t.path, t.text is None) for t in tokens if t.pages == 6}
    vectors = {t.vector for t in tokens if t.pages == 6}
    assert len(vectors) == 1 and ("/body/div.m", True) in everywhere and ("/body/div.m", False) in everywhere
    assert [r.slot for r in template.deduce(df).collect()] == ["/body/div.c"]


def test_copies_keep_their_text(spark):
    rows = [(i, "http://h/", "<body><article><p>the same text on every page</p></article><footer>f</footer></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in template.extract(df).collect()} == {"the same text on every page"}


def test_broken_markup_and_long_runs():
    for html in ("<a href=\"x" * 20_000, "<" * 100_000, "<!--" * 50_000, "<p class='a" * 20_000, "&" * 100_000, "<div class=abcdefgh>x" * 30_000, "</div>" * 20_000, "<script>" * 5_000):
        template.main_text(html, None)
    assert template.main_text("<p title='a > b'>one<p>two &lt;b&gt; &nbsp; &#233;<br>three", None) == "one\n\ntwo <b> é three"
    assert template.main_text("a <1 b <p>c</p> 3 < 4", None) == "a <1 b\n\nc\n\n3 < 4"


def texts_of(spark, bodies):
    """Extracted texts of pages of one host, in order."""
    df = spark.createDataFrame([(i, "http://h/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(template.extract(df).collect(), key=lambda r: r.page_id)]


def test_no_article_is_narrowed_to_a_part(spark):
    def parts(i):
        return f"Headline {i}", f"Lead of {i}", " ".join(f"first{i}x{j}" for j in range(30)), " ".join(f"second{i}x{j}" for j in range(20))

    layouts = (
        "<article class=post><h1>{}</h1><p>{}</p><div class=entry-content><p>{}</p></div><div class=content><p>{}</p></div></article>",
        "<div role=main><h1>{}</h1><p>{}</p><div class=content><p>{}</p><p>{}</p></div></div>",
        "<div class=page><h1>{}</h1><p>{}</p><div class=a><p>{}</p></div><div class=b><p>{}</p></div></div>",
        "<h1>{}</h1><p>{}</p><article><p>{}</p></article><article class=more><p>{}</p></article>",
    )
    for layout in layouts:
        got = texts_of(spark, [f"<nav>Menu {i}</nav>" + layout.format(*parts(i)) + f"<footer>Foot {i}</footer>" for i in range(6)])
        assert got == ["\n\n".join(parts(i)) for i in range(6)], layout
    got = texts_of(spark, [f"<article><h1>Daily report</h1><div class=content><p>varies {i}</p></div></article>" for i in range(6)])
    assert got == [f"Daily report\n\nvaries {i}" for i in range(6)]


def test_names_do_not_make_furniture_of_the_text(spark):
    def parts(i):
        return " ".join(f"first{i}x{j}" for j in range(30)), " ".join(f"second{i}x{j}" for j in range(8))

    layouts = (
        "<article class='post tag-social'><p>{}</p><p>{}</p></article>",
        "<main class=no-sidebar><p>{}</p><p>{}</p></main>",
        "<main class=sidebar><p>{}</p><p>{}</p></main>",
        "<div class=social><main><p>{}</p><p>{}</p></main></div>",
        "<div class='content has-sidebar'><p>{}</p><p>{}</p></div>",
        "<div class=discussion><p>{}</p><p>{}</p></div>",
        "<article><p>{}</p><section id=share-prices><p>{}</p></section></article>",
        "<article><div class=side-by-side><p>{}</p></div><div class=post-header><h1>{}</h1></div></article>",
    )
    junk = "<div class='cookie-notice'>We use {0} cookies</div><div class=comment-list>Comment {0}</div>"
    for layout in layouts:
        got = texts_of(spark, [junk.format(i) + layout.format(*parts(i)) for i in range(6)])
        assert got == ["\n\n".join(parts(i)) for i in range(6)], layout


def test_unclosed_elements_do_not_cut_the_page():
    for name in ("button", "object", "svg", "math", "select", "noscript", "video"):
        assert template.main_text(f"<p>one</p><{name} class=x><p>two</p>", None) == "one\n\ntwo", name
    assert template.main_text("<p>one</p><script>if (a) { <p>two</p>", None) == "one"
    template.main_text("<button>x" * 100_000, None)
