import pytest

from veilspan.llm import html

FRAME = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad box'>Buy {n}</div>{main}"
    "<aside>Side {n}</aside><form><p>Search</p></form><div class=\"cookie-notice\">We use cookies</div>"
    "<section id=comments><p>Nice {n}!</p></section><footer>&copy; host {n}</footer></body></html>"
)


def page(main, n=1):
    return FRAME.format(main=main, n=n)


@pytest.mark.parametrize(
    ("main", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<p>three</article>", "A & B\none two\nthree"),
        ("<article><p><b>Title.<br><p>Body&nbsp;<i>it</i>alic</p></article>", "Title.\nBody italic"),
        ("<main><div>x<script>y</script> z</div><ul><li>a<li>b</ul></main>", "x z\na\nb"),
        ("<article>t &lt;p&gt; &#233; &eacute;<!-- no --> 1 < 2</article>", "t <p> é é 1 < 2"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><div class=share>S</div></article>", "a\nb\nc"),
        ("<article><p>x</p><article class=comment><p>hello</p></article></article>", "x"),
        ("<article><p title='a>b'>q</p><p hidden>h</p><textarea>f</textarea></article>", "q"),
        ("<article></article>", ""),
    ],
)
def test_articles(main, text):
    assert html.extract(page(main), None) == text
    wrapper = html.induce([page(f"<article><h1>h{k}</h1><p>p {k}</p></article>", k) for k in range(4)])
    assert wrapper["path"][-1] == "article[0]" or "main" in main
    assert html.extract(page(main), wrapper) == text


def soup(k, extra=""):
    return (
        f"<html><body><div class=top><p>All the news, every day</p></div><div class=wrap><div class=links><a href=/>x {k}</a></div>"
        f"<div class=story><p class=tag>Read our best stories</p><p>Story {k} begins here with words.</p><p>It goes on for {k} lines.</p>{extra}</div></div>"
        f"<div class=bottom><p>Made by us</p></div></body></html>"
    )


def test_without_an_article_the_varying_slots_are_content():
    wrapper = html.induce([soup(k) for k in range(5)])
    assert wrapper["path"][-1] == "div.story[0]"
    got = html.extract(soup(9, "<p>A third one.</p>"), wrapper)
    assert got == "Story 9 begins here with words.\nIt goes on for 9 lines.\nA third one."


def test_tree_matching_finds_the_largest_common_tree():
    a = html.parse("<div><p>1</p><ul><li>a<li>b</ul></div>").nodes()[0]
    b = html.parse("<div><ul><li>x</ul><p>2</p><ul><li>y<li>z</ul></div>").nodes()[0]
    assert html.match(a, b, {}) == 5
    assert len(list(html.aligned(a, b, {}))) == 5


def test_broken_and_very_long_pages():
    for text in ("", "<", "<p", "</p></div>", "<a href='x", "<!-- x", "<script>x", "a<b>c", "<p>" * 20_000 + "x", "<div>" * 5000 + "y", "<" * 100_000):
        html.extract(text, None)
    assert html.induce(["<div>" * 5000, "<div>" * 4000]) is None
    assert html.extract("plain text", None) == "plain text"
    assert len(html.extract("<article>" + "<p>word word</p>" * 30_000 + "</article>", None).split("\n")) == 30_000


def test_rows_of_any_kind(spark):
    good = page("<article><p>x</p></article>")
    rows = [(1, "http://a.b/1", good), (1, "http://a.b/1", good), (None, "http://A.b/2", page("<article><p>y</p></article>", 2)), (2, None, good), (3, "none", None), (4, "http://a.b/", ""), (5, "http://c.d", soup(1))]
    pages = spark.createDataFrame([(i, u, h, "w", 1) for i, u, h in rows], "page_id long, url string, html string, wrapper string, host_ int")
    found = html.main_texts(pages).collect()
    got = sorted((r.page_id or 0, r.main_text) for r in found)
    assert [t for _, t in got][:6] == ["y", "x", "x", "x", "", ""] and len(got) == 7
    assert html.main_texts(pages.limit(0)).count() == 0


def post(k, more=""):
    body = " ".join(f"word{k}x{i}" for i in range(200))
    return (
        f"<html><body><div class=top><p>All the news</p></div><div class=post><h1><a href=/{k}>Title {k}</a></h1><p>by writer {k}</p>"
        f"<div class=body><p>{body}</p></div>{more}</div><div class=bottom><p>Made by us</p></div></body></html>"
    )


def test_headings_and_short_parts_beside_the_body_stay():
    second = "<div class=part><p>Second part 4.</p></div>"
    for pages in ([post(k) for k in range(6)], [post(0), *[post(k, second if k == 4 else "") for k in range(1, 6)]]):
        wrapper = html.induce(pages)
        got = html.extract(post(9, second), wrapper).split("\n")
        assert got[:2] == ["Title 9", "by writer 9"] and got[2].startswith("word9x0 ") and got[3:] == ["Second part 4."]


def test_all_sibling_articles_stay():
    def two(k):
        articles = f"<article><p>First, a longer one {k}.</p></article><article><p>Second {k}.</p></article>"
        return page(f"<div>{articles}<article class=comment><p>hello {k}</p></article></div>", k)

    wrapper = html.induce([page(f"<div><article><p>Only {k}</p></article></div>", k) for k in range(5)])
    assert wrapper["path"][-1] == "article[0]"
    for known in (None, wrapper, html.induce([two(k) for k in range(5)])):
        assert html.extract(two(9), known) == "First, a longer one 9.\nSecond 9."


def test_template_goes_only_with_its_text():
    wrapper = html.induce([soup(k) for k in range(5)])
    without = soup(9).replace("<p class=tag>Read our best stories</p>", "<p class=tag>The lead of story 9.</p>")
    assert html.extract(without, wrapper).startswith("The lead of story 9.\nStory 9 begins")
    # the template line is known although the first page lacks it
    pages = [soup(0).replace("<p class=tag>Read our best stories</p>", ""), *[soup(k) for k in range(1, 6)]]
    assert html.extract(soup(9), html.induce(pages)).startswith("Story 9 begins")


def test_large_pages_are_aligned():
    for extra in ("<p>more of it</p>" * 2000, "<div>" * 400 + "deep", "<ul>" + "<li><b>x</b></li>" * 900 + "</ul>"):
        wrapper = html.induce([soup(k, extra) for k in range(4)])
        assert "div.story[0]" in wrapper["path"]
        assert html.extract(soup(9), wrapper).startswith("Story 9 begins")


def test_constancy_is_confirmed_over_all_pages_of_a_host(spark):
    def section(k, name):
        return soup(k).replace("<p class=tag>", f"<p class=section>{name}</p><p class=tag>")

    rows = [("http://a.b/", section(k, "News")) for k in range(60)]
    hashes = {r.h: r.hash_ for r in spark.createDataFrame(rows, "u string, h string").selectExpr("h", "xxhash64('a.b', h) hash_").collect()}
    first = sorted([h for _, h in rows], key=hashes.get)[:6]
    rows = [(u, h if h in first else h.replace("News", f"Part {i % 20}")) for i, (u, h) in enumerate(rows)]
    hashes = {r.h: r.hash_ for r in spark.createDataFrame(rows, "u string, h string").selectExpr("h", "xxhash64('a.b', h) hash_").collect()}
    sampled = sorted([h for _, h in rows], key=hashes.get)[:6]
    rows = [r for r in rows if r[1] in first or r[1] not in sampled]
    found = html.main_texts(spark.createDataFrame(rows, "url string, html string")).collect()
    for r in found:
        assert "Read our best stories" not in r.main_text
        assert r.main_text.split("\n")[0] in r.html and not r.main_text.startswith("Story")
