import pytest

from plumbline.llm import html_main as H

SCHEMA = "page_id bigint, url string, html string, host string, low string, text string"


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li>Menu<li>More</ul></nav><!-- note <p>no</p> --><div class="ad">Buy</div><header>Top</header>
    <article><header><h1>A &amp; B</h1></header><p><b>One<br>two<p>Three&nbsp;  four</p><form>Ask</form><aside>Side</aside>
    <ul><li>x<li>y</ul><div class="comments"><p>Reader</p></div></article><footer>&copy; Foot</footer>"""
    assert H.main_text(page) == "A & B\nOne two\nThree four\nx\ny"


def test_without_article_and_cut_off():
    assert H.main_text("<body><p>a</p><div id='sidebar'>b</div><p>c &am") == "a\nc &am"
    assert H.main_text("<p>a<!-- open") == "a" and H.main_text("plain  text") == "plain text" and H.main_text("") == ""
    assert H.main_text("<script>x") == "" and H.main_text("a < b &lt; c") == "a < b < c"


def test_low_importance_branches_go(spark):
    """A host whose template has no telling names: what repeats goes, what differs stays."""
    words = [f"w{i} x{i} y{i}" for i in range(12)]
    rows = [(i, "http://h.example/p", f"<body><div><span>Our site, home and shop</span></div><section><p>{w}</p><p>more {w}</p></section><div><div>All rights</div></div></body>", "c", "c", "c") for i, w in enumerate(words)]
    rows += [(100, None, None, "c", "c", "c"), (101, "", "", "c", "c", "c"), (102, "odd url", "<p>alone</p>", "c", "c", "c"), (0, *rows[0][1:])]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert [texts[i] for i in range(12)] == [f"{w}\nmore {w}" for w in words]
    assert texts[100] == texts[101] == "" and texts[102] == "alone"


def test_articles_are_kept_though_they_repeat(spark):
    rows = [(i, "http://h.example/", "<article><p>same text</p></article>", "c", "c", "c") for i in range(20)]
    assert {r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"same text"}


def test_deep_articles_and_copies_survive(spark):
    """Same-looking wrappers, seven levels and more above the text, and hosts that are mostly copies of one page."""
    deep = "<html><body>" + "<div>" * 9 + "<ul><li>Menu</li></ul><article><p>{}</p></article>" + "</div>" * 9 + "</body></html>"
    plain = "<html><body><div><div><p>{}</p></div><b>Our site</b></div></body></html>"
    rows = [(i, "http://deep.example/", deep.format(f"text {i}"), "c", "c", "c") for i in range(12)]
    rows += [(100 + i, "http://copies.example/", plain.format("same" if i < 40 else f"other {i}"), "c", "c", "c") for i in range(48)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].split("\n")[-1] == f"text {i}" for i in range(12))
    assert got[100] == "same" and got[145] == "other 45"


def test_importance_decides_inside_and_outside_articles(spark):
    """Unnamed template blocks in <main> go; a lead outside it, headings with telling ids and an entry's header stay."""
    page = """<html><body><script>track({0})</script><div class=lead>Lead {0}</div><div class=x9>Our shop</div><div class=ad>Buy {0}</div>
    <main><div class="entry-header"><h1>Title {0}</h1></div><h2 id="related-work">Related {0}</h2><p>Text {0}</p><div class=x7>read next</div><div class=comments>Reader {0}</div></main></body></html>"""
    rows = [(i, "http://h.example/", page.format(i), "c", "c", "c") for i in range(12)]
    same = "<html><body><script>track({})</script><article><p>{}</p></article></body></html>"
    rows += [(100 + i, "http://copies.example/", same.format(i, "same" if i < 40 else f"other {i}"), "c", "c", "c") for i in range(48)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(12)] == [f"Lead {i}\nTitle {i}\nRelated {i}\nText {i}" for i in range(12)]
    assert [got[100 + i] for i in range(48)] == ["same"] * 40 + [f"other {i}" for i in range(40, 48)]


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quotes_in_values_headers_and_references():
    assert H.main_text("<article><a title=don't>x</a> one</p><p>two 'q' three</p><p>four</p></article>") == "x one\ntwo 'q' three\nfour"
    assert H.main_text("""<article><a title = "a > b" href='c>d' data-x="it's">x</a><p>y</article>""") == "x\ny"
    assert H.main_text('<article><div class="article-header"><h1>Title</h1></div><p>t</p></article>') == "Title\nt"
    assert H.main_text("<article><b>&am</b>p; &lt;<i>b&gt;</i></article>") == "&amp; <b>".replace("&amp;", "&amp;")
    assert H.main_text("<p " + "a=\"b" * 3 + ">t</p>") in ("", "t") and H.main_text("<p a==>t</p>") == "t"


def test_teasers_do_not_hide_the_text():
    body = "".join(f"<p>Sentence {i} of a text that is long.</p>" for i in range(20))
    assert H.main_text(f"<body><div>{body}</div><article><p>Teaser</p></article></body>").count("\n") == 20


def test_known_articles_in_known_templates(spark):
    """Pages of templates whose parts have no telling names, around and inside the article: the article comes back exactly."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    templates = [
        "<html><body><div class=t1><ul><li>Start<li>Shop<li>About us</ul></div><div class=c><h1>{0}</h1>{1}</div><div class=t2><p>All rights reserved</p></div></body></html>",
        "<html><body><div><b>Our paper</b></div><main><div class=q>Read our letter every week</div><h1>{0}</h1>{1}<div class=q2><span>Tell your friends</span></div></main><div>Imprint</div></body></html>",
        "<html><body><table><tr><td>Menu<br>Contact<td><article><h1>{0}</h1>{1}<p class=z>Written for you by our team</p></article></table></body></html>",
    ]
    rows, wanted = [], {}
    for host, template in enumerate(templates):
        for i in range(15):
            title, paragraphs = sentence(5), [sentence(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
            page = host * 100 + i
            rows.append((page, f"http://h{host}.example/{i}", template.format(title, "".join(f"<p>{p}" for p in paragraphs)), "c", "c", "c"))
            wanted[page] = "\n".join([title, *paragraphs])
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got == wanted
    assert sum(H.main_text(r[2]) != wanted[r[0]] for r in rows) == len(rows)  # each of these pages needs the tree


def test_long_deep_and_unclosed_pages():
    import time

    began = time.time()
    assert H.main_text("<article>" + "<p>word " * 100_000).count("\n") == 99_999
    assert H.main_text("<div>" * 50_000 + "x" + "</span>" * 50_000) == "x"
    assert H.main_text("<p><button></button>" + "<ul><b>" * 30_000 + "y") == "y"
    assert len(H.main_text("<article>" + "z" * 3_000_000)) == 3_000_000
    assert time.time() - began < 30


ARTICLE = "<p>First words of the story that is told here at length.</p><p>Second words, which end it.</p>"
TOLD = "First words of the story that is told here at length.\nSecond words, which end it."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content with-sidebar">{ARTICLE}</div>',
        f'<div id="page" class="no-sidebar single">{ARTICLE}<div class="share">Share it</div></div>',
        f'<div class="market share-price">{ARTICLE}</div><div class="footer">All rights</div>',
        f'<form id="aspnetForm"><div class="menu"><a>Home</a></div>{ARTICLE}<input name="q"></form>',
        f'<div class="no-header"><div class="page-with-banner">{ARTICLE}</div></div><aside><p>Aside of many more words than the text has, of many more words than the text has, of many more words.</p></aside>',
    ],
)
def test_names_never_take_most_of_a_page(page):
    assert H.main_text(f"<html><body>{page}</body></html>") == TOLD


def test_headings_are_not_judged_as_headers():
    assert H.main_text(f'<body><h1 class="page-header">Title</h1>{ARTICLE}</body>') == f"Title\n{TOLD}"


def test_comments_and_real_forms_still_go():
    more = "<p>A remark that is longer than all of the story.</p>" * 20
    assert H.main_text(f'<body><div class="story">{ARTICLE}</div><div class="comments">{more}</div><form><p>Your name</p><label>Mail</label></form></body>') == TOLD
