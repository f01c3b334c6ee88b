import random

import pytest
from pyspark.sql import functions as F

from codetrawl.llm.html_text import extract_text, main_text

LONG = "Many words of a paragraph that goes on for a while, as paragraphs of an article do. " * 3
P1, P2, P3 = (f"{k} {LONG}".strip() for k in ("First", "Second", "Third"))
ARTICLE = f"<h1>A title</h1><p>{P1}</p><p>Short.</p><p>{P2}</p><p>{P3}</p><p>End.</p>"
WANTED = "\n".join(["A title", P1, "Short.", P2, P3, "End."])
MENU = "".join(f'<li><a href="/{k}">entry {k}</a></li>' for k in range(8))

PAGES = {
    "article": f"<html><body><nav><ul>{MENU}</ul></nav><article>{ARTICLE}</article><footer>&copy; {LONG}</footer></body></html>",
    "main without article": f"<body><header><h2>Site</h2></header><main>{ARTICLE}</main><aside>{LONG}</aside>",
    "classes": f'<body><div class="top-menu">{MENU}</div><div id="wrap"><div class="left sidebar">{LONG}</div><div id="content">{ARTICLE}</div>'
               f'<div id="cookie-notice">{LONG}</div></div><div class="site_footer">{LONG}</div>',
    "no marks at all": f"<body><ul>{MENU}</ul><div><div>{ARTICLE.replace('<p>End.</p>', '')}<p>End. {LONG}</p></div></div><p>Imprint</p>",
    "inside the article": f'<article><nav>{MENU}</nav><h1>A title</h1><div class="ad">Buy this. {LONG}</div><p>{P1}</p><p>Short.</p><form><p>Your mail</p><input></form>'
                          f'<div><p>{P2}</p></div><p>{P3}</p><p>End.</p><section class="comments"><article class="comment"><p>{LONG}{LONG}</p></article></section></article>',
    "comments beside it": f'<body><article>{ARTICLE}</article><ol class="commentlist"><li>{LONG * 20}</li></ol>',
    "related articles": f"<body><main><article>{ARTICLE}</article><aside><article>{LONG}</article></aside></main>",
    "style names": f'<body class="has-sidebar"><div class="layout sidebar-right">{"<article>"}{ARTICLE}</article></div></body>',
    "one form around all": f'<body><form id="aspnetForm"><nav>{MENU}</nav><article>{ARTICLE}</article></form></body>',
    "scripts": f'<body><script>var x = "</p><p>{LONG}";</script><style>p {{ }}</style><article>{ARTICLE}<noscript>{LONG}</noscript></article><!-- {LONG} --><template>{LONG}</template>',
    "unclosed": f"<body><div><ul>{MENU}<article><h1>A title<p>{P1}<p class=ad>{LONG}<p>Short.<br><p>{P2}<p>{P3}<p>End.",
    "odd declarations": f"<!DOCTYPE html><![if IE]><p>old</p><![endif]><?php x ?><article>{ARTICLE}</article><![CDATA[ x ]]>",
    "flat": f"<p>Home</p><p>About</p><h1>A title</h1><p>{P1}</p><p>Short.</p><p>{P2}</p><p>{P3}</p><p>Imprint</p>",
    "hidden": f'<body><div hidden>{LONG}</div><article>{ARTICLE}<p style="display: none">{LONG}</p></article>',
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    wanted = WANTED
    if name == "no marks at all":
        wanted = WANTED.replace("End.", f"End. {LONG}".strip())
    if name == "flat":
        wanted = WANTED.removesuffix("\nEnd.")
    assert main_text(PAGES[name]) == wanted


def test_references_and_blanks():
    page = "<article><p>a &amp; b&nbsp;&#99;\n\t d&eacute;&quot <b>bold</b>er<br>line &unknown; &lt;p&gt;</p>\n<p> </p><p>z</p></article>"
    assert main_text(page) == "a & b c dé\" bolder line &unknown; <p>\nz"


def test_no_text():
    assert [main_text(x) for x in (None, "", " \n ", "<p></p>", "<nav>a</nav>", "<script>x", "<")] == ["", "", "", "", "", "", "<"]
    assert main_text("just words") == "just words"


def test_chunks_change_nothing(monkeypatch):
    page = PAGES["inside the article"] + "<p>&amp;&copy;&#8364; x</p>" * 50
    whole = main_text(page)
    for size in (1, 7, 1000):
        monkeypatch.setattr("codetrawl.llm.html_text.CHUNK", size)
        assert main_text(page) == whole


def test_any_markup_ends(spark):
    rng = random.Random(6)
    bits = ["<", ">", "</", "<!--", "-->", "<![", "]]>", "<div class='ad'>", "</div>", "<p>", "<article>", "</article>", "<script>", "</script>",
            "&#", "&amp", "words of text", "<a href=\"", "<title>", "<!", "<?", "<form>", "</form>", "\x00", "é", "<h1>", "<br/>", "<svg/>"]
    for _ in range(1500):
        main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))


def test_large_pages_take_linear_time():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text(deep) == LONG.strip()
    many = "<article>" + f"<p>{P1}</p>" * 20_000 + "</article>"
    assert main_text(many) == "\n".join([P1] * 20_000)


def test_rows(spark):
    rows = [(1, "u", PAGES["article"], 5), (1, "u", PAGES["article"], 5), (None, None, None, None), (2, "v", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long").withColumn("_op_html", F.lit("x"))
    found = sorted(map(tuple, extract_text(pages, keep=["page_id", "url", "n_chars"]).collect()), key=repr)
    assert found == sorted([(1, "u", WANTED, len(WANTED))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract_text(pages.limit(0), keep=["page_id"]).columns == ["page_id", "text", "n_chars"] and not extract_text(pages.limit(0), keep=["page_id"]).count()
