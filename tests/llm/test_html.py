import random
import re
import time
from html import unescape

import pytest

from tickersieve.llm import html
from tickersieve.llm.queries import op9_html_extraction, table

STORY = "<h1>Head &amp; line</h1><p>First, a <b>bold</b> word.<br>Second part; it goes on.<p>Third \n part&nbsp;here, unclosed.<ul><li>An item, listed.</ul>"
TEXT = "Head & line First, a bold word. Second part; it goes on. Third part here, unclosed. An item, listed."
AROUND = {
    "article": "<article>{}</article>", "main": "<main><section>{}</section></main>", "class": '<div id="page"><div class="post-content">{}</div></div>',
    "plain": '<div id="wrap"><div>{}</div></div>', "role": '<div role="main">{}</div>',
}


@pytest.mark.parametrize("around", AROUND)
def test_a_page_full_of_other_things(around):
    page = f"""<!DOCTYPE html><html><head><title>No title</title><style>p{{x:1}}</style><script>var t = "</p><p>not this, surely. Not at all.</p>";</script></head>
    <body class="single"><header><a href=/>Home</a> Site name, a slogan.</header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
    <div class="cookie-notice">We use cookies, as everybody does. Accept?</div><!-- a comment, not shown --><div class='ad'>Buy this, now.</div>
    {AROUND[around].format(STORY)}
    <aside><p>Side story, in short.</p></aside><form><label>Name</label><textarea>typed, text.</textarea></form>
    <section class="comments"><article class="comment"><p>I disagree, strongly. Really I do, and so on and on.</p></article></section>
    <div id="sidebar">More, elsewhere.</div><noscript>Enable scripts.</noscript><footer>&copy; someone, some year.</footer></body></html>"""
    assert html.main_text(page) == TEXT


def test_broken_and_small_pages():
    assert html.main_text("") == "" and html.main_text("<p") == "" and html.main_text("<nav>a, b.</nav>") == ""
    assert html.main_text("just text, no tags &lt;here&gt;") == "just text, no tags <here>"
    assert html.main_text("<article><p>One, cut off by the end") == "One, cut off by the end"
    assert html.main_text("<article><script>x</article>") == ""
    assert html.main_text("<p>a</p></div></p><p>b &amp c</p>") == "a b & c"


def test_names_of_page_parts():
    text = "Words of a block, in a sentence."
    for name in ("ad-slot", "adbox", "cookieBar", "commentlist", "comment_section", "site-header", "newsletter-box", "related-posts", "share-buttons", "Sidebar left"):
        assert html.main_text(f"<article><p>Kept, this.</p><div class='{name}'>{text}</div></article>") == "Kept, this.", name
    for name in ("article-header", "headline", "adage", "lead", "shade", "body-copy", "commons"):
        assert html.main_text(f"<article><p>Kept, this.</p><div class='{name}'>{text}</div></article>") == f"Kept, this. {text}", name
    assert html.main_text(f"<main><header><h1>Title</h1></header><p>{text}</p></main>") == f"Title {text}"


def test_paths_with_more_text_and_punctuation_score_higher():
    page = html.Page("<div><p>Long text, with signs. And more of it, here.</p><p>Again, a sentence.</p></div><ul><li>x</li><li>y</li></ul>")
    score = page.scores(page.ratios())
    assert min(score[:2]) > max(score[2:]) and [b.path for b in page.blocks] == [1, 1, 3, 3]


def plain_ratios(page):
    """The ratios of a page's paths by their texts, from a plain reading of well-formed pages without names."""
    stack, found = [], []
    for close, tag, text in re.findall(r"<(/?)([a-z0-9]+)>([^<]*)", page):
        stack = stack[:-1] if close else [*stack, tag]
        if text.strip():
            found.append(("/".join(stack), text.strip(), any(t in ("article", "main") for t in stack)))
    out = []
    for path, _, marked in found:
        own = [t for p, t, _ in found if p == path]
        length, signs = sum(map(len, own)) / len(own), sum(len(html.PUNCTUATION.findall(t)) for t in own) / len(own)
        out.append(length * (1 + signs) * (html.BONUS if marked else 1))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_ratios_match_a_plain_statement_by_path_texts(seed):
    pick = random.Random(seed)

    def element(depth):
        tag = pick.choice(["div", "section", "article", "blockquote"])
        if depth == 0 or pick.random() < 0.4:
            return f"<p>{'Some words, here. ' * pick.randrange(1, 5)}</p>"
        return f"<{tag}>{''.join(element(depth - 1) for _ in range(pick.randrange(1, 4)))}</{tag}>"

    page = f"<div>{''.join(element(4) for _ in range(6))}</div>"
    assert html.Page(page).ratios() == pytest.approx(plain_ratios(page))


def test_parts_of_an_article_whatever_their_names():
    a, b = "A first paragraph, with words. And more of them.", "A second one; it goes on, and on."
    for name in ("discussion", "related-work", "legal", "search-results"):
        page = f"<article><h1>T</h1><p>{a}</p><section class='{name}'><p>{b}</p><p>{a}</p></section></article>"
        assert html.main_text(page) == f"T {a} {b} {a}", name
    for name in ("discussion", "sidebar-layout", "page-comments"):
        assert html.main_text(f"<body><div class='{name}'><p>{a}</p><p>{b}</p></div><p>Short.</p></body>").startswith(f"{a} {b}"), name
    assert html.main_text(f"<article><p>{a} A <span class='tag'>word</span> inside.</p><ul><li><a href=x>Linked item</a></li><li>Other item</li></ul><p>{b}</p></article>") == f"{a} A word inside. Linked item Other item {b}"
    assert html.main_text(f"<article><p>{a} <span hidden>not</span> seen.</p></article>") == f"{a} seen."
    beside = f"<body><ul><li><a href=1>One link</a></li><li><a href=2>Two links</a></li></ul><div><p>{a}</p><p>{b}</p><p>{a}</p></div></body>"
    assert html.main_text(beside) == f"{a} {b} {a}"


def test_deep_and_broken_nesting_takes_time_in_proportion():
    for page in ("<div>" * 50_000 + "Words, at the bottom.", "<div><p>Words, here.</p>" * 50_000, "<div>" * 50_000 + "</section></x></p>" * 50_000 + "Words.", "<ul><li>x, y." * 30_000):
        start = time.perf_counter()
        assert html.main_text(page)
        assert time.perf_counter() - start < 15


def test_the_given_pages(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    out = op9_html_extraction(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("<[^>]*>", " ", inside)).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_null_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, None, "<p>x, y.</p>"), (1, "u", None)], "page_id long, url string, html string")
    out = html.extract(pages.selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, None, "x, y.", 5), (1, "u", "", 0)], key=repr)
    assert html.extract(pages.limit(0)).collect() == []


def test_names_of_titles_and_paragraphs_drop_nothing():
    a, b = "A first paragraph, with words. And more of them.", "A second one; it goes on, and on."
    for name in ("post-title", "entry-title", "article-title", "story-title"):
        assert html.main_text(f"<div class=wrap><h1 class='{name}'>T</h1><p>{a}</p><p>{b}</p></div>") == f"T {a} {b}", name
    for name in ("text-center", "text-muted", "text"):
        assert html.main_text(f"<div><p>{a}</p><p class='{name}'>In the middle.</p><p>{b}</p></div>") == f"{a} In the middle. {b}", name
    assert html.main_text(f"<div><div class=text-center>A caption.</div><p>{a}</p><p>{b}</p></div>") == f"A caption. {a} {b}"


def test_an_article_split_by_an_advert_is_whole():
    long, last = "<p>Many words, in sentences. One more, and so on and on.</p>" * 12, "<h2>End</h2><p>The last words, of the story.</p>"
    page = f"<body><div><div class=text>{long}</div><div class=ad>Buy, now.</div><div class=text>{last}</div></div></body>"
    assert html.main_text(page).endswith("so on and on. End The last words, of the story.") and "Buy" not in html.main_text(page)
