"""Pages whose wrappers carry words or tags that elsewhere mark what is no content."""

import pytest
from parcelwise.llm import html_cut

FIRST = "A long first paragraph of the text, with a good many words in it that belong to the article."
SECOND = "Another long paragraph follows, one with more than only a few words, and it ends the article."
BOTH = f"<p>{FIRST}</p><p>{SECOND}</p>"
TALK = "I think that this is a very nice article and I liked all of it a lot, thank you for it."
REST = f"""<nav><a href=x>Home</a> <a href=y>News</a></nav><div class="sidebar"><p>About us: we have written here for
many years now, about all things.</p></div><section id="comments"><p>{TALK}</p></section><footer><p>Some rights of this
site are reserved by its owners, as ever.</p></footer>"""

WRAPPERS = [
    '<div class="layout no-sidebar">', '<div id="page" class="has-comments">', '<main class="content with-sidebar">',
    '<form method="post" action="page.aspx" id="aspnetForm">', '<div class="layout sidebar-right">',
    '<div class="content-sidebar-wrap">', '<div class="hasSidebar withAds">', '<div class="page comments-open">',
    '<main class="sidebar-left">', '<article class="post tag-social category-search">', '<div class="header-fixed">']


@pytest.mark.parametrize("opening", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", '<div class="entry-content">{}</div>'])
@pytest.mark.parametrize("rest_inside", [False, True])
def test_a_wrapper_does_not_lose_its_article(opening, inner, rest_inside):
    closing = f"</{opening[1:].split(' ')[0]}>"
    page = f"<body>{opening}{inner.format(BOTH)}" + (REST + closing if rest_inside else closing + REST) + "</body>"
    assert html_cut.main_text(page) == f"{FIRST} {SECOND}"


def test_wrappers_in_each_other_and_side_by_side():
    page = f'<form><div id="page" class="sidebar"><div class="layout ad-top"><article>{BOTH}</article></div></div></form>'
    assert html_cut.main_text(page) == f"{FIRST} {SECOND}"
    each = [f"{FIRST[:-1]} number {i}." for i in range(6)]
    page = "".join(f'<div class="card social-on"><article><p>{x}</p></article></div>' for x in each)
    assert html_cut.main_text(page + REST) == " ".join(each)
    assert html_cut.main_text(page.replace("article>", "section>").replace("<section", '<section class="post"')) == " ".join(each)


def test_sections_longer_than_the_article_stay_out():
    talk = "".join(f'<div class="comment"><div class="comment-text"><p>{TALK} {i}</p></div></div>' for i in range(9))
    for opening in ('<div id="comments">', '<section class="comments-area">'):
        closing = f"</{opening[1:].split(' ')[0]}>"
        for article in (f"<p>{FIRST}</p>", f"<article><p>{FIRST}</p></article>"):
            assert html_cut.main_text(f"<body>{article}{opening}{talk}{closing}</body>") == FIRST
    side = f'<aside><article><p>{TALK}</p></article></aside><div class="related"><article><p>{TALK}</p></article></div>'
    assert html_cut.main_text(f"<main><p>{FIRST}</p></main>{side}") == FIRST


def test_a_short_article_beside_a_long_notice():
    notice = f'<div class="ad">{TALK}</div>'
    assert html_cut.main_text(f"<nav><a href=x>x</a></nav>{notice}<article><h1>A short one.</h1><p>Here.</article>") == "A short one. Here."
    lines = "".join(f"<p>Line {i} of a poem.</p>" for i in range(9))
    want = " ".join(f"Line {i} of a poem." for i in range(9))
    assert html_cut.main_text(f'<body>{lines}<div class="cookie-notice">{TALK}</div></body>') == want
