"""Page layouts: what is main text whatever names stand around it, and broken markup in linear time."""

import html
import random
import re
import time

import pytest

from assaylake.llm import html_blocks

TREE = html_blocks.train_tree(html_blocks.LABELLED)
LONG = "This paragraph has quite a number of plain words in it, so that it looks like text."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = "<footer><p>Copyright of the site, with an address and a number to call.</p></footer>"

LAYOUTS = {
    "sidebar layout": (f"<div class='site has-sidebar'>{MENU}<article><h1>Title</h1><p>{LONG}</p></article>{FOOT}</div>",
                       ["Title", LONG]),
    "fixed header": (f"<div class='page-header-fixed'>{MENU}<main><p>{LONG}</p></main></div>", [LONG]),
    "entry header": (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", ["Title", LONG]),
    "post header": (f"<article><section class='post-header'><h1>Title</h1><p>{LONG}</p></section></article>",
                    ["Title", LONG]),
    "article header": (f"<article><header class='header'><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG]),
    "names on paragraphs": (f"<article><p class='share-price'>The price rose.</p><p class='dialog'>He spoke.</p>"
                            f"<h2 class='notice'>A notice</h2><p>{LONG}</p></article>",
                            ["The price rose.", "He spoke.", "A notice", LONG]),
    "sources": (f"<article><p>{LONG}</p><ul><li><a href='1'>First source</a></li><li><a href='2'>Second</a></li>"
                f"<li><a href='3'>Third one</a></li></ul></article>", [LONG, "First source", "Second", "Third one"]),
    "short page": ("<html><body><h1>Short news</h1><p>It rained today.</p></body></html>",
                   ["Short news", "It rained today."]),
    "wrapped in a banner": (f"<div class='banner'><div class='widget'><article><p>{LONG}</p></article></div></div>", [LONG]),
    "article in a sidebar": (f"<main><p>{LONG}</p></main><aside><article><p>{LONG} Elsewhere.</p></article></aside>", [LONG]),
    "comments as articles": (f"<article><p>{LONG}</p></article><section id='comments'><article><p>{LONG} Thanks.</p>"
                             "</article></section>", [LONG]),
    "comment class": (f"<article><p>{LONG}</p><ol class='comment-list'><li><p>{LONG} Nice.</p></li></ol></article>", [LONG]),
    "boxes in an article": (f"<article><p>{LONG}</p><div class='ad'>Buy now</div><div class='share-buttons'>Share this"
                            f"</div><form><p>{LONG} Mail?</p></form><div class='newsletter'><p>{LONG} Subscribe.</p></div>"
                            f"<p>End of it.</p></article>", [LONG, "End of it."]),
    "site parts by name": (f"<div class='site-header'><p>{LONG} Site.</p></div><div id='main-menu'><p>{LONG} Menu.</p></div>"
                           f"<article><p>{LONG}</p></article><div class='page_footer'><p>{LONG} Foot.</p></div>", [LONG]),
    "nothing named": (f"<div><a href='/'>Home</a> <a href='/b'>Blog</a></div><div><p>{LONG}</p><p>{LONG}</p></div>"
                      "<div><a href='/x'>Imprint</a></div>", [LONG, LONG]),
    "only a menu": (MENU + FOOT, []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, want = LAYOUTS[name]
    assert html_blocks.main_blocks(page, TREE) == want


def _tags_by_regex(page):
    """Tags by a backtracking pattern: quotes that are closed hide brackets, others do not."""
    token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
                       r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    return [(m.start(), m.end()) for m in token.finditer(page)]


def test_tags_as_a_pattern_finds_them():
    r = random.Random(1)
    bits = ["<a ", "<b>", "</b>", 'x="1"', "y='2'", 'z="<>"', "text ", ">", "<!-- c -->", "<!x>", "<p", " q='\"' ", "\n"]
    for _ in range(3000):
        page = "".join(r.choice(bits) for _ in range(r.randrange(12))) + ">"
        tags, at, got = html_blocks._Tags(page), 0, []
        while (t := tags.next(at)) is not None:
            got.append(t[:2])
            at = t[1]
        assert got == _tags_by_regex(page), page


@pytest.mark.parametrize("bit", ["<a ", '<a b="', "<a '", '<a "> ', "<div>", "</p>", "<div></x>", "<", '"', "<a b='c\" ", "<!-", "<p "
                                 "class='a' "])
def test_broken_pages_take_linear_time(bit):
    """A page of 1 MB that repeats any broken piece."""
    began = time.process_time()
    html_blocks.main_blocks(bit * (1_000_000 // len(bit)), TREE)
    assert time.process_time() - began < 6
    began = time.process_time()
    html_blocks.main_blocks((bit * 20_000)[:100_000] + f"<article><p>{LONG}</p></article>", TREE)
    assert time.process_time() - began < 2


def test_text_around_broken_tags_is_kept():
    page = f"<article><p>one < two & three</p><p>{LONG} <a href=\"x>link</a></p><p>after</article>"
    got = " ".join(html_blocks.main_blocks(page, TREE))
    assert "one < two & three" in got and "link" in got and "after" in got
    assert html_blocks.main_blocks("<article><p>a &amp; b &lt;c&gt; &#233; &nbsp; d</p></article>", TREE) == [
        html.unescape("a &amp; b &lt;c&gt; &#233; d")]
