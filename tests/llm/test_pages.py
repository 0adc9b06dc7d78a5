"""Main text of pages that were written by hand for these tests, with texts and names of their own; no training page is among them."""

import pytest

from backtrail.llm import html_tree

RIVER = "The river rose on the second night, and by morning the lower road was gone; people carried what they could up to the school."
MILL = "Nobody had seen the old mill from that side before. Its wheel hung over the water like a broken tooth, and the miller sat below it."
BRIDGE = "They rebuilt the bridge in the following year with stone from the quarry, paid for by a tax on salt that the council never lifted."
YEARS = "Years later the engineer wrote that he had guessed the height of the arch, since the drawings had been lost in the flood."
TOP = '<ul class="site-links"><li><a href="/">Front</a></li><li><a href="/l">Local</a></li><li><a href="/s">Sport</a></li></ul>'

PAGES = {
    "article of paragraphs": (f"<!doctype html><html lang=en><head><meta charset=utf-8><title>Flood</title></head><body><nav>{TOP}</nav><article><p>{RIVER}</p><p>{MILL}</p></article><footer><p>All rights reserved</p></footer></body></html>", [RIVER, MILL]),
    "header in an article": (f"<body><header>{TOP}</header><article><header><h1>After the flood</h1></header><p>{RIVER}</p><p>{BRIDGE}</p></article><footer>Printed in town</footer>", ["After the flood", RIVER, BRIDGE]),
    "main with sections": (f"<body><nav>{TOP}</nav><main><section><h2>The night</h2><p>{RIVER}</p></section><section><h2>The mill</h2><p>{MILL}</p><p>{YEARS}</p></section></main><footer><a href=/c>Contact</a></footer></body>", ["The night", RIVER, "The mill", MILL, YEARS]),
    "section alone": (f"<html><body><section><h1>The bridge</h1><p>{BRIDGE}</p><p>{YEARS}</p></section></body></html>", ["The bridge", BRIDGE, YEARS]),
    "named box": (f'<html><body><div class="topnav">{TOP}</div><div class="content"><p>{RIVER}</p><p>{MILL}</p></div><div id="footer">Since 1904</div></body></html>', [RIVER, MILL]),
    "boxes without names": (f"<html><head><title>x</title></head><body><div>{TOP}</div><div><div><p>{RIVER}</p><p>{MILL}</p><p>{BRIDGE}</p></div></div></body></html>", [RIVER, MILL, BRIDGE]),
    "right in the body": (f"<html><head><title>x</title></head><body><nav>{TOP}</nav><h1>The bridge</h1><p>{BRIDGE}</p><p>{YEARS}</p><footer><p>Since 1904</p></footer></body></html>", ["The bridge", BRIDGE, YEARS]),
    "table cells": (f"<html><body><nav>{TOP}</nav><table><tr><td>{RIVER}</td></tr><tr><td>{MILL}</td></tr></table></body></html>", [RIVER, MILL]),
    "table in an article": (f"<html><body><article><h1>Heights</h1><p>{RIVER}</p><table><tr><th>Night</th><th>Metres</th></tr><tr><td>First</td><td>2.1</td></tr></table><p>{YEARS}</p></article></body></html>", ["Heights", RIVER, "Night", "Metres", "First", "2.1", YEARS]),
    "head without end": (f"<html><head><title>T</title><article><p>{RIVER}</p></article>", [RIVER]),
    "no body": (f"<title>T</title><main><h1>The mill</h1><p>{MILL}</p></main>", ["The mill", MILL]),
    "lists and quotes": (f"<html><body><nav>{TOP}</nav><article><h1>Three things</h1><p>{RIVER}</p><ul><li>The road was closed.</li><li>The school stayed open.</li></ul><blockquote><p>{YEARS}</p></blockquote></article></body></html>", ["Three things", RIVER, "The road was closed.", "The school stayed open.", YEARS]),
    "parts that aren't text": (
        f'<html><body><header class="masthead"><a href="/">The Valley Paper</a></header><div class="cookie-notice"><p>We keep small files on your machine to count readers. Agree to go on.</p></div>'
        f'<article><h1>The mill</h1><p>{MILL}</p><div class="advert"><p>Buy two lamps and pay for one, this week only at the market.</p></div><p>{BRIDGE}</p><script>var a = "<p>no</p>";</script></article>'
        f'<aside class="sidebar"><h3>Read next</h3><p>The ferry that never came back</p></aside><section class="comments"><h3>2 replies</h3><div class="comment"><p>I remember that night well, we were all up on the hill until the morning came.</p></div></section>'
        f'<form action="/s"><label>Search</label><input name=q></form><footer><p>Editor: town hall</p></footer></body></html>', ["The mill", MILL, BRIDGE]),
    "nothing but links": (f"<html><body><nav>{TOP}</nav><footer><a href=/a>About</a> <a href=/b>Terms</a></footer></body></html>", []),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page, want = PAGES[name]
    assert html_tree.default_model().extract([page]) == [" ".join(want)]


def test_all_layouts_are_learned():
    model = html_tree.default_model()
    pages = html_tree.labelled_pages(80, seed=4242)
    right = 0
    for page, good in pages:
        parsed = html_tree.Page(page)
        right += model.extract([page])[0] == " ".join(t for n, t in parsed.segments if n in good)
    assert right >= 72


def test_labels_of_a_marked_page():
    m = html_tree.MARK
    page = html_tree.Page(f"<body><nav>x</nav><div><h1>{m}a</h1><section><p>{m}b</p></section><p>c</p></div></body>")
    assert sorted(page.tag[i] for i in html_tree.labels(page)) == ["div", "h1", "p", "section"]
    assert html_tree.labels(html_tree.Page("<p>a</p>")) == set()
