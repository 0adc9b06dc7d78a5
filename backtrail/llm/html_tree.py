"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are a tree of hidden labels, content or not. A node's own features (tag, class and id words,
text length, link share, neighbours, its part of the page's text, where it stands) give its potential; each parent and
child share a potential that depends on the kind of the child. Sum-product messages go up from the leaves and down from the
root once, which gives exact marginals; text whose block is content with probability 0.5 or more is kept. The parameters
are fitted by gradient ascent on the exact likelihood of labelled pages: layouts written by hand (LAYOUTS), whose texts are
filled in, and pages composed of the usual parts in ever other ways. Held-out pages of neither origin are in the tests.

Reading a page: end tags may be missing, pages may be cut anywhere; comments, scripts, styles and the head hold no text;
references are decoded; inline elements don't break words; white space inside a block becomes one space, and blocks are
joined in page order by one space. Nothing is capped.

Defined results: null and empty pages, and pages without content, have the empty text; repeated rows stay repeated; a null
page_id or url is returned as such; other columns aren't looked at, whatever their names; an empty table gives no rows. A
probability of exactly 0.5 counts as content.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from backtrail.llm.common import map_rows

_TAG = re.compile(r"""<!--(?:>|->|.*?--!?>|.*\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Formulas and drawings stand in their block's text; spaces part the labels of a drawing and the cells of a formula.
FOREIGN = set(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none "
    "mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml svg g path rect circle ellipse line polyline polygon defs use symbol marker text tspan textpath "
    "lineargradient radialgradient stop clippath mask pattern filter image desc metadata switch view animate animatemotion animatetransform set mpath foreignobject".split()
)
SPACED = set("text textpath desc metadata mtd annotation annotation-xml foreignobject".split())
INLINE |= FOREIGN
SILENT = set("script style template noscript title head iframe object audio video canvas select textarea datalist".split())
RAW = set("script style title textarea iframe noscript template".split())
#: What can stand in a head; any other start tag, and text, ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What a new block ends, if it stands right above.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


class Page:
    """Block elements in page order, and the text segments in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [()]
        self.depth = [0]
        self.segments: list[tuple[int, str]] = []
        self.linked: dict[int, int] = {}
        self._read(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        words: list[str] = []
        if "=" in attributes:
            for name, *values in _NAMES.findall(attributes):
                own = _WORDS.findall("".join(values).lower())
                words += own + ["id:" + w for w in own if name.lower() == "id"]
        stack.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(stack[-2])
        self.depth.append(self.depth[stack[-2]] + 1)
        self.names.append(tuple(words))

    def _read(self, source: str) -> None:
        stack, buffer, at, links, silent = [0], [], 0, 0, 0
        size = len(source)

        def flush():
            if buffer:
                text = " ".join("".join(buffer).split())
                if text and not silent:
                    self.segments.append((stack[-1], text))
                buffer.clear()

        def end_head():
            nonlocal silent
            while any(self.tag[i] == "head" for i in stack):
                flush()
                silent -= self.tag[stack.pop()] in SILENT

        while at < size:
            m = _TAG.search(source, at)
            text = source[at : m.start() if m else size]
            if text:
                text = html.unescape(text) if "&" in text else text
                if silent and text.strip():
                    end_head()
                buffer.append(text)
                if links:
                    self.linked[stack[-1]] = self.linked.get(stack[-1], 0) + len(text.strip())
            if not m:
                break
            at = m.end()
            tag = (m[1] or "").lower()
            if not tag:
                continue
            if source[m.start() + 1] == "/":
                if tag in INLINE:
                    if tag in SPACED:
                        buffer.append(" ")
                    links -= tag == "a" and links > 0
                elif tag == "br":
                    flush()
                elif any(self.tag[i] == tag for i in stack):
                    flush()
                    while self.tag[gone := stack.pop()] != tag:
                        silent -= self.tag[gone] in SILENT
                    silent -= tag in SILENT
                continue
            if silent and tag not in IN_HEAD:
                end_head()
            if tag in INLINE:
                if tag in SPACED:
                    buffer.append(" ")
                links += tag == "a"
            elif tag in VOID:
                if tag in ("br", "hr"):
                    flush()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                if tag != "title":
                    flush()
                at = end.start() if end else size
                close = source.find(">", at)
                at = close + 1 if close >= 0 else size
            else:
                flush()
                links = 0
                ends = ENDS.get(tag, {"p"})
                while len(stack) > 1 and self.tag[stack[-1]] in ends:
                    stack.pop()
                silent += tag in SILENT
                self._open(tag, m[2] or "", stack)
        flush()

    def lengths(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, text in self.segments:
            out[node] = out.get(node, 0) + len(text)
        return out


SECTIONS = set("article main section div body #page html".split())
FRINGE = set("nav aside footer header form menu dialog".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
KINDS = 4


def kind(tag: str) -> int:
    """The kind of a child, which chooses the potential that it shares with its parent."""
    return 0 if tag in FRINGE else 1 if tag in ("article", "main") else 2 if tag in SECTIONS else 3


#: Words for classes and ids of parts that aren't content, and of parts that are.
FRINGE_NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip",
    "header": "header masthead topbar site branding logo",
    "footer": "footer bottom copyright legal colophon credits",
    "aside": "sidebar aside widget related recommended popular trending rail more",
    "div": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner notice alert cookie consent gdpr message warning popup modal overlay newsletter subscribe signup paywall share social follow tags meta byline author hidden",
    "section": "comments comment reply replies discussion respond responses reader disqus",
    "form": "form search login contact feedback subscribe",
}
CONTENT_NAMES = "content article post entry body text story main page".split()
NOT_CONTENT = {w for words in FRINGE_NAMES.values() for w in words.split()} - {"more", "site", "toc"}


LONG = 80  # characters of a paragraph that is hardly a label


def node_features(page: Page) -> list[list[str]]:
    """The names of each node's features."""
    n = len(page.tag)
    own = [0] * n
    for node, length in page.lengths().items():
        own[node] = length
    linked = [min(page.linked.get(i, 0), own[i]) for i in range(n)]
    below, below_linked = own[:], linked[:]
    paragraphs, headings = [0] * n, [0] * n
    before: list[str] = ["-"] * n  # tags of the neighbours
    after: list[str] = ["-"] * n
    last: dict[int, int] = {}
    for i in range(1, n):
        up = page.parent[i]
        if up in last:
            before[i], after[last[up]] = page.tag[last[up]], page.tag[i]
        last[up] = i
        paragraphs[up] += page.tag[i] == "p"
        headings[up] += page.tag[i] in HEADINGS
    for i in range(n - 1, 0, -1):  # children come behind their parents
        below[page.parent[i]] += below[i]
        below_linked[page.parent[i]] += below_linked[i]
    total = max(1, below[0])
    has = [t in ("article", "main") for t in page.tag]
    some = "article" if any(has) else "body" if "body" in page.tag else "bare"
    inside, fringe = [False] * n, [False] * n
    long_ones = [i for i in range(n) if own[i] >= LONG and 2 * linked[i] < own[i]]
    first, final = (long_ones[0], long_ones[-1]) if long_ones else (n, -1)
    holds = [0] * n  # how many of the long ones
    for i in long_ones:
        while i >= 0:
            holds[i] += 1
            i = page.parent[i]
    out = []
    for i, tag in enumerate(page.tag):
        up = page.parent[i]
        named = not NOT_CONTENT.isdisjoint(page.names[i])
        inside[i] = has[i] or (i > 0 and inside[up])
        fringe[i] = tag in FRINGE and not (tag == "header" and i > 0 and inside[up]) or named or (i > 0 and fringe[up])
        where = "before" if i < first else "behind" if i > final else "amid"
        f = ["bias", f"tag:{tag}", f"size:{min(6, (own[i] // 20).bit_length()) if own[i] else -1}", f"where:{some}:{inside[i]}", f"in:{page.tag[up] if i else '-'}", f"fringe:{fringe[i]}:{inside[i]}", f"{where}:{tag in HEADINGS}"]
        amount = "unknown" if not long_ones else "no" if not holds[i] else "all" if holds[i] == len(long_ones) else "some"
        f += [f"long:{amount}:{fringe[i]}", f"{page.tag[up] if i else '-'}>{tag}"]
        f += [f"name:{w}" for w in set(page.names[i])]
        f += [f"next:{after[i]}", f"last:{before[i]}"]
        if below[i]:
            share = below[i] / total
            f += [f"part:{1 + (share > 0.02) + (share > 0.1) + (share > 0.3) + (share > 0.6)}", f"below:{int(below_linked[i] / below[i] * 3.99)}:{min(6, (below[i] // 20).bit_length())}"]
        if own[i]:
            f.append(f"links:{int(linked[i] / own[i] * 3.99)}")
        if paragraphs[i] or headings[i]:
            f.append(f"holds:{min(3, paragraphs[i])}:{min(2, headings[i])}")
        out.append(f)
    return out


class Forest:
    """Several pages' trees as arrays, ordered by depth, ready for message passing."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0] + [len(p.tag) for p in pages])
        self.parent = np.concatenate([np.array(p.parent) + s * (np.array(p.parent) >= 0) for p, s in zip(pages, starts, strict=False)])
        self.kind = np.array([kind(t) for p in pages for t in p.tag])
        depth = np.concatenate([p.depth for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.starts = starts

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(label 1) of each node, P(parent's label, own label) of each node with a parent).

        unary[i, y]: log potential; pair[kind, y of parent, y of child]: log potential."""
        n = len(unary)
        up = unary.copy()  # belief from below, without the parent
        message = np.zeros((n, 2))  # to the parent
        for level in reversed(self.levels[1:]):
            joint = pair[self.kind[level]] + up[level][:, None, :]
            message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        both = np.zeros((n, 2, 2))
        belief = up.copy()
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]
            joint = pair[self.kind[level]] + above[:, :, None] + up[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            both[level] = p / p.sum(axis=(1, 2), keepdims=True)
            # the child's belief, in the scale of its own subtree
            down = np.logaddexp(pair[self.kind[level]][:, 0, :] + above[:, 0, None], pair[self.kind[level]][:, 1, :] + above[:, 1, None])
            belief[level] = up[level] + down - down.max(axis=1, keepdims=True)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return p, both


class Model:
    def __init__(self, names: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.names, self.weights, self.pair = names, weights, pair

    def unary(self, pages: list[Page]) -> np.ndarray:
        score = [sum(self.weights[j] for f in fs if (j := self.names.get(f)) is not None) for p in pages for fs in node_features(p)]
        return np.stack([np.zeros(len(score)), np.array(score)], axis=1)

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        p, _ = forest.marginals(self.unary(pages), self.pair)
        out = []
        for page, start in zip(pages, forest.starts, strict=False):
            out.append(" ".join(text for node, text in page.segments if p[start + node] >= 0.5))
        return out


def train(labelled: list[tuple[str, set[int]]], rounds: int = 150, rate: float = 0.3, penalty: float = 0.02) -> Model:
    """labelled: pages and the numbers of their content nodes. Adagrad on the exact log-likelihood."""
    pages = [Page(s) for s, _ in labelled]
    y = np.array([i in good for p, (_, good) in zip(pages, labelled, strict=True) for i in range(len(p.tag))], dtype=int)
    rows = [f for p in pages for f in node_features(p)]
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    index = np.array([names[f] for r in rows for f in r])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    forest = Forest(pages)
    child = forest.parent >= 0
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    w, pair = np.zeros(len(names)), np.zeros((KINDS, 2, 2))
    grown_w, grown_p = np.full(len(names), 1e-6), np.full((KINDS, 2, 2), 1e-6)
    for _ in range(rounds):
        score = np.bincount(row, w[index], minlength=len(rows))
        p, both = forest.marginals(np.stack([np.zeros(len(rows)), score], axis=1), pair)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], both[child])
        step_w = np.bincount(index, (y - p)[row], minlength=len(names)) - penalty * w
        step_p = seen - expected - penalty * pair
        grown_w += step_w**2
        grown_p += step_p**2
        w += rate * step_w / np.sqrt(grown_w)
        pair += rate * step_p / np.sqrt(grown_p)
    return Model(names, w, pair)


#: Marks a text as content in a page that is yet to be labelled.
MARK = "\u2063"

#: Pages by hand. C: a paragraph, H: a heading, S: a short line, all of them content. N: a few words, L: a link, P: a sentence
#: or two, none of them content. X*: repeated some times.
LAYOUTS = """
<!doctype html><html><head><title>N</title></head><body><nav><a>L</a><a>L</a></nav><article><p>C</p><p>C</p>[<p>C</p>]</article><footer><p>N</p></footer></body></html>
<!doctype html><html><head><title>N</title></head><body><nav><ul>[<li>L</li>]</ul></nav><article><header><h1>H</h1></header>[<p>C</p>]</article><footer>P</footer></body></html>
<!doctype html><title>N</title><nav>[L ]</nav><main><section><h2>H</h2><p>C</p></section>[<section><h2>H</h2><p>C</p></section>]</main><footer>N</footer>
<html><head><title>N</title><body><header><a>L</a><p>N</p></header><section><h1>H</h1>[<p>C</p>]</section><footer><p>P</p></footer>
<html><body><div id=top>N</div><div class=menu>[L ]</div><div class=content><p>C</p>[<p>C</p>]</div><div class=footer>N</div></body></html>
<html><body><div><a>L</a> <a>L</a> <a>L</a></div><div><div><p>C</p>[<p>C</p>]</div></div><div>N</div></body></html>
<html><head><title>N</title></head><body><nav>[L ]</nav><h1>H</h1>[<p>C</p>]<footer>N</footer></body></html>
<html><head><title>N</title></head><body><h1>H</h1><p>C</p>[<p>C</p>]</body></html>
<html><body><header><h1>N</h1><nav>[<a>L</a>]</nav></header><table><tr><td>C</td></tr><tr><td>C</td></tr></table><footer><small>N</small></footer></body></html>
<html><body><nav>[L ]</nav><article><h1>H</h1><table><tr><th>S</th><th>S</th></tr>[<tr><td>S</td><td>S</td></tr>]</table>[<p>C</p>]</article><footer>P</footer></body></html>
<html><body><table><tr><td>[L<br>]</td><td><h1>H</h1>[<p>C</p>]</td></tr></table><p>N</p></body></html>
<html><body><div id=page><div id=header><p>N</p></div><div id=main><h2>H</h2>[<p>C</p>]<h3>H</h3>[<p>C</p>]</div><div id=sidebar><h3>N</h3><p>P</p></div><div id=footer>N</div></div></body></html>
<html><body><main><h1>H</h1><div class=lead><p>C</p></div><div>[<p>C</p>]</div></main><aside><h2>N</h2><ul>[<li>L</li>]</ul></aside></body></html>
<html><body><main><article><header><p class=kicker>N</p><h1>H</h1></header><section><p>C</p></section><section><h2>H</h2>[<p>C</p>]<ul>[<li>S</li>]</ul></section><footer>N</footer></article></main></body></html>
<body><header><p>N</p></header><article><h1>H</h1><p>C</p><aside><p>P</p></aside><p>C</p><form><label>N</label></form><p>C</p></article><section id=comments><h2>N</h2>[<div class=comment><p>P</p><p>P</p></div>]</section></body>
<body><article><h1>H</h1><div class=byline>N</div><p>C</p><figure><figcaption>S</figcaption></figure><blockquote><p>C</p></blockquote><p>C</p><div class="share social">[L ]</div></article><div class=related><h3>N</h3>[<p>P</p>]</div></body>
<body><div class=cookie-banner><p>P</p></div><div class=post><h2>H</h2>[<p>C</p>]<ol>[<li>C</li>]</ol></div><div class=comments>[<p>P</p>]</div></body>
<body><nav><a>L</a></nav><section><p>C</p><dl><dt>S</dt><dd>C</dd><dt>S</dt><dd>C</dd></dl></section><section class=newsletter><h2>N</h2><p>P</p></section><footer><div><p>N</p></div></footer></body>
<body><div class=wrap><div><ul>[<li>L</li>]</ul></div><div><h1>H</h1><div><div><p>C</p></div><div>[<p>C</p>]</div></div></div><div><p>N</p></div></div></body>
<body>C<p>C</p>C<br>C</body>
<body><nav>[L ]</nav>C<br><br>C<p>C</p><footer>N</footer></body>
<html><body><article>C</article><footer>N</footer></body></html>
<html><body><div class=nav>[L ]</div><article><h1>H</h1><pre>C</pre>[<p>C</p>]<h2>H</h2><p>S</p></article><div class=ad>P</div></body></html>
<html><head><title>N</title></head><body><article><p>C</p></article></body></html>
<html><head><title>N</title></head><body><nav>[L ]</nav><article><h1>H</h1><p>C</p></article></body></html>
<title>N</title><article><p>C</p></article>
<html><body><main><p>C</p></main><footer><p>N</p></footer></body></html>
<html><body><div class=article><p>C</p></div><footer>N</footer></body></html>
<html><body><section><p>C</p></section></body></html>
<html><body><header><h1>N</h1></header><main><article><p>C</p></article></main><footer><p>P</p></footer></body></html>
<html><head><title>N</title></head><body>C</body></html>
<html><head><title>N</title></head><body>S</body></html>
<html><head></head><body>C<br>C<p>C</p></body></html>
<html><head><title>N</title></head><body><nav>[L ]</nav>C</body></html>
<html><body><p>S</p></body></html>
<html><body><article><p>S</p></article></body></html>
<html><head><title>N</title></head><body><main>C</main></body></html>
<html><body><nav>[L ]</nav><main>C<br><br>C</main><footer>N</footer></body></html>
<html><body><article>C</article></body></html>
<html><body><article>S</article></body></html>
<html><body><nav>[L ]</nav><article><h1>H</h1>C</article><footer>N</footer></body></html>
<html><body><section>C</section><footer>N</footer></body></html>
<html><body><div class=content>C<br><br>C</div><div class=footer>N</div></body></html>
<html><body><div>C</div></body></html>
<html><body><nav>[L ]</nav><div>C</div></body></html>
<div>C</div>
<div>S</div>
<article>C</article>
<p>C</p>
S
<p>C</p>[<p>C</p>]
<h1>H</h1>[<p>C</p>]
<article><h1>H</h1>[<p>C</p>]</article>
<div><p>C</p></div>
"""  # fmt: skip


class Composer:
    """Writes a page whose content is marked."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.out: list[str] = []

    def words(self, low: int, high: int, content: bool = False) -> str:
        r = self.random
        text = " ".join("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return MARK * content + text.capitalize() + r.choice([".", ".", "", "!"])

    def laid_out(self) -> str:
        """One of LAYOUTS, filled in."""
        r = self.random
        layout = r.choice(LAYOUTS.strip().split("\n"))
        layout = re.sub(r"\[([^\]]*)\]", lambda m: m[1] * r.randint(1, 6), layout)
        long_ = r.choice([25, 40, 90])
        fill = {"C": lambda: self.linked(r.randint(6, 14), long_, True), "H": lambda: self.words(1, 9, True), "S": lambda: self.words(1, 6, True), "N": lambda: self.words(1, 9), "L": lambda: f"<a href=x>{self.words(1, 2)}</a>", "P": lambda: self.words(4, 45)}
        return re.sub(r"(?<![\w<&-])[CHSNLP](?![\w-])", lambda m: fill[m[0]](), layout)

    def linked(self, low: int, high: int, content: bool) -> str:
        text = self.words(low, max(low, high), content)
        return text if self.random.random() < 0.75 else f'{text} <a href="/y">{self.words(1, 4)}</a> {self.words(1, 9)}'

    def open(self, tag: str, names: str = "") -> None:
        attribute = "" if not names else f' {self.random.choice(["class", "class", "id"])}="{names}"'
        self.out.append(f"<{tag}{attribute}>")

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def block(self, tag: str, text: str, names: str = "") -> None:
        self.open(tag, names)
        self.out.append(text)
        self.close(tag)

    def links(self, n: int) -> None:
        self.open("ul")
        for _ in range(n):
            self.block("li", f'<a href="/x">{self.words(1, 2)}</a>')
        self.close("ul")

    def fringe(self, tag: str) -> None:
        r = self.random
        names = " ".join(r.sample(FRINGE_NAMES[tag].split(), r.randint(1, 2))) if r.random() < (0.95 if tag in ("div", "section") else 0.5) else ""
        if not names and tag in ("div", "section"):
            names = r.choice(FRINGE_NAMES[tag].split())
        outer = r.choice([tag, tag, "div", "section"]) if names else tag
        self.open(outer, names)
        style = r.random()
        if tag == "nav" or style < 0.2:
            self.links(r.randint(2, 7)) if r.random() < 0.7 else self.out.extend(f'<a href="/x">{self.words(1, 2)}</a> ' for _ in range(r.randint(1, 6)))
        elif tag == "form":
            self.out.append(f'<label>{self.words(1, 3)}</label><input name="q">{self.words(1, 2)}')
        elif tag == "section" or style < 0.45:
            for _ in range(r.randint(1, 4)):
                inner = r.choice(["div", "div", "div", "li", "li", "p", "p", "article"])
                self.open(inner, r.choice(["comment", "", "item", "reply"]) if inner != "p" else "")
                self.out.append(self.words(3, 40)) if inner == "p" else self.block("p", self.words(3, 60))
                self.close(inner)
        elif style < 0.7:
            self.out.append(self.words(2, 25))
        else:
            if r.random() < 0.4:
                self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 4))
            for _ in range(r.randint(1, 3)):
                self.block("p", self.words(2, 35))
        self.close(outer)

    def body_text(self, n: int) -> None:
        r = self.random
        for _ in range(n):
            style = r.random()
            if style < 0.66:
                self.block("p", self.linked(1, r.choice([3, 6, 25, 90]), True))
            elif style < 0.74:
                self.block(r.choice(["h2", "h3"]), self.words(1, 8, True))
            elif style < 0.79:
                self.block("blockquote", self.words(3, 40, True))
            elif style < 0.84:
                self.open("ul")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.words(2, 15, True))
                self.close("ul")
            elif style < 0.88:
                self.block(r.choice(["pre", "figcaption", "div"]), self.words(3, 30, True))
            elif style < 0.92:
                self.open("table")
                for _ in range(r.randint(1, 4)):
                    self.open("tr")
                    for _ in range(2):
                        self.block("td", self.words(1, 6, True))
                    self.close("tr")
                self.close("table")
            else:
                self.fringe(r.choice(["div", "aside", "div", "form", "nav", "section"]))

    def article(self) -> None:
        r = self.random
        name = lambda: r.choice(CONTENT_NAMES)
        boxes = r.choice([[("article", "")]] * 6 + [[("main", "")], [("section", "")], [("div", name())], [("div", name())], [("div", "")], [("div", ""), ("div", "")], [("main", ""), ("article", "")], [("main", ""), ("div", name())], [("article", ""), ("div", name())], [("article", name())], []])
        for tag, names in boxes:
            self.open(tag, names)
        style = r.random()
        if style < 0.6:
            self.block("h1", self.words(2, 10, True))
        elif style < 0.7 and boxes:
            self.open("header")
            self.block("h1", self.words(2, 10, True))
            self.close("header")
        if r.random() < 0.15:
            for _ in range(r.randint(1, 3)):
                self.open("section")
                self.block("h2", self.words(1, 8, True))
                self.body_text(r.randint(1, 4))
                self.close("section")
        elif boxes and r.random() < 0.12:
            for _ in range(r.randint(1, 3)):
                self.out.append(self.words(3, 60, True) + r.choice(["", "<br>", "<br><br>"]))
        else:
            self.body_text(r.randint(1, 12))
        if boxes and r.random() < 0.15:
            self.fringe("section")
        for tag, _ in reversed(boxes):
            self.close(tag)

    def page(self) -> str:
        r = self.random
        if r.random() < 0.45:
            return self.laid_out()
        wrapped = r.random() < 0.3
        if r.random() < 0.85:  # their tags may be left out
            self.out.append("<!DOCTYPE html><html><head><title>x</title>" + r.choice(["</head><body>", "</head><body>", "<body>", ""]))
        for tag in r.sample(["header", "nav", "div", "div", "form"], r.randint(0, 4)):
            self.fringe(tag)
        if wrapped:
            self.open("div", r.choice(["wrapper", "container", "page", "layout", ""]))
        if r.random() < 0.2:
            self.fringe("aside")
        self.article()
        for tag in r.sample(["aside", "section", "div", "nav"], r.randint(0, 2)):
            self.fringe(tag)
        if wrapped:
            self.close("div")
        if r.random() < 0.9:
            self.fringe("footer")
        self.out.append("</body></html>")
        return "".join(self.out)


def labels(page: Page) -> set[int]:
    """The content nodes of a marked page: those with marked text, the lowest node above all of them, and what lies between."""
    marked = {node for node, text in page.segments if MARK in text}
    held = [0] * len(page.tag)
    for node in marked:
        while node >= 0:
            held[node] += 1
            node = page.parent[node]
    some = {i for i, n in enumerate(held) if n}
    whole = max((i for i in some if held[i] == len(marked)), key=lambda i: page.depth[i], default=-1)
    out = set()
    for i in some:
        at = i
        while at not in (-1, whole):
            at = page.parent[at]
        if at == whole:
            out.add(i)
    return out


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, set[int]]]:
    """(page, numbers of its content nodes)."""
    pages = [Composer(seed * 1_000_003 + i).page() for i in range(n)]
    return [(p.replace(MARK, ""), labels(Page(p))) for p in pages]


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages(1100))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    model = model or default_model()

    def make():
        def f(ids, urls, sources):
            texts = model.extract(sources)
            return ids, urls, texts, [len(t) for t in texts]

        return f

    return map_rows(pages, ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint", make)
