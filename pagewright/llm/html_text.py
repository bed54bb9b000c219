"""HTML extraction with a tree-structured graphical model.

The block elements of a page form a tree. Each node is content or not; its class and id words, its amount of text
and its share of link text speak for either (unary potentials), and so does the label of its parent, by the node's tag
(pairwise potentials).
Sum-product message passing, once upward and once downward, gives the exact marginal of every node, and the text
of nodes that are more likely content than not is the page's text.

The potentials are counted on labelled pages. By default those are made here: TRAIN_PAGES layouts with articles, menus, adverts,
side columns, notices, forms and reader comments (labelled_pages) and a third as many whose content stands in the body itself
(plain_pages); each element carries its label. Training takes no others; extraction takes all pages, whole.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import random
import re
from collections import Counter

from pyspark.sql import DataFrame

from .core import map_batches

TRAIN_PAGES = 1500
#: Elements without content, elements whose content is not text of the page, elements within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover semantics svg g text tspan object canvas noscript template".split())
#: Elements that hold one stretch of text; #text is text that stands in the body itself.
OUTER = frozenset(["#root", "html", "body"])
LINES = frozenset("#text p li h1 h2 h3 h4 h5 h6 td th tr dt dd pre blockquote".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of these kinds, looked for up to the nearest of the others.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*>", re.S)
LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y|data-t)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTIAL = re.compile(r"<[a-zA-Z/!?][^<>]*\Z", re.S)
NAME = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")


class Page:
    """The block tree of a page, parents before children, and its pieces of text in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.label, self.loose = [-1], ["#root"], [()], ["0"], ["0"]
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, whether it stands in a link; node -1: a break in the line
        self._read(source)
        n = len(self.parent)
        own, links = [0] * n, [0] * n
        for i, t, link in self.pieces:
            if i >= 0 and (k := len(t.strip())):
                own[i] += k
                links[i] += k * link
        self.own = list(own)
        kids, titled, bare = [0] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            own[p] += own[i]
            links[p] += links[i]
            kids[p] += self.tag[i] == "p"
            titled[p] |= self.tag[i] == "h1"
            bare[p] |= self.tag[i] == "#text"
        self.bare = bare
        self.size, self.links, self.paragraphs, self.titled = own, links, kids, titled

    def _read(self, s: str) -> None:
        stack = [0]
        link = 0
        at, end = 0, len(s)
        unclosed = set()  # tags that do not close any more
        while at < end:
            m = TOKEN.search(s, at)
            stop = m.start() if m else end
            if stop > at:
                text = s[at:stop]
                if not m:
                    text = PARTIAL.sub("", text)
                    if (loose := LOOSE.search(text)):  # a tag with an open quote
                        text = text[: loose.start()] + " " + LOOSE.sub(" ", text[loose.start() :])
                if text:
                    text = htmllib.unescape(text)
                    if self.tag[stack[-1]] in OUTER and not text.isspace():
                        self._open_body(stack)
                        self._node(stack, "#text", (), self.loose[stack[-1]], "0")
                    self.pieces.append((stack[-1], text, link > 0))
            if not m:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag in RAW:
                    if not m[2].endswith("/"):  # one that is never closed holds what stands before the next tag
                        close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(s, at)
                        if not close:
                            unclosed.add(tag)
                        at = close.end() if close else nxt if (nxt := s.find("<", at)) >= 0 else end
                    self.pieces.append((-1, "", False))
                elif tag in INLINE:
                    link += tag == "a"
                elif tag in VOID:
                    if tag in ("br", "hr"):
                        self.pieces.append((-1, "", False))
                else:
                    self._open(stack, tag, m[2])
                    link = 0
            elif m[3]:
                tag = m[3].lower()
                if tag == "a":
                    link = max(0, link - 1)
                elif tag not in INLINE and tag not in VOID:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            del stack[k:]
                            self.pieces.append((-1, "", False))
                            link = 0
                            break

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if self.tag[stack[-1]] == "#text" or tag in ENDS_P and self.tag[stack[-1]] == "p":
            stack.pop()
        kinds, walls = SIBLINGS.get(tag, (None, None))
        if kinds:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in walls:
                    break
                if self.tag[stack[k]] in kinds:
                    del stack[k:]
                    break
        if tag not in ("html", "head", "body"):
            self._open_body(stack)
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = tuple(NAME.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
        self._node(stack, tag, names, found.get("data-y", "0"), found.get("data-t", "0"))

    def _open_body(self, stack: list[int]) -> None:
        """The body that a page may leave out."""
        if self.tag[stack[-1]] in ("#root", "html"):
            self._node(stack, "body", (), "0", "0")

    def _node(self, stack: list[int], tag: str, names: tuple, label: str, loose: str) -> None:
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label)
        self.loose.append(loose)
        self.pieces.append((-1, "", False))
        stack.append(len(self.parent) - 1)

    def features(self, i: int) -> list[tuple]:
        n, total = self.size[i], max(1, self.size[0])
        share = self.links[i] / n if n else 0
        kind = self.tag[i] if self.tag[i] in OUTER else ""  # the outer elements hold all of the page: their amounts speak otherwise
        out = [(f"{kind}links", round(share * 4) if n else 5), *[("name", x) for x in self.names[i]]]
        if self.tag[i] not in LINES:  # in lines of text the amount says little, and there are many of them
            counts = {"size": min(8, n.bit_length() // 2), "share": round(4 * n / total), "paragraphs": min(3, self.paragraphs[i]), "titled": self.titled[i], "bare": self.bare[i]}
            out += [(kind + k, v) for k, v in counts.items()]
        return out

    def text(self, content) -> str:
        """The pieces of nodes for which content[node] holds, blocks joined by one blank."""
        out, block = [], []
        last = -1
        for i, t, _ in [*self.pieces, (-1, "", False)]:
            if i < 0 or i != last:
                out.append(BLANK.sub(" ", "".join(block)).strip())
                block = []
            if i >= 0 and content[i]:
                block.append(t)
            last = i
        out.append(BLANK.sub(" ", "".join(block)).strip())
        return " ".join(x for x in out if x)


class Model:
    """Potentials of a two-state tree model, as log-probabilities from labelled pages."""

    def __init__(self, pages: list[Page]):
        pair, feature, kinds, labels = Counter(), Counter(), {}, Counter()
        for p in pages:
            y = [x == "1" for x in p.label]
            for i in range(1, len(y)):
                for tag in (p.tag[i], ""):
                    pair[tag, y[p.parent[i]], y[i]] += 1
                labels[y[i]] += 1
                for f in p.features(i):
                    feature[f, y[i]] += 1
                    kinds.setdefault(f[0], set()).add(f)
        every = [[(pair["", a, b] + 0.5) / (pair["", a, False] + pair["", a, True] + 1) for b in (False, True)] for a in (False, True)]
        self.pair = {t: [[math.log((pair[t, a, b] + 4 * every[a][b]) / (pair[t, a, False] + pair[t, a, True] + 4)) for b in (False, True)] for a in (False, True)] for t in {k[0] for k in pair} | {""}}
        total = {k: [sum(feature[f, y] for f in fs) for y in (False, True)] for k, fs in kinds.items()}
        self.unary = {}
        for k, fs in kinds.items():
            for f in fs:
                base = labels if k == "name" else {False: total[k][0], True: total[k][1]}
                w = [math.log((feature[f, y] + 0.5) / (base[y] + 1)) for y in (False, True)]
                self.unary[f] = w[1] - w[0]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node; the root is not content."""
        n = len(page.parent)
        get = self.unary.get
        score = [0.0] * n  # log odds of what is below and at each node
        pairs = [self.pair.get(t, self.pair[""]) for t in page.tag]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            s = score[i] + sum(get(f, 0.0) for f in page.features(i))
            score[i] = s
            (n0, n1), (c0, c1) = pairs[i]
            m = _plus(c0, c1 + s) - _plus(n0, n1 + s)  # message to the parent, as log odds
            up[i] = m
            score[page.parent[i]] += m
        out, belief = [0.0] * n, [-60.0] * n
        for i in range(1, n):
            b = belief[page.parent[i]] - (up[i] if page.parent[i] else 0.0)  # the parent without this child
            (n0, n1), (c0, c1) = pairs[i]
            down = _plus(n1, c1 + b) - _plus(n0, c0 + b)
            belief[i] = score[i] + down
            out[i] = 1 / (1 + math.exp(-max(-60.0, min(60.0, belief[i]))))
        return out


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 7) -> list[str]:
    """Made pages whose elements say in data-y whether they are content."""
    r = random.Random(seed)

    vocabulary = ["".join(r.choice("aeioustrnlmdcp") for _ in range(r.randint(1, 9))) for _ in range(400)]

    def words(a, b):
        return " ".join(r.choices(vocabulary, k=r.randint(a, b)))

    def el(tag, y, inner, name=""):
        c = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag} data-y="{y}"{c}>{inner}' + ("" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>")

    def links(n):
        return el("ul", 0, "".join(el("li", 0, f'<a href="/x">{words(1, 3)}</a>') for _ in range(n)))

    def aside():
        kind = r.randrange(9)
        return [
            lambda: el("nav", 0, links(r.randint(3, 9)), r.choice(["", "menu", "navigation"])),
            lambda: el("aside", 0, el("h3", 0, words(1, 3)) + links(r.randint(2, 6)) + (el("p", 0, words(5, 30)) if r.random() < 0.4 else ""), r.choice(["", "sidebar", "related"])),
            lambda: el("div", 0, words(3, 30) if r.random() < 0.6 else el("p", 0, words(3, 25)), r.choice(["ad", "ads", "advert", "advertisement", "promo", "banner", "sponsored"])),
            lambda: el("div", 0, words(6, 20) if r.random() < 0.5 else el("p", 0, words(6, 20)) + el("button", 0, words(1, 2)), r.choice(["cookie", "notice", "consent", "popup", "newsletter", "alert"])),
            lambda: el("form", 0, el("p", 0, words(2, 9)) + '<input name="q">' + el("button", 0, words(1, 2)), r.choice(["", "search", "login", "subscribe"])),
            lambda: el(r.choice(["section", "div", "ol"]), 0, el("h2", 0, words(1, 3)) + "".join(el(r.choice(["div", "div", "div", "li", "li", "li", "li", "article"]), 0, el("p", 0, words(4, 60)), r.choice(["comment", "comment reply"])) for _ in range(r.randint(1, 6))), r.choice(["comments", "discussion", "responses"])),
            lambda: el("div", 0, links(r.randint(2, 7)), r.choice(["share", "social", "tags", "breadcrumb", "pagination", "sidebar", "widget"])),
            lambda: el("header", 0, el("p", 0, words(1, 4)) + (links(4) if r.random() < 0.5 else ""), r.choice(["", "masthead", "header", "top"])),
            lambda: el("footer", 0, ("&copy; " + words(3, 14)) if r.random() < 0.6 else el("p", 0, words(3, 18)) + links(3), r.choice(["", "footer", "bottom"])),
        ][kind]()

    def content():
        parts = [el("h1", 1, words(3, 12))]
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 12, 16])):
            x = r.random()
            inner = words(1, r.choice([5, 20, 90, 90, 400, 1500]))
            if r.random() < 0.3:
                inner += f' <a href="/y">{words(1, 4)}</a> ' + words(1, 20)
            if r.random() < 0.2:
                inner = "<b>" + inner
            parts.append(el("p", 1, inner) if x < 0.75 else el("h2", 1, words(2, 7)) if x < 0.83 else el("ul", 1, "".join(el("li", 1, words(3, 25)) for _ in range(3))) if x < 0.89 else el("blockquote", 1, el("p", 1, words(8, 40))) if x < 0.94 else el("pre", 1, words(4, 30)) if x < 0.97 else el("table", 1, el("tr", 1, el("td", 1, words(1, 9)) + el("td", 1, words(1, 9)))))
            if r.random() < 0.05:
                parts.append(aside())
        return el(r.choice(["article", "article", "main", "div", "section"]), 1, "".join(parts), r.choice(["", "", "content", "post", "entry", "article body", "story", "text"]))

    out = []
    for _ in range(count):
        before, after = [aside() for _ in range(r.randint(0, 4))], [aside() for _ in range(r.randint(0, 4))]
        middle = content()
        if r.random() < 0.3:
            middle = el("div", 0, middle + (aside() if r.random() < 0.5 else ""), r.choice(["wrapper", "container", "page", "row"]))
        out.append(f"<html data-y=0><head data-y=0><title>{words(2, 8)}</title></head><body data-y=0>{''.join(before)}{middle}{''.join(after)}</body></html>")
    return out


def plain_pages(count: int = TRAIN_PAGES // 3, seed: int = 11) -> list[str]:
    """Made pages whose content stands in the body itself: paragraphs, lists, tables or bare text, down to one line; some with menus,
    adverts and footers around it. data-y as in labelled_pages; data-t: the same for the text of the body."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnlmdcp") for _ in range(r.randint(1, 9))) for _ in range(400)]
    words = lambda a, b: " ".join(r.choices(vocabulary, k=r.randint(a, b)))
    link = lambda: f'<a href="/x">{words(1, 3)}</a>'
    line = lambda: words(1, r.choice([2, 6, 20, 90])) + (f" <b>{words(1, 4)}</b> " + words(1, 5) if r.random() < 0.3 else "") + (" " + link() + " " + words(1, 9) if r.random() < 0.3 else "")
    menu = lambda y: "<ul data-y=0>" + "".join(f"<li data-y=0>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>"
    around = [
        lambda: f"<nav data-y=0>{menu(0)}</nav>",
        lambda: f"<header data-y=0>{menu(0)}</header>",
        lambda: f"<footer data-y=0><p data-y=0>{words(2, 14)}</p></footer>",
        lambda: f"<footer data-y=0>&copy; {words(2, 9)}</footer>",
        lambda: f'<div data-y=0 class="{r.choice(["ad", "advert", "cookie", "notice", "share"])}">{words(2, 14)}</div>',
        lambda: f'<aside data-y=0 class="sidebar"><h3 data-y=0>{words(1, 3)}</h3>{menu(0)}</aside>',
        lambda: f"<form data-y=0><p data-y=0>{words(2, 7)}</p><button data-y=0>{words(1, 2)}</button></form>",
    ]
    blocks = [
        lambda: f"<p data-y=1>{line()}</p>",
        lambda: f"<p data-y=1>{line()}</p>",
        lambda: f"<h2 data-y=1>{words(1, 7)}</h2>",
        lambda: "<ul data-y=1>" + "".join(f"<li data-y=1>{line()}</li>" for _ in range(r.randint(1, 4))) + "</ul>",
        lambda: f"<table data-y=1><tr data-y=1><td data-y=1>{words(1, 9)}</td><td data-y=1>{words(1, 9)}</td></tr></table>",
        lambda: f"<blockquote data-y=1><p data-y=1>{line()}</p></blockquote>",
        lambda: f"<pre data-y=1>{line()}</pre>",
    ]
    out = []
    for _ in range(count):
        kind = r.randrange(4)
        body = f"<h1 data-y=1>{words(1, 9)}</h1>" if kind < 3 and r.random() < 0.4 else ""
        if kind == 0:
            body += "".join(r.choice(blocks)() for _ in range(r.choice([1, 1, 2, 4, 9])))
        elif kind == 1:
            body += f"<div data-y=1>{''.join(r.choice(blocks)() for _ in range(r.choice([1, 1, 2, 4])))}</div>"
        elif kind == 2:
            tag = r.choice(["div", "article", "main", "section"])
            body += f"<{tag} data-y=1>{line()}</{tag}>"
        else:
            body = line()
        some = [a() for a in r.sample(around, r.choice([0, 0, 1, 2, 3]))]
        cut = r.randint(0, len(some))
        page = "".join(some[:cut]) + body + "".join(some[cut:])
        head = f"<head data-y=0><title>{words(1, 6)}</title></head>" if r.random() < 0.5 else ""
        out.append(f"<html data-y=0>{head}<body data-y=1 data-t=1>{page}</body></html>")
    return out


@functools.lru_cache(1)
def default_model() -> Model:
    return Model([Page(x) for x in labelled_pages() + plain_pages()])


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.text([p >= 0.5 for p in model.marginals(page)])


def extract_pages(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages with text (the main text, empty if there is none) and n_chars (its code points).

    A null or empty page has an empty text; text without markup is the text of a body. Character references are decoded; white space within a
    block becomes one blank; blocks are joined by one blank in page order. Text inside scripts, styles, titles and other
    elements that do not hold markup is no text. Broken markup is read as far as it goes. Every repeated row is read. Columns named text or
    n_chars are replaced; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # a few hundred numbers

    def fn(b):
        texts = [extract(x, shared.value) for x in b.column(html).to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages, "text string, n_chars long", fn, html)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
