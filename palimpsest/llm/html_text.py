"""HTML main-text extraction with a tree-structured graphical model.

A page becomes a tree of block elements with runs of inline text as leaves. Every node has
a binary label, content or not. A node's own features (tag, words of its class, id and role;
how long, how linked and how much like sentences its text and the text below it are; for a leaf
the leaves beside it and whether most of the page's plain text is where it is) give its potential;
each parent-child edge has a 2 x 2 potential that depends on the kind of the child. One upward
and one downward pass of sum-product messages give exact marginals; leaves with a marginal
of one half or more are the main text, in page order. Names of elements are hints that training
pages drop, make up and mislead with, so that text can outweigh them.

All potentials are trained by maximum conditional likelihood (the gradient needs the same
marginals) on labelled pages, which ``labelled_pages`` makes from seeded templates, on the
driver: the number of pages is a parameter. Prediction is one pass over the pages without a
shuffle; the trained weights are a few kilobytes.

Defined cases: null or empty html, or a page without content, gives an empty text; broken
markup (missing or stray end tags, cut-off pages) is parsed as far as it goes; a quote that
is never closed is a character of its tag, which ends at the next >; scripts, styles and the
like end at their end tag alone; text in no element is a leaf of the page; repeated rows stay; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import load, pick, slices

#: Tags by what they do to a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html legend li main menu nav noscript object ol p pre section summary table tbody td tfoot th thead tr ul button select option label caption".split()
)
#: Never shown as text, whatever they hold; of these, only the foreign ones may close themselves.
RAW = frozenset("script style template textarea title iframe svg canvas audio video".split())
FOREIGN = frozenset(("svg",))
VOID_BREAKS = frozenset(("br", "hr", "wbr"))
#: An opening tag ends these open elements first, up to the boundary elements.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
}
#: Tags of a page that has nothing but its text ("" is a leaf).
PLAIN = frozenset(["", *"html body p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th figure figcaption object center".split()])
#: Kinds of children, by which edge potentials differ.
KINDS = {"": 0, "p": 1, "pre": 1, "blockquote": 1, **{f"h{i}": 2 for i in range(1, 7)}, "li": 3, "ul": 3, "ol": 3, "dl": 3, "dt": 3, "dd": 3, "article": 4, "main": 4, "div": 5, "section": 5, "td": 6, "tr": 6, "table": 6, "tbody": 6, "th": 6}
OTHER_KIND, N_KINDS, CONTAINERS = 7, 8, 4
#: A feature of fewer training pages is left out: a name that is seen so seldom says nothing.
LEAST_PAGES = 8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_ENDS = frozenset(".!?:;…\"'”»")


class Node:
    __slots__ = ("tag", "parent", "names", "label", "parts", "linked")

    def __init__(self, tag: str, parent: int, names: tuple[tuple[str, bool], ...] = (), label: int = -1):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.parts: list[str] = []
        self.linked = 0


def parse(page: str) -> list[Node]:
    """Block elements and text leaves (tag "") in page order; a parent comes before its children.

    Takes time in proportion to the page: where the open elements of each tag are is kept.
    """
    nodes = [Node("html", -1)]
    stack, leaf, links, at, in_head = [0], None, 0, 0, False
    places: dict[str, list[int]] = defaultdict(list)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[nodes[stack.pop()].tag].pop()

    def innermost(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def text(raw: str) -> None:
        nonlocal leaf
        if in_head or not raw:
            return
        if leaf is None:
            if raw.isspace():
                return
            leaf = Node("", stack[-1], (), nodes[stack[-1]].label)
            nodes.append(leaf)
        raw = entities.unescape(raw)
        leaf.parts.append(raw)
        if links:
            leaf.linked += len(raw)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1])
        if tag in RAW and not closing:
            if tag not in FOREIGN or not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "head":
            in_head = not closing
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in VOID_BREAKS:
            if tag == "hr":
                leaf = None
            else:
                text(" ")
        elif tag in BLOCKS:
            leaf, links = None, 0
            if not closing:
                in_head = False
                if tag == "html":
                    continue
                ends, bound = ENDS.get(tag, (frozenset(), frozenset()))
                while nodes[stack[-1]].tag == "p":
                    cut(len(stack) - 1)
                last = innermost(ends)
                if last > innermost(bound):
                    cut(last)
                names, label = [], nodes[stack[-1]].label
                for a in _ATTRIBUTE.finditer(m[3]):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "data-y":
                        label = int(value == "1")
                    else:
                        for name in value.split():
                            words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
                            # a word of a name of many words says less than one that stands by itself
                            names += [(w, len(words) < 3) for w in words]
                nodes.append(Node(tag, stack[-1], tuple(dict.fromkeys(names)), label))
                places[tag].append(len(stack))
                stack.append(len(nodes) - 1)
            elif places[tag]:
                cut(places[tag][-1])
    return nodes


def _share(part: int, whole: int) -> int:
    """A share in four grades."""
    x = part / max(1, whole)
    return 0 if x < 0.05 else 1 if x < 0.3 else 2 if x < 0.75 else 3


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features of each node that hold: its tag and names; how long, how linked and how much like sentences
    its text and that of all below it are; a container's share of the page's text; the leaves beside a leaf."""
    out: list[list[str]] = []
    bare = all(n.tag in PLAIN for n in nodes)
    n_nodes = len(nodes)
    texts = [_SPACE.sub(" ", "".join(n.parts)).strip() if not n.tag else "" for n in nodes]
    chars, linked, ended, leaves = ([0] * n_nodes for _ in range(4))
    for i in range(n_nodes - 1, -1, -1):
        if not nodes[i].tag:
            chars[i], linked[i], leaves[i] = len(texts[i]), min(nodes[i].linked, len(texts[i])), 1
            ended[i] = int(texts[i][-1:] in _ENDS and chars[i] > 20)
        if (up := nodes[i].parent) >= 0:
            for held in (chars, linked, ended, leaves):
                held[up] += held[i]
    # how much plain text each container holds itself, and the most that one holds: where a page's text mostly is
    holder, own = list(range(n_nodes)), [0] * n_nodes
    for i, n in enumerate(nodes):
        if n.parent >= 0 and (not n.tag or KINDS.get(n.tag, OTHER_KIND) < CONTAINERS):
            holder[i] = holder[n.parent]
        if not n.tag:
            own[holder[i]] += chars[i] - linked[i]
    most = max(1, max(own))
    place = [0 if 5 * x < most else 1 if x < most else 2 for x in own]
    whole, last = max(1, chars[0]), ""
    for i, n in enumerate(nodes):
        size = 0 if chars[i] < 25 else 1 if chars[i] < 120 else 2 if chars[i] < 400 else 3
        grade = f"{_share(linked[i], chars[i])}{min(2, ended[i])}{size}"
        if n.tag:
            kind = KINDS.get(n.tag, OTHER_KIND)
            got = ["t:" + n.tag, *(("n:" if few else "m:") + w for w, few in n.names), "named" if n.names else "plain"]
            if kind >= CONTAINERS:  # a long article has many paragraphs, of which each says little: what is below them is told by their leaves
                got += [f"b:{grade}", f"p:{_share(chars[i], whole)}", f"k:{kind}:{_share(linked[i], chars[i])}{_share(chars[i], whole)}"]
            if n.parent >= 0 and nodes[n.parent].tag in ("html", "body"):
                got.append(f"top:{n.tag}:{bare}")
            out.append(got)
            continue
        up = n.parent
        s = texts[i]
        got = ["leaf", f"where:{place[holder[i]]}", f"in:{nodes[up].tag}:{bare and nodes[up].tag in ('html', 'body')}", f"len:{min(7, int(math.log2(chars[i] + 1)))}" if chars[i] < 256 else "len:long"]
        got.append(f"link:{_share(linked[i], chars[i])}")
        got += [f"l:{grade}", f"up:{_share(linked[up], chars[up])}{min(2, ended[up])}"]
        if last:
            got.append(f"after:{last}")
        if s[-1:] in _ENDS:
            got.append("sentence")
        if "©" in s or "all rights reserved" in s.lower():
            got.append("copyright")
        last = f"{_share(linked[i], chars[i])}{min(3, chars[i] // 40)}"
        out.append(got)
    following = ""
    for i in range(n_nodes - 1, -1, -1):
        if not nodes[i].tag:
            if following:
                out[i].append(f"before:{following}")
            following = f"{_share(linked[i], chars[i])}{min(3, chars[i] // 40)}"
    return out


class Model:
    """weights of node features; edge[kind][parent label][child label]: log potentials."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(N_KINDS)]

    def infer(self, nodes: list[Node], feats: list[list[str]]) -> tuple[list[float], list[float], list[float], list[list[list[float]]]]:
        """Sum-product in log odds: marginal of each node, its upward belief, the parent's odds without it, edge tables."""
        get, n = self.weights.get, len(nodes)
        psi = [[[math.exp(x) for x in r] for r in e] for e in self.edge]
        kind = [psi[KINDS.get(x.tag, OTHER_KIND)] for x in nodes]
        up = [sum(get(f, 0.0) for f in fs) for fs in feats]
        message = [0.0] * n
        for i in range(n - 1, 0, -1):
            e, p = math.exp(max(-30.0, min(30.0, up[i]))), kind[i]
            message[i] = math.log((p[1][0] + p[1][1] * e) / (p[0][0] + p[0][1] * e))
            up[nodes[i].parent] += message[i]
        odds, rest = up[:], [0.0] * n
        for i in range(1, n):
            rest[i] = max(-30.0, min(30.0, odds[nodes[i].parent] - message[i]))
            e, p = math.exp(rest[i]), kind[i]
            odds[i] += math.log((p[0][1] + p[1][1] * e) / (p[0][0] + p[1][0] * e))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds], up, rest, kind

    def extract(self, page: str) -> str:
        """The main text of a page."""
        nodes = parse(page)
        marginal = self.infer(nodes, features(nodes))[0]
        blocks = (_SPACE.sub(" ", "".join(n.parts)).strip() for n, m in zip(nodes, marginal) if not n.tag and m >= 0.5)
        return "\n".join(b for b in blocks if b)


def labelled_pages(count: int, seed: int = 20240607) -> list[str]:
    """Pages from varied templates; data-y says of each element whether it is content.

    Names are no more than a hint: on some pages there are none, on some they are made up, and now and
    then content has a name of several words with one in it that elsewhere stands for something else.
    """
    rng = random.Random(seed)
    pick_ = rng.choice
    naming = ["told"]

    def words(low: int, high: int) -> str:
        w = ["".join(pick_("aeiounrstlmdéüñ") for _ in range(rng.randint(1, 11))) for _ in range(rng.randint(low, high))]
        return " ".join(w).capitalize()

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 14) + pick_((".", ".", ".", "!", "?", "&hellip;", "")) for _ in range(rng.randint(low, high)))

    def made_up() -> str:
        return pick_((lambda: "".join(pick_("bcdfgkxz") for _ in range(rng.randint(2, 6))), lambda: f"css-{rng.randint(100, 999)}x", lambda: f"{pick_(('col', 'row', 'box', 'cell', 'grid'))}-{rng.randint(1, 12)}"))()

    def element(tag: str, y: int, inner: str, name: str = "") -> str:
        holds = tag in ("div", "section", "article", "main")
        if naming[0] == "none" or (naming[0] == "clutter" and y):
            name = ""
        elif naming[0] == "made up":
            name = made_up() if name or (y and holds and rng.random() < 0.6) else ""
        elif y and rng.random() < 0.25:
            name = pick_(("", made_up())) if holds else ""
        elif y and naming[0] == "told" and rng.random() < 0.04:
            name = "-".join(rng.sample(("side", "by", "two", "top", "nav", "ad", "menu", "footer", "header", "comment", "notice", "promo", "with", "no", "main"), 3))
        how = pick_(("class", "class", "id")) if name else ""
        return f'<{tag} data-y="{y}"' + (f' {how}="{name}"' if name else "") + f">{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>")

    def links(y: int, n: int) -> str:
        return element("ul", y, "".join(element("li", y, f'<a href="/x">{words(1, 3)}</a>') for _ in range(n)))

    def paragraph(y: int, tag: str = "p") -> str:
        s = sentences(1, pick_((1, 1, 3, 8))) if rng.random() < 0.85 else "".join(pick_("aeiounrstlm1") for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.2:
            s = f"<b>{s}" + pick_(("</b>", "<br>", ""))
        elif rng.random() < 0.2:
            s += f' <a href="/y">{words(1, 4)}</a> {sentences(1, 1)}'
        elif rng.random() < 0.06:
            s = f'<a href="/y">{s}</a>'
        return element(tag, y, s)

    def junk(kind: str) -> str:
        short = lambda: element("p", 0, sentences(1, 2))
        text = pick_((lambda: sentences(1, 2), lambda: sentences(1, 2), short, short, lambda: short() + short(), lambda: paragraph(0)))()
        if kind == "menu" and rng.random() < 0.25:  # links without a list
            return element(pick_(("div", "p", "nav")), 0, pick_((" ", "<br>", " | ")).join(f'<a href="/x">{words(1, 2)}</a>' for _ in range(rng.randint(2, 7))), pick_(("", "menu", "topnav", "links")))
        if kind == "menu":
            return element(pick_(("nav", "nav", "div", "ul")), 0, links(0, rng.randint(2, 8)), pick_(("", "menu", "nav", "navbar", "navigation", "breadcrumb", "topnav", "main menu")))
        if kind == "header":
            return element(pick_(("header", "header", "div")), 0, element(pick_(("h1", "div", "p", "a")), 0, words(1, 4)) + pick_(("", links(0, 3))), pick_(("header", "site header", "masthead", "banner", "page header", "top bar")))
        if kind == "footer":
            return element(pick_(("footer", "footer", "div")), 0, pick_(("&copy; x.example.net &middot; ", "", "Copyright 2020 ")) + text + pick_(("", links(0, 3))), pick_(("footer", "site footer", "bottom", "legal", "copyright", "")) or "footer")
        if kind == "sidebar":
            return element(pick_(("aside", "aside", "div", "section")), 0, pick_(("", element("h3", 0, words(1, 4)))) + pick_((links(0, 5), text)), pick_(("sidebar", "side", "related", "widget", "recommended", "more", "newsletter", "social share", "tags", "author bio")))
        if kind == "notice":
            if rng.random() < 0.1:
                return element("noscript", 0, text)
            return element(pick_(("div", "div", "section", "p", "dialog")), 0, text + pick_(("", "<button>Ok</button>")), pick_(("cookie notice", "notice", "consent", "banner notice", "gdpr", "alert", "popup", "modal", "cookies", "paywall")))
        if kind == "advert":
            return element(pick_(("div", "div", "aside", "section", "p")), 0, text, pick_(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad banner", "adsense")))
        if kind == "form":
            return element("form", 0, element("label", 0, words(1, 3)) + "<input type=text>" + pick_(("", element("p", 0, sentences(1, 2)))) + f"<button>{words(1, 2)}</button>", pick_(("", "search", "login", "subscribe", "contact")))
        one = lambda: element(*pick_((("div", 0), ("li", 0), ("p", 0))), pick_(("", element("span", 0, words(1, 2)))) + text, pick_(("comment", "comment body", "reply", "")))
        if rng.random() < 0.25:
            one = lambda: element("article", 0, text, pick_(("comment", "comment body", "user comment")))
        return element(pick_(("section", "div", "ol", "aside")), 0, pick_(("", element(pick_(("h2", "h3")), 0, words(1, 3)))) + "".join(one() for _ in range(rng.randint(1, 4))), pick_(("comments", "comment list", "reader comments", "responses", "discussion", "disqus thread")))

    def article() -> str:
        inner = [element(pick_(("h1", "h1", "h2")), 1, words(2, 9))] if rng.random() < 0.85 else []
        usual = "div" if rng.random() < 0.12 else "p"
        for _ in range(pick_((rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9), rng.randint(10, 60)))):
            r = rng.random()
            if r < 0.7:
                inner.append(paragraph(1, usual))
            elif r < 0.75:
                inner.append(element(pick_(("h2", "h3")), 1, words(1, 6)))
            elif r < 0.8:
                inner.append(element(pick_(("ul", "ol")), 1, "".join(element("li", 1, words(1, 12)) for _ in range(rng.randint(2, 5)))))
            elif r < 0.82:  # links that belong to the article
                inner.append(paragraph(1, usual) + links(1, rng.randint(2, 4)) + paragraph(1, usual))
            elif r < 0.86:
                inner.append(element("blockquote", 1, pick_((sentences(1, 3), paragraph(1)))))
            elif r < 0.88:
                inner.append(element("table", 1, "".join(element("tr", 1, element("td", 1, words(1, 4)) + element("td", 1, words(1, 4))) for _ in range(3))))
            elif r < 0.895:
                inner.append(element("pre", 1, words(2, 20)))
            elif r < 0.91:
                caption = element("figcaption", 1, pick_((words(2, 12), sentences(1, 2))))
                inner.append(element("figure", 1, pick_(('<img src="/i">' + caption, caption + '<img src="/i">', element("object", 1, words(2, 8)) + caption))))
            elif r < 0.92:
                inner.append(element(pick_(("p", "div")), 1, words(1, 6) + " <math><mi>x</mi><mo>=</mo><mn>2</mn></math> " + sentences(1, 1)))
            elif r < 0.95:  # a part of the article, whatever it is called
                part = "".join(paragraph(1, usual) for _ in range(rng.randint(1, 4)))
                inner.append(element(pick_(("section", "section", "div")), 1, pick_(("", element("h2", 1, words(1, 4)))) + part, pick_(("", "intro", "discussion", "results", "summary", "part", "chapter", "lead"))))
            else:
                inner.append(junk(pick_(("advert", "sidebar", "notice", "form"))))
        if rng.random() < 0.04:  # a list of verses, steps or the like
            inner += [element("p", 1, words(1, 4) + pick_((".", ""))) for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.04:  # right in the body, or in what holds the article and other things
            return "".join(inner)
        body = "".join(inner) + (junk("comments") if rng.random() < 0.15 else "")
        for _ in range(pick_((0, 0, 0, 0, 1, 1, 2))):  # plain wrappers, with the article alone or something beside it
            body = element("div", 1, body) + (junk(pick_(("sidebar", "advert"))) if rng.random() < 0.3 else "")
        r = rng.random()
        if r < (0.2 if naming[0] == "clutter" else 0.45):
            return element("article", 1, body, pick_(("", "", "post", "story", "hentry")))
        if r < 0.6:
            return element("main", 1, body, pick_(("", "content")))
        if r < 0.7:
            return element("div", 1, body)
        name = pick_(("content", "post", "entry content", "article body", "story", "main content", "text", "post body", "article"))
        return element(pick_(("div", "section")), 1, body, name)

    pages = []
    for i in range(count):
        naming[0] = pick_(("told", "told", "clutter", "none", "made up"))
        if i % 25 == 0:  # a fragment without any page around it
            pages.append(article() if i % 50 else "".join(paragraph(1) for _ in range(rng.randint(1, 4))) if i % 100 else f'<div data-y="1">{sentences(1, 4)}</div>')
            continue
        some = lambda kinds, p: "".join(junk(k) for k in kinds if rng.random() < p)
        middle = article()
        if rng.random() < 0.25:  # little else than the article
            beside = "".join(junk(k) for k in ("sidebar", "menu", "footer") if rng.random() < 0.3)
            pages.append(f"<html><body data-y=0>{pick_((middle + beside, element('div', 0, middle + beside), element('div', 1, middle) + beside, element('div', 1, middle) + beside))}</body></html>")
            continue
        if rng.random() < 0.1:  # laid out in a table
            cells = [element("td", 0, pick_((junk("menu"), links(0, rng.randint(2, 6)), "".join(f'<a href="/x">{words(1, 2)}</a><br>' for _ in range(rng.randint(1, 6)))))), element("td", 1, middle)]
            middle = element("table", 0, element("tr", 0, "".join(cells)))
        elif rng.random() < 0.4:
            middle = element(pick_(("div", "main", "div")), 0, some(("sidebar", "advert"), 0.3) + middle + some(("sidebar", "comments", "form"), 0.4), pick_(("wrapper", "container", "page", "layout", "")))
        before = some(rng.sample(("header", "menu", "notice", "advert", "form"), 5), 0.5)
        after = some(rng.sample(("comments", "sidebar", "advert", "form", "notice"), 5), 0.3) + (junk("footer") if rng.random() < 0.8 else "")
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body data-y=0>{before}{middle}{after}" + pick_(("</body></html>", "")))
    return pages


@lru_cache(maxsize=2)
def trained(pages: int = 1800, epochs: int = 7, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """The model fitted to ``pages`` labelled pages, the same in every process."""
    model, squares = Model(), {}
    edge_squares = [[[1e-6] * 2 for _ in range(2)] for _ in range(N_KINDS)]
    data = [(nodes := parse(p), features(nodes)) for p in labelled_pages(pages)]
    seen = Counter(f for _, feats in data for f in set(chain.from_iterable(feats)))
    data = [(nodes, [[f for f in fs if seen[f] >= LEAST_PAGES] for fs in feats]) for nodes, feats in data]
    order, mean = random.Random(1), defaultdict(float)
    edge_mean = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(N_KINDS)]
    for epoch in range(epochs):
        order.shuffle(data)
        for nodes, feats in data:
            marginal, up, rest, psi = model.infer(nodes, feats)
            for i, node in enumerate(nodes):
                y = max(0, node.label)
                g = y - marginal[i]
                if abs(g) > 1e-4:
                    for f in feats[i]:
                        w = model.weights.get(f, 0.0)
                        d = g - penalty * w
                        squares[f] = squares.get(f, 1e-6) + d * d
                        model.weights[f] = w + rate * d / math.sqrt(squares[f])
                if i:
                    k, yp = KINDS.get(node.tag, OTHER_KIND), max(0, nodes[node.parent].label)
                    e1, e2 = math.exp(rest[i]), math.exp(max(-30.0, min(30.0, up[i])))
                    t = [[psi[i][0][0], psi[i][0][1] * e2], [psi[i][1][0] * e1, psi[i][1][1] * e1 * e2]]
                    total = t[0][0] + t[0][1] + t[1][0] + t[1][1]
                    for a in (0, 1):
                        for b in (0, 1):
                            d = (a == yp and b == y) - t[a][b] / total - penalty * model.edge[k][a][b]
                            edge_squares[k][a][b] += d * d
                            model.edge[k][a][b] += rate * d / math.sqrt(edge_squares[k][a][b])
        if epoch >= epochs // 2:  # the result is the mean of the later epochs
            for f, w in model.weights.items():
                mean[f] += w / (epochs - epochs // 2)
            for e, m in zip(model.edge, edge_mean):
                for a in (0, 1):
                    for b in (0, 1):
                        m[a][b] += e[a][b] / (epochs - epochs // 2)
    model.weights, model.edge = dict(mean), edge_mean
    return model


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, pages in slices(batch, "html"):
                texts = [model.extract(p.decode("utf-8", "replace")) if p else "" for p in pages]
                keep = [batch.column(c).slice(start, len(pages)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text."""
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("binary"))
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")) + ", text string"
    return rows.mapInArrow(_extract(model or trained()), schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
