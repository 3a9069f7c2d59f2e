"""Main text of web pages: boosted trees over the nodes of the document tree, decoded along the tree.

A tolerant parser makes a tree of block elements from any markup. Each node is described by its subtree (text, links,
paragraphs, density), the words of its tag, class, id and role, its depth and position, and how it compares with its
siblings. Boosted trees give the odds that it belongs to the article. A node that is left out takes all below it with it;
among all such choices the one with the greatest total odds is found from the leaves up, so that no node contradicts an
ancestor. The trees are fitted on made-up pages, whose parts are known because they were made as such.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import no_cache, slices, table, trim

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+")
# Elements by what a parser does with them.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hr".split())
#: Of the silent ones the content is no text of the page: scripts, styles, markup that shows nothing or another page, drawings
#: and controls of forms. All other elements, ``math``, ``object``, ``noscript`` and media among them, give their text.
SILENT = frozenset("script style head title template iframe svg select button textarea".split())
#: Of these the content is plain characters, which run to the end tag or to the end of the page.
RAW = frozenset("script style textarea title".split())
#: Silent elements of another language, in which ``/>`` ends an element.
FOREIGN = frozenset(("svg",))
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot"}
SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words in class, id and role attributes that tell a part of a page.
GOOD = frozenset("article articles content main post entry story body text page blog prose hentry single".split())
BAD = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toolbar toc",
    "head": "header masthead banner topbar logo branding search",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside rail widget widgets related recommended popular trending recent tags complementary",
    "notice": "notice alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup disclaimer warning message",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promoted promotion adsense dfp outbrain",
    "form": "form login register contact input search",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader",
    "share": "share sharing social follow facebook twitter",
}
_BAD = {w: k for k, line in enumerate(BAD.values()) for w in line.split()}
TAGS = {t: k for k, t in enumerate("root body main article section div p h ul ol li table tr td blockquote pre figure header footer nav aside form address details".split())}
DOCUMENT_TAG = TAGS["root"]


@lru_cache(len(SILENT))
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


@lru_cache(len(SILENT))
def _start_tag(name: str) -> re.Pattern:
    return re.compile(rf"<{name}(?=[\s/>])", re.I)


def _after_silent(markup: str, name: str, attributes: str, at: int, endless: set[str]) -> int:
    """Where a page goes on after the start tag of a silent element that ends at ``at``.

    A head may leave out its end tag: its own tags are read one by one, silent ones among them, and anything else ends it.
    Elements without an end tag lose their tag only, except for those whose content is plain characters; so do elements
    that ``/>`` ends. ``endless`` holds the names that have no end tag in the rest of the page.
    """
    closed = attributes.rstrip().endswith("/")
    if name == "head" or closed and name in FOREIGN:
        return at
    end = None if name in endless else _end_tag(name).search(markup, at)
    if end is None:
        endless.add(name)
        return len(markup) if name in RAW else at
    if closed and name not in RAW and _start_tag(name).search(markup, at, end.start()):
        return at  # the end tag is that of the next element of this name
    return end.end()


class Page:
    """Nodes in page order (a parent before its children) and text blocks with the node that holds them."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.words, self.depth = ["root"], [-1], [()], [0]
        self.owner, self.text, self.links = [], [], []
        self.inside = [0]
        stack: list[tuple[str, int]] = [("root", 0)]
        pieces: list[str] = []
        linked, at, anchor = 0, 0, 0
        endless: set[str] = set()

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.owner.append(stack[-1][1])
                    self.text.append(text)
                    self.links.append(linked)
            pieces.clear()
            linked = 0

        def close(to: int):
            flush()
            del stack[to:]

        while m := _TAG.search(markup, at):
            if m.start() > at:
                piece = _html.unescape(markup[at : m.start()])
                pieces.append(piece)
                linked += len(piece) if anchor else 0
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if not m[1]:
                if name in SILENT:
                    at = _after_silent(markup, name, m[3], at, endless)
                    continue
                if name == "br":
                    pieces.append(" ")
                elif name == "a":
                    anchor = 1
                if name not in BLOCKS:
                    continue
                flush()
                if name in CLOSES_P and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in SAME:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in SAME[name]:
                            break
                        if stack[k][0] == name or name in ("dt", "dd") and stack[k][0] in ("dt", "dd") or name in ("td", "th") and stack[k][0] in ("td", "th"):
                            close(k)
                            break
                if name in VOID or name == "html":
                    continue
                anchor = 0
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.depth.append(len(stack))
                named = " ".join(a or b or c for a, b, c in _NAMED.findall(m[3])) if m[3].strip() else ""
                self.words.append(tuple(w.lower() for w in _PART.findall(named)))
                stack.append((name, node))
            elif name == "a":
                anchor = 0
            elif name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                else:
                    flush()
        if at < len(markup):
            pieces.append(_html.unescape(markup[at:]))
        flush()

    def features(self) -> np.ndarray:
        """One row per node."""
        n = len(self.tag)
        parent = np.array(self.parent)
        chars, links, blocks, stops, commas, first = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf)
        at = 0
        for k, text, link in zip(self.owner, self.text, self.links, strict=True):
            chars[k] += len(text)
            links[k] += min(link, len(text))
            blocks[k] += 1
            stops[k] += text.count(". ") + (text[-1] in ".!?")
            commas[k] += text.count(",")
            first[k] = min(first[k], at)
            at += len(text)
        paragraphs = np.array([t == "p" for t in self.tag], float)
        items, nodes, children = np.array([t in ("li", "td") for t in self.tag], float), np.ones(n), np.zeros(n)
        sums = (chars, links, blocks, stops, commas, paragraphs, items, nodes)
        for k in range(n - 1, 0, -1):
            p = parent[k]
            for s in sums:
                s[p] += s[k]
            children[p] += 1
            first[p] = min(first[p], first[k])
        total = max(1.0, chars[0])
        siblings = np.where(parent >= 0, children[parent], 1)
        rank, seen, mates = np.zeros(n), {}, {}
        for k in range(1, n):
            p = self.parent[k]
            rank[k] = seen[p] = seen.get(p, -1) + 1
            mates[p, self.tag[k]] = mates.get((p, self.tag[k]), 0) + 1
        same = np.array([1.0, *[mates[self.parent[k], self.tag[k]] for k in range(1, n)]])
        kind = np.zeros((n, 2 + len(BAD)))
        above = np.zeros((n, 4))
        for k in range(n):
            for w in self.words[k]:
                kind[k, 0] += w in GOOD
                if w in _BAD:
                    kind[k, 1] += 1
                    kind[k, 2 + _BAD[w]] += 1
            tag = self.tag[k]
            own = (tag in ("article", "main"), tag in ("nav", "header", "footer", "aside", "form"), min(kind[k, 0], 1), min(kind[k, 1], 1))
            above[k] = np.maximum(above[self.parent[k]], own) if k else own
        share = chars / np.maximum(1, np.where(parent >= 0, chars[parent], total))
        code = np.array([TAGS.get("h" if len(t) == 2 and t[0] == "h" and t[1].isdigit() else t, len(TAGS)) for t in self.tag], float)
        main = np.array([t in ("article", "main") for t in self.tag], float)
        frame = np.array([t in ("nav", "header", "footer", "aside", "form") for t in self.tag], float)
        start = np.where(np.isfinite(first), first, 0) / total
        return np.column_stack([
            code, main, frame, np.array(self.depth), np.log1p(chars), links / np.maximum(1, chars), chars / nodes, chars / np.maximum(1, blocks), np.log1p(paragraphs), items / nodes,
            stops / np.maximum(1, blocks), commas / np.maximum(1, chars) * 100, children, siblings, rank / np.maximum(1, siblings), same / np.maximum(1, siblings), share, chars / total, start, kind, above,
        ])


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which nodes are in: the best total of odds under the rule that nothing below a node that is out is in."""
    n = len(page.tag)
    inside, outside = logit.copy(), -logit
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        inside[p] += max(inside[k], outside[k])
        outside[p] += outside[k]
    chosen = np.zeros(n, bool)
    chosen[0] = True
    for k in range(1, n):
        chosen[k] = chosen[page.parent[k]] and inside[k] >= outside[k]
    return chosen


def _made_page(rng: random.Random) -> str:
    """A made-up page. Elements that belong to no article carry the attribute ``x``."""
    w = lambda: "".join(rng.choice("etaoinshrdlucmfwé") for _ in range(rng.randint(1, 11)))
    pick = rng.choice

    def sentence(a=3, b=18):
        s = " ".join(w() + pick((",", "", "", "", "")) for _ in range(rng.randint(a, b)))
        return s.capitalize() + pick((".", ".", ".", "?", "!"))

    def prose(a=1, b=6):
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def items(n, link=True):
        return "".join(f'<li><a href="/{w()}">{w()}</a></li>' if link else f"<li>{sentence()}</li>" for _ in range(n))

    word = lambda kind: pick(BAD[kind].split())
    extra = lambda kind: f' {pick(("class", "id"))}="{pick(("", "", w() + "-", "site-"))}{word(kind)}{pick(("", "", "-" + w(), " " + w()))}"'

    def bad(kind):
        name = extra(kind)
        if kind == "menu":
            inner = pick((f"<ul>{items(rng.randint(2, 9))}</ul>", "".join(f'<a href="#">{w()}</a> ' for _ in range(rng.randint(2, 8)))))
            return pick((f"<nav x>{inner}</nav>", f"<nav x{name}>{inner}</nav>", f"<div x{name}>{inner}</div>", f"<ul x{name}>{items(rng.randint(2, 8))}</ul>"))
        if kind == "head":
            return pick((f"<header x><h1>{w()} {w()}</h1><p>{sentence()}</p></header>", f"<div x{name}><a href='/'>{w()}</a> {sentence(2, 6)}</div>", f"<header x{name}>{sentence(2, 9)}</header>"))
        if kind == "foot":
            return pick((f"<footer x>&copy; {w()}.{w()} &middot; {sentence()}</footer>", f"<footer x{name}><p>{prose(1, 2)}</p></footer>", f"<div x{name}>{sentence()} <a href='/t'>{w()}</a></div>"))
        if kind == "side":
            inner = f"<h3>{w()} {w()}</h3>" + pick((f"<ul>{items(rng.randint(2, 6))}</ul>", f"<p>{prose(1, 3)}</p>"))
            return pick((f"<aside x>{inner}</aside>", f"<aside x{name}>{inner}</aside>", f"<div x{name}>{inner}</div>"))
        if kind == "comment":
            one = lambda: pick((f"<li><b>{w()}</b><p>{prose(1, 3)}</p></li>", f'<div class="{word("comment")}"><p>{prose(1, 3)}</p></div>'))
            inner = f"<h3>{w()} {w()}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
            return pick((f"<div x{name}>{inner}</div>", f"<section x{name}>{inner}</section>", f"<ol x{name}>{inner}</ol>"))
        if kind == "form":
            return pick((f"<form x><p>{sentence(2, 7)}</p><label>{w()}</label><input></form>", f"<form x{name}>{sentence(2, 7)} {w()}</form>", f"<div x{name}><p>{sentence()}</p></div>"))
        inner = pick((prose(1, 2), f"<p>{prose(1, 2)}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>"))
        return pick((f"<div x{name}>{inner}</div>", f"<section x{name}>{inner}</section>", f"<p x{name}>{prose(1, 2)}</p>"))

    def good():
        parts = [f"<h1>{sentence(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(pick((1, 2, 3, 5, 8, 14))):
            parts.append(pick((
                f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{sentence(1, 4)}</p>", f"<p><b>{sentence()}<br>", f"<h2>{sentence(1, 6)}</h2>",
                f"<ul>{items(rng.randint(2, 6), False)}</ul>", f"<blockquote>{prose()}</blockquote>", f"<p>{prose(1, 2)} <a href='/{w()}'>{w()} {w()}</a> {sentence()}</p>", f"<table><tr><td>{w()}</td><td>{w()}</td></tr></table>", f"<pre>{w()} {w()}</pre>",
            )))
            if rng.random() < 0.08:
                parts.append(bad(pick(("advert", "share", "side", "notice"))))
        body = "".join(parts)
        name = f'{pick(("class", "id"))}="{pick(("", "", w() + "-"))}{pick(sorted(GOOD))}{pick(("", "", "-" + w()))}"'
        return pick((f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<div {name}>{body}</div>", f"<article {name}>{body}</article>", f"<main><article>{body}</article></main>", f"<div {name}><div>{body}</div></div>", f"<div>{body}</div>"))

    before = [bad(k) for k in ("head", "menu", "notice", "advert") if rng.random() < 0.6]
    after = [bad(k) for k in ("share", "comment", "side", "form", "advert", "foot") if rng.random() < 0.5]
    content = good()
    if rng.random() < 0.3:
        before, after = [pick((f"<div>{x}</div>", x)) if " x" not in x[:9] else x for x in before], after
        content = f"<div class='wrap'>{''.join(before)}{content}{''.join(after)}</div>"
        before, after = [], []
    return "<html><body>" + "".join([*before, content, *after]) + "</body></html>"


_MARK = re.compile(r"<[a-z0-9]+ x[ >]")


def _labels(markup: str, page: Page) -> np.ndarray:
    """1 for nodes that neither are marked nor lie below a marked one."""
    opened = [m.group(0) for m in _TAG.finditer(markup) if m[2] and not m[1] and m[2].lower() in BLOCKS and m[2].lower() not in VOID and m[2].lower() != "html"]
    out = np.ones(len(page.tag))
    for k, tag in enumerate(opened, 1):
        out[k] = 0 if _MARK.match(tag) or not out[page.parent[k]] else 1
    return out


@lru_cache(1)
def model(seed: int = 11, pages: int = 300) -> Boosted:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        markup = _made_page(rng)
        page = Page(markup)
        xs.append(page.features())
        ys.append(_labels(markup, page))
    return fit(np.concatenate(xs), np.concatenate(ys), trees=40, depth=4)


def main_texts(markups: list[str], trees: Boosted) -> list[str]:
    """Blocks of the nodes that are in, in page order, joined by line feeds."""
    pages = [Page(m) for m in markups]
    parts = [p.features() for p in pages]
    if not pages:
        return []
    logits = np.split(np.clip(trees.logit(np.concatenate(parts)), -6, 6), np.cumsum([len(x) for x in parts])[:-1])
    out = []
    for page, logit in zip(pages, logits, strict=True):
        chosen = decode(page, logit)
        out.append("\n".join(t for k, t in zip(page.owner, page.text, strict=True) if chosen[k]))
    return out


def main_text(html_col: Column) -> Column:
    """The main text of a column of pages.

    Defined results: null or empty pages and pages without an article give an empty text; text outside any element counts
    as the article's; an element without an end tag takes no more than its parent's rest, a silent one only its tag (unless
    its content is plain characters, which then run to the end); buttons and other controls are forms; pages of any length
    are read whole; pages are independent of each other, so that repeated rows get equal texts; an empty table stays empty.
    """
    trees = model()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        no_cache()
        try:
            for column in batches:
                yield pa.array([t for part in slices(column) for t in main_texts([x.decode() for x in part], trees)], pa.string())
        finally:
            trim()

    return run(html_col)


def query(spark, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
