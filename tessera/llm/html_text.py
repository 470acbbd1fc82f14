"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is read once into its leaf blocks: stretches of text that no block element interrupts, in page order,
each with its ancestors' tags, class and id words and a few measures of its text. The field labels the blocks
as main text or not, is trained on labelled pages on the driver, and is decoded by Viterbi, page by page, in
a map without a shuffle. The weights that go along are a few hundred numbers.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+)(?:>|(\Z))", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: References to numbers beyond all code points, of more digits than the standard decoder has to read.
_HUGE = re.compile(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no text of the page.
_RAW = frozenset("script style template noscript iframe svg canvas object audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: A start tag closes an open element of these, up to the nearest of the walls.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Above:
    """The features of an open element and its ancestors: those it adds to its parent's, and the nearest block
    element. A page's elements share their ancestors, so depth costs nothing."""

    __slots__ = ("near", "own", "parent")

    def __init__(self, parent: Above | None, near: str, own: tuple[str, ...]):
        self.parent, self.near, self.own = parent, near, own

    def __iter__(self) -> Iterator[str]:
        chain, at = [], self
        while at:
            chain.append(at.own)
            at = at.parent
        yield from ("bias", self.near)
        for own in reversed(chain):
            yield from own


@dataclass
class Block:
    text: str
    #: What the block's elements say, and what its text does.
    above: Above | tuple[str, ...]
    measures: list[str]

    @property
    def features(self) -> list[str]:
        return [*self.above, *self.measures]


def _own(tag: str, attributes: str) -> list[str]:
    out = ["in:" + tag]
    if attributes:
        for kind, a, b, c in _NAMED.findall(attributes):
            out += [f"{'role' if kind.lower() == 'role' else 'name'}:{w.lower()}" for w in _WORD.findall(a or b or c)]
    return out


def _measures(text: str, linked: int) -> list[str]:
    n = len(text)
    out = [f"length:{min(6, n.bit_length() // 2)}", f"links:{min(3, 4 * linked // max(1, n))}"]
    if text[-1] in ".!?…:;\"'»”":
        out.append("sentence")
    if "©" in text or "|" in text:
        out.append("mark")
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page; never fails, whatever the markup, and takes time in proportion to its length.

    As in browsers, a tag that the page ends in is dropped, an end tag without its start is passed over, and one of an
    inline element reaches no further than the nearest block element.
    """
    out: list[Block] = []
    stack: list[tuple[str, Above]] = [("", Above(None, "at:", ()))]
    #: Where in the stack the open elements of each name are, and the open block elements.
    where: dict[str, list[int]] = defaultdict(list)
    solid = [0]
    #: The features that the open elements have added.
    seen: set[str] = set()
    parts: list[str] = []
    linked = 0
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1], _measures(text, linked)))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(_HUGE.sub("\ufffd", raw)) if "&" in raw else raw
            parts.append(text)
            if where["a"]:
                linked += len(text)

    def last(names: Iterable[str]) -> int:
        """The highest place in the stack of an element of these names, 0 if none is open."""
        return max((where[n][-1] for n in names if where[n]), default=0)

    def pop(to: int) -> None:
        for tag, above in stack[to:]:
            where[tag].pop()
            seen.difference_update(above.own)
        del stack[to:]
        while solid[-1] >= to:
            solid.pop()

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] is not None:
            continue
        block = tag not in _INLINE
        if m[1]:
            if block:
                close()
            found = last((tag,))
            if found and (block or found > solid[-1]):
                pop(found)
            continue
        if block:
            close()
            if tag in _CLOSES:
                ends, walls = _CLOSES[tag]
                found = last(ends)
                if found > last(walls):
                    pop(found)
            elif tag != "br" and stack[solid[-1]][0] == "p":
                pop(solid[-1])
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        above = stack[-1][1]
        own = tuple(x for x in _own(tag, m[3]) if x not in seen)
        seen.update(own)
        where[tag].append(len(stack))
        if block:
            solid.append(len(stack))
        stack.append((tag, Above(above, "at:" + tag if block else above.near, own)))
    close()
    return out


# --- the field -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Scores of label 1 over label 0: a weight a feature, ``step[a][b]`` from label a to b, and the start's."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: float

    def emissions(self, page: list[Block]) -> list[float]:
        w, out = self.weights, []
        known: dict[Above | None, float] = {None: w.get("bias", 0.0)}

        def of(above: Above | tuple[str, ...]) -> float:
            if isinstance(above, tuple):
                return sum([w.get(f, 0.0) for f in above])
            chain, at = [], above
            while at not in known:
                chain.append(at)
                at = at.parent
            for x in reversed(chain):
                known[x] = known[x.parent] + sum([w.get(f, 0.0) for f in x.own])
            return known[above] + w.get(above.near, 0.0)

        for b in page:
            out.append(of(b.above) + sum([w.get(f, 0.0) for f in b.measures]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the most likely labels; 0 where both are equal."""
        if not page:
            return []
        e, (s0, s1) = self.emissions(page), self.step
        best, back = (0.0, self.start + e[0]), []
        for x in e[1:]:
            a, b = best[0] + s0[0], best[1] + s1[0]
            c, d = best[0] + s0[1] + x, best[1] + s1[1] + x
            back.append((int(b > a), int(d > c)))
            best = (max(a, b), max(c, d))
        label = int(best[1] > best[0])
        out = [label]
        for ways in reversed(back):
            label = ways[label]
            out.append(label)
        return out[::-1]


def _add(a: float, b: float) -> float:
    hi, lo = max(a, b), min(a, b)
    return hi + math.log1p(math.exp(lo - hi))


def _expected(e: list[float], step, start: float) -> tuple[list[float], np.ndarray]:
    """The probability of label 1 of each block, and the expected number of each step."""
    (s00, s01), (s10, s11) = step
    f = [(0.0, start + e[0])]
    for x in e[1:]:
        a, b = f[-1]
        f.append((_add(a + s00, b + s10), _add(a + s01, b + s11) + x))
    z = _add(*f[-1])
    b0 = b1 = 0.0
    one, steps = [0.0] * len(e), np.zeros((2, 2))
    one[-1] = math.exp(f[-1][1] - z)
    for i in range(len(e) - 1, 0, -1):
        p, q = f[i - 1]
        x = e[i]
        steps += np.exp([[p + s00 + b0 - z, p + s01 + x + b1 - z], [q + s10 + b0 - z, q + s11 + x + b1 - z]])
        b0, b1 = _add(s00 + b0, s01 + x + b1), _add(s10 + b0, s11 + x + b1)
        one[i - 1] = math.exp(q + b1 - z)
    return one, steps


def train(pages: Iterable[tuple[list[Block], list[int]]], epochs: int = 20, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by AdaGrad over the pages in order, with weight decay; deterministic."""
    pages = [(b, y) for b, y in pages if b]
    names = sorted({f for b, _ in pages for x in b for f in x.features})
    index = {f: i for i, f in enumerate(names)}
    coded = [([np.array([index[f] for f in x.features]) for x in b], y) for b, y in pages]
    w, g = np.zeros(len(names) + 5), np.full(len(names) + 5, 1e-6)
    k = len(names)
    for _ in range(epochs):
        for rows, y in coded:
            step = ((w[k], w[k + 1]), (w[k + 2], w[k + 3]))
            one, steps = _expected([float(w[r].sum()) for r in rows], step, float(w[k + 4]))
            grad = np.zeros(len(w))
            for r, p, label in zip(rows, one, y, strict=True):
                grad[r] += p - label
            for a, b in zip(y, y[1:], strict=False):
                steps[a][b] -= 1
            grad[k : k + 4], grad[k + 4] = steps.ravel(), one[0] - y[0]
            grad += decay * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
    return Field({f: float(w[i]) for f, i in index.items()}, ((float(w[k]), float(w[k + 1])), (float(w[k + 2]), float(w[k + 3]))), float(w[k + 4]))


#: How sites mark what is no main text: (element, class or id).
_ASIDE = (
    ("nav", ""), ("nav", "main-menu"), ("div", "menu"), ("ul", "breadcrumb"), ("div", "navbar navigation"), ("header", ""), ("header", "site-header"), ("div", "header masthead"), ("div", "topbar"),
    ("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright legal"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "related-posts"), ("div", "recommended"),
    ("div", "cookie-notice"), ("div", "consent banner"), ("section", "notice alert"), ("div", "popup modal"), ("div", "ad"), ("div", "ads advert"), ("div", "advertisement sponsored"), ("div", "banner promo"),
    ("form", ""), ("form", "search"), ("div", "newsletter subscribe signup"), ("div", "login"), ("div", "share social"), ("div", "tags meta"), ("div", "pagination pager"),
    ("section", "comments"), ("div", "comment-list"), ("ol", "commentlist replies"), ("div", "reader-comments disqus"),
)
_MAIN = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content post"), ("section", "story text"), ("div", "main-content"))
_SYLLABLES = "ba de ki lo mu na per ro sta ti un ver wo ya zen".split()


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """``n`` made-up pages, and which of their leaf blocks are main text: an article under one of the usual
    containers, and menus, headers, footers, sidebars, notices, adverts, forms and comments around and in it."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(k: int) -> str:
        return " ".join(words(3, 18).capitalize() + "." for _ in range(rng.randint(1, k)))

    def opened(tag: str, names: str) -> str:
        return f'<{tag} {rng.choice(("class", "id"))}="{names}">' if names else f"<{tag}>"

    def aside(labels: list[int]) -> str:
        tag, names = rng.choice(_ASIDE)
        k = rng.randint(1, 5)
        labels += [0] * k
        kind = rng.randrange(4)
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{words(1, 12)}</li>" for _ in range(k))
        elif kind == 0:
            inner = "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"
        elif kind == 1:
            inner = "".join(f"<p>{sentences(3)}</p>" for _ in range(k))
        elif kind == 2:
            inner = "".join(f"<div><span>{words(1, 8)}</span></div>" for _ in range(k))
        else:
            inner = words(2, 20) + "".join(f"<p>{sentences(2)}</p>" for _ in range(k - 1))
        return opened(tag, names) + inner + f"</{tag}>"

    def body(labels: list[int]) -> str:
        out = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.randrange(14)
            k = 1
            if kind < 7:
                piece = f"<p>{sentences(6)}</p>"
            elif kind == 7:
                piece = f"<h2>{words(1, 6)}</h2>"
            elif kind == 8:
                k = rng.randint(1, 4)
                piece = "<ul>" + "".join(f"<li>{words(1, 10)}</li>" for _ in range(k)) + "</ul>"
            elif kind == 9:
                piece, k = f"<p><b>{words(1, 6)}<br><p>{sentences(2)}</p>", 2
            elif kind == 10:
                piece = rng.choice((f"<blockquote>{sentences(2)}</blockquote>", f"<pre>{words(2, 9)}</pre>", f'<p><a href="/y">{words(2, 8)}</a> {words(1, 4)}.</p>', f"<p>{words(1, 3)}</p>"))
            elif kind > 11:
                piece, k = aside(labels), 0
            else:
                k = rng.randint(2, 4)
                piece = "<table><tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(k)) + "</tr></table>"
            labels += [1] * k
            out.append(piece)
        return "".join(out)

    pages = []
    for _ in range(n):
        labels: list[int] = []
        head = ""
        if rng.random() < 0.9:
            head, labels = f"<head><title>{words(2, 8)}</title><style>p{{}}</style></head>", [0]
        before = "".join(aside(labels) for _ in range(rng.randint(0, 3)))
        tag, names = rng.choice(_MAIN)
        title = ""
        if rng.random() < 0.8:
            title = f"<h1>{words(2, 10)}</h1>"
            labels.append(1)
        main = opened(tag, names) + title + body(labels)
        main += "" if rng.random() < 0.3 else aside(labels) if rng.random() < 0.3 else ""
        after = "".join(aside(labels) for _ in range(rng.randint(0, 3)))
        wrap = rng.choice(("", "div", "section"))
        page = before + main + f"</{tag}>" + after
        pages.append((f"<html>{head}<body>" + (f"<{wrap}>{page}</{wrap}>" if wrap else page) + "</body></html>", labels))
    return pages


@cache
def field() -> Field:
    """The default field, trained once a process on the labelled pages."""
    read = [(blocks(page), labels) for page, labels in labelled_pages()]
    return train((b, y) for b, y in read if len(b) == len(y))


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, label in zip(found, model.decode(found), strict=True) if label)


def extract(pages: DataFrame, html: str = "html", into: str = "main_text", model: Field | None = None) -> DataFrame:
    """``pages`` with a column ``into`` (replaced if there): the main blocks of the whole page, references
    decoded and white space inside a block as one space, joined by a space; empty for null, empty or markup
    without text. Repeated rows are read each; other columns pass through."""
    model = model or field()

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return page.map(lambda x: main_text(x, model))

    return pages.withColumn(into, text(F.coalesce(F.col(f"`{html}`"), F.lit(""))))
