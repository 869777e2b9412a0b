"""Operator 9: main text of web pages from flat text blocks.

A page is cut at block tags into flat blocks. Each block has its words and link density,
those of its neighbours, and the mark of the nearest telling container (article or main: 1;
navigation, footer, aside, form, or a name such as "ad" or "comments": -1; none: 0); an article
within comments or an aside stays other matter. A decision tree, grown from the small labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice

# Element and class names.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("iframe noframes noembed script style svg template textarea title".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
GOOD_TAG = frozenset(["article", "main"])
BAD_TAG = frozenset("nav footer aside form button select fieldset menu dialog head".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GOOD_NAME = frozenset("article articlebody post entry story maincontent articletext posttext postbody entrytext".split())
BAD_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion popup modal overlay cookie cookies consent gdpr notice notices notification "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars widget widgets footer masthead topbar toolbar skip share sharing social "
    "comment comments commentlist respond replies disqus newsletter subscribe subscription signup login pagination pager copyright imprint hidden".split()
)
#: Names of other matter even as a part of a longer name; other parts of such names can be layout around an article, which a main or article element in it then is.
FIRM_NAME = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr comments commentlist respond replies disqus newsletter popup modal hidden".split())
#: Parts that say that a page has something, not that an element is it.
ABOUT_LAYOUT = frozenset("has with no without layout page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    mark: int = 0
    heading: bool = False
    item: bool = False
    text: str = ""
    words: int = 0
    density: float = 0.0


#: Marks: main text, loosely or firmly other matter.
GOOD, LOOSE, FIRM = 1, -1, -2


def name_mark(own: str) -> int:
    """What one class or id tells of its element: FIRM or LOOSE other matter, GOOD, or 0.

    ``notice`` tells only as a whole name, and ``comment`` as one or at its beginning: a notice board or an editor's comment is text.
    """
    parts = PART.findall(own)
    if own.replace("-", "").replace("_", "") in GOOD_NAME:
        return GOOD
    bad = [p for i, p in enumerate(parts) if p in BAD_NAME and not (len(parts) > 1 and (p in ("notice", "notices") or (p == "comment" and i)))]
    if not bad or ABOUT_LAYOUT & set(parts):
        return 0
    return FIRM if len(parts) == 1 or parts[0] == "comment" or FIRM_NAME & set(bad) else LOOSE


def unseen(rest: str) -> bool:
    """Whether an element says of itself that it isn't shown."""
    return any(n.lower() == "hidden" or (n.lower() == "style" and "display:none" in v.replace(" ", "").lower()) for n, v in ATTRIBUTE.findall(rest))


def mark_of(tag: str, rest: str, within: int) -> int:
    """The mark of an element in a container of the mark ``within``: firm other matter holds nothing else, loose one can hold a main or article element."""
    if within == FIRM:
        return FIRM
    good = GOOD if tag in GOOD_TAG else 0
    if tag in BAD_TAG or (tag == "header" and within <= 0):
        return FIRM
    told = 0
    if rest and not rest.isspace() and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                if value in BAD_ROLE:
                    return FIRM
                good = good or int(value in ("main", "article"))
            elif (name == "aria-hidden" and value == "true") or unseen(rest):
                return FIRM
            elif name in ("class", "id"):
                for own in value.split():
                    mark = name_mark(own)
                    if mark == FIRM and not good:
                        return FIRM
                    told = told or mark
        # What an article is called besides doesn't make it another thing, but a comment that is one stays one.
        if good and any(name_mark(own) == FIRM for name, value in ATTRIBUTE.findall(rest) if name.lower() in ("class", "id") for own in value.strip("\"'").lower().split()):
            return FIRM
    if good:
        return GOOD
    return within if within == LOOSE or not told else told


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag; comments and declarations have no name.

    Whoever takes a tag may send the place from which to go on. Every byte is read a bounded number of
    times: a quote or bracket that isn't found once isn't looked for again.
    """
    at, quoting, bracket = 0, True, True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        found = NAME.match(page, start + 1)
        if found:
            end, here = -1, found.end()
            while quoting and bracket:
                stop = STOP.search(page, here)
                if stop and stop[0] == ">":
                    end = stop.start()
                    break
                here = page.find(stop[0], stop.end()) + 1 if stop else 0
                quoting = here > 0
            if end < 0 and bracket:
                end = page.find(">", found.end())
                bracket = end >= 0
            if end < 0:
                at = start + 1
                continue
            tag = (start, end + 1, bool(found[1]), found[2].lower(), page[found.end() : end])
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            tag = (start, end + 3 if end >= 0 else len(page), False, "", "")
        elif bracket and page[start + 1 : start + 2] in ("!", "?", "/"):
            end = page.find(">", start)
            bracket = end >= 0
            if end < 0:
                at = start + 1
                continue
            tag = (start, end + 1, False, "", "")
        else:
            at = start + 1
            continue
        at = (yield tag) or tag[1]


def blocks(page: str) -> list[Block]:
    """The page's flat blocks that hold text, in order."""
    found: list[Block] = []
    now = Block()
    stack: list[tuple[str, int]] = []  # name, mark of the nearest telling container
    opened: dict[str, int] = {}
    heading = item = spoilt = False
    anchors = deep = 0
    dark = ""  # the inline element that isn't shown, and how deep it is in others of its name

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                now.words = now.text.count(" ") + 1
                now.density = min(1.0, now.linked / now.words)
                now.mark = -1 if spoilt else max(-1, stack[-1][1]) if stack else 0
                now.heading, now.item = heading, item
                found.append(now)
        now = Block()

    def hold(text: str) -> None:
        if text and not dark:
            now.parts.append(text)
            if anchors:
                now.linked += len(text.split())

    at, scan = 0, tags(page)
    tag = next(scan, None)
    while tag:
        start, end, closing, name, rest = tag
        hold(page[at:start])
        at = end
        if name in RAW:
            if not closing and not rest.endswith("/"):
                shut = re.compile(f"</{name}", re.I).search(page, at)
                at = shut.start() if shut else len(page)
        elif name in BLOCK:
            close()
            anchors, dark, spoilt = 0, "", name == "p" and not closing and mark_of(name, rest, 0) < 0
            if name in HEADINGS:
                heading = not closing
            elif name in ("li", "dt", "dd"):
                item = not closing
            if name != "p" and name not in VOID:
                if not closing:
                    within = stack[-1][1] if stack else 0
                    stack.append((name, mark_of(name, rest, within)))
                    opened[name] = opened.get(name, 0) + 1
                elif opened.get(name):
                    while True:
                        last, _ = stack.pop()
                        opened[last] -= 1
                        if last == name:
                            break
        elif dark:
            deep += name == dark and (-1 if closing else 1)
            dark = dark if deep else ""
        elif not closing and name not in VOID and rest and not rest.isspace() and unseen(rest):
            dark, deep = name, 1
        elif name == "a":
            anchors = 0 if closing else 1
        elif name == "br":
            hold(" ")
        try:
            tag = scan.send(at)
        except StopIteration:
            tag = None
    hold(page[at:])
    close()
    return found


#: Order of a row: words, link density, words and density of the block before and after,
#: mark, heading, list item, whether the page has a marked article with text.
FEATURES = 10


def features(found: list[Block]) -> np.ndarray:
    has = float(any(b.mark > 0 for b in found))
    x = np.zeros((len(found), FEATURES))
    for i, b in enumerate(found):
        x[i] = (b.words, b.density, 0, 0, 0, 0, b.mark, b.heading, b.item, has)
        if i:
            x[i, 2:4] = found[i - 1].words, found[i - 1].density
        if i + 1 < len(found):
            x[i, 4:6] = found[i + 1].words, found[i + 1].density
    return x


#: Small labelled table (features as above, then 1 for main text): made-up blocks of the usual shapes of pages, labelled by the rule that a reader would use.
LABELLED = [
    # paragraphs, headings and short lines of a marked article
    (120, 0.00, 60, 0.00, 80, 0.00, 1, 0, 0, 1, 1), (60, 0.05, 9, 0.00, 45, 0.00, 1, 0, 0, 1, 1), (1, 0.00, 40, 0.00, 90, 0.00, 1, 0, 0, 1, 1), (2, 0.00, 1, 0.00, 1, 0.00, 1, 0, 0, 1, 1),
    (8, 0.00, 7, 0.00, 30, 0.00, 1, 1, 0, 1, 1), (12, 0.00, 1, 1.00, 70, 0.00, 1, 1, 0, 1, 1), (7, 0.00, 9, 0.00, 1, 0.00, 1, 1, 0, 1, 1), (3, 0.00, 9, 0.00, 11, 0.00, 1, 0, 0, 1, 1),
    (30, 0.30, 50, 0.00, 40, 0.10, 1, 0, 0, 1, 1), (12, 0.00, 10, 0.00, 14, 0.00, 1, 0, 1, 1, 1), (4, 0.00, 6, 0.00, 5, 0.00, 1, 0, 1, 1, 1), (25, 0.00, 8, 0.00, 12, 0.10, 1, 0, 0, 1, 1),
    (40, 0.00, 70, 0.00, 0, 0.00, 1, 0, 0, 1, 1), (1, 0.00, 3, 0.00, 9, 0.20, 1, 0, 0, 1, 1), (9, 0.45, 22, 0.00, 31, 0.00, 1, 0, 0, 1, 1), (14, 0.60, 40, 0.00, 52, 0.00, 1, 0, 0, 1, 1),
    (5, 1.00, 60, 0.00, 75, 0.00, 1, 0, 0, 1, 1), (3, 1.00, 35, 0.00, 44, 0.02, 1, 0, 0, 1, 1), (6, 0.50, 8, 0.40, 7, 0.50, 1, 0, 1, 1, 1),
    # its lines beside menus, and single links in it
    (6, 0.00, 30, 0.00, 2, 1.00, 1, 0, 0, 1, 1), (2, 0.00, 45, 0.00, 1, 1.00, 1, 0, 0, 1, 1), (1, 0.00, 2, 1.00, 3, 1.00, 1, 0, 0, 1, 1), (40, 0.00, 12, 0.00, 2, 1.00, 1, 0, 0, 1, 1), (70, 0.05, 1, 1.00, 1, 1.00, 1, 0, 0, 1, 1), (9, 0.00, 3, 1.00, 4, 1.00, 1, 1, 0, 1, 1), (11, 0.20, 2, 1.00, 5, 1.00, 1, 0, 1, 1, 1), (20, 0.00, 9, 0.00, 4, 1.00, 1, 0, 0, 1, 1), (4, 0.00, 80, 0.00, 3, 1.00, 1, 0, 0, 1, 1),
    (7, 0.50, 60, 0.00, 3, 1.00, 1, 0, 0, 1, 1), (55, 0.00, 70, 0.00, 6, 0.90, 1, 0, 0, 1, 1), (3, 0.00, 20, 0.00, 8, 1.00, 1, 1, 0, 1, 1),
    # its lists of links: a menu in it is a nav element or is called one
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 1, 1, 1), (2, 1.00, 1, 1.00, 2, 1.00, 1, 0, 1, 1, 1), (3, 1.00, 4, 1.00, 3, 1.00, 1, 0, 1, 1, 1), (5, 1.00, 6, 1.00, 4, 1.00, 1, 0, 1, 1, 1),
    (8, 0.95, 7, 1.00, 9, 1.00, 1, 0, 1, 1, 1), (2, 1.00, 40, 0.00, 3, 1.00, 1, 0, 1, 1, 1), (3, 1.00, 65, 0.00, 2, 1.00, 1, 0, 1, 1, 1), (4, 1.00, 30, 0.00, 4, 1.00, 1, 0, 1, 1, 1), (2, 1.00, 1, 1.00, 2, 1.00, 1, 0, 0, 1, 1),
    # menus, notices, adverts, footers, comments: marked as other matter
    (1, 1.00, 0, 0.00, 1, 1.00, -1, 0, 1, 1, 0), (1, 1.00, 1, 1.00, 8, 0.00, -1, 0, 1, 1, 0), (8, 0.00, 1, 1.00, 10, 0.00, -1, 0, 0, 1, 0), (9, 0.00, 80, 0.00, 0, 0.00, -1, 0, 0, 1, 0),
    (45, 0.00, 80, 0.00, 30, 0.00, -1, 0, 0, 1, 0), (30, 0.00, 45, 0.00, 60, 0.00, -1, 0, 0, 1, 0), (5, 0.00, 12, 0.00, 40, 0.00, -1, 1, 0, 1, 0), (20, 0.10, 6, 0.00, 11, 0.00, -1, 0, 1, 1, 0),
    (60, 0.00, 45, 0.00, 50, 0.00, -1, 0, 0, 0, 0), (90, 0.02, 3, 0.00, 2, 0.00, -1, 0, 0, 0, 0), (2, 1.00, 1, 1.00, 3, 1.00, -1, 0, 1, 0, 0), (3, 0.00, 5, 0.00, 5, 0.00, -1, 1, 0, 0, 0), (12, 0.30, 20, 0.00, 0, 0.00, -1, 0, 0, 0, 0), (150, 0.00, 120, 0.00, 130, 0.00, -1, 0, 0, 1, 0),
    # unmarked blocks beside a marked article
    (8, 0.00, 1, 1.00, 9, 0.00, 0, 0, 0, 1, 0), (20, 0.00, 90, 0.00, 0, 0.00, 0, 0, 0, 1, 0), (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 1, 1, 0), (45, 0.10, 60, 0.00, 3, 1.00, 0, 0, 0, 1, 0), (6, 0.00, 3, 0.30, 25, 0.00, 0, 1, 0, 1, 0), (70, 0.00, 50, 0.00, 12, 0.00, 0, 0, 0, 1, 0),
    (30, 0.00, 12, 0.00, 9, 0.00, 0, 0, 0, 1, 0), (90, 0.00, 60, 0.00, 80, 0.00, 0, 0, 0, 1, 0), (13, 0.00, 3, 0.00, 2, 0.00, 0, 0, 0, 1, 0), (4, 0.00, 60, 0.00, 70, 0.00, 0, 1, 0, 1, 0), (25, 0.00, 30, 0.00, 40, 0.00, 0, 0, 0, 1, 0), (60, 0.00, 5, 0.00, 50, 0.00, 0, 0, 0, 1, 0), (15, 0.00, 1, 1.00, 35, 0.00, 0, 0, 0, 1, 0),
    # pages without a marked article: running text, whatever stands beside it
    (60, 0.00, 8, 0.00, 70, 0.00, 0, 0, 0, 0, 1), (35, 0.05, 60, 0.00, 40, 0.00, 0, 0, 0, 0, 1), (18, 0.00, 30, 0.00, 25, 0.10, 0, 0, 0, 0, 1), (14, 0.10, 40, 0.00, 3, 1.00, 0, 0, 0, 0, 1), (110, 0.01, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 1), (24, 0.00, 1, 0.00, 2, 0.00, 0, 0, 0, 0, 1), (40, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (13, 0.00, 2, 1.00, 4, 0.00, 0, 0, 0, 0, 1), (28, 0.20, 6, 0.00, 5, 1.00, 0, 0, 0, 0, 1), (33, 0.15, 1, 0.00, 12, 1.00, 0, 0, 1, 0, 1), (52, 0.00, 7, 0.00, 6, 0.00, 0, 0, 0, 0, 1), (75, 0.00, 20, 0.00, 1, 1.00, 0, 0, 0, 0, 1), (16, 0.00, 9, 0.00, 8, 0.00, 0, 1, 0, 0, 1), (44, 0.25, 3, 1.00, 60, 0.00, 0, 0, 0, 0, 1),
    # and short blocks beside running text
    (7, 0.00, 3, 1.00, 60, 0.00, 0, 1, 0, 0, 1), (5, 0.00, 40, 0.00, 38, 0.00, 0, 1, 0, 0, 1), (3, 0.00, 50, 0.00, 45, 0.00, 0, 0, 0, 0, 1), (2, 0.00, 30, 0.00, 22, 0.00, 0, 0, 0, 0, 1), (9, 0.00, 25, 0.00, 42, 0.00, 0, 0, 1, 0, 1), (1, 0.00, 20, 0.00, 19, 0.00, 0, 0, 0, 0, 1), (4, 0.00, 1, 1.00, 35, 0.00, 0, 1, 0, 0, 1), (6, 0.00, 18, 0.00, 24, 0.20, 0, 0, 0, 0, 1),
    # links, and short blocks among links and other short blocks
    (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 1, 0, 0), (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0), (6, 0.80, 4, 1.00, 5, 0.70, 0, 0, 0, 0, 0), (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0), (3, 0.00, 5, 0.00, 4, 0.00, 0, 0, 0, 0, 0), (7, 0.50, 40, 0.00, 50, 0.00, 0, 0, 0, 0, 0), (2, 1.00, 60, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (5, 0.00, 3, 1.00, 4, 1.00, 0, 1, 0, 0, 0), (8, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0, 0), (24, 0.90, 20, 0.80, 22, 0.95, 0, 0, 0, 0, 0), (15, 0.60, 3, 1.00, 12, 0.70, 0, 0, 1, 0, 0), (30, 0.55, 40, 0.60, 28, 0.70, 0, 0, 0, 0, 0), (50, 0.80, 60, 0.00, 40, 0.00, 0, 0, 0, 0, 0), (9, 0.00, 8, 0.00, 7, 0.00, 0, 0, 0, 0, 0), (1, 0.00, 2, 0.00, 1, 0.00, 0, 0, 1, 0, 0), (18, 0.45, 8, 0.00, 10, 0.00, 0, 0, 0, 0, 0),
    (4, 0.00, 12, 0.70, 6, 0.00, 0, 0, 0, 0, 0), (6, 0.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0, 0), (3, 0.00, 45, 0.00, 0, 0.00, 0, 0, 0, 0, 0), (2, 0.00, 3, 0.00, 8, 0.00, 0, 1, 0, 0, 0),
]


@dataclass
class Node:
    column: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None
    answer: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A classification tree by Gini impurity; ties go to the first column and lowest bound."""
    if depth == 0 or y.min() == y.max():
        return Node(answer=bool(y.mean() >= 0.5))
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for bound in (values[:-1] + values[1:]) / 2:
            low = y[x[:, column] <= bound]
            high = y[x[:, column] > bound]
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (low, high))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, column, bound)
    if best is None:
        return Node(answer=bool(y.mean() >= 0.5))
    _, column, bound = best
    low = x[:, column] <= bound
    return Node(column, float(bound), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.lru_cache(maxsize=1)
def tree() -> Node:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :FEATURES], rows[:, FEATURES])


def is_main(row: np.ndarray) -> bool:
    node = tree()
    while node.column >= 0:
        node = node.low if row[node.column] <= node.bound else node.high
    return node.answer


def main_text(page: str | None) -> str:
    """The main blocks' texts, joined by line feeds; empty for null, empty or textless pages."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(row))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points). Repeated rows repeat; other columns are left out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return by_slice(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), work, "page_id long, url string, text string, n_chars long", "html")
