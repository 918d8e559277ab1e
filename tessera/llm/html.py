"""Main-text extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block
tags. For each path the text length and the punctuation of its blocks are
summed and divided by the number of blocks; both ratios are smoothed over the
page, neighbours on other paths counting half, and fused into one value. Paths
whose fused value reaches a threshold are content. The element that holds most
of their weight is the page's main part, whatever it is called; in it, what is
beside content goes with it, and divisions without any content path go. Tags
of menus, forms and the like exclude their whole subtree from the start, and so
do names that say nothing else than that they mark an advert or a notice. Names
that say more, as in "legal-analysis", only vote: what they mark is content if
the ratio of its path is, and does not go along with what is beside it.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PUNCTUATION = ".,;:!?…。，、；：！？¿¡"

#: Elements whose content is never text; what is inside them is not markup either.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
#: Those of them that also end a block.
ENDS_BLOCK = ("textarea", "title", "xmp")
#: Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run along in a line and neither end a block nor count in paths.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rb rt rp".split())
#: Excluded with all they hold.
EXCLUDED = frozenset("head nav header footer aside form menu dialog button select option svg math object audio video canvas".split())
#: Parts of class names, ids and roles that exclude an element, compared word by word.
EXCLUDING = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login register menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "side aside footer header masthead toolbar comment comments commentlist disqus replies reply respond discussion related recommended "
    "recommendations share sharing social tags tagcloud pagination pager widget widgets copyright legal disclaimer search form hidden toc contentinfo complementary".split()
)
#: Words that say nothing about what a part of a page is for: beside them an excluding word still stands alone.
STRUCTURAL = frozenset(
    "area bar block bottom box btn button card col column container content flex frame grid group holder inner item items left level li link links list row "
    "main mobile module outer panel pane primary region right secondary section site slot small sticky title top unit wrap wrapper zone js id the".split()
)
#: Words that say that a part belongs to the text, whatever stands beside them.
OF_THE_TEXT = frozenset("article post entry story body text abstract chapter lede paragraph heading headline".split())
#: Words that mean something else on a heading.
ON_HEADINGS = frozenset(("header", "side", "alert", "notice"))
#: Elements that say that they hold the main part; what they hold weighs more when it is chosen.
CONTAINERS = ("article", "main")
CONTAINED_WEIGHT = 3.0
#: Elements that can be the main part, and that go if they hold no content path.
DIVISIONS = frozenset("html body article main section div center td details fieldset figure hgroup".split())
#: Content has at least the standard deviation of the fused ratios, and at least this share of what a character has on average.
CONTENT_SHARE = 0.5
#: Share of the content's weight that the main part has to hold.
MAIN_SHARE = 0.7
#: A block with this share of linked text is a link, and content only if its path is.
LINK_SHARE = 0.8
#: What a neighbour on another path counts when ratios are smoothed.
OTHER_PATH = 0.5
#: Within a container, a header is part of the article.
IN_CONTAINER = frozenset(("header",))
#: What the start of an element closes if open: end tags that may be left out.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

WINDOW = np.exp(-0.5 * np.arange(-2, 3) ** 2)


@dataclass
class Block:
    """One run of text: its innermost block element, the number of its path, and whether an ancestor is excluded or doubted."""

    node: int
    path: int
    contained: bool
    excluded: bool
    doubted: bool = False
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


@dataclass
class Tree:
    """Block elements in page order: their tags and parents. The first stands for the page."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])

    def add(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        return len(self.tags) - 1


@dataclass(slots=True)
class _Open:
    """An open element: where it is in the stack, and how many block elements are around it or are itself."""

    tag: str
    node: int
    path: int
    contained: bool
    excluded: bool
    doubted: bool = False
    at: int = 0
    depth: int = 0


class _Stack:
    """Open elements. What an end tag means is looked up by tag, so that its cost does not depend on the depth."""

    def __init__(self):
        self.items = [_Open("", 0, 0, False, False)]
        self.blocks: list[_Open] = []
        self.open: dict[str, list[_Open]] = defaultdict(list)

    def push(self, x: _Open) -> None:
        if x.tag not in INLINE:
            self.blocks.append(x)
        x.at, x.depth = len(self.items), len(self.blocks)
        self.items.append(x)
        self.open[x.tag].append(x)

    def cut(self, at: int) -> list[_Open]:
        gone = self.items[at:]
        del self.items[at:]
        for x in reversed(gone):
            # an element that was closed across a block has lost its tag
            if x.tag:
                self.open[x.tag].pop()
                if x.tag not in INLINE:
                    self.blocks.pop()
        return gone

    def close(self, tag: str) -> None:
        """An end tag: the innermost such element and all inside it; an inline one that was closed across a block goes alone."""
        if not self.open[tag]:
            return
        x = self.open[tag][-1]
        if tag in INLINE and len(self.blocks) > x.depth:
            self.open[tag].pop()
            x.tag = ""
        else:
            self.cut(x.at)

    def close_implied(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Take the innermost of some open elements, and all inside it, away, unless a scope's element is nearer."""
        if not any(self.open[t] for t in tags):
            return
        for here in reversed(self.blocks):
            if here.tag in tags:
                inside = self.cut(here.at)[1:]
                # formatting that was open goes on after it, of one kind up to three times
                top = self.items[-1]
                for x in inside:
                    if x.tag in INLINE and len(self.open[x.tag]) < 3:
                        self.push(_Open(x.tag, top.node, top.path, top.contained, x.excluded, x.doubted))
                return
            if here.tag in scope:
                return


def _named(tag: str, value: str) -> int:
    """What the names of an element say: 2 if one excludes it, 1 if one casts doubt on it."""
    most = 0
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        against = words & EXCLUDING - (ON_HEADINGS if re.fullmatch("h[1-6]", tag) else frozenset())
        if against and not words & OF_THE_TEXT:
            most = max(most, 1 if words - against - STRUCTURAL else 2)
    return most


def _excluded(tag: str, attributes: str, contained: bool) -> int:
    """2 if an element goes with all it holds, 1 if ratios have to speak for it."""
    most = 0
    if tag in EXCLUDED and not (contained and tag in IN_CONTAINER):
        return 2
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
            if name in ("class", "id", "role") and tag not in ("html", "body", *CONTAINERS):
                most = max(most, _named(tag, value))
    return most


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The page's blocks that hold text, in page order, and its elements. Time is in proportion to the page, however deep it is."""
    stack, tree = _Stack(), Tree()
    paths: dict[tuple[int, str], int] = {}
    found: list[Block] = []
    now: Block | None = None
    links, at = 0, 0

    def say(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        top = stack.items[-1]
        if top.excluded and not (stack.blocks and stack.blocks[-1].excluded):
            # an excluded element inside a line: its text is no part of the block, wherever it stands
            return
        if now is None:
            now = Block(top.node, top.path, top.contained, top.excluded, bool(stack.blocks and stack.blocks[-1].doubted))
            found.append(now)
        said = entities.unescape(raw)
        now.parts.append(said)
        if links:
            now.linked += len(said)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            say(entities.escape(m[0][9:].removesuffix("]]>")))
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            stack.close(tag)
            if tag not in INLINE:
                now = None
            continue
        if tag in RAW and not m[0].endswith("/>"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            if tag in ENDS_BLOCK:
                now = None
            continue
        if tag not in INLINE:
            now = None
            if tag in CLOSES_P:
                stack.close_implied(("p",), ("button", "table", "td", "article", "section", "div", "li"))
            if tag in CLOSES:
                stack.close_implied(CLOSES[tag], SCOPES[tag])
        elif tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        outer = stack.items[-1]
        said = _excluded(tag, m[3] or "", outer.contained)
        excluded, doubted = outer.excluded or said == 2, outer.doubted or said > 0
        if tag in INLINE:
            if not (m[3] or "").endswith("/"):
                stack.push(_Open(tag, outer.node, outer.path, outer.contained, excluded, doubted))
        else:
            path = paths.setdefault((outer.path, tag), len(paths) + 1)
            stack.push(_Open(tag, tree.add(tag, outer.node), path, outer.contained or tag in CONTAINERS, excluded, doubted))
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text], tree


def fused_ratios(found: list[Block]) -> np.ndarray:
    """For each block, its path's text and punctuation ratios, smoothed and multiplied. Linked text has no length."""
    numbers: dict[int, int] = {}
    of = np.array([numbers.setdefault(b.path, len(numbers)) for b in found])
    n = np.bincount(of)
    own = np.array([len(b.text) - min(b.linked, len(b.text)) for b in found], dtype=float)
    text = np.bincount(of, own) / n
    marks = np.bincount(of, [sum(map(b.text.count, PUNCTUATION)) for b in found]) / n
    total, spoken, marked = (np.zeros(len(found)) for _ in range(3))
    for shift in range(-2, 3):
        i = np.arange(max(0, -shift), len(found) - max(0, shift))
        weight = WINDOW[shift + 2] * np.where(of[i] == of[i + shift], 1.0, OTHER_PATH)
        total[i] += weight
        spoken[i] += weight * text[of[i + shift]]
        marked[i] += weight * marks[of[i + shift]]
    return np.sqrt(spoken * (total + marked)) / total


def content(found: list[Block], tree: Tree) -> list[bool]:
    """Which blocks are content."""
    free = np.array([not b.excluded for b in found], dtype=bool)
    if not free.any():
        return free.tolist()
    ratio = fused_ratios(found)
    node = np.array([b.node for b in found])
    length = np.array([len(b.text) for b in found])
    usual = np.average(ratio[free], weights=length[free])
    limit = min(max(ratio.std(), CONTENT_SHARE * usual), ratio[free].max())
    picked = free & (ratio >= limit)
    # weight and number of content blocks in each element, and of all and other blocks than headings; parents come before children
    weight, picks, titles, others = np.zeros(len(tree.tags)), *np.zeros((3, len(tree.tags)), dtype=np.int64)
    np.add.at(weight, node, np.where(picked, ratio * length * np.where([b.contained for b in found], CONTAINED_WEIGHT, 1.0), 0.0))
    np.add.at(picks, node, picked)
    heading = np.array([bool(re.fullmatch("h[1-6]", tree.tags[b.node])) for b in found])
    np.add.at(titles, node, free & heading)
    np.add.at(others, node, free & ~heading)
    for x in range(len(tree.tags) - 1, 0, -1):
        weight[tree.parents[x]] += weight[x]
        for count in (picks, titles, others):
            count[tree.parents[x]] += count[x]
    # the innermost division that holds most of the weight: those that do are one inside the other
    main = max((x for x, tag in enumerate(tree.tags) if weight[x] >= MAIN_SHARE * weight[0] and (tag in DIVISIONS or not x)), default=0)
    # an element is kept if it is in the main part and every division between the two has content or just headings
    kept = [False] * len(tree.tags)
    kept[main] = True
    for x in range(main + 1, len(tree.tags)):
        kept[x] = kept[tree.parents[x]] and (tree.tags[x] not in DIVISIONS or picks[x] > 0 or titles[x] > 0 == others[x])
    out = [bool(ok and kept[b.node] and (p or not b.doubted and b.linked < LINK_SHARE * len(b.text))) for b, ok, p in zip(found, free, picked, strict=True)]
    return _with_heading(found, tree, main, out)


def _with_heading(found: list[Block], tree: Tree, main: int, out: list[bool]) -> list[bool]:
    """The heading just before a main part without one belongs to it."""
    first = out.index(True) if True in out else 0
    if first and not any(tree.tags[b.node] in ("h1", "h2") for b, ok in zip(found, out, strict=True) if ok):
        above, x = set(), main
        while x >= 0:
            above.add(x)
            x = tree.parents[x]
        for i in range(first - 1, -1, -1):
            b = found[i]
            if not b.excluded and tree.tags[b.node] in ("h1", "h2") and tree.parents[b.node] in above:
                out[i] = True
                break
    return out


def main_text(page: str | None) -> str:
    """The content blocks of a page joined by line feeds; empty if there are none."""
    found, tree = blocks(page or "")
    return "\n".join(b.text for b, ok in zip(found, content(found, tree), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of every row from its whole page. Null and empty pages and pages without content have empty texts.

    Repeated rows stay. Other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
