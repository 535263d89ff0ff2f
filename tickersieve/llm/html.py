"""Main text of web pages by tag-path ratios.

Each page's blocks of text are grouped by their root-to-leaf tag path. Per path the text length and
the punctuation per block are aggregated, smoothed over the page's order of blocks, fused into one score
and compared with a threshold. Paths below containers marked as content (article, main, or named so) score BONUS times as much,
those below parts that are named doubtfully only DOUBT times. Content are the blocks over the threshold, and what shares the
container that holds most of their score, or a container marked as content; doubtful parts of these need a score over the threshold too.
Outside of marked containers, blocks that are mostly links need that score by themselves, not by their neighbours.

Menus, headers, footers, asides, forms and scripts, and parts named as adverts, notices, comments and the like, have
paths of weight 0. A name has no effect on an element that holds most of the page's text, unless content is marked elsewhere.

A null or empty page has an empty text. Repeated rows repeat their result. Paths and containers are numbers, so that time and memory
grow with the page's length however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, map_arrow

# Fixed values of the HTML standard and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp img".split())
SKIPPED = frozenset("nav header footer aside form button select option menu dialog head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
CUES = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|banner)|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notices?|notification\w*|alert\w*|popup|modal|overlay|sidebar\w*|side-bar|widget\w*|related-?posts?|"
    r"share\w*|sharing|social\w*|comment\w*|disqus\w*|respond|nav|navbar|navigation|navmenu|menu\w*|breadcrumb\w*|pagination|pager|footer\w*|masthead|topbar|site-header|page-header|"
    r"toolbar|newsletter\w*|subscribe|subscription|signup|login|copyright|skip|paywall|outbrain|taboola)(?:$|[\s_-])",
    re.IGNORECASE,
)
DOUBTS = re.compile(r"(?:^|[\s_-])(?:related\w*|recommend\w*|discussion|reactions?|reply|replies|search\w*|tags?|tag-list|legal|disclaimer|toc)(?:$|[\s_-])", re.IGNORECASE)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|post-content|entry|entry-content|content|main|main-content|story|story-body|body-text|text)(?:$|[\s_-])", re.IGNORECASE)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("table ul ol dl article section main body div".split())
# these are no containers; a name as content says nothing about what stands beside them
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre html body td tr tbody".split())
BONUS = 2.0
DOUBT = 0.6
MOST = 0.5  # of a page's text, from which the name of an element that holds all marked content, if any, says nothing
NEARLY_ALL = 0.8  # the same for an element inside marked content
FADE = 0.9  # of a container's score that counts for the one around it
THRESHOLD = 0.5  # of the page's mean score; the ends of an article are smoothed down by what stands beside them
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("span", "small", "label")}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}


class Block:
    __slots__ = ("path", "container", "text", "linked")

    def __init__(self, path: int, container: int, text: str, linked: int):
        self.path, self.container, self.text, self.linked = path, container, text, linked


class Container:
    """An element that holds blocks; `off`: never content, `named`: named as such, `doubt`: doubtfully, `mark`: as content."""

    __slots__ = ("parent", "off", "named", "doubt", "mark")

    def __init__(self, parent: int, off: bool, named: bool, doubt: bool, mark: bool):
        self.parent, self.off, self.named, self.doubt, self.mark = parent, off, named, doubt, mark


def _named(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Is the element hidden; named as something else than content, doubtfully so, as content?"""
    if "=" not in attributes and "hidden" not in attributes:
        return False, False, False, False
    hidden = off = doubt = on = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            off |= bool(CUES.search(value))
            doubt |= bool(DOUBTS.search(value))
            on |= bool(CONTENT.search(value))
        elif key == "role":
            off |= value.lower() in ROLES
            on |= value.lower() in ("main", "article")
        elif key == "itemprop":
            on |= value == "articleBody"
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return hidden or bool(re.search(r"\shidden(?:\s|=|$)", attributes)), off, doubt, on


def blocks(page: str) -> tuple[list[Block], list[Container]]:
    """Text blocks in page order, and the containers, each after the one around it."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, path, container
    open_: dict[str, int] = defaultdict(int)  # elements of a tag in the stack
    paths: dict[tuple[int, str], int] = {}
    containers: list[Container] = []
    held: list[str] = []
    linked = [0]
    links = 0
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                _, path, container = stack[-1] if stack else ("", -1, -1)
                out.append(Block(path, container, text, min(linked[0], len(text))))
            held.clear()
            linked[0] = 0

    def say(text: str) -> None:
        text = unescape(text) if "&" in text else text
        held.append(text)
        if links:
            linked[0] += len(text)

    def close(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            open_[tag] -= 1
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            links = 0 if m[1] else 1
        if tag in _RAW_END and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if not m[1] and tag in ("span", "small", "label") and _named(m[3])[0]:
                end = _INLINE_END[tag].search(page, at)
                if end:
                    at = end.end()
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in ("p", "li") and stack[i][0] in SCOPES:
                    break
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in IMPLIED and any(open_[t] for t in IMPLIED[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in IMPLIED[tag]:
                    close(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in ("html", "body"):
            if open_[tag]:
                continue
            if tag == "body":
                while stack and stack[-1][0] == "head":
                    close(len(stack) - 1)
        hidden, off, doubt, on = _named(m[3])
        if tag in ("html", "body", "main") or tag == "article" and on:
            hidden = off = doubt = False
        skipped = tag in SKIPPED and not (tag == "header" and (open_["article"] or open_["main"]))
        mark = on and tag not in LEAVES or tag in ("article", "main")
        path, container = (stack[-1][1], stack[-1][2]) if stack else (-1, -1)
        path = paths.setdefault((path, tag + ".content" * mark), len(paths))
        if tag not in LEAVES or hidden or off or doubt:
            containers.append(Container(container, skipped or hidden, off, doubt, mark))
            container = len(containers) - 1
        stack.append((tag, path, container))
        open_[tag] += 1
    flush()
    return out, containers


class Page:
    """What follows for each block of a page from the containers around it."""

    def __init__(self, page: str) -> None:
        self.blocks, containers = blocks(page)
        n = len(containers)
        self.parents = [c.parent for c in containers]
        off = [False] * n
        for i, c in enumerate(containers):
            off[i] = c.off or c.parent >= 0 and off[c.parent]
        text = [0] * n
        total = 0
        for b in self.blocks:
            if b.container < 0 or not off[b.container]:
                total += len(b.text)
                if b.container >= 0:
                    text[b.container] += len(b.text)
        for i in range(n - 1, -1, -1):
            if self.parents[i] >= 0:
                text[self.parents[i]] += text[i]
        # text in containers marked as content, below each container
        marked = [0] * n
        for i in range(n - 1, -1, -1):
            marked[i] = text[i] if containers[i].mark and not off[i] else marked[i]
            if self.parents[i] >= 0:
                marked[self.parents[i]] += marked[i]
        all_marked = sum(m for i, m in enumerate(marked) if self.parents[i] < 0)
        dropped, doubt, holder = [False] * n, [False] * n, [-1] * n
        for i, c in enumerate(containers):
            up = c.parent
            within = up >= 0 and holder[up] >= 0
            large = text[i] > (NEARLY_ALL if within else MOST) * total and (within or marked[i] == all_marked)
            dropped[i] = off[i] or c.named and not large or up >= 0 and dropped[up]
            doubt[i] = c.doubt and not large or up >= 0 and doubt[up]
            holder[i] = holder[up] if up >= 0 and holder[up] >= 0 else i if c.mark else -1
        at = lambda values, none: [values[b.container] if b.container >= 0 else none for b in self.blocks]
        self.dropped, self.doubt, self.holder = at(dropped, False), at(doubt, False), at(holder, -1)

    def ratios(self) -> list[float]:
        """The fused ratio of each block's path; 0 below parts that are never content."""
        size: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for b, dropped in zip(self.blocks, self.dropped):
            if not dropped:
                s = size[b.path]
                s[0] += len(b.text) - b.linked
                s[1] += len(PUNCTUATION.findall(b.text))
                s[2] += 1
        out = []
        for b, dropped, doubt, holder in zip(self.blocks, self.dropped, self.doubt, self.holder):
            s = size[b.path]
            weight = (BONUS if holder >= 0 else 1.0) * (DOUBT if doubt else 1.0)
            out.append(0.0 if dropped else s[0] / s[2] * (1 + s[1] / s[2]) * weight)
        return out

    def scores(self, raw: list[float]) -> list[float]:
        """The ratios, smoothed over neighbouring blocks."""
        smooth = []
        for i, dropped in enumerate(self.dropped):
            near = [raw[j] for j in (i - 1, i + 1) if 0 <= j < len(raw) and not self.dropped[j]]
            smooth.append(0.0 if dropped else (2 * raw[i] + sum(near)) / (2 + len(near)))
        return smooth

    def largest(self, score: list[float], over: set[int]) -> list[bool]:
        """For each block: is it in the container that holds most of the score over the threshold?"""
        total = [0.0] * len(self.parents)
        root = 0.0
        for i in over:
            c = self.blocks[i].container
            if c >= 0:
                total[c] += score[i]
            else:
                root += score[i]
        for c in range(len(total) - 1, -1, -1):
            up = self.parents[c]
            if up >= 0:
                total[up] += FADE * total[c]
            else:
                root += FADE * total[c]
        best = max(range(len(total)), key=lambda c: (total[c], c), default=-1)
        if best < 0 or root > total[best]:
            return [True] * len(self.blocks)
        below = [False] * len(total)
        for c, up in enumerate(self.parents):
            below[c] = c == best or up >= 0 and below[up]
        return [b.container >= 0 and below[b.container] for b in self.blocks]


def main_text(page: str) -> str:
    p = Page(page)
    kept = [i for i, dropped in enumerate(p.dropped) if not dropped]
    if not kept:
        return ""
    raw = p.ratios()
    score = p.scores(raw)
    level = THRESHOLD * sum(score[i] for i in kept) / len(kept)
    over = {i for i in kept if score[i] >= level}
    inside = p.largest(score, over)
    holders = {p.holder[i] for i in over if p.holder[i] >= 0}
    out = []
    for i in kept:
        b, marked = p.blocks[i], p.holder[i] in holders
        if i not in over and (p.doubt[i] or not (inside[i] or marked)):
            continue
        if not marked and b.linked * 2 > len(b.text) and raw[i] < level:
            continue
        out.append(b.text)
    return " ".join(out)


def _step(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [main_text(p or "") for p in chunk.column("html").to_pylist()]
    yield batch(page_id=chunk.column("page_id"), url=chunk.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points for every page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_arrow(pages, _step, "page_id long, url string, text string, n_chars long")
