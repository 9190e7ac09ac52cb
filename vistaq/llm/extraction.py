"""HTML extraction by tag-path ratios.

A page is read as a stream of tags and texts.  Every text belongs to a
root-to-leaf path of tags (of blocks with their first class; blocks that are
links as a whole stand apart).  For each path of a page, text length, number of
texts, punctuation and link text are added up; the ratio of text to texts and
the punctuation are smoothed over neighbouring paths in page order and fused with
the same figures of the path's container.  What the page says weighs the fused ratio: little
for paths outside an article that it marks, and for parts whose class, id or
role is a name of something else (adverts, comments and so on); a label with
such a name among others is cleared by the ratio of its part.  Paths whose
weighted ratio is above a share of the best hold the content, on every page.
Only elements that can't be main text by their tag (scripts, navigation, forms,
footers) take no part.

Edge cases: null and empty pages, and pages without visible text, give an empty
text; unclosed and stray tags follow the usual repair rules; nesting may be
as deep as the page is long; text outside all tags counts as a path of its own; repeated rows are extracted each; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, in_small_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements that are never main text.
_DROPPED = {"aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "menu", "nav", "noembed", "noframes", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video", "xmp"}
#: Words of a class, id or role that name something else than main text.
_NAMED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "captcha", "comment", "commentlist", "comments", "complementary", "contentinfo", "consent", "cookie", "cookies",
    "disclaimer", "discussion", "disqus", "dropdown", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "reader", "readers", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "talk", "teaser", "toolbar", "tooltip", "widget", "widgets",
}
#: As above, but inside an article they hold its own title.
_OUTSIDE = {"header", "topbar"}
_CONTENT = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Of the words above, those that are a usual id of a div for something else; the others are as usual in ids made of headings.
_IDS = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "commentlist", "comments", "cookie", "cookies", "disqus", "footer", "masthead", "menubar", "navbar", "pager", "pagination", "popup", "sidebar", "toolbar", "widget", "widgets"}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？…]")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Share of the best path's weighted ratio from which on a path holds content.
THRESHOLD = 0.15
#: Least share of link text in a block that is a link, and the least number of such blocks that make a list of links.
LINKED, LINKS = 0.9, 3
#: Weight of a path's container against the path itself.
CONTAINER = 0.6
#: Weights of a path outside the article that a page marks, and of one named as something else.
OUTSIDE, NAMED = 0.03, 0.05
#: A part with a name in its label is cleared if its own ratio reaches this share of the best path's.
CLEARED = 0.5

# How an element is named: not at all, in part of its label, or by all of it.
_PLAIN, _SUSPECT, _OTHER = 0, 1, 2


@dataclass(slots=True)
class _Node:
    tag: str
    path: int
    dropped: bool
    article: bool
    link: bool
    #: path of the nearest block, that of the block around it, and whether it is a heading
    block: int
    container: int
    heading: bool
    is_block: bool


@dataclass(slots=True)
class Path:
    """Sums of a root-to-leaf path, apart for blocks that are links as a whole."""

    container: int
    chars: int = 0
    texts: int = 0
    marks: int = 0
    linked: int = 0


@dataclass
class Page:
    """Paths are numbers; ``above`` and ``label`` of each give its root-to-leaf form."""

    above: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    article: list[bool] = field(default_factory=lambda: [False])
    named: list[int] = field(default_factory=lambda: [_PLAIN])
    #: runs of (block number, path, container, heading, text in links, text)
    runs: list[tuple[int, int, int, bool, bool, str]] = field(default_factory=list)


def _words(value: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(value)]


def _named(attributes: str, tag: str, inside: bool, marks: bool) -> int:
    """How class, id, role or the hidden state name something else than main text.

    ids and labels of headings and paragraphs are made of their text and name
    nothing.  A class or role all of whose words are names says it (a comment,
    say); one with a name among other words only makes the element a suspect, on
    which its ratio decides.  Inside an article an id counts only if all its words are those
    of a div for something else.  An element that marks an article is named only
    inside another.
    """
    out = _PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "role", "data-role"):
            for token in value.split():
                words = _words(token)
                hits = [w in _NAMED or (w in _OUTSIDE and not inside) for w in words]
                if not any(hits) or (marks and not inside) or (inside and tag in _HEADINGS):
                    continue
                out = max(out, _OTHER if all(hits) else _SUSPECT)
        elif name in ("id", "aria-label"):
            words = _words(value)
            if marks or tag in _HEADINGS or tag == "p" or not words:
                continue
            if not inside:
                hits = [w in _NAMED or w in _OUTSIDE for w in words]
                out = max(out, _OTHER if all(hits) else _SUSPECT if any(hits) else _PLAIN)
            elif name == "id" and tag == "div" and all(w in _IDS for w in words):
                out = _OTHER
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _OTHER
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _OTHER
    return out


def _label(tag: str, attributes: str, is_block: bool) -> str:
    """The tag; of a block with its first class, so that a sidebar's and the story's ``div/p`` are two paths."""
    if not is_block or "class" not in attributes.lower():
        return tag
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "class":
            first = (m[2] or m[3] or m[4] or "").split()
            return f"{tag}.{re.sub('[0-9]+', '', first[0]).lower()}" if first else tag
    return tag


def read(html: str) -> Page:
    """Texts of a page with their paths and blocks, in time and memory linear in the page."""
    page = Page()
    known: dict[tuple[int, str, bool, int], int] = {}
    stack = [_Node("", 0, False, False, False, 0, 0, False, True)]
    counts: dict[str, int] = {}  # open elements of each tag
    block, at, end = 0, 0, len(html)

    def cut(depth: int) -> bool:
        """Closes the elements from here on; whether a block is among them."""
        blocks = False
        for node in stack[depth:]:
            counts[node.tag] -= 1
            blocks = blocks or node.is_block
        del stack[depth:]
        return blocks

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not top.dropped:
            page.runs.append((block, top.path, top.container, top.heading, top.link, entities.unescape(raw) if "&" in raw else raw))

    while at < end:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if counts.get(tag):
                if cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)):
                    block += 1
            elif tag in _BLOCK:
                block += 1
            continue
        if tag in _VOID:
            if tag == "br":
                text(" ")
            elif tag in _BLOCK:
                block += 1
            continue
        if tag in _RAW:
            ended = _RAW_END[tag].search(html, at)
            block += tag in _BLOCK
            at = ended.end() if ended else end
            continue
        is_block = tag in _BLOCK
        if is_block:
            block += 1
            if tag in _CLOSES and any(counts.get(t) for t in _CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _SCOPE[tag]:
                        break
                    if stack[i].tag in _CLOSES[tag]:
                        cut(i)
                        if tag not in ("tr", "tbody", "thead"):
                            break
            if tag not in ("li", "td", "th", "dd", "dt", "tr") and counts.get("p"):
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"))
        attributes = m[3]
        if attributes.rstrip().endswith("/") and not is_block:
            continue
        top = stack[-1]
        marks = tag in _CONTENT or bool(attributes and re.search(r"articlebody|role\s*=\s*[\"']?main\b", attributes, re.I))
        article = top.article or marks
        dropped = top.dropped or tag in _DROPPED or (tag == "header" and not top.article)
        named = _named(attributes, tag, top.article, marks) if attributes and tag not in ("html", "body") else _PLAIN
        key = (top.path, _label(tag, attributes, is_block), article, named)
        path = known.get(key)
        if path is None:
            path = known[key] = len(page.above)
            page.above.append(top.path)
            page.label.append(key[1])
            page.article.append(article)
            page.named.append(max(named, page.named[top.path]) if named != _SUSPECT else named if page.named[top.path] != _OTHER else _OTHER)
        # what lies in a marked article has the article for its container, so that its short blocks are not lost
        container = top.container if top.article else path if marks else top.block if is_block else top.container
        counts[tag] = counts.get(tag, 0) + 1
        stack.append(_Node(tag, path, dropped, article, top.link or tag == "a", path if is_block else top.block, container, top.heading or tag in _HEADINGS, is_block))
    return page


def link_blocks(page: Page) -> set[int]:
    """Blocks that are links as a whole; links in headings count as plain text."""
    total: dict[int, list[int]] = {}
    for block, _, _, heading, link, value in page.runs:
        size = len(value.strip())
        found = total.setdefault(block, [0, 0])
        found[0] += size
        found[1] += size * (link and not heading)
    return {block for block, (chars, linked) in total.items() if chars and linked >= LINKED * chars}


def sums(page: Page, links: set[int]) -> dict[tuple[int, bool], Path]:
    """Sums of each path, apart for blocks that are links."""
    out: dict[tuple[int, bool], Path] = {}
    for block, path, container, _, link, value in page.runs:
        if ink := value.strip():
            found = out.setdefault((path, block in links), Path(container))
            found.chars += len(ink)
            found.texts += 1
            found.marks += len(_PUNCTUATION.findall(ink))
            found.linked += len(ink) * link
    return out


def _own(p: Path) -> float:
    plain = p.chars - p.linked
    return plain / p.texts * (plain / p.chars) * (1 + p.marks / p.texts)


def ratios(page: Page, paths: dict[tuple[int, bool], Path]) -> dict[tuple[int, bool], float]:
    """The fused ratio of each path: smoothed text and punctuation of the path and of its container.

    A list of links has no part in its container's ratio.
    """
    names = list(paths)
    own = [_own(paths[n]) for n in names]
    smooth = [(own[max(i - 1, 0)] + 2 * own[i] + own[min(i + 1, len(own) - 1)]) / 4 for i in range(len(own))]
    alone = {n: n[1] and paths[n].texts >= LINKS and paths[n].marks <= paths[n].texts for n in names}
    containers: dict[int, float] = {}
    for n, value in zip(names, smooth, strict=True):
        if not alone[n]:
            containers[paths[n].container] = containers.get(paths[n].container, 0.0) + value * paths[n].texts
    most, best = max(containers.values(), default=0.0) or 1.0, max(smooth, default=0.0) or 1.0
    return {n: 0.0 if alone[n] else (1 - CONTAINER) * value / best + CONTAINER * containers[paths[n].container] / most for n, value in zip(names, smooth, strict=True)}


def cleared(page: Page, paths: dict[tuple[int, bool], Path]) -> set[int]:
    """Suspects whose whole part reads like text: with punctuation, and a ratio near that of the page's best path."""
    best = max((_own(p) for p in paths.values()), default=0.0)
    root = list(range(len(page.above)))  # the suspect around a path, or itself
    total: dict[int, Path] = {}
    for path in range(1, len(page.above)):  # parents come first
        if page.named[path] == _SUSPECT and page.named[page.above[path]] == _SUSPECT:
            root[path] = root[page.above[path]]
    for (path, _), p in paths.items():
        if page.named[path] == _SUSPECT:
            t = total.setdefault(root[path], Path(0))
            t.chars, t.texts, t.marks, t.linked = t.chars + p.chars, t.texts + p.texts, t.marks + p.marks, t.linked + p.linked
    good = {r for r, t in total.items() if t.marks and _own(t) >= CLEARED * best}
    return {path for path in range(len(root)) if page.named[path] == _SUSPECT and root[path] in good}


def content_paths(page: Page, link_blocks: set[int]) -> set[tuple[int, bool]]:
    """Paths whose fused ratio, weighted by what the page says of them, is above the threshold.

    If lists of links are most of the text, they are what the page is about.
    """
    paths = sums(page, link_blocks)
    fused, clear = ratios(page, paths), cleared(page, paths)
    marked = any(page.article[path] for path, _ in paths)
    weight = {n: (OUTSIDE if marked and not page.article[n[0]] else 1.0) * (NAMED if page.named[n[0]] == _OTHER or (page.named[n[0]] == _SUSPECT and n[0] not in clear) else 1.0) for n in paths}
    links = {n for n in paths if not fused[n] and n[1] and weight[n] == 1.0}
    if links and 2 * sum(paths[n].chars for n in links) >= sum(paths[n].chars for n in paths if weight[n] == 1.0):
        return {n for n in paths if weight[n] == 1.0}
    least = THRESHOLD * max((fused[n] * weight[n] for n in paths), default=0.0)
    return {n for n in paths if fused[n] * weight[n] >= least and (paths[n].linked < 0.5 * paths[n].chars or paths[n].marks > paths[n].texts or page.article[n[0]])}


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    page = read(html)
    links = link_blocks(page)
    chosen = content_paths(page, links)
    out: list[str] = []
    held: list[str] = []
    last = None
    for block, path, _, _, _, value in page.runs:
        if block != last and held:
            out.append(" ".join("".join(held).split()))
            held = []
        last = block
        if (path, block in links) in chosen:
            held.append(value)
        elif held:
            held.append(" ")
    if held:
        out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` (earlier ones named as those added are replaced), then text and n_chars (code points)."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("text", "n_chars")]
    source = in_small_batches(pages).select(*dict.fromkeys([*keep, html]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(rows, extended(source.select(*keep).schema, "text string, n_chars long"))
