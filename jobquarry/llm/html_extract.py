"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its root-to-leaf path of block tags. A path also
carries the marks of its elements: a strong one for tags, roles and classes of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, a weak one for classes that articles use as well ("related", "discussion"). Marks keep
paths apart; an element that wraps the content loses its mark. Per path:

1. aggregate: mean text length and mean punctuation of its blocks, on log scales, and the share of text inside links;
2. smooth: along the page, runs of one path are averaged with their neighbours (1, 2, 1);
3. fuse: the geometric mean of a path's own ratio and its smoothed one, times a weight by its strongest mark (``WEIGHTS``;
   outside all articles of a page that has some it counts as marked strongly);
4. threshold: paths at ``SHARE`` of the text-weighted mean of paths without a strong mark, or above, are content paths.

Content paths select the content nodes: the deepest element that holds most of their text, widened to its ``article`` or
``main`` if it stands in one, and all other articles with a content path. The result is, in page order, the blocks of
content paths, wherever they stand, and within content nodes the unmarked blocks off them, such as headings, short items and
lists of links (lists of links only in articles and main parts), with headings beside content. Scripts, styles, controls and
hidden elements are no text. Nothing is cut: pages and blocks of any length are read whole.

States: null and empty pages give the empty string and 0; markup errors (unclosed or stray tags and comments) are
read as browsers do in the common cases; null ids and urls are kept; repeated rows are rows; extra columns are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by what they do to blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video map button select option optgroup textarea input label fieldset legend datalist noembed noframes".split())
MARKED = frozenset("nav footer aside dialog menu form".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class names and ids that mark boilerplate, strongly or weakly; those of layout, which lift a mark.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars aside rail footer footers masthead topbar cookie cookies consent gdpr notice notices popup modal overlay toast comment comments commentlist respond replies reply"
    " disqus share sharing social newsletter subscribe subscription signup signin login form forms pagination pager toolbar alerts notification notifications announcement infobar".split()
)
WEAK = frozenset("disclaimer discussion related recommended recommendations register search copyright skip hidden widget widgets alert".split())
GOOD = frozenset("content article post entry story main body text page wrapper container layout grid row col column site".split())
NEGATORS = frozenset("has with no without".split())
STATES = frozenset("open opened closed enabled disabled on off count".split())
SITE = frozenset("header site page top global main".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes of articles that are comments ("comments-open" speaks of an article that may have some).
COMMENT = re.compile(r"(?i)(?<![a-z])comments?(?![a-z-]*-?(?:open|closed|enabled|disabled|on|off|count))(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。]")
#: A path is content if its fused ratio reaches this share of the text-weighted mean.
SHARE = 0.35
#: What a path's ratio counts by its strongest mark: none, weak, strong.
WEIGHTS = (1.0, 0.5, 0.02)


def mark_of(names: str, framed: bool) -> int:
    """The mark of a class or id: by the first or last word of each of its names, or by any if no word of layout stands
    beside it; a name that is a word of layout lifts the marks of the others. A header counts only outside articles
    (``framed``: inside one)."""
    mark = 0
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        if not words or words[-1] in STATES:
            continue
        if len(words) == 1 and words[0] in GOOD:
            return 0
        if not framed and "header" in words and words[0] in SITE and len(words) <= 2:
            mark = 2
        for k, w in enumerate(words):
            if not (k and words[k - 1] in NEGATORS) and (k in (0, len(words) - 1) or not GOOD.intersection(words)):
                mark = max(mark, 2 if w in STRONG else int(w in WEAK))
    return mark


class Page:
    """Elements (parallel lists, parents before children) and text blocks of one page."""

    def __init__(self, html: str):
        self.tag, self.parent, self.drop, self.mark, self.comments = ["#"], [-1], [False], [0], [False]
        self.blocks: list[tuple[str, int, int]] = []  # text, element, characters inside links
        self.stack, self.open = [0], defaultdict(int)
        self.buffer: list[str] = []
        self.linked = self.at = 0
        self.read(html)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            if text:
                self.blocks.append((text, self.at, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        if not self.buffer:
            if raw.isspace():
                return
            self.at = next(e for e in reversed(self.stack) if self.tag[e] not in INLINE)
        self.buffer.append(raw)
        if self.open["a"]:
            self.linked += len(raw)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.tag[self.stack.pop()]] -= 1

    def close(self, names, limits) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in names:
                self.flush()
                self.pop_to(depth)
                return
            if tag in limits:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in CLOSES_P and self.open["p"]:
            self.close(("p",), ("button", "td", "th", "caption", "object"))
        if tag in CLOSED_BY:
            self.close(*CLOSED_BY[tag])
        drop, mark, comments, here = tag in DROPPED, 2 * (tag in MARKED), False, self.stack[-1]
        framed = self.open["article"] + self.open["main"] > 0
        if attributes and tag not in ("html", "body"):
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name in ("class", "id"):
                    comments |= COMMENT.search(value) is not None
                    if tag == "article":
                        mark = max(mark, 2 * comments)
                    elif tag != "main" and not (framed and tag in HEADINGS):
                        mark = max(mark, mark_of(value, framed))
                elif name == "role":
                    mark = max(mark, 2 * (value.lower() in ROLES))
                elif name == "style":
                    drop |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
                else:
                    drop |= name == "hidden" or value.lower() == "true"
        if tag == "header" and not framed:
            mark = 2
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(here)
        self.drop.append(drop or self.drop[here])
        self.mark.append(mark)
        self.comments.append(comments)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if tag == "br":
                self.text(" ")
            elif m[1]:
                if self.open[tag] > 0:
                    depth = max(k for k, e in enumerate(self.stack) if self.tag[e] == tag)
                    if tag in INLINE and any(self.tag[e] not in INLINE for e in self.stack[depth + 1 :]):
                        continue
                    if tag not in INLINE:
                        self.flush()
                    self.pop_to(depth)
            else:
                self.start(tag, m[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = close.end() if close else end
                    self.pop_to(len(self.stack) - 1)
        self.flush()


def paths_of(page: Page, blocks) -> tuple[list[str], list[int]]:
    """Of each element, its path and the strongest mark on it. Marks of elements that wrap the content don't count:
    those with an article, a main part or the page's title inside, or with most of the text in three paragraphs or more."""
    n = len(page.tag)
    framing, paragraphs, text = [t in ("article", "main", "h1") for t in page.tag], [t == "p" for t in page.tag], [0] * n
    for words, e, _ in blocks:
        text[e] += len(words)
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        framing[up] += framing[e]
        paragraphs[up] += paragraphs[e]
        text[up] += text[e]
    paths, marks = [""] * n, [0] * n
    for e in range(1, n):
        up, tag, mark = page.parent[e], page.tag[e], page.mark[e]
        wraps = framing[e] > (tag in ("article", "h1")) or (paragraphs[e] >= 3 and 5 * text[e] >= 3 * text[0])
        if mark and wraps and not page.comments[e] and tag not in ("nav", "footer", "aside", "header"):
            mark = 0
        paths[e] = paths[up] + ("" if tag in INLINE else f"/{tag}") + "!" * mark
        marks[e] = max(marks[up], mark)
    return paths, marks


def frames_of(page: Page, blocks, marks: list[int]) -> list[bool]:
    """Which elements stand in an article, or else in the main part; none if no block does."""
    for want in ("article", "main"):
        inside = [t == want for t in page.tag]
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[page.parent[e]]
        if any(inside[e] and marks[e] < 2 for _, e, _ in blocks):
            return inside
    return [False] * len(page.tag)


def content_paths(page: Page, blocks, paths: list[str], weights: list[float], share: float) -> tuple[set[str], dict[str, float]]:
    """The paths at the threshold or above, and the share of text inside links by path."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    weight: dict[str, float] = {}
    for text, e, linked in blocks:
        weight[paths[e]] = max(weight.get(paths[e], 0.0), weights[e])
        for k, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), linked)):
            sums[paths[e]][k] += v
    links = {p: linked / size for p, (_, size, _, linked) in sums.items()}
    ratio = {p: math.log1p(size / n) * (1 + math.log1p(signs / n)) * (1 - links[p]) for p, (n, size, signs, _) in sums.items()}
    line = [p for k, p in enumerate(paths[b[1]] for b in blocks) if not k or p != paths[blocks[k - 1][1]]]
    around: dict[str, list[float]] = defaultdict(list)
    for k, p in enumerate(line):
        left, right = line[max(0, k - 1)], line[min(len(line) - 1, k + 1)]
        around[p].append((ratio[left] + 2 * ratio[p] + ratio[right]) / 4)
    fused = {p: (ratio[p] * sum(x) / len(x)) ** 0.5 * weight[p] for p, x in around.items()}
    plain = [p for p in sums if weight[p] > WEIGHTS[2]]
    if not plain:
        return set(), links
    limit = share * sum(fused[p] * sums[p][1] for p in plain) / sum(sums[p][1] for p in plain)
    return {p for p, f in fused.items() if f >= limit}, links


def main_blocks(html: str, share: float = SHARE) -> list[str]:
    """The blocks of the main text, in page order."""
    page = Page(html)
    blocks = [b for b in page.blocks if not page.drop[b[1]]]
    if not blocks:
        return []
    paths, marks = paths_of(page, blocks)
    framed = frames_of(page, blocks, marks)
    some = any(framed)
    content, links = content_paths(page, blocks, paths, [WEIGHTS[2] if some and not f else WEIGHTS[m] for f, m in zip(framed, marks, strict=True)], share)

    inside: dict[int, int] = defaultdict(int)
    total, tops, chains = 0, set(), set()
    for text, e, _ in blocks:
        if paths[e] in content:
            total += len(text)
            while e > 0:
                inside[e] += len(text)
                chains.add(e)
                if page.tag[e] == "article":
                    tops.add(e)
                e = page.parent[e]
    if not total:
        return []
    node = max((e for e, w in inside.items() if 5 * w >= 4 * total), default=0)
    if node > 0 and node in {e for _, e, _ in blocks}:
        node = page.parent[node]
    up = node
    while up > 0 and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    tops.add(up if up > 0 else node)
    beside = {page.parent[e] for e in chains}
    out = []
    for text, e, _ in blocks:
        p, up, within, heading = paths[e], e, False, False
        while up >= 0 and not within:
            within = up in tops
            heading |= page.tag[up] in HEADINGS and page.parent[up] in beside
            up = page.parent[up]
        plain = 2 * links[p] <= 1
        if p in content or (marks[e] == 0 and ((within and (plain or framed[e])) or (heading and plain and framed[e] == some))):
            out.append(text)
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, the url, ``text`` (blocks joined by a line end) and ``n_blocks``."""

    def each(batches):
        for batch in batches:
            found = [main_blocks(h.as_py() or "") for h in batch.column(2)]
            texts = pa.array(["\n".join(b) for b in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pa.array([len(b) for b in found], pa.int64())], ["id", "url", "text", "n_blocks"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(each, "id long, url string, text string, n_blocks long").withColumnsRenamed({"id": id_col, "url": url_col})
