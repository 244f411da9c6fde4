"""Operator 8: main text of web pages by tag-path ratios.

Text blocks are grouped by their root-to-leaf tag path. Every path gets the ratio of its text (links not counted)
and punctuation to its nodes; a path is also measured by the one without its innermost wrapper. Ratios are smoothed
along the page, fused with the ratio of the enclosing container, and thresholded against that of the main
container, inside articles as well: an article or main element only weighs its blocks by a fixed factor. Elements
that are never part of an article (by HTML's own semantics, or by roles) are left out before; words of class names
and ids, and forms, are a factor on the ratios too. Paths, containers and marked elements are numbers that know
their parents, so a page costs time and memory in proportion to its size, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PUNCT = re.compile(r"[.,;:!?。，！？]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Fixed values of HTML: elements without end tags, elements whose content is not markup, and
#: elements that break a line.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object".split())
#: Of these, elements whose content is markup: where one is never closed, only its tag is left out.
_MARKUP = frozenset("noscript template svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
#: Never article text, by element and by role; and words of class names and ids that count against it.
_OUT = frozenset("nav aside footer button select dialog menu head label datalist canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner "
    "sidebar comment comments disqus reply replies cookie cookies consent gdpr notice notices newsletter subscribe "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social "
    "related recommended widget toolbar login signup register search pagination pager copyright disclaimer skip".split())
#: Words that say nothing beside a listed one.
_NEUTRAL = frozenset(
    "area bar block body box btn button buttons container content inner item items left link links list outer "
    "panel post posts right row section top bottom user wrap wrapper".split())
_FORMS, _FORM_ROLES, FORM = frozenset(("form", "fieldset")), frozenset(("form", "search")), 0.1
_KEEP = frozenset("html body main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("article main body section div".split())
#: A block is kept from this share of the main container's ratio; weights of blocks in the main text's article or
#: container and, on pages with an article, outside; a block's own part in the fusion with its container, and
#: what of the ratio of the path without its wrapper counts.
SHARE, INSIDE, OUTSIDE, OWN, UNWRAPPED = 0.5, 1.25, 0.3, 0.25, 0.5
_LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}


def _never(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element and all in it is boilerplate; ``inside``: within an article or main."""
    if tag in _KEEP:
        return False
    if tag in _OUT or (tag == "header" and not inside):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _penalty(tag: str, attrs: str, inside: bool) -> float:
    """The factor on an element's paths by its class and id: a name of listed words and nothing of
    its own counts as boilerplate, one with other words half."""
    if tag in _KEEP:
        return 1.0
    factor = FORM if tag in _FORMS else 1.0
    for m in _ATTR.finditer(attrs) if "=" in attrs else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role" and value.lower() in _FORM_ROLES:
            factor = FORM
        if m[1].lower() in ("class", "id"):
            for name in value.split():
                words = {w.lower() for w in _NAME.findall(name) if not w.isdigit()}
                if words & _WORDS or tag == "div" and not inside and "header" in words:
                    leaf = inside and tag in ("p", "blockquote", "li", "dd", "td", "pre")
                    factor = min(factor, 0.5 if leaf or words - _WORDS - _NEUTRAL - {"header"} else 0.1)
    return factor


class Page:
    """A page's text blocks, in order, and the tree they hang on.

    ``blocks``: text, path, container, article, characters in links, marked element, leaf tag. ``paths``: number of
    the enclosing path and tag, by path; ``containers``: enclosing container, path, and article, by container;
    ``marked``: enclosing marked element, factor, whether an article or main, and article, by element that has a factor
    below 1 or is an article or main. Number 0 is none; parents have lower numbers than what they hold.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, int, int, int, int, int, str]] = []
        self.paths: list[tuple[int, str]] = [(0, "")]
        self.containers: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.marked: list[tuple[int, float, bool, int]] = [(0, 1.0, False, 0)]
        self._number: dict[tuple[int, str], int] = {}
        # open elements: tag, path, left out, article, container, marked element; and where each tag is open
        self._stack: list[tuple[str, int, bool, int, int, int]] = [("", 0, False, 0, 0, 0)]
        self._open: dict[str, list[int]] = defaultdict(list)
        self._parts: list[str] = []
        self._at, self._links, self._linked = self._stack[0], 0, 0
        self._read(page)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                _, path, _, article, box, mark = self._at
                self.blocks.append((text, path, box, article, min(self._linked, len(text)), mark, self.paths[path][1]))
            self._parts.clear()

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if top[2] or not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        if not self._parts:
            if raw.isspace():
                return
            self._at, self._linked = top, 0
        self._parts.append(raw)
        if self._links:
            self._linked += len(raw.strip())

    def _last(self, tags: Iterable[str]) -> int:
        """The innermost open element of these tags, 0 if none is open."""
        return max((self._open[t][-1] for t in tags if self._open[t]), default=0)

    def _pop_to(self, i: int) -> None:
        while len(self._stack) > i:
            tag = self._stack.pop()[0]
            self._open[tag].pop()
            self._links -= tag == "a"

    def _close_open(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """End the innermost of ``tags`` if no element of ``within`` is open inside it."""
        i = self._last(tags)
        if i and i > self._last(within):
            self._pop_to(i)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            self._text(page[at: m.start() if m else n])
            if not m:
                break
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                if m[1] is not None:
                    self._text(m[1])
                continue
            end, attrs, tag = (m[2] or m[5]), (m[4] or m[7] or ""), tag.lower()
            if tag in _BLOCK:
                self._flush()
            if end:
                self._close_open((tag,), () if tag in _BLOCK else ("td", "th", "table", "article", "main", "body"))
                continue
            if tag in _RAW and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", close.end()) + 1 if close else 0
                at = stop or (at if tag in _MARKUP else n)
                continue
            if tag in _VOID or (attrs.endswith("/") and tag not in _BLOCK):
                continue
            if tag in _CLOSES_P:
                self._close_open(("p",), ("td", "th", "table", "article", "main", "section", "div", "body", "button"))
            if tag in _LISTS:
                self._close_open({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)), _LISTS[tag])
            self._push(tag, attrs)
        self._flush()

    def _push(self, tag: str, attrs: str) -> None:
        _, path, out, article, box, mark = self._stack[-1]
        # inline elements but links say nothing about a block's place
        if tag in _BLOCK or tag == "a":
            path = self._number.setdefault((path, tag), len(self.paths))
            if path == len(self.paths):
                self.paths.append((self._stack[-1][1], tag))
        own = tag in ("article", "main")
        if tag in _CONTAINERS or tag == "td" and not article:
            self.containers.append((box, path, article or (len(self.containers) if own else 0)))
            box = len(self.containers) - 1
        inside = article or (box if own else 0)
        factor = _penalty(tag, attrs, bool(article))
        if factor < 1 or own:
            self.marked.append((mark, factor, own, article))
            mark = len(self.marked) - 1
        self._links += tag == "a"
        self._open[tag].append(len(self._stack))
        self._stack.append((tag, path, out or _never(tag, attrs, bool(article)), inside, box, mark))


def _summed(own: list[float], parents: list[int]) -> list[float]:
    """Sums over all that hangs below each number: parents come before their children."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def factors(page: Page) -> list[float]:
    """The least factor of the elements around each block. A factor is lifted from an element with an
    article or main of at least half the largest one's prose, and from one with most of the prose of
    the article around it, or of a page without articles."""
    marked = page.marked
    up = [m[0] for m in marked]
    prose = [0.0] * len(marked)
    around: dict[int, float] = defaultdict(float)
    for text, _, _, article, link, mark, _ in page.blocks:
        prose[mark] += len(text) - link
        around[article] += len(text) - link
    prose = _summed(prose, up)
    own = [i for i, m in enumerate(marked) if m[2]]
    large = 0.5 * max((prose[i] for i in own if marked[i][1] == 1), default=0) or 0.5 * max((prose[i] for i in own), default=0)
    holds = [0.0] * len(marked)
    for i in own:
        if prose[i] >= large > 0:
            # an article with a factor of its own does not lift that
            holds[i if marked[i][1] == 1 else up[i]] += 1
    holds = _summed(holds, up)
    least = [1.0] * len(marked)
    for i in range(1, len(marked)):
        parent, factor, _, article = marked[i]
        lifted = holds[i] or (article or not own) and prose[i] > 0.5 * around[article]
        least[i] = min(least[parent], 1.0 if lifted else factor)
    return [least[b[5]] for b in page.blocks]


def scores(page: Page) -> tuple[list[float], float]:
    """Every block's fused score, and the ratio of the main container it is measured by."""
    found, factor = page.blocks, factors(page)
    # an article under a tenth of the largest one is no article by itself
    prose: dict[int, float] = defaultdict(float)
    for b, f in zip(found, factor):
        if b[3] and f == 1:
            prose[b[3]] += len(b[0]) - b[4]
    most = max(prose.values(), default=0)
    vouched = {a for a in prose if most > 0 and prose[a] >= 0.1 * most}

    # text and punctuation by tag path
    key = [(b[1], b[3] in vouched, f) for b, f in zip(found, factor)]
    chars, plain, marks, nodes = (defaultdict(float) for _ in range(4))
    for k, b in zip(key, found):
        text, link = b[0], b[4]
        signs = len(_PUNCT.findall(text))
        # linked text of many marks is a reference, not a menu
        link *= 1 - min(1, max(0, signs - 1) / 3) if len(text) >= 40 else 1
        chars[k] += len(text)
        plain[k] += len(text) - link
        marks[k] += signs * (1 - link / len(text))
        nodes[k] += 1
    ratio = {k: k[2] * math.sqrt((plain[k] / nodes[k]) * (1 + marks[k] / nodes[k])) for k in chars}
    share = {k: plain[k] / chars[k] for k in chars}

    def unwrapped(k: tuple[int, bool, float]) -> float:
        """The ratio of the path without the container around the leaf."""
        wrap, leaf = page.paths[k[0]]
        outer, tag = page.paths[wrap]
        return ratio.get((page._number.get((outer, leaf), -1), *k[1:]), 0.0) if tag in _CONTAINERS and leaf not in _CONTAINERS else 0.0

    own = [max(ratio[k], UNWRAPPED * unwrapped(k)) for k in key]
    # a heading has the ratio of what it heads, within one container
    for i in range(len(found) - 2, -1, -1):
        if found[i][6] in _HEADINGS and found[i][2] == found[i + 1][2] and factor[i] == factor[i + 1]:
            own[i] = max(own[i], own[i + 1])
    # the middle one of three neighbours of one container smooths without blurring the borders of the article
    near = [[own[j] if 0 <= j < len(own) and found[j][2] == found[i][2] else own[i] for j in (i - 1, i, i + 1)] for i in range(len(own))]
    smooth = [max(x, f * sorted(three)[1]) for x, f, three in zip(own, factor, near)]

    # containers of one path are one: an article in several sections is not ranked piece by piece
    group = [(b[3], page.containers[b[2]][1]) for b in found]
    weight, total = defaultdict(float), defaultdict(float)
    for g, b, k, s, f in zip(group, found, key, smooth, factor):
        for name in (g, b[3]) if f == 1 else ((g, None) if b[3] else (g,)):
            weight[name] += s * share[k] * len(b[0])
            total[name] += share[k] * len(b[0])
    main = max(vouched or set(group), key=lambda g: weight[g])
    if weight[main] <= 0:
        return [0.0] * len(found), 0.0
    best = weight[main] / total[main]
    fused = [s if f < 1 or not total[g] else s ** OWN * (weight[g] / total[g]) ** (1 - OWN) for s, f, g in zip(smooth, factor, group)]
    held = [b[3] in vouched for b in found] if vouched else _holding(page, [share[k] * x >= SHARE * best for k, x in zip(key, fused)])
    return [share[k] * x * (INSIDE if h else OUTSIDE if vouched else 1) for k, x, h in zip(key, fused, held)], best


def _holding(page: Page, passed: list[bool]) -> list[bool]:
    """Of a page without an article: blocks in containers of blocks that passed, or in the innermost one, the body
    apart, around nine tenths of their text."""
    up = [c[0] for c in page.containers]
    direct = [0.0] * len(up)
    for b, ok in zip(page.blocks, passed):
        direct[b[2]] += len(b[0]) * ok
    size = _summed(direct, up)
    around = max((i for i in range(1, len(up)) if size[i] >= 0.9 * size[0] > 0 and page.paths[page.containers[i][1]][1] != "body"), default=0)
    # containers of one path are one
    good = {page.containers[i][1] for i in range(1, len(up)) if direct[i]}
    inside = [False] * len(up)
    for i in range(1, len(up)):
        inside[i] = inside[up[i]] or i == around or page.containers[i][1] in good and page.paths[page.containers[i][1]][1] != "body"
    return [inside[b[2]] or page.containers[b[2]][1] in good for b in page.blocks]


def main_text(page: str) -> str:
    """The article of a page: kept blocks in page order, joined by one space."""
    read = Page(page)
    if not read.blocks:
        return ""
    score, best = scores(read)
    return " ".join(b[0] for b, s in zip(read.blocks, score) if best and s >= SHARE * best)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars (code points).

    Defined cases: null and empty html give the empty text; broken markup is read as browsers
    do in outline (open elements end with their parent); pages of any length and depth are read whole, in
    time and memory proportional to them; repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
