"""HTML extraction by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf path of block-level tags and classes. Per path the
length of text, the punctuation and the length of links are summed over its nodes; the ratios of text
and of punctuation to nodes are fused into one value per path (less what is linked), smoothed along the page, and a path is content if its best block reaches
`level` times the page's best. What the page says of itself shifts that: a value counts `BONUS` times within what is marked as the text (article, main) and
`MENU` times in a menu. So menus, link lists, adverts and other short lines go by their ratios, inside and outside of articles alike.

Ratios can't tell long sentences of one kind from those of another, so for some containers names are asked as well: footers, sidebars and
headers of the page by their tag or role never are content; forms and those
named as boilerplate by a whole part of their class or id (notices, adverts, comments) only if their fused ratios times lengths
are more than those of all the page beside them, what is marked there counted `MARKED` times.

An article is taken if one of its paths is content or if its fused ratios times lengths, counted `MARKED` times, reach half of the most that another one or
all the rest has. Since short headings, lists and lines belong to the text that they stand in, its blocks of low ratio stay too, but for menus and for what is
mostly links before or behind all its content. Outside of articles, what stands between two blocks of content, in the container of one or as a heading above the first is kept
too; directly in the body, a menu's links before or after all content are not.

Defined results: null html is empty; a page without content gives an empty text and n_chars 0; unclosed elements end where
HTML says (a new paragraph ends the one before), other stray or unclosed tags end the block; blocks of equal ratios are treated alike; repeated rows each get a row; an empty table gives an
empty result; very long pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z][a-zA-Z0-9]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr wbr br img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("head script style noscript template footer aside iframe svg math button select textarea title object audio video canvas map dialog xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "thead"), "tbody": ("tbody", "thead")}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav footer header form blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption address".split())
ROOTS = ("", "html", "body")
_WORDS = frozenset("ad ads adv nav navbar navigation menu header masthead footer banner notice notices alert popup modal overlay toolbar widget share sharing social login signup search meta tags pager pagination consent gdpr".split())
_NAMES = frozenset("advert adverts advertisement advertisements advertising advertorial comment comments commentlist commentform sidebar sidebars cookie cookies cookiebar sponsor sponsors sponsored promo promos promotion promotions promoted newsletter newsletters subscribe subscription subscriptions breadcrumb breadcrumbs related recommended disqus respond replies sitenav menubar".split())
_PARTS = frozenset("bar bars block box boxes button buttons container form icon icons inner item items link links list panel row section wrap wrapper top bottom left right main site page".split())
_ROLES = frozenset("banner contentinfo complementary search alert alertdialog dialog".split())
_MENUS = frozenset("nav menu navigation menubar".split())
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Times that the weight of a marked element counts against the rest of the page.
MARKED = 12
#: What a value counts within an article, and in a menu.
BONUS, MENU = 2.0, 0.5
_PUNCT = re.compile(r"[.,;:!?…、。，？！]")


class Block(NamedTuple):
    path: str
    #: Number of the article that it stands in, or 0.
    article: int
    text: str
    #: Length of what is linked.
    link: int
    #: Containers around it that are named as boilerplate, from the outermost in.
    doubts: tuple[int, ...]
    menu: bool


def named(token: str, inside: bool, article: bool) -> bool:
    """Whether a class or id says boilerplate; in and on an article, menu words do only if they are all of it."""
    for parts in (re.split(r"[^a-z0-9]+", token.lower()), re.split(r"[^a-z0-9]+", _HUMP.sub("-", token).lower())):
        if any(p.rstrip("0123456789") in _NAMES for p in parts):
            return True
        words = [p for p in parts if p in _WORDS and not (inside and p == "header")]
        if words and not article and (not inside or all(p in _WORDS or p in _PARTS or not p for p in parts)):
            return True
    return False


def boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, bool, str]:
    """(whether the container never holds content, whether it does only if it holds most of the page, whether it is a menu, its class names); inside: within an article."""
    names = ""
    drop = tag in SKIP or tag == "header" and not inside
    doubt = tag == "form"
    menu = tag in _MENUS
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                doubt |= value.lower() == "form"
                drop |= value.lower() in _ROLES
                menu |= value.lower() in _MENUS
            elif key == "hidden":
                drop = True
            elif key == "aria-hidden":
                drop |= value.lower() == "true"
            else:
                if key == "class":
                    names = ".".join(value.lower().replace("/", "_").split())
                if tag not in ("html", "body", "article", "main") or key == "class" and tag == "article":
                    doubt |= any(named(t, inside, tag == "article") for t in value.split())
    return drop, doubt, menu, names


def read_blocks(html: str) -> list[Block]:
    """All blocks of text that may be content."""
    out: list[Block] = []
    stack: list[tuple[str, bool, str, int, tuple[int, ...], bool]] = []  # tag, dropped, path, article, doubtful containers, menu
    text: list[str] = []
    link = articles = anchors = doubts = 0

    def close() -> None:
        nonlocal link
        if text:
            t = " ".join("".join(text).split())
            if t and not (stack and stack[-1][1]):
                _, _, path, article, within, menu = stack[-1] if stack else ("", False, "", 0, (), False)
                out.append(Block(path, article, t, link, within, menu))
            text.clear()
        link = 0

    def pop_to(k: int) -> None:
        close()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece and not (stack and stack[-1][1]):
            piece = unescape(piece)
            text.append(piece)
            if anchors:
                link += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                anchors = 0 if m[1] else 1
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                close()
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        close()
        if tag in CLOSES_P or tag in SAME:
            ends = SAME.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        _, dropped, path, article, within, menu = stack[-1] if stack else ("", False, "", 0, (), False)
        if tag in ("html", "body"):
            dropped = False
        if not dropped:
            dropped, doubt, named_menu, names = boilerplate(tag, m[3], bool(article))
            menu = menu or named_menu
            path = f"{path}/{tag}{'.' + names if names else ''}"
            if tag in ("article", "main") and not article and not dropped:
                articles += 1
                article = articles
            if doubt:
                doubts += 1
                within = (*within, doubts)
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append((tag, dropped, path, article, within, menu))
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = end.start() if end else n
    close()
    return out


def path_sums(blocks: list[Block]) -> dict[str, list[int]]:
    """Of each path: length of text, punctuation, nodes, length of links."""
    paths: dict[str, list[int]] = {}
    for b in blocks:
        p = paths.setdefault(b.path, [0, 0, 0, 0])
        p[0] += len(b.text)
        p[1] += len(_PUNCT.findall(b.text))
        p[2] += 1
        p[3] += min(b.link, len(b.text))
    return paths


def fused_ratios(blocks: list[Block]) -> np.ndarray:
    """The smoothed value of each block: text and punctuation per node of its path, less what is linked."""
    paths = path_sums(blocks)
    value = {k: np.log1p(l / n) * np.log1p(1 + q / n) * (1 - a / max(1, l)) for k, (l, q, n, a) in paths.items()}
    raw = np.array([value[b.path] for b in blocks])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel, "same")
    return np.maximum(raw * 0.7, 0) + 0.3 * np.convolve(raw, kernel, "same")[: len(raw)] / weight[: len(raw)] if len(raw) >= 5 else raw


def without_boilerplate(blocks: list[Block]) -> list[Block]:
    """The blocks outside of doubtful containers, and in those that weigh more than all of the page beside them."""
    if not any(b.doubts for b in blocks):
        return blocks
    weights = fused_ratios(blocks) * [len(b.text) for b in blocks]
    total = float(weights.sum())
    held: dict[int, float] = {}
    for b, w in zip(blocks, weights):
        for c in b.doubts:
            held[c] = held.get(c, 0.0) + w
    freed: set[int] = set()
    for c in sorted(c for c, w in held.items() if 2 * w > total):  # the outer ones first
        marked = sum(w for b, w in zip(blocks, weights) if b.article and c not in b.doubts and freed.issuperset(b.doubts))
        if held[c] > total - held[c] + (MARKED - 1) * marked:
            freed.add(c)
    return [b for b in blocks if freed.issuperset(b.doubts)]


def container(path: str) -> str:
    """The innermost element on the path that holds flowing text with its headings, lists, quotes and tables."""
    steps = path.split("/")
    while steps[-1].split(".")[0] in FLOW:
        steps.pop()
    return "/".join(steps)


def extract(html: str, level: float = 0.5) -> str:
    """The main text of a page: its content blocks, joined by two line feeds."""
    blocks = without_boilerplate(read_blocks(html))
    if not blocks:
        return ""
    fused = fused_ratios(blocks)
    most = float(fused.max())
    if most <= 0:
        return ""
    # a path is content if its best block reaches a part of the page's best
    best: dict[tuple[str, bool], float] = {}
    weight: dict[int, float] = {}
    for b, f in zip(blocks, fused):
        key = (b.path, bool(b.article))
        best[key] = max(best.get(key, 0.0), f * (BONUS if b.article else 1) * (MENU if b.menu else 1))
        weight[b.article] = weight.get(b.article, 0.0) + f * len(b.text) * (MARKED if b.article else 1)
    passed = [best[b.path, bool(b.article)] >= level * most for b in blocks]
    # an article is taken by a path in it, or by its weight
    taken = {a for a, w in weight.items() if a and w >= level * max(weight.values())}
    taken |= {b.article for b, f, ok in zip(blocks, fused, passed) if b.article and ok and f >= level * most}
    take = [ok and (not b.article or b.article in taken) for b, ok in zip(blocks, passed)]
    # blocks of low ratio belong to the article that they stand in, but for menus and link lists at its ends
    ends: dict[int, tuple[int, int]] = {}
    for k, b in enumerate(blocks):
        if take[k] and b.article:
            ends[b.article] = (ends.get(b.article, (k, k))[0], k)
    for k, b in enumerate(blocks):
        if b.article in taken and not b.menu:
            low, high = ends.get(b.article, (k, k))
            take[k] |= 2 * b.link < len(b.text) or low < k < high
    # headings, lists and other short blocks outside of articles belong to the content that they stand in, between or above
    loose = [k for k, b in enumerate(blocks) if not b.article and take[k]]
    if loose:
        homes = {container(blocks[k].path) for k in loose}
        inner = tuple(f"{h}/" for h in homes | {blocks[k].path.rsplit("/", 1)[0] for k in loose} if h.rsplit("/", 1)[-1] not in ROOTS)
        for k, b in enumerate(blocks):
            heading = b.path.rsplit("/", 1)[-1].split(".")[0] in HEADINGS
            beside = container(b.path) in homes and (heading or 2 * b.link < len(b.text))
            take[k] |= not b.article and not b.menu and (loose[0] < k < loose[-1] or b.path.startswith(inner) or beside)
        for k in range(loose[0] - 1, -1, -1):
            if blocks[k].article or blocks[k].menu or blocks[k].path.rsplit("/", 1)[-1].split(".")[0] not in HEADINGS:
                break
            take[k] = True
    return "\n\n".join(b.text for b, t in zip(blocks, take) if t)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
