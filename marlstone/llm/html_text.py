"""Main text of web pages by tag-path ratios.

Text is gathered into blocks, each with the tag path from the root to where it stands. Per path, the page's text length and
punctuation are summed and set against the number of blocks; both ratios are smoothed along the page. A path's own ratios, the
smoothed ones and the share of text that is not linked are fused, and paths whose fused ratio reaches a share of the best are
strong; those mostly of links are menus. The strong blocks tell where the article is: the smallest element that holds them, widened to
an enclosing <article>. What stands there stays, however short, but for menus and the headings that lead only to them; directly in the body, only what lies
between strong blocks does. A heading right before stays, and so does all from the last <h1> on where no menu lies between. Where
most strong text is in elements marked as the article, strong blocks outside count no more. Parts that are no prose by their
element or naming (navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) never take part.

Defined results: null, empty and text-free pages give an empty text of 0 characters; each row stands on its own, so
repeated rows repeat; of a page of nothing but links only what is in marked elements stays; broken markup (unclosed or stray tags, a cut-off page) is read as far as it goes; columns other
than page_id, url and html are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.llm.common import bound_batches, map_texts, table

#: Elements whose text is never part of an article (fixed values).
SKIPPED = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea iframe object svg math canvas "
    "audio video dialog menu label input datalist map title".split()
)
#: Elements that end a block of text (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag (fixed values).
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
#: What ends an open element that needs no end tag of its own (fixed values).
ENDS_P = BLOCK - {"br", "caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}
#: Words that mark a part as no prose (fixed values), when a whole name of a class, id or role is made of them and of BESIDE.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts "
    "popup modal newsletter subscribe menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets header masthead topbar footer "
    "contentinfo complementary comment comments disqus replies respond discussion related recommended recommendations share sharing social "
    "pagination pager toolbar login signup search form dialog hidden".split()
)
#: Words that say where or how often such a part stands (fixed values).
BESIDE = frozenset(
    "site page main top bottom left right global primary secondary sticky user reader box bar area wrap wrapper container list item items section block "
    "links buttons posts articles inner outer".split()
)
#: Elements marked as the article (fixed values).
MARKED = frozenset(("article", "main"))
#: Short by nature, so they stand with what they head.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption dt".split())
#: Kept within the article even where they are wholly linked.
LABELS = HEADINGS | {"figcaption"}
KEPT_ROOTS = frozenset(("html", "body", "article", "main"))
#: Share of the best fused ratio that a strong path needs, and share of linked text that makes a menu.
THRESHOLD, MENU = 0.25, 0.5
PUNCTUATION = ".,;:!?…。，、！？"

_token = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_segments = re.compile(r"[-_]+")
_named_by = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_hidden = re.compile(r"\s(?:hidden(?=[\s=/>])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)


class Block:
    """A run of text without a block boundary: where it stands and how much of it is linked."""

    __slots__ = ("path", "within", "parts", "linked", "marked")

    def __init__(self, path: str, within: tuple[int, ...], marked: bool) -> None:
        """within: the numbers of the elements on the path; marked: whether one of them is marked as the article."""
        self.path, self.within, self.marked, self.parts, self.linked = path, within, marked, [], 0

    @property
    def last(self) -> str:
        """The element that the text stands in."""
        return self.path.rpartition("/")[2]


def no_prose(value: str) -> bool:
    """Whether one of the names in a class, id or role is made of the words that mark a part as no prose."""
    for name in value.lower().split():
        words = _segments.split(name.strip("-_"))
        if not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The page's blocks of visible text outside skipped parts, in page order."""
    out: list[Block] = []
    names: list[str] = []
    numbers: list[int] = []
    opened = 0
    skipping: list[bool] = []
    at, links = 0, 0
    current: Block | None = None
    raw_end: re.Pattern | None = None

    def pop(to: int) -> None:
        nonlocal links
        for name in names[to:]:
            links -= name == "a"
        del names[to:], numbers[to:], skipping[to:]

    def close(names_: tuple[str, ...] | str, barriers: tuple[str, ...] = ()) -> None:
        for i in range(len(names) - 1, -1, -1):
            if names[i] in names_:
                pop(i)
                return
            if names[i] in barriers:
                return

    def text(piece: str) -> None:
        nonlocal current
        if not piece or skipping and skipping[-1]:
            return
        if current is None:
            if not piece.strip():
                return
            path = "/".join(n for n in names if n in BLOCK)
            current = Block(path, tuple(i for i, n in zip(numbers, names, strict=True) if n in BLOCK), not MARKED.isdisjoint(names))
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    end = len(html)
    while at < end:
        found = _token.search(html, at)
        if found is None:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            current = None
        if found["end"]:
            if tag in names:
                close((tag,), () if tag in BLOCK else tuple(BLOCK - {"p"}))
            continue
        if tag in ENDS_P and "p" in names:
            close(("p",), ("button", "td", "th", "table", "article", "section", "div", "main"))
        if tag in ENDS_SAME:
            close((tag,), ENDS_SAME[tag])
        if tag in VOID:
            continue
        rest = found["rest"]
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)
            last = raw_end.search(html, at)
            at = last.end() if last else end
            continue
        skip = bool(skipping and skipping[-1]) or tag in SKIPPED
        if not skip and len(rest) > 2 and tag not in KEPT_ROOTS:
            skip = bool(_hidden.search(" " + rest)) or any(no_prose(" ".join(m)) for m in _named_by.findall(" " + rest))
        opened += 1
        names.append(tag), numbers.append(opened), skipping.append(skip)
        links += tag == "a"
    return out


def main_text(html: str) -> str:
    """The article's blocks, white space squeezed, one a line."""
    found = []
    for block in blocks(html):
        # references are decoded after the markup is gone, so that decoded brackets are text
        squeezed = " ".join(unescape("".join(block.parts)).split())
        if squeezed:
            found.append((block, squeezed))
    if not found:
        return ""
    strong, menus = ratios(found)
    own = [block for block, _ in found]
    size = [0, 0]
    for block, body in found:
        if block.path in strong:
            size[block.marked] += len(body)
    inside = size[1] > size[0]
    at = [i for i, block in enumerate(own) if block.path in strong and (block.marked or not inside)]
    stay = _article(own, at, menus)
    return "\n".join(body for (_, body), ok in zip(found, stay, strict=True) if ok)


def ratios(found: list[tuple[Block, str]]) -> tuple[set[str], set[str]]:
    """The strong paths of a page and those that are mostly links, from its blocks and their texts."""
    sums: dict[str, list[int]] = {}
    for block, body in found:
        own = sums.setdefault(block.path, [0, 0, 0, 0])
        own[0] += len(body)
        own[1] += sum(map(body.count, PUNCTUATION))
        own[2] += 1
        own[3] += min(block.linked, len(body))
    length = {path: size / n for path, (size, _, n, _) in sums.items()}
    points = {path: (marks + 1) / (n + 1) for path, (_, marks, n, _) in sums.items()}
    free = {path: 1 - linked / size for path, (size, _, _, linked) in sums.items()}
    # smoothed over the neighbours of each block; a path has the mean of its blocks, beside its own ratio, so neighbours alone make none strong
    near: dict[str, float] = {}
    for (block, _), x, y in zip(found, _smooth([length[b.path] for b, _ in found]), _smooth([points[b.path] for b, _ in found]), strict=True):
        near[block.path] = near.get(block.path, 0.0) + sqrt(x * y) / sums[block.path][2]
    fused = {path: free[path] * sqrt(sqrt(length[path] * points[path]) * near[path]) for path in sums}
    best = max(fused.values())
    return {path for path, ratio in fused.items() if ratio >= THRESHOLD * best and free[path] > MENU}, {path for path in sums if free[path] <= MENU}


def _article(own: list[Block], at: list[int], menus: set[str]) -> list[bool]:
    """Which blocks are the article's, from the places `at` of strong ones and the paths of menus."""
    stay = [False] * len(own)
    if not at:  # nothing but links: only what is marked
        return [b.marked for b in own]
    low, high = min(own[i].within[:-1] for i in at), max(own[i].within[:-1] for i in at)
    shared = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    tags = own[at[0]].path.split("/")[:shared] if shared else []
    if "article" in tags:
        shared = len(tags) - tags[::-1].index("article")
    home, whole = low[:shared], not {"html", "body"}.issuperset(tags)
    first, last = at[0], at[-1]
    menu = [b.path in menus and b.last not in LABELS for b in own]
    if whole:  # the blocks of one element follow each other
        while first and own[first - 1].within[:shared] == home:
            first -= 1
        while last + 1 < len(own) and own[last + 1].within[:shared] == home:
            last += 1
    stay[first : last + 1] = [not m for m in menu[first : last + 1]]
    for i in range(last - 1, first - 1, -1):  # a heading that only leads to a menu goes with it
        stay[i] = stay[i] and (own[i].last not in HEADINGS or stay[i + 1])
    top = next((i for i in range(first - 1, -1, -1) if menu[i] or own[i].last == "h1"), None)
    if top is not None and not menu[top]:
        stay[top:first] = [True] * (first - top)
    for i in range(first - 1, -1, -1):
        if own[i].last not in HEADINGS:
            break
        stay[i] = True
    return stay


def _smooth(values: list[float]) -> list[float]:
    """Means of each value and its neighbours, weighted 1, 2, 1."""
    padded = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:])]


SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extractor() -> Callable[[list[bytes | None]], dict]:
    def step(pages: list[bytes | None]) -> dict:
        texts = [main_text(raw.decode()) if raw else "" for raw in pages]
        return {"text": texts, "n_chars": list(map(len, texts))}

    return step


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, the main text of each page and its length in code points."""
    return map_texts(pages, keep, extractor, SCHEMA, "html")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
