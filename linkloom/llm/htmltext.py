"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style noscript template iframe noembed noframes object svg math canvas video audio map "
                   "select option datalist textarea head title button fieldset input label dialog".split())
APART = frozenset("nav footer aside menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output progress "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form "
                  "toolbar status".split())
# Words of class names and ids that hint at what is not part of an article; the second list names text by others than
# its author, of which there may be more than of the article.
NOTICES = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie "
                    "cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
                    "overlay paywall popup promo promoted promotion recommended recommendations related search share "
                    "sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar "
                    "widget widgets".split())
OTHERS = frozenset("comment comments commentlist disqus replies reply".split())
# Elements that an open one of the same class ends.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
        "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
_SCOPE = frozenset("ul ol dl table div article section main body td th blockquote nav aside header footer".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?P<name>[^\s=\"'/>]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?]")

# Weight of the neighbouring blocks when scores are smoothed, and the share of the mean score that a path needs.
NEIGHBOUR = 0.25
THRESHOLD = 0.5
# An element that only its names make suspect is taken for a wrapper of the article if the sentences outside all such
# elements have less than this share of its own: by a word of NOTICES, and by one of OTHERS or a form.
OUTSIDE = (0.25, 0.02)
# An article or main element is the article if it holds more than this share of all content.
MOST = 0.5


@dataclass
class Block:
    path: str
    text: str
    apart: bool
    suspect: tuple[int, ...]
    region: tuple[int, ...]
    links: int
    tags: int


def _apart(tag: str, attrs: str, inside: bool) -> int:
    """Is the element no part of an article? 3 by its tag, role or state; 1 suspect by its class or id, 2 as text by others
    or a form; else 0. ``inside``: of an article or main element, whose header belongs to it."""
    if tag in SILENT or tag in APART or tag == "header" and not inside:
        return 3
    kind = 2 if tag == "form" else 0
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m["name"].lower(), html.unescape(m["a"] or m["b"] or m["c"] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 3
        if name == "role" and value.lower() in ROLES - {"form"}:
            return 3
        if name == "style" and "display:none" in _SPACE.sub("", value.lower()):
            return 3
        if name in ("class", "id") and tag not in INLINE and tag not in ("body", "html", "main"):
            words = {w.lower() for w in _NAME_WORDS.findall(value)}
            kind = max(kind, 2 if words & OTHERS else 1 if words & NOTICES else 0)
    return kind


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks of text in page order, with their root-to-leaf path and the containers they lie in, and the elements that
    are suspect by their names (1 or 2, see ``_apart``). One that holds a first heading is not."""
    out: list[Block] = []
    kinds: dict[int, int] = {}
    # tag, apart (it or what it lies in), number of the element, in a link, path and region without inline elements,
    # apart by an inline element, suspect elements, inside an article or main element
    stack: list[tuple] = [("#root", False, 0, False, "#root", (0,), False, (), False)]
    numbered, at, cells, links, tags, first = 0, 0, [], 0, 0, stack[0]

    def close() -> None:
        nonlocal cells, links, tags
        if cells:
            text = " ".join("".join(cells).split())
            if text:
                out.append(Block(first[4], text, first[1], first[7], first[5], links, max(1, tags)))
            cells = []
        links = tags = 0

    def say(raw: str, plain: bool = False) -> None:
        nonlocal links, first
        text = raw if plain else html.unescape(raw)
        if not cells and not text.strip():
            return
        top = stack[-1]
        if cells and first[1] != top[1]:
            if not text.strip() or top[6]:  # an aside inside a sentence
                return
            close()
        if not cells:
            first = top
        if top[3]:
            links += len(text.strip())
        cells.append(text)

    def shut(down_to: int) -> None:
        for s in stack[down_to:]:
            if s[0] not in INLINE:
                close()
                break
        del stack[down_to:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"], True)
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        tags += 1
        if m["end"]:
            if tag == "br":
                close()
            if tag == "p" and not any(s[0] == "p" for s in stack):
                close()
            limit = next((i for i in range(len(stack) - 1, 0, -1)
                          if stack[i][0] == tag or stack[i][0] in _SCOPE and tag in INLINE), 0)
            if limit and stack[limit][0] == tag:
                shut(limit)
            continue
        if tag == "br" or tag == "hr":
            close()
            continue
        if tag in VOID:
            continue
        if tag in _CLOSES_P:  # these end an open paragraph, with what is open inside it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    shut(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        for other in ENDS.get(tag, "").split():
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == other:
                    shut(i)
                    break
                if stack[i][0] in _SCOPE and stack[i][0] not in ("td", "th"):
                    break
        if tag not in INLINE:
            close()
        numbered += 1
        above, inline = stack[-1], tag in INLINE
        own = _apart(tag, m["attrs"], above[8])
        suspect = above[7]
        if own in (1, 2):
            kinds[numbered] = own
            suspect = (*suspect, numbered)
        if tag == "h1" and not above[1]:
            for number in suspect:
                kinds.pop(number, None)
        stack.append((tag, above[1] or own == 3, numbered, above[3] or tag == "a",
                      above[4] if inline else f"{above[4]}/{tag}", above[5] if inline else (*above[5], numbered),
                      above[6] or own == 3 and inline, suspect, above[8] or tag in ("article", "main")))
        if m["attrs"].endswith("/") and tag in ("svg", "math", "path", "use"):
            stack.pop()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
            if tag not in SILENT:
                say(page[at:end.start()], True)
            at = end.end()
            shut(len(stack) - 1)
    close()
    return out, kinds


def _sentences(b: Block) -> int:
    """Characters of a block outside links, if it has a punctuation mark."""
    return max(0, len(b.text) - b.links) if _PUNCT.search(b.text) else 0


def without_suspects(found: list[Block], kinds: dict[int, int]) -> list[Block]:
    """Blocks outside suspect elements. An element whose sentences outweigh all those outside suspect elements is no
    sidebar but wraps the article: the largest such is cleared, until there is none."""
    kinds = dict(kinds)
    while True:
        outside, held = 0, defaultdict(int)
        for b in found:
            first = next((e for e in b.suspect if e in kinds), None)
            if first is None:
                outside += _sentences(b)
            else:
                held[first] += _sentences(b)
        wrapper = max((e for e in held if outside < OUTSIDE[kinds[e] - 1] * held[e]), key=lambda e: held[e], default=None)
        if wrapper is None:
            return [b for b in found if not any(e in kinds for e in b.suspect)]
        del kinds[wrapper]


def path_scores(found: list[Block]) -> dict[str, float]:
    """Per tag path: the text ratio (characters per tag) and the punctuation ratio (marks per tag) of all its
    blocks, less what is link text, fused as a geometric mean and smoothed over the page."""
    chars, marks, tags, linked = (defaultdict(int) for _ in range(4))
    for b in found:
        chars[b.path] += len(b.text)
        linked[b.path] += min(b.links, len(b.text))
        marks[b.path] += len(_PUNCT.findall(b.text))
        tags[b.path] += b.tags
    score = {}
    for p in chars:
        plain = chars[p] - linked[p]
        score[p] = np.sqrt(plain / tags[p] * (1 + marks[p]) / tags[p]) * plain / chars[p]
    raw = np.array([score[b.path] for b in found])
    near = np.concatenate([raw[:1], raw, raw[-1:]])
    smooth = (1 - 2 * NEIGHBOUR) * raw + NEIGHBOUR * (near[:-2] + near[2:])
    total, weight = defaultdict(float), defaultdict(int)
    for b, s in zip(found, smooth):
        total[b.path] += s * len(b.text)
        weight[b.path] += len(b.text)
    return {p: total[p] / weight[p] for p in total}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a newline; empty if there is none.

    Blocks in menus, site headers, footers, asides, scripts and what is hidden are no candidates, nor those in elements that
    are suspect by their names and hold no more than what is outside (``without_suspects``). Tag paths are scored, and
    those above a share of the mean are content. The article is the innermost article or main element that holds most of
    all content, or else what holds all of it but small articles beside it. Headings and short paragraphs in there belong
    to the text too, paths below the threshold that are mostly links do not.
    """
    found, kinds = blocks(page or "")
    found = without_suspects([b for b in found if not b.apart], kinds)
    if not found:
        return ""
    scores = path_scores(found)
    mean = sum(scores[b.path] * len(b.text) for b in found) / sum(len(b.text) for b in found)
    chosen = {p for p, s in scores.items() if s >= THRESHOLD * mean}
    content = [b for b in found if b.path in chosen]
    total = sum(len(b.text) for b in content)
    held, depth = defaultdict(int), {}
    for b in content:
        for i, (tag, number) in enumerate(zip(b.path.split("/"), b.region)):
            if tag in ("article", "main"):
                held[number] += len(b.text)
                depth[number] = (i, number)
    under = sum(len(b.text) for b in content if any(r in held for r in b.region))
    best = max((e for e in held if held[e] > MOST * total), key=depth.get, default=None)
    if best is not None:
        kept = [b for b in found if best in b.region]
    elif under > MOST * total:  # many articles of like size: what they hold
        kept = [b for b in found if any(r in held for r in b.region)]
    else:
        content = [b for b in content if not any(r in held for r in b.region)]
        common = content[0].region
        for b in content[1:]:
            n = next((i for i, (x, y) in enumerate(zip(common, b.region)) if x != y), min(len(common), len(b.region)))
            common = common[:n]
        # A heading before the container (as in a page without any wrapper) is in the same parent and stays.
        kept = [b for b in found if common[-1] in b.region and not any(r in held for r in b.region)]
    links, chars = defaultdict(int), defaultdict(int)
    for b in kept:
        links[b.path] += min(b.links, len(b.text))
        chars[b.path] += len(b.text)
    return "\n".join(b.text for b in kept if b.path in chosen or not links[b.path] * 2 > chars[b.path])


def extract(pages: DataFrame, text: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in ``name``, which replaces a column of that name. A null page has an empty
    text. Pages are independent: nothing is shuffled."""
    rest = pages.drop(name) if name != text else pages
    out = T.StructType([f for f in rest.schema.fields if f.name != name] + [T.StructField(name, T.StringType())])
    at = rest.columns.index(text)
    kept = [i for i, f in enumerate(rest.schema.fields) if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(t.as_py()) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), texts], names=[f.name for f in out.fields])

    return rest.mapInArrow(run, out)
