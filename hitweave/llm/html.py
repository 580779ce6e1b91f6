"""Main text of web pages by tree scoring.

A page becomes a tree of elements; broken markup is read as browsers do for the common cases (paragraphs end where a
block begins, stray end tags are ignored, a cut page ends all elements). Paragraphs give points for themselves, their
commas and their length to parent, grandparent and further ancestors, each share smaller; an element's points are
discounted by the part of its text that stands in links. The best element (or the article around it) and those
siblings that score near it or are plain paragraphs are kept; beside an article only further articles. Menus, headers,
footers, sidebars, notices, adverts, forms, comments and hidden elements are left out by element, role and class; by class
or id not if they hold an article or most of the page's text outside links (comments: all of it). Where no block is long
enough for points, an article's words or else all text outside the left-out parts are kept.

Defined cases: null and empty pages and pages without text outside the left-out parts give an empty text, text without any
element is kept whole; a character reference without a semicolon or a tag cut by the page's end are read as far as they go; repeated pages give
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hitweave.llm.words import slices

# fixed values: elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form button menu dialog fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts adbox banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead comment comments disqus respond replies cookie cookies consent gdpr notice popup modal overlay "
    "subscribe newsletter signup login share sharing social related widget pagination pager toolbar".split()
)
COMMENTS = frozenset("comment comments disqus respond replies".split())
PROTECTED = frozenset("html body article main".split())
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("html body article main section div ul ol dl table td th blockquote nav header footer aside form".split())

COMMAS = ",\uff0c\u3001\u060c"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "named", "comments", "score", "text", "links")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: frozenset[str] = frozenset()):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.comments = not COMMENTS.isdisjoint(named)
        self.parts: list[Node | str] = []
        self.score = 0.0
        self.text = self.links = 0


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is left out for what it is, and the parts left out that its class or id names."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True, frozenset()
    if not attributes.strip(" /\n") or tag in PROTECTED:
        return False, frozenset()
    a = {k.lower(): html.unescape(x or y or z or "") for k, x, y, z in ATTRIBUTE.findall(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "").lower()) or a.get("role", "").lower() in ROLES:
        return True, frozenset()
    names = re.split(r"[^a-z]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    return False, NAMES.intersection(names)


def _leave_out_named(root: Node) -> None:
    """Leave out elements named like menus and so on, but not around an article or most of the text outside
    links (comments: all of it); the text is that of the articles where they have some.
    """
    seen, todo = [], [root]
    while todo:  # ancestors come before what they hold
        x = todo.pop()
        if not x.out:
            seen.append(x)
            todo.extend(p for p in x.parts if isinstance(p, Node))
    if not any(x.named for x in seen):
        return
    holds = dict.fromkeys(seen, False)
    plain = {x: 0 if x.tag == "a" else sum(len(p.strip()) for p in x.parts if isinstance(p, str)) for x in seen}
    for x in reversed(seen):
        if x.parent is not None:
            plain[x.parent] += 0 if x.parent.tag == "a" else plain[x]
            holds[x.parent] |= holds[x] or x.tag in ("article", "main")
    inside = dict.fromkeys(seen, False)
    for x in seen:
        if x.parent is not None:
            inside[x] = inside[x.parent] or x.parent.tag in ("article", "main")
    whole = sum(plain[x] for x in seen if x.tag in ("article", "main") and not inside[x])
    for x in seen:
        if x.named and not holds[x]:
            of = whole or plain[root]
            x.out = bool(whole) and not inside[x] or plain[x] * 2 <= of or x.comments and plain[x] < of


def parse(page: str) -> Node:
    root = Node("#", None)
    stack = [root]
    places: dict[str, list[int]] = {}  # where the open elements of a tag are in the stack
    scopes = [0]
    at = 0

    def close(to: int) -> None:
        for x in reversed(stack[to:]):
            places[x.tag].pop()
            if x.tag in SCOPES:
                scopes.pop()
        del stack[to:]

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(html.unescape(text))

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK or tag in ENDS:
            over = ENDS.get(tag, frozenset()) | ({"p"} if tag in BLOCK else frozenset())
            while (i := max((places[t][-1] for t in over if places.get(t)), default=0)) and i >= scopes[-1]:
                close(i)
                if stack[-1].tag not in over:
                    break
        parent = stack[-1]
        out, named = _left_out(tag, m[3] or m[6] or "", bool(places.get("article") or places.get("main")))
        node = Node(tag, parent, parent.out or out, named)
        parent.parts.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(node)
    say(page[at:])
    _leave_out_named(root)
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Texts, and elements before and after what they hold, in page order; left-out elements are skipped."""
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        x, after = todo.pop()
        if isinstance(x, Node) and not after:
            if x.out:
                continue
            yield x, False
            todo.append((x, True))
            todo.extend((p, False) for p in reversed(x.parts))
        else:
            yield x, after


def _score(root: Node) -> list[Node]:
    """Give all elements their points; returns those that have some."""
    nodes, depth_of_link, where, blocks = [], 0, [root], [root]
    own: dict[Node, list[int]] = {}
    for x, after in _walk(root):
        if isinstance(x, str):
            size = len(x.strip())
            where[-1].text += size
            where[-1].links += size if depth_of_link else 0
            o = own.setdefault(blocks[-1], [0, 0])
            o[0] += size
            o[1] += sum(x.count(c) for c in COMMAS)
        elif not after:
            where.append(x)
            if x.tag in BLOCK:
                blocks.append(x)
            depth_of_link += x.tag == "a"
        else:
            where.pop()
            if x.tag in BLOCK:
                blocks.pop()
            depth_of_link -= x.tag == "a"
            nodes.append(x)
            if x.parent is not None and x is not root:
                x.parent.text += x.text
                x.parent.links += x.links
    for block, (size, commas) in own.items():
        if size < 25 or block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = 1 + commas + min(size / 100, 3)
        up, level = block.parent if block.tag not in ("div", "article", "section", "main", "body") else block, 0
        while up is not None and level < 5:
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    found = []
    for n in nodes:
        if n.score > 0 and n.text:
            n.score *= 1 - n.links / n.text
            if n.tag in ("article", "main"):
                n.score *= 1.5
            found.append(n)
    return found


def _blocks(root: Node) -> Iterator[str]:
    words: list[str] = []
    for x, _ in _walk(root):
        if isinstance(x, str):
            words.append(x)
        elif x.tag in BLOCK:
            yield " ".join("".join(words).split())
            words = []
        elif x.tag == "br":
            words.append(" ")
    yield " ".join("".join(words).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    found = _score(root)
    if found:
        best = max(found, key=lambda n: n.score)
        up = best
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        best = up or best
    else:  # nothing long enough: an article's few words, if there is one
        best = next((x for x, _ in _walk(root) if isinstance(x, Node) and x.tag in ("article", "main")), None)
        if best is None:
            return _rest(root)
    keep = [best]
    if best.parent is not None and best.parent is not root:
        least = best.score * 0.2
        keep = []
        for s in best.parent.parts:
            if s is best:
                keep.append(s)
            elif isinstance(s, Node) and not s.out and (best.tag not in ("article", "main") or s.tag == best.tag):
                density = s.links / s.text if s.text else 1.0
                if s.score >= least or s.tag == "p" and (s.text > 80 and density < 0.25 or s.text and not density):
                    keep.append(s)
    return " ".join(b for n in keep for b in _blocks(n) if b) or _rest(root)


def _rest(root: Node) -> str:
    """All text of a page but the left-out parts."""
    return " ".join(b for b in _blocks(root) if b)


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """All columns of the pages but the markup, and the main text."""
    names = [c for c in pages.columns if c not in (column, out)]
    at = pages.columns.index(column)
    keep = [pages.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), texts], [*names, out])

    fields = [pages.schema[c] for c in names]
    return pages.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
