"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, halved at each step up; a container's points are
discounted by its link density; the best container is kept with those of its siblings that score well or read like
paragraphs. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are taken
out of the tree before, by element or by the words of class, id and role. One pass over the pages, no shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import need, slices

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
DROP = frozenset("head nav footer aside form menu dialog button select option object canvas audio video".split()) | RAW
BLOCK = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element closes an open one of its own list when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus respond sidebar footer nav navbar navigation menu menubar breadcrumb breadcrumbs cookie cookies consent gdpr notice share sharing social related newsletter subscribe subscription popup modal overlay pager pagination masthead toolbar widget widgets complementary contentinfo search login signup".split())
GOOD = frozenset("article body content entry main post story text".split())


#: Elements at which the search for the one that a start tag closes ends, or that it looks for.
_LISTS = frozenset(CLOSES) | frozenset().union(*SCOPE.values())
PARAGRAPH = frozenset("p pre td blockquote li".split())
CONTAINER = frozenset("div section article body #root".split())


class Node:
    __slots__ = ("tag", "words", "parent", "parts", "block", "listed", "kept", "score", "chars", "linked", "size", "commas")

    def __init__(self, tag: str, words: frozenset, parent: "Node | None", kept: bool = True):
        self.tag, self.words, self.parent = tag, words, parent
        self.parts: list = []  # text and nodes
        self.block: Node = self if tag in BLOCK or parent is None else parent.block  # the nearest block around
        self.listed: Node = self if tag in _LISTS or parent is None else parent.listed
        self.kept = kept  # neither dropped nor in something dropped
        self.score = 0.0
        self.chars = self.linked = self.size = self.commas = 0


def _words(attributes: str) -> frozenset:
    out = set()
    for _, a, b, c in _ATTR.findall(attributes):
        out.update(w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", a or b or c) if w)
    return frozenset(out)


def parse(source: str) -> Node:
    """The element tree, without dropped elements; forgiving about tags left open.

    Dropped elements follow the same rules as others, so one that is left open ends where its parent, or the paragraph or
    list item that it is, ends. Each tag costs the same however deep it stands: open elements are counted by name.
    """
    root = at = Node("#root", frozenset(), None)
    opened: dict[str, int] = {}
    pos = 0

    def leave(upto: Node) -> None:
        """Closes all open elements below ``upto``."""
        nonlocal at
        while at is not upto:
            opened[at.tag] -= 1
            at = at.parent

    while True:
        m = _TOKEN.search(source, pos)
        text = source[pos : m.start() if m else len(source)]
        if text and at.kept:
            at.parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1]), m[3]
        if closing:
            if opened.get(tag):
                while at.tag != tag:
                    leave(at.parent)
                leave(at.parent)
            continue
        if tag in VOID:
            if at.kept:
                at.parts.append(Node(tag, frozenset(), at))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
            pos = end.end() if end else len(source)
            continue
        if tag in BLOCK and at.block.tag == "p":  # a block ends an open paragraph, and what is open in it
            leave(at.block.parent)
        if tag in CLOSES:
            n = at.listed
            while n is not root and n.tag not in SCOPE[tag] and n.tag not in CLOSES[tag]:
                n = n.parent.listed
            if n.tag in CLOSES[tag]:
                leave(n.parent)
        words = _words(attributes) if "=" in attributes else frozenset()
        inside = opened.get("article") or opened.get("main")
        unwanted = tag in DROP or (tag not in ("html", "body", "article", "main") and words & BOILERPLATE) or tag == "header" and not inside or _HIDDEN.search(" " + attributes)
        node = Node(tag, words, at, at.kept and not unwanted)
        if node.kept:
            at.parts.append(node)
        if not attributes.endswith("/>"):
            opened[tag] = opened.get(tag, 0) + 1
            at = node


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters, those in links, and commas of every subtree, and the points that paragraphs pass up, in one pass from the leaves."""
    for n in reversed(nodes):
        own = own_commas = longest = 0  # of the text that stands in the node itself
        for p in n.parts:
            if isinstance(p, Node):
                n.chars += p.chars
                n.linked += p.chars if p.tag == "a" else p.linked
                n.size += p.size
                n.commas += p.commas
                n.score += _passed(p)
            else:
                bare = len(p.strip())
                n.chars += bare
                n.size += len(p)
                longest = max(longest, bare)
                if bare:
                    own += len(p)
                    own_commas += p.count(",")
        n.commas += own_commas
        if n.tag == "a":
            n.linked = n.chars
        if n.tag in CONTAINER and longest >= 25:
            n.score += _points(own, own_commas)


def _points(size: int, commas: int) -> float:
    return 1 + commas + min(3.0, size / 100)


def _passed(n: Node) -> float:
    """What a node passes to its parent: a paragraph, if there is none within it, its own points, others half of what they got."""
    return n.score / 2 if n.score or n.tag not in PARAGRAPH or not n.chars else _points(n.size, n.commas)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts between the borders of blocks, white space as one space, empty ones left out, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag in ("br", "wbr", "img"):
            run.append(" " if n.tag == "br" else "")
        elif n.tag in BLOCK or n.tag == "#root":
            end()
            stack.append(None)
            stack.extend(reversed(n.parts))
        else:
            stack.extend(reversed(n.parts))
    end()
    return out


def extract(source: str | None) -> str:
    """The main text: blocks in page order joined by a line feed; empty if there is none."""
    if not source:
        return ""
    root = parse(source)
    nodes = _walk(root)
    _measure(nodes)
    scored = [n for n in nodes if n.score > 0]
    if not scored:
        best = next((n for n in nodes if n.tag in ("article", "main")), root)
        return "\n".join(blocks([best]))
    best = max(scored, key=_final)
    while best.parent is not None and best.parent.tag not in ("body", "html", "#root") and best.tag not in ("article", "main"):
        owner = best.parent
        if owner.tag in ("article", "main") or _final(owner) >= 0.75 * _final(best):
            best = owner
        else:
            break
    if best.parent is None:
        return "\n".join(blocks([best]))
    least = max(10.0, 0.2 * _final(best))
    kept = [n for n in best.parent.parts if n is best or isinstance(n, Node) and (n.score > 0 and _final(n) >= least or n.tag == "p" and n.chars >= 80 and n.linked < 0.25 * n.chars)]
    return "\n".join(blocks(kept))


def _final(n: Node) -> float:
    """The points, with a few for an element or a name that says what it holds, discounted by the share of links."""
    bonus = 5 if n.tag in ("article", "main") or n.tag in ("div", "section") and n.words & GOOD else 0
    return (n.score + bonus) * (1 - n.linked / max(1, n.chars))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; null and empty pages have an empty text."""

    def run(batches):
        for b in slices(batches, 256):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return need(pages, page_id, url, source).select(F.col(page_id).cast("long"), F.col(url), F.col(source)).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_tree_scoring(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages whose article is one element of simple blocks, as in the given tables.
SQL_OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '</?(?:p|h1|div|li|ul)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, CAST(length(array_to_string(parts, chr(10))) AS BIGINT) AS n_chars FROM c
"""
