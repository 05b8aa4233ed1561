"""HTML main-text extraction by consensus host paths.

Each page scores its containers and votes for the generalised tag-class path of the best; votes are
counted per host in Spark; then every page is extracted again by the paths its host agreed on. A page
on which none of them holds text falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, in_arrow

#: Share of a host's votes from which a path counts as agreed on; so a host has at most 1 / SHARE paths.
SHARE = 0.05
#: Hosts whose paths, some hundred bytes each, are broadcast at most.
BROADCAST_HOSTS = 100_000
#: Part of a container's weight that one child must hold for the search to go down to it.
HOLDS = 0.6

#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template iframe object svg math canvas head title nav footer aside button select textarea input dialog menu map audio video".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that flow within a block; all others begin and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements in which the search for the main container goes down.
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
#: Elements that say that they are the main text, and those that hold text where they stand beside containers.
WHOLE = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: What an opening tag ends, besides what lies between.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | {tag: {"p"} for tag in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements over whose border an opening tag ends nothing.
SCOPE = frozenset("html body table div article section main td th ul ol dl blockquote aside nav footer header form".split())
#: Words in a class, id or role that mark what stands beside the main text.
ASIDE = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay "
    "sidebar aside widget rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc footer foot header masthead topbar toolbar comment comments commentlist disqus "
    "discussion replies reply respond related recommended recommendations share sharing social newsletter subscribe subscription signup login search searchbox form hidden print "
    "contentinfo complementary copyright legal skip".split()
)
#: Words in a class, id or role that mark the main text.
MAIN = frozenset("article main content post entry story body text page".split())
#: Words that make a class a remark on the state of the page: has-sidebar and comments-open are no sidebar and no comments.
STATE = frozenset("has have no not with without open opened closed enabled disabled".split())
#: Part of what would otherwise be kept of a page that an element holds which no name of an aside can drop.
NEARLY_ALL = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "aside", "named", "good", "boost")

    def __init__(self, tag: str, parent: Node | None, names: str = "", aside: bool = False, named: bool = False, good: bool = False, boost: float = 1.0):
        self.tag, self.parent, self.names, self.boost, self.children = tag, parent, names, boost, []
        self.aside, self.named, self.good = aside or named, named and not aside, good  # named: dropped for its names alone

    def path(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.tag + "".join(f".{c}" for c in node.names.split()))
            node = node.parent
        return ">".join(reversed(out))


def _open(tag: str, attributes: str, parent: Node) -> Node:
    found = {}
    if attributes:
        for name, a, b, c in _NAMES.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
    if not found:
        return Node(tag, parent, aside=tag in DROPPED or tag == "header" and not _in_article(parent), named=tag == "form", good=tag in WHOLE, boost={"article": 3.0, "main": 2.5}.get(tag, 1.0))
    parts = [{w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower()) if w} for key in ("class", "id", "role") for part in found.get(key, "").split()]
    good = any(p & MAIN for p in parts) or tag in WHOLE
    # A name of an aside counts unless the element says otherwise: by its tag, by a name of the main text, or as a mere state.
    sure = any(p & MAIN and not p & ASIDE for p in parts) or tag == "article" and not _in_article(parent, ("article",))
    spared = sure or tag in ("body", "html", "main") or found.get("role") == "main"
    told = found.get("role", "").lower() in ASIDE or {"hidden"} in parts
    named = told and tag not in ("body", "html", "main") or not spared and any(p & ASIDE and not p & STATE for p in parts)
    named = named or tag == "form"  # as for names, unless it wraps the page
    aside = tag in DROPPED or tag == "header" and not _in_article(parent)
    aside = aside or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    names = " ".join(sorted(re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()))
    return Node(tag, parent, names, aside, named, sure or tag in WHOLE, {"article": 3.0, "main": 2.5}.get(tag, 1.5 if good else 1.0))


def _in_article(node: Node | None, tags: tuple = WHOLE) -> bool:
    """Whether an element around says that it is the main text: by its tag, or where no tags are asked for in particular by its names."""
    while node is not None:
        if node.tag in tags or tags is WHOLE and node.good and not node.aside and node.tag not in ("body", "html"):
            return True
        node = node.parent
    return False


def _spare(root: Node) -> None:
    """No aside is what, for its names alone, would be dropped with prose that is nearly all text of a page.

    The names stand where an element elsewhere says that it is the main text, and has some.
    """
    while True:
        order, stack = [], [(root, False, False)]
        while stack:
            n, lost, link = stack.pop()
            order.append((n, lost, link))
            if not n.aside or n.named:
                stack += [(c, lost or n.aside, link or c.tag == "a") for c in n.children if not isinstance(c, str)]
        held, kept, prose = {}, {}, set()  # letters in all and without asides, those in links counting little
        for n, _, link in reversed(order):
            below = [c for c in n.children if not isinstance(c, str) and id(c) in held]
            own = sum(len(c.strip()) for c in n.children if isinstance(c, str)) * (0.1 if link else 1.0)
            dropped = n.aside and not n.named
            held[id(n)] = 0.0 if dropped else own + sum(held[id(c)] for c in below)
            kept[id(n)] = 0.0 if n.aside else own + sum(kept[id(c)] for c in below)
            if not dropped and (n.tag in PROSE and own or any(id(c) in prose for c in below)):
                prose.add(id(n))
        left = kept[id(root)]
        able = [n for n, lost, _ in order if n.named and n.aside and not lost and id(n) in prose and held[id(n)] >= NEARLY_ALL * (held[id(n)] + left)]
        spared = max(able, key=lambda n: held[id(n)], default=None)
        above, up = set(), spared
        while up is not None:
            above.add(id(up))
            up = up.parent
        if spared is None or any(n.good and kept[id(n)] and not lost and id(n) not in above for n, lost, _ in order):
            return
        spared.aside = spared.named = False


def parse(page: str) -> Node:
    """A tree of elements and strings, asides marked."""
    root = _tree(page)
    _spare(root)
    return root


def _tree(page: str) -> Node:
    """A tree of elements and strings; tags left open end where their parent does."""
    root = node = Node("", None)
    at, opened = 0, Counter()

    def left(node: Node, up: Node) -> None:
        """Elements from ``node`` up to below ``up`` are open no more."""
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            node.children.append(text)
        if m is None:
            return root
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                left(node, up.parent)
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in ("html", "body", "head"):
            if opened[tag] > 0:
                continue
            if tag == "body" and node.tag == "head":
                left(node, node.parent)
                node = node.parent
        ends = CLOSES.get(tag)
        if ends and any(opened[x] > 0 for x in ends):
            up = node
            while up.parent is not None and up.tag not in ends and up.tag not in SCOPE:
                up = up.parent
            if up.tag in ends and up.parent is not None:
                left(node, up.parent)
                node = up.parent
        child = _open(tag, m[3] or m[6] or "", node)
        node.children.append(child)
        if tag in VOID or (m[3] or m[6] or "").rstrip().endswith("/") and tag not in INLINE and tag not in CONTAINERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        opened[tag] += 1
        node = child


def weigh(node: Node, weights: dict[int, float], linked: bool = False) -> float:
    """Letters of main text below ``node``, those in links counting little, times what its names promise."""
    order, stack = [], [(node, linked)]
    while stack:
        n, link = stack.pop()
        order.append((n, link))
        if not n.aside:
            stack += [(c, link or c.tag == "a") for c in n.children if not isinstance(c, str)]
    for n, link in reversed(order):
        own = 0.0
        if not n.aside:
            for c in n.children:
                own += len(c.strip()) * (0.1 if link else 1.0) if isinstance(c, str) else weights[id(c)]
        weights[id(n)] = own * n.boost
    return weights[id(node)]


def _beside(node: Node, child: Node, weights: dict[int, float]) -> bool:
    """Whether ``node`` has headings, paragraphs or words of its own outside ``child``, other than links."""
    for c in node.children:
        if isinstance(c, str):
            if _WORD.search(c):
                return True
        elif c is not child and c.tag in PROSE and not c.aside and weights[id(c)] > 0.5 * len(text_of([c])):
            return True
    return False


def best(root: Node) -> tuple[Node, float]:
    """The smallest container that holds most of what is above it, and never a part of an article.

    The search ends at an article or main element, and where going down would leave prose behind; but it
    does go down to an article or main element, which says itself that it is the text.
    """
    weights: dict[int, float] = {}
    weigh(root, weights)
    node = root
    while node.tag not in WHOLE:
        inner = [c for c in node.children if not isinstance(c, str) and not c.aside and c.tag in CONTAINERS]
        child = max(inner, key=lambda c: weights[id(c)], default=None)
        total = weights[id(node)] / node.boost
        if child is None or not total or weights[id(child)] < HOLDS * total or child.tag not in WHOLE and _beside(node, child, weights):
            break
        node = child
    return node, weights[id(node)]


def matching(root: Node, path: str) -> list[Node]:
    """The outermost elements on a path, in page order."""
    steps, level = path.split(">") if path else [], [root]
    for step in steps:
        level = [c for n in level for c in n.children if not isinstance(c, str) and not c.aside and c.tag + "".join(f".{x}" for x in c.names.split()) == step]
    return level


def text_of(nodes: list[Node]) -> str:
    """The blocks below ``nodes``, one to a line, without what stands beside the main text."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(run)).strip()
        if line:
            blocks.append(line)
        run.clear()

    for top in nodes:
        stack: list = [(top, False)]
        while stack:
            n, leaving = stack.pop()
            if isinstance(n, str):
                run.append(html.unescape(n))  # a reference doesn't go on over a tag
            elif leaving:
                flush()
            elif n.tag == "br":
                run.append(" ")
            elif not n.aside or n is top:
                if n.tag not in INLINE:
                    flush()
                    stack.append((n, True))
                stack += [(c, False) for c in reversed(n.children)]
        flush()
    return "\n".join(blocks)


def extract(page: str, paths: list[str]) -> str:
    """The main text of a page by the first of ``paths`` that holds any, or else by its own best container."""
    root = parse(page)
    for path in paths:
        text = text_of(matching(root, path))
        if text:
            return text
    return text_of([best(root)[0]])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, weights = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            node, weight = best(parse(page or ""))
            if weight > 0:
                hosts.append(host)
                paths.append(node.path())
                weights.append(weight)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], names=["host", "path", "weight"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page or "", paths or []) for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("host")], names=["page_id", "url", "text", "n_chars", "host"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Returns ``page_id``, ``url``, ``text``, ``n_chars`` and ``host``. Null and empty pages have an empty
    text; pages without a host share one, the empty one; a page on a host of its own votes alone. Rows
    that repeat are extracted and vote each. Ties of votes go to the heavier, then the first path. A page of
    any length is taken whole, by one task. An empty table gives no rows. Other columns, of whatever name, are
    not read. The agreed paths are at most ``1 / SHARE`` for each host; up to ``BROADCAST_HOSTS`` hosts they are
    sent to the pages, beyond that pages and paths meet by a shuffle whose large hosts can be split.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = in_arrow(pages.select("host", "html"), _vote, "host string, path string, weight double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("weight")).alias("weight"))
    own = Window.partitionBy("host")
    agreed = counted.withColumn("all", F.sum("votes").over(own)).where(F.col("votes") >= SHARE * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path")))
    agreed = Scratch(pages.sparkSession).table(agreed.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths")), "paths")
    agreed = F.broadcast(agreed) if agreed.count() <= BROADCAST_HOSTS else agreed
    return in_arrow(pages.join(agreed, "host", "left").select("page_id", "url", "html", "host", "paths"), _again, "page_id long, url string, text string, n_chars long, host string")
