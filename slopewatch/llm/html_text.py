"""Main text of web pages by wrapper induction.

Pages of a host and layout (which structural elements come in which order) are made from one template. One page of
each is its wrapper; every other page's DOM tree is aligned with it by simple tree matching. Over all pages of a wrapper
it is summed up how much text stands in each aligned node, how much of that in links, and how often a node's own text is
the same. From the root the node that holds most of the unlinked text is followed down to the content: the slot that
varies most. Nodes within it whose text stays the same on pages that are no copies of each other are template. The
main text is the content without template and without parts that are no article by their tag, role or class.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.shared import written
from slopewatch.llm.url_filter import host_of

#: A wrapper node is template if at least so many pages match it and so large a share of them has its text.
LEAST_PAGES, SAME_SHARE = 8, 0.9
#: A page with so large a share of its wrapper's text is a copy of it and tells nothing about the template.
COPY_SHARE = 0.8
#: The content is followed into a child with so large a share of the text.
MOST_TEXT = 0.6
#: Pairs of children up to which two lists are matched as well as possible; longer ones by their equal beginnings and ends, then in order.
MOST_PAIRS = 900
#: Bytes of wrappers that may be broadcast; beyond it they are joined to the pages.
WRAPPER_BYTES = 48 << 20

#: Depth of Python calls that deep trees may need; Python's own calls take no machine stack.
RECURSION = 1_000_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Parts that are no article, by tag, by role attribute and by a word of class or id.
NO_ARTICLE = frozenset("nav footer aside form script style template noscript iframe button select input textarea dialog menu head svg canvas object audio video".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Whole words of class or id; parts of a word, such as in `side-effects`, say nothing.
NO_WORD = frozenset(
    "ad ads advert advertisement adsbygoogle sponsored promo comments comment-list commentlist disqus_thread respond cookie-notice cookie-banner cookies consent newsletter newsletter-signup"
    " popup modal sidebar breadcrumb breadcrumbs pagination pager navbar nav menu site-header site-footer masthead share sharing share-buttons social social-share related related-posts recommended widget notice skip-link".split()
)
#: The words that count within an article, and only on elements that hold others: adverts, reader comments, consent and sharing.
INNER_WORD = frozenset("ad ads advert advertisement adsbygoogle sponsored comments comment-list commentlist disqus_thread respond cookie-notice cookie-banner cookies consent share sharing share-buttons social-share".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text themselves; the content isn't followed into them.
TEXT = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption caption address".split())
#: Elements whose order of first appearance is a page's layout.
LAYOUT = r"(?i)<(header|nav|main|article|aside|footer)[\s>]"

#: Comments, declarations and tags. Each alternative takes a place of the text once, so no page takes longer than in proportion to its size.
_TAG = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>"
_TOKEN, _TOKEN_OR_CDATA = re.compile(_TAG, re.S), re.compile(r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|" + _TAG, re.S)
#: An attribute's name and value. Values are consumed whole, so that names inside them aren't seen.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_SPACE = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("attributes", "children", "kids", "number", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.kids: list[Node] | None = None
        self.number = -1

    def elements(self) -> list[Node]:
        """The children that are elements; kept once the tree is numbered."""
        return [c for c in self.children if c.__class__ is Node] if self.kids is None else self.kids


def parse(source: str) -> Node:
    """A tree of the page's elements and texts; never fails. Unclosed elements end with their parent."""
    root = at = Node("#root", "", None)
    open_tags: dict[str, int] = {}
    position, end = 0, len(source)
    last_tag, last_cdata = source.rfind(">"), source.rfind("]]>")

    def closed(upto: Node) -> Node:
        """Leaves all elements below `upto`."""
        node = at
        while node is not upto:
            open_tags[node.tag] -= 1
            node = node.parent
        return upto

    while position < end:
        if position > last_tag:  # no tag ends any more; an open comment goes on to the end
            comment = source.find("<!--", position)
            at.children.append(source[position : comment if comment >= 0 else end])
            break
        m = (_TOKEN_OR_CDATA if position <= last_cdata else _TOKEN).search(source, position)
        if m is None:
            at.children.append(source[position:])
            break
        if m.start() > position:
            at.children.append(source[position : m.start()])
        position = m.end()
        close, tag, attributes = m.group("close", "tag", "attributes")
        if m.re is _TOKEN_OR_CDATA and m["cdata"]:
            at.children.append(m["cdata"])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if open_tags.get(tag):
                node = at
                while node.tag != tag:
                    if node.tag == "table" and tag in ("p", "div", "span", "b", "i", "a"):
                        node = root
                        break
                    node = node.parent
                if node is not root:
                    at = closed(node.parent)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            node = at
            while node is not root and node.tag not in ("p", "td", "th", "li", "div", "article", "section", "table", "button"):
                node = node.parent
            if node.tag == "p":
                at = closed(node.parent)
        if tag in SIBLINGS and any(open_tags.get(t) for t in SIBLINGS[tag]):
            node, last = at, None
            while node is not root and node.tag not in FENCES[tag]:
                if node.tag in SIBLINGS[tag]:
                    last = node
                node = node.parent
            if last is not None:
                at = closed(last.parent)
        node = Node(tag, attributes, at)
        at.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, position)
            position = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def numbered(root: Node) -> list[Node]:
    """The tree's nodes in page order; each gets its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        node.kids = node.elements()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def inline(node: Node) -> list[Node]:
    """The node's descendants down to the next blocks: what stands in the same block as its own text."""
    out, todo = [], node.elements()
    while todo:
        n = todo.pop()
        if n.tag not in BLOCK and n.tag not in RAW:
            out.append(n)
            todo.extend(n.elements())
    return out


def text_hash(node: Node) -> int:
    """Of the text that stands in the node's own block, parts in other blocks left out; 0 without text and for parts of a block."""
    if node.tag not in BLOCK:
        return 0
    own: list[str] = []
    todo: list = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            own.append(x)
        elif x.tag not in BLOCK and x.tag not in RAW:
            todo.extend(reversed(x.children))
    text = _SPACE.sub(" ", "".join(own)).strip()
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) if text else 0


def in_order(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Children with equal tags from both ends, then each next one that has an equal tag among those left."""
    m = 0
    while m < min(len(x), len(y)) and x[m].tag == y[m].tag:
        m += 1
    n = 0
    while n < min(len(x), len(y)) - m and x[-1 - n].tag == y[-1 - n].tag:
        n += 1
    places: dict[str, list[int]] = {}
    for j in range(len(y) - n - 1, m - 1, -1):
        places.setdefault(y[j].tag, []).append(j)
    out, last = [(i, i) for i in range(m)], m - 1
    for i in range(m, len(x) - n):
        of = places.get(x[i].tag, [])
        while of and of[-1] <= last:
            of.pop()
        if of:
            last = of.pop()
            out.append((i, last))
    return out + [(len(x) - k, len(y) - k) for k in range(n, 0, -1)]


def aligned(page: Node, wrapper: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes with equal tags, in order, whose parents are a pair, as many as possible.

    Lists of children with more than MOST_PAIRS pairs are matched by `in_order`, so wide pages take linear time.
    """
    sizes: dict[tuple[int, int], tuple[int, list | None]] = {}

    def match(a: Node, b: Node) -> int:
        known = sizes.get((a.number, b.number))
        if known is not None:
            return known[0]
        x, y = a.elements(), b.elements()
        if len(x) * len(y) > MOST_PAIRS:
            chosen = in_order(x, y)
            size = 1
            for i, j in chosen:  # no generator: its calls would take machine stack in deep trees
                size += match(x[i], y[j]) if x[i].kids and y[j].kids else 1
            sizes[a.number, b.number] = size, [(x[i], y[j]) for i, j in chosen]
            return size
        # equal elements without children at the beginning count one whatever they are matched with: so they are a pair
        same = 0
        for p, q in zip(x, y, strict=False):
            if p.tag != q.tag or p.kids or q.kids:
                break
            same += 1
        ends = list(zip(x[:same], y[:same], strict=True))
        x, y = x[same:], y[same:]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            row, above = table[i + 1], table[i]
            for j, q in enumerate(y):
                most = above[j + 1] if above[j + 1] > row[j] else row[j]
                if p.tag == q.tag:
                    got = above[j] + (match(p, q) if p.kids and q.kids else 1)
                    if got > most:
                        most = got
                row[j + 1] = most
        chosen, i, j = [], len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((x[i], y[j]))
        sizes[a.number, b.number] = same + table[-1][-1] + 1, ends + chosen
        return same + table[-1][-1] + 1

    match(page, wrapper)
    pairs, todo = [], [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        known = sizes.get((a.number, b.number))
        if known is not None:
            todo.extend(known[1])
    return pairs


def text_sizes(nodes: list[Node]) -> tuple[list[int], list[int]]:
    """Characters of text within each node, outside of links and in them; without what stands in scripts and the like."""
    plain, link = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        n = nodes[k]
        plain[k] += sum(len(c.strip()) for c in n.children if c.__class__ is str)
        if n.tag == "a":
            plain[k], link[k] = 0, plain[k] + link[k]
        elif n.tag in NO_ARTICLE or n.tag in RAW:
            plain[k] = 0
        if n.parent is not None:
            up = n.parent.number
            plain[up] += plain[k]
            link[up] += link[k]
    return plain, link


def marked(node: Node) -> bool:
    """Whether the node says that it is the article."""
    if node.tag in ("article", "main"):
        return True
    return bool(node.attributes) and (attribute(node).get("role") == "main" or attribute(node).get("itemprop") == "articleBody")


def content_of(nodes: list[Node], plain: list[int]) -> Node:
    """The node that holds the content, by the text in each node (of one page, or summed up over aligned pages).

    From the root the child with most of the text is followed, down to text itself; a marked element is followed
    to, and gone back to from below, as it also holds the title. So is a parent whose only other text is a heading.
    """
    at = nodes[0]
    while True:
        inner = [c for c in at.elements() if c.tag not in TEXT and c.tag in BLOCK and c.tag not in NO_ARTICLE]
        best = max(inner, key=lambda c: plain[c.number], default=None)
        if best is None or plain[best.number] < MOST_TEXT * plain[at.number] or not plain[best.number]:
            break
        if not marked(best) and not any(c.tag in BLOCK for c in best.elements()):
            break
        at = best
    up = at
    while up.parent is not None:
        if marked(up):
            return up
        up = up.parent
    while at.parent is not None and at.parent.tag not in ("body", "html", "#root"):
        others = [c for c in at.parent.elements() if c is not at and plain[c.number]]
        if not others or not all(c.tag in HEADINGS or any(h.tag in HEADINGS for h in c.elements()) for c in others):
            break
        at = at.parent
    return at


class Wrapper:
    """A wrapper page, the number of its content node, and which of its nodes are template."""

    def __init__(self, source: str, content: int = -1, template: set[int] | None = None) -> None:
        self.root = parse(source)
        self.nodes = numbered(self.root)
        self.hashes = [text_hash(n) for n in self.nodes]
        self.own = [sum(len(c.strip()) for c in n.children if c.__class__ is str) if h else 0 for n, h in zip(self.nodes, self.hashes, strict=True)]
        self.content = content
        self.template = template or set()


def attribute(node: Node) -> dict[str, str]:
    """The node's attributes by their lower-cased names; of equal names the first counts."""
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(node.attributes) if node.attributes else ():
        found.setdefault(k.lower(), v.strip("\"'"))
    return found


def no_article(node: Node, inside: bool) -> bool:
    """Whether a node's tag, role or words say that it is no part of the article; `inside`: it is within an article.

    There, few words count, and not those of paragraphs and other elements of text.
    """
    if node.tag in NO_ARTICLE or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("body", "html", "article", "main", "#root") and not inside:
        return False
    a = attribute(node)
    if a.get("role", "").lower() in NO_ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if inside and node.tag in TEXT:
        return False
    return not (INNER_WORD if inside else NO_WORD).isdisjoint(f"{a.get('class', '')} {a.get('id', '')}".lower().split())


def blocks(node: Node, dropped: set[int], inside: bool) -> list[str]:
    """Texts of the node's blocks in page order, without dropped nodes and parts that are no article."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            run.append(x)
        elif x is not node and (x.tag in RAW or no_article(x, inside)):
            if x.tag in BLOCK or x.tag in NO_ARTICLE:
                flush()
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            mine = x.number in dropped
            todo.extend(c for c in reversed(x.children) if not (mine and c.__class__ is str))
    flush()
    return out


def main_text(source: str, wrapper: Wrapper | None) -> str:
    """The page's main text: blocks joined by line feeds. Without a wrapper, the page is its own."""
    root = parse(source)
    nodes = numbered(root)
    dropped: set[int] = set()
    node = None
    if wrapper is not None:
        pairs = aligned(root, wrapper.root)
        node = next((a for a, b in pairs if b.number == wrapper.content), None)
        if wrapper.template:
            same = [a for a, b in pairs if b.number in wrapper.template and text_hash(a) == wrapper.hashes[b.number]]
            dropped = {n.number for a in same for n in (a, *inline(a))}
    found = blocks(node, dropped, node.tag not in ("body", "html", "#root")) if node is not None else []
    if not found:  # nothing of the page is where its wrapper has the content
        node = content_of(nodes, text_sizes(nodes)[0])
        found = blocks(node, dropped, node.tag not in ("body", "html", "#root"))
    return "\n".join(found)


def summed_up(batches: Iterator[pa.RecordBatch], wrappers) -> Iterator[pa.RecordBatch]:
    """(host, node, n, same, plain) of this task's pages: how often a wrapper's node is matched by pages that are no copies, and with equal text; text in it."""
    made: dict[str, tuple[Wrapper | None, np.ndarray]] = {}
    sys.setrecursionlimit(RECURSION)

    def rows() -> pa.RecordBatch:
        hosts = [h for h, (_, c) in made.items() for _ in range(len(c))]
        table = np.concatenate([np.column_stack([np.arange(len(c)), c]) for _, c in made.values()]) if made else np.zeros((0, 4), np.int64)
        some = np.flatnonzero(table[:, 1:].any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in some.tolist()], pa.string()), *(pa.array(x) for x in table[some].T.astype(np.int64))], names=["host", "node", "n", "same", "plain"])

    for batch in batches:
        host, source, given = (batch.column(i) for i in (0, 1, 2))
        for i in range(batch.num_rows):
            h, page = host[i].as_py(), source[i].as_py()
            if not page:
                continue
            if h not in made:
                if len(made) > 2000:
                    yield rows()
                    made.clear()
                text = wrappers.value.get(h) if wrappers is not None else given[i].as_py()
                w = Wrapper(text) if text else None
                made[h] = w, np.zeros((len(w.nodes) if w else 0, 3), np.int64)
            w, counts = made[h]
            if w is None:
                continue
            root = parse(page)
            plain, _ = text_sizes(numbered(root))
            pairs = aligned(root, w.root)
            equal = [text_hash(a) == w.hashes[b.number] if w.hashes[b.number] else None for a, b in pairs]
            copy = sum(w.own[b.number] for (_, b), e in zip(pairs, equal, strict=True) if e) >= COPY_SHARE * sum(w.own)
            for (a, b), e in zip(pairs, equal, strict=True):
                row = counts[b.number]
                row[2] += plain[a.number]
                if e is not None and not copy:
                    row[0] += 1
                    row[1] += e
    yield rows()


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, _wrapper, _content, _template) of rows (host, _wrapper, stats)."""
    for batch in batches:
        contents, templates = [], []
        for source, stats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            nodes = numbered(parse(source))
            plain = [0] * len(nodes)
            for x in stats:
                plain[x["node"]] = x["plain"]
            contents.append(content_of(nodes, plain).number)
            templates.append(sorted(x["node"] for x in stats if x["n"] >= LEAST_PAGES and x["same"] >= SAME_SHARE * x["n"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(contents, pa.int32()), pa.array(templates, pa.list_(pa.int32()))], names=["host", "_wrapper", "_content", "_template"])


def texts(batches: Iterator[pa.RecordBatch], wrappers) -> Iterator[pa.RecordBatch]:
    """The page's columns and its text."""
    made: dict[str, Wrapper | None] = {}
    sys.setrecursionlimit(RECURSION)
    for batch in batches:
        names = batch.schema.names
        host, source = batch.column(names.index("_host")), batch.column(names.index("html"))
        out = []
        for i in range(batch.num_rows):
            h, page = host[i].as_py(), source[i].as_py() or ""
            if h not in made:
                if len(made) > 2000:
                    made.clear()
                text, content, nodes = wrappers.value.get(h, (None, None, None)) if wrappers is not None else (batch.column(names.index(c))[i].as_py() for c in ("_wrapper", "_content", "_template"))
                made[h] = Wrapper(text, content, set(nodes)) if text else None
            out.append(main_text(page, made[h]))
        keep = [i for i, n in enumerate(names) if n not in ("_host", "_wrapper", "_content", "_template")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.string())], names=[*(names[i] for i in keep), "_text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, html and `_text`, the main text (empty if none). Null html counts as empty; more columns are left out.

    Pages without a host in their url share the host "". A page that is alone with its host and layout is its own
    wrapper: its content is found in the same way, but no template. Repeated rows get equal texts.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    layout = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LAYOUT), F.lit(1)), F.lower))
    host = F.concat_ws(" ", host_of(F.col("url")), F.coalesce(layout, F.array().cast("array<string>")))
    # one page of each host and layout is its wrapper: that with the least hash
    least = F.min_by("html", F.struct(F.xxhash64("html"), F.xxhash64("url")))
    wrappers = written(pages.where("length(html) > 0").groupBy(host.alias("_host")).agg(least.alias("html")), "wrappers")
    size, hosts = wrappers.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.count("*")).first()
    small = size <= WRAPPER_BYTES and hosts <= 400_000
    shared = spark.sparkContext.broadcast({r[0]: r[1] for r in wrappers.collect()}) if small else None
    named = pages.select(host.alias("_host"), "html")
    named = named.withColumn("_wrapper", F.lit(None).cast("string")) if small else named.join(wrappers.withColumnRenamed("html", "_wrapper"), "_host")
    counts = named.mapInArrow(lambda b: summed_up(b, shared), "host string, node long, n long, same long, plain long").groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("n", "same", "plain")))
    stats = counts.groupBy("host").agg(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), "n", "same", "plain")).alias("stats"))  # a row for each node of one page
    ready = wrappers.join(stats, wrappers["_host"] == stats["host"]).select("host", F.col("html").alias("_wrapper"), "stats")
    made = written(ready.mapInArrow(decided, "host string, _wrapper string, _content int, _template array<int>"), "wrappers-template")
    rows = pages.withColumn("_host", host)
    if small:  # numbers of nodes beside the wrappers: less than the wrappers themselves
        ready = spark.sparkContext.broadcast({r[0]: (r[1], r[2], r[3]) for r in made.collect()})
    else:
        ready, rows = None, rows.join(made.withColumnRenamed("host", "_host"), "_host", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("_host", "_wrapper", "_content", "_template"))
    return rows.mapInArrow(lambda b: texts(b, ready), schema + ", _text string")


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
