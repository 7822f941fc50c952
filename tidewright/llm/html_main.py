"""Main text of web pages by site template removal.

Pages are parsed into element trees and every subtree is hashed. Spark counts on how many pages
of a host a subtree outside of articles stands, and in how many different articles of a host a
block inside of them; what recurs in many is template and is deleted, and with it what is page
furniture by its markup.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import fresh, shielded, travels
from tidewright.session import cut

#: A subtree is template if it stands on at least so many pages of its host and on at least
#: this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Seeds of the hashes of subtrees outside and inside of articles, which are told apart.
OUTSIDE, INSIDE = 0, 1
#: Templates are broadcast if they take at most so many bytes; else pages are joined by key.
BROADCAST_BYTES = 32 << 20

#: Element names of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: Blocks that mean something only among others; inside of articles they go with these only.
PARTS = frozenset("br caption dd dt figcaption legend option summary tbody td tfoot th thead tr".split())
#: Never main text, wherever they stand.
FURNITURE = frozenset("script style noscript template nav aside form button select input textarea iframe object embed svg canvas audio video dialog menu head title footer noembed noframes xmp datalist search".split())
#: Words of class, id, role or aria-label that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar search searchbox form login signup subscribe subscription newsletter share sharing social comment comments reply replies respond discussion disqus related recommended recommendations widget pagination pager skip complementary contentinfo".split())

travels(__name__)


class Node:
    __slots__ = ("kids", "marks", "name", "own")

    def __init__(self, name: str, marks: frozenset = frozenset(), own: str = ""):
        self.name, self.marks, self.own, self.kids = name, marks, own, []


def parse(page: str | None) -> Node:
    """A tolerant element tree: kids are nodes and strings of decoded text. Comments, doctypes
    and raw text of scripts and the like are left out; missing end tags close as HTML says for
    paragraphs, list items and table parts, else where an outer element ends."""
    import re
    from html import unescape

    text = page or ""
    root = Node("#root")
    stack = [root]
    token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    attribute = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

    def say(s: str) -> None:
        if s:
            stack[-1].kids.append(unescape(s))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                del stack[k:]
                return

    at, n = 0, len(text)
    while at < n:
        m = token.search(text, at)
        if m is None:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            else:
                close(name)
        elif m[2]:
            name, attrs = m[2].lower(), {}
            for a in attribute.finditer(m[3]):
                attrs.setdefault(a[1].lower(), unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]))
            marks = frozenset(w for k in ("class", "id", "role", "aria-label", "itemprop") if k in attrs for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs[k]).lower()) if w)
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in BLOCK:
                        break
            if name in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in SIBLINGS[name]:
                        del stack[k:]
                        if name not in ("thead", "tbody", "tfoot", "tr"):
                            break
                    elif stack[k].name in SCOPES[name]:
                        break
            node = Node(name, marks, " ".join(f"{k}={attrs[k]}" for k in sorted(attrs) if k in ("class", "id", "role")))
            stack[-1].kids.append(node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = end.end() if end else n
            elif name not in VOID and not m[3].rstrip().endswith("/"):
                stack.append(node)
            elif name not in VOID and name not in ("svg", "path", "circle", "rect"):
                stack.append(node)  # a slash does not close an HTML element
    return root


def _is_furniture(node: Node, inside: bool) -> bool:
    """inside: the node stands in the article, whose own header and notes may be its text."""
    if node.name in FURNITURE or node.name == "header" and not inside:
        return True
    return bool(node.marks & MARKS) and node.name not in ("html", "body", "article", "main")


def _articles(root: Node) -> list[Node]:
    """The outermost articles, else the outermost main elements, that are no furniture."""
    for kind in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.name == kind or kind == "article" and "articlebody" in node.marks or kind == "main" and "main" in node.marks and node.name in ("div", "section"):
                found.append(node)
            elif not _is_furniture(node, False):
                todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
        if found:
            return found
    return []


def _hashes(root: Node, skip: set[int], seed: int = OUTSIDE) -> dict[int, int]:
    """64-bit hash of the subtree of each node that is not in skip, by id(node)."""
    import xxhash

    out: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if id(node) not in skip:
            order.append(node)
            todo.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.name} {node.own}".encode("utf-8", "surrogatepass"), seed=seed)
        for k in node.kids:
            if isinstance(k, Node):
                h.update(out.get(id(k), 0).to_bytes(8, "little"))
            elif s := " ".join(k.split()):
                h.update(b"\0" + s.encode("utf-8", "surrogatepass"))
        out[id(node)] = h.intdigest()
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _may_recur(node: Node) -> bool:
    """Whether a node inside of an article can be template by itself: inline elements are words
    of their sentence, cells of their row."""
    return node.name in BLOCK and node.name not in PARTS


def subtree_hashes(page: str | None) -> tuple[list[int], int | None, list[int]]:
    """Distinct signed hashes of the subtrees with some text outside the page's articles, those
    that hold none of them; the hash of its articles (null if none); and the hashes of the blocks
    with some text inside of them."""
    import xxhash

    root = parse(page)
    tops = _articles(root)
    articles = {id(a) for a in tops}
    holds: set[int] = set()

    order, todo = [], [(root, None)]
    parents = {}
    while todo:
        node, up = todo.pop()
        parents[id(node)] = up
        order.append(node)
        if id(node) in articles:
            while node is not None and id(node) not in holds:
                holds.add(id(node))
                node = parents[id(node)]
            continue
        todo.extend((k, node) for k in node.kids if isinstance(k, Node))
    hashes = _hashes(root, articles)
    within: list[Node] = []
    todo = list(tops)
    while todo:
        node = todo.pop()
        within.append(node)
        todo.extend(k for k in node.kids if isinstance(k, Node))
    worded: set[int] = set()
    for node in reversed(order + within):
        if any(id(k) in worded if isinstance(k, Node) else k.strip() for k in node.kids):
            worded.add(id(node))
    found = {hashes[id(x)] for x in order if id(x) in hashes and id(x) not in holds and id(x) in worded and x.name not in ("#root", "html", "body")}
    if not tops:
        return sorted(map(_signed, found)), None, []
    inner: dict[int, int] = {}
    for top in tops:
        inner |= _hashes(top, set(), INSIDE)
    blocks = {inner[id(x)] for x in within if id(x) not in articles and id(x) in worded and _may_recur(x)}
    own = xxhash.xxh64(b"".join(inner[id(x)].to_bytes(8, "little") for x in tops), seed=INSIDE).intdigest()
    return sorted(map(_signed, found)), _signed(own), sorted(map(_signed, blocks))


def main_text(page: str | None, template: set[int]) -> str:
    """Text of the page's articles, or of its whole body if it has none, without furniture and
    subtrees whose signed hash is in template; blocks joined by one space."""
    root = parse(page)
    articles = _articles(root)
    tops = articles or [root]
    hashes: dict[int, int] = {}
    for top in tops if template else ():
        hashes |= _hashes(top, set(), INSIDE if articles else OUTSIDE)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(run).split()):
            blocks.append(s)
        run.clear()

    for top in tops:
        todo: list = [(top, False)]
        while todo:
            node, done = todo.pop()
            if isinstance(node, str):
                run.append(node)
                continue
            block = node.name in BLOCK
            if done:
                flush()
                continue
            recurs = bool(hashes) and (not articles or _may_recur(node)) and _signed(hashes[id(node)]) in template
            if node is not top and (_is_furniture(node, bool(articles)) or recurs):
                if block:
                    flush()
                continue
            if block:
                flush()
                todo.append((node, True))
            todo.extend((k, False) for k in reversed(node.kids))
        flush()
    return " ".join(blocks)


def host_of(url: str) -> F.Column:
    """Lower-case host of a URL column: what follows the scheme and any user, without port. A
    URL without one gives the empty host; null stays null."""
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hashes): subtrees that recur on at least least_pages pages of their host and on
    the share least_share of them. Counts are over all pages; a page counts once. For blocks
    inside of articles, different articles of the host are counted in place of its pages, so
    that copies of one article don't make it template."""
    result = T.StructType([T.StructField("outside", T.ArrayType(T.LongType())), T.StructField("article", T.LongType()), T.StructField("inside", T.ArrayType(T.LongType()))])

    @F.arrow_udf(result)
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            found = [subtree_hashes(p.as_py()) for p in batch]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], kinds[i]) for i in range(3)], names=["outside", "article", "inside"])

    # one pass: the page itself is counted under a null hash, and so is its article
    none = F.array(F.lit(None).cast("long"))
    pair = lambda article: lambda h: F.struct(article.alias("article"), h.alias("hash"))
    outside = F.transform(F.concat(none, "p.outside"), pair(F.lit(None).cast("long")))
    inside = F.when(F.col("p.article").isNotNull(), F.transform(F.concat(none, "p.inside"), pair(F.col("p.article")))).otherwise(F.array().cast("array<struct<article:bigint,hash:bigint>>"))
    rows = pages.select(host_of(url).alias("host"), hashed(F.col(html).cast("string")).alias("p"))
    seen = rows.select("host", F.explode(F.concat(outside, inside)).alias("x")).groupBy("host", "x.article", "x.hash").agg(F.count("*").alias("n"))
    within = F.col("article").isNotNull()
    seen = seen.groupBy("host", within.alias("within"), "hash").agg(F.sum(F.when(within, F.lit(1)).otherwise(F.col("n"))).alias("n"))
    seen = cut(seen)
    sizes = seen.where("hash IS NULL").select(F.col("host").alias("_host"), F.col("within").alias("_within"), F.col("n").alias("n_all"))
    often = seen.where(F.col("hash").isNotNull() & (F.col("n") >= least_pages))
    often = often.join(sizes, F.col("host").eqNullSafe(F.col("_host")) & (F.col("within") == F.col("_within"))).where(F.col("n") >= least_share * F.col("n_all"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


@shielded(["url", "html"], ["out"])
def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """pages with a string column `out`, the main text of each whole page (empty if none).

    Null html is an empty page; a null URL is a host like any other; repeated pages count and
    are extracted each; an empty table gives an empty one. Within a page's article, furniture
    and blocks that recur in the host's articles go; copies of one article count once, so they
    stay. A share of at least a half of a host's pages holds few subtrees per host; they are
    broadcast if their measured size allows, else joined by host.
    """
    host, cutoff = fresh(pages, "page_host", "page_template")
    found = cut(templates(pages, url, html, least_pages, least_share))
    size = found.agg(F.sum(F.size("hashes") * 8 + F.octet_length(F.coalesce("host", F.lit(""))) + 32)).first()[0] or 0
    side = found.select(F.col("host").alias("_h"), F.col("hashes").alias(cutoff))
    rows = pages.withColumn(host, host_of(url))
    rows = rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col(host).eqNullSafe(F.col("_h")), "left")

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for page, hashes in batches:
            yield pa.array([main_text(p.as_py(), set(h.as_py() or ())) for p, h in zip(page, hashes, strict=True)], pa.string())

    own = [pages[c] for c in pages.columns]
    return rows.select(*own, text(F.col(html).cast("string"), F.col(cutoff)).alias(out))
