"""Main text of web pages: site templates go by subtree hashes counted per host, then the article's blocks are read."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexipress.llm._arrow import chunks, column
from lexipress.storage import settle

#: A subtree is a site's template if it is on at least so many pages of a host and on this share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 10, 0.2
#: Bytes of a table that is broadcast, at most.
SMALL = 4 << 20

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas head nav footer aside form button select option textarea input label dialog menu audio video map".split())
DROPPED_BLOCKS = frozenset("head nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that an opening tag of a kind closes, and those that keep it from looking further.
CLOSES = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()},
    "li": frozenset({"li", "p"}), "dd": frozenset({"dd", "dt", "p"}), "dt": frozenset({"dd", "dt", "p"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}), "tbody": frozenset({"tr", "td", "th", "thead", "p"}), "body": frozenset({"head"}),
}
FENCES = frozenset("html body div section article main table ul ol dl nav aside header footer form blockquote button".split())
#: Words in classes, ids and roles that name what isn't the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|sign-up|login|nav|navbar|navigation|menu|breadcrumb\w*|"
    r"sidebar|side-bar|footer|masthead|site-header|page-header|topbar|toolbar|social|share|sharing|related|recommend\w*|trending|widget|comment|comments|commentlist|disqus|respond|reply|replies|pager|pagination|"
    r"search|searchbox|skip|skip-link|copyright|legal|disclaimer|alert|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|$|/)""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    names: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)  # strings and nodes, in order
    digest: int = 0
    size: int = 0  # characters of text below
    links: int = 0  # link elements, itself included


def parse(page: str) -> Node:
    """A forgiving tree of the page; a page that is cut off anywhere still gives one."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, rest = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closed = CLOSES.get(tag)
        if closed:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    break
                if stack[k].tag in FENCES:
                    break
        names, hidden = "", False
        if "=" in rest or "hidden" in rest:
            for a in _ATTRIBUTE.finditer(rest):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() in ("class", "id", "role"):
                    names += " " + value
                else:
                    hidden |= value.lower() != "false"
        node = Node(tag, names, hidden)
        stack[-1].parts.append(node)
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _seal(root: Node) -> list[Node]:
    """Digests of all subtrees, from the leaves up; the nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.tag}|{node.names.strip()}")
        node.size, node.links = 0, int(node.tag == "a")
        for p in node.parts:
            if isinstance(p, Node):
                h.update(p.digest.to_bytes(8, "little"))
                node.size += p.size
                node.links += p.links
            else:
                text = _SPACE.sub(" ", p).strip()
                h.update(b"\0" + text.encode())
                node.size += len(text)
        node.digest = h.intdigest()
    return order[::-1]


def subtree_digests(page: str | None) -> list[int]:
    """Digests (as signed integers) of the page's different subtrees that hold text, the whole page aside."""
    root = parse(page or "")
    found = {x.digest for x in _seal(root) if x is not root and x.size and x.tag in BLOCKS | DROPPED}
    return [d - (1 << 64) if d >> 63 else d for d in found]


def _unwanted(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED or node.hidden:
        return True
    if node.tag == "header" and not inside:
        return True
    return bool(node.names) and node.tag not in ("html", "body", "article", "main") and bool(BOILERPLATE.search(node.names))


def _article(root: Node) -> Node:
    """The article element of most text, else the main element, else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is not root and _unwanted(node, inside):
            continue
        kind = "article" if node.tag == "article" else "main" if node.tag == "main" or "main" in node.names.split() else ""
        if kind and not inside:
            found[kind].append(node)
        todo += [(p, inside or kind == "article") for p in node.parts if isinstance(p, Node)]
    for kind in ("article", "main"):
        if found[kind]:
            return max(found[kind], key=lambda x: x.size)
    return root


def _recurs(node: Node, top: Node, root: Node, template: set[int]) -> bool:
    """Whether the subtree goes as template. In an article that is marked as such, passages may recur: there only
    subtrees with links go, not headings, paragraphs and the like."""
    if node.digest not in template or node.tag in ("html", "body", "article", "main"):
        return False
    return top is root or bool(node.links) and node.tag in ("div", "section", "ul", "ol", "table", "dl", "p", "details")


def blocks(page: str | None, template: set[int]) -> list[str]:
    """The main text's blocks in page order. ``template``: unsigned digests of subtrees that go."""
    root = parse(page or "")
    _seal(root)
    top = _article(root)
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [top]
    end = object()
    while todo:
        x = todo.pop()
        if x is end:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x is not top and (_unwanted(x, top is not root) or _recurs(x, top, root, template)):
            if x.tag in BLOCKS or x.tag in DROPPED_BLOCKS:
                flush()
            elif x.tag not in ("script", "style", "noscript", "template"):
                line.append(" ")
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in RAW and x is not root:
            continue
        else:
            block = x.tag in BLOCKS
            if block:
                flush()
                todo.append(end)
            todo += reversed(x.parts)
    flush()
    return out


def host_of(url: Column) -> Column:
    """The host in lower case, without port; empty if there's none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(id, url, text, n_chars), a row per row of ``pages``.

    First every page's subtrees are hashed and counted by host over all pages; those on at least ``least_pages``
    pages and ``share`` of a host's are its template. Then each page loses its template, its menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, comments and hidden parts, and the article's blocks are read:
    character references decoded, white space inside a block as one space, blocks joined by two line ends (``n_chars``
    counts these too). An article or main element
    is the article where there is one; it is never template as a whole. Null and empty pages give an empty text; null
    urls are a host of their own; null ids and repeated rows stay rows; other columns are ignored.

    Counts are summed in tasks before the shuffle. A page meets only its host's template, in a join by host: a broadcast
    if all templates take 4 MB at most, else a merge join, where Spark splits hosts of many pages.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            counts: dict[tuple[str, int], int] = {}
            for host, page in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist(), strict=True):
                counts[host, 0] = counts.get((host, 0), 0) + 1  # pages of the host
                for d in subtree_digests(page):
                    counts[host, d] = counts.get((host, d), 0) + 1
            hosts, ds = zip(*counts, strict=True) if counts else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ds, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["host", "digest", "n"])

    counted = settle(source.select("host", "html").mapInArrow(digests, "host string, digest long, n long").groupBy("host", "digest").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pages), "subtrees")
    totals = counted.where("digest = 0").select("host", F.col("n").alias("pages"))
    hosts = totals.agg(F.coalesce(F.sum(F.length("host") + 16), F.lit(0)).alias("bytes")).first()
    totals = F.broadcast(totals) if hosts.bytes <= SMALL else totals.hint("shuffle_merge")
    template = counted.where("digest <> 0").join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    template = settle(template.groupBy("host").agg(F.collect_set("digest").alias("template")), "templates")
    size = template.agg(F.coalesce(F.sum(F.length("host") + 8 * F.size("template")), F.lit(0)).alias("bytes")).first()
    joined = source.join(F.broadcast(template) if size.bytes <= SMALL else template.hint("shuffle_merge"), "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = []
            for page, gone in zip(column(batch, "html").to_pylist(), column(batch, "template").to_pylist(), strict=True):
                texts.append("\n\n".join(blocks(page, {d % (1 << 64) for d in gone or ()})))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = source.schema["id"].dataType.simpleString()
    return joined.select("id", "url", "html", "template").mapInArrow(extract, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
