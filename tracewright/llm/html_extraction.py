"""Main text of web pages by site style trees (operator 3).

A page is parsed into elements; an element's style node is the path of tag, id and classes down to it. The pages of a host are merged
into one tree of style nodes. Over the m pages where a node occurs its importance is the larger of two entropies, both to
base m: of its contents (one hash of its text a page) and of its presentations (the styles of its children). 1 means that every page has another
content there, 0 that all are alike. Nodes on `MIN_PAGES` pages or more with an importance below `NOISE_BELOW` are noise of
that host. Pages of a host that are copies (alike in all nodes but those that are noise by their kind) count once, so that what only copies
share is not taken for boilerplate; `html` and `body` hold the whole page and are no nodes.

Removed from each page are: elements that are noise by their kind (menus, footers, side bars, notices, adverts, forms, scripts, comments:
by tag, role, or a word of id or class), and the noise nodes of its host, wherever they are. A mark (`article`, `main`, role or a class) is a
prior: inside a marked element importance i counts as i + `PRIOR` (1 - i), so that only what is nearly alike on all distinct pages is noise there, and
blocks that are mostly links stay. Text outside a mark is judged as on a page without marks: it stays unless it's noise or mostly links.
A word of id or class says nothing after `has-`, `no-`, `with-` or `without-`, and doesn't make noise of an element around an `article` or `main` that is at least
half as long as the page's longest, or, on pages without these, around more than three quarters of the text: such wrappers are left to the tree.
Inside a mark a name tells noise only if its other words name parts of any page (`comment-list`, not `related-work`). Paths of any depth are told apart.
On hosts with fewer than `MIN_PAGES` distinct pages only the kind of the element and the links decide.

Text: character references are decoded, a run of white space (and `<br>`) becomes one space, blocks are joined by an empty line.

The tree's statistics are counts by (host, node, hash) of distinct pages, dealt by all of host, node, hashes and page, so a host with most
pages is spread over many tasks; no page's html is shuffled. The noise nodes are broadcast if they are at most
`MAX_BROADCAST_NODES`, else joined to the pages by host.

Defined results: a null html is an empty text; a null url or one without `://` has an empty host, and such pages are one site; repeated
rows are copies and give a row each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Mapping
from html import unescape
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import trimmed
from .shared import lower_ascii, table

MIN_PAGES, NOISE_BELOW, MAX_BROADCAST_NODES, LONG_PATH = 8, 0.25, 100_000, 400
PRIOR = 0.2
#: Fixed values of HTML: elements without an end tag, of which only text up to the end tag follows, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select option button canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements that hold the whole page.
WHOLE = frozenset(("html", "body"))
CELL = frozenset(("td", "th"))
ENDS_P = BLOCK - {"body", "html", "head"}
#: What is noise by its kind.
NOISE_TAGS = frozenset("nav footer aside form menu dialog search head".split())
NOISE_ROLES = frozenset("navigation contentinfo complementary banner search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
PART_WORDS = frozenset("area articles bar block body bottom box button buttons container content entry form group head header icons inner item items left link links list main module news outer panel pages post posts right section site slot stories text title top unit wrap wrapper".split())
ARTICLE_WORDS = frozenset("article articlebody content entry maincontent post postbody story".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"""([A-Za-z_:@][^\s=/>"']*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_SPACE = re.compile(r"\s+")
#: Classes that tell which other parts a page has.
_STATE = re.compile(r"(?<![\w-])(?:has|no|with|without)[-_][\w-]+")
_WORDS = re.compile(r"[a-z0-9]+")


class Element:
    """noise, article: as far as the start tags tell; `settle` corrects them when the page has been read."""

    __slots__ = ("tag", "node", "noise", "article", "label", "parent", "kind", "word", "header", "mark", "main", "dead", "size", "wraps", "links")

    def __init__(self, tag: str, node: str, label: str, parent: Element | None = None, kind: bool = False, word: bool = False, header: bool = False, mark: bool = False, main: bool = False):
        self.tag, self.node, self.label, self.parent = tag, node, label, parent
        self.kind, self.word, self.header, self.mark, self.main = kind, word, header, mark, main
        self.links = (parent.links if parent is not None else 0) + (tag == "a")
        self.size, self.wraps, self.dead = 0, False, kind or (parent is not None and parent.dead)
        self.judge()

    def judge(self) -> None:
        up = self.parent
        self.noise = up is not None and (up.noise or self.kind or (self.word and not self.wraps) or (self.header and not up.article))
        self.article = up is not None and ((self.mark and not self.noise) or up.article)


def below(parent: Element, label: str) -> str:
    """The path of an element under `parent`; the part above of a long one is a hash, so that depth has no limit and paths don't grow with it."""
    above = parent.node if len(parent.node) <= LONG_PATH else "#" + hashlib.blake2b(parent.node.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return f"{above}/{label}"


def tells_noise(token: str, sure: bool) -> bool:
    """Whether an id or class has a noise word; sure: and, beside such words, only words that name parts of any page."""
    parts = _WORDS.findall(token)
    return any(x in NOISE_WORDS for x in parts) and (not sure or all(x in NOISE_WORDS or x in PART_WORDS or x.isdigit() for x in parts))


def describe(tag: str, attrs: str, parent: Element) -> Element:
    label, words, hits, roles, hidden = tag, set(), set(), set(), False
    if attrs.strip():
        found = {m[1].lower(): unescape((m[2] or "").strip("\"'")).lower() for m in _ATTR.finditer(attrs)}
        names = (found.get("id", "") + " " + found.get("class", "")).strip()
        words, roles = set(_WORDS.findall(names)), set(found.get("role", "").split())
        hits = {x for t in _STATE.sub(" ", names).split() if tells_noise(t, parent.article) or "header" in t for x in _WORDS.findall(t)}
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        if names:
            label = f"{tag}.{re.sub(r'[0-9]+', '0', '.'.join(sorted(names.split())))}"
    main = tag in ("article", "main") or "main" in roles or "article" in roles
    mark = main or (tag in ("div", "section") and bool(words & ARTICLE_WORDS))
    kind = hidden or tag in NOISE_TAGS or bool(roles & NOISE_ROLES)
    word = tag not in ("html", "body", "main") and bool(hits & NOISE_WORDS) and not (tag == "article" and not hits & {"comment", "comments", "ad", "advert", "related"})
    header = (tag == "header" or "header" in hits) and tag not in ("html", "body")
    return Element(tag, below(parent, label), label, parent, kind, word, header, mark, main)


def settle(elements: list[Element], texts: list[tuple[Element, int]]) -> None:
    """Decide which wrappers a word of id or class doesn't make noise of, and judge all elements (parents come first) again."""
    if not any(e.word or (e.header and e.tag != "header") for e in elements):
        return
    total = 0
    for top, n in texts:
        if not top.dead:
            total += n
            while top is not None:
                top.size += n
                top = top.parent
    mains = [e for e in elements if e.main and not e.word and not e.dead and e.size]
    longest = max((e.size for e in mains), default=0)
    for e in mains:
        up = e.parent if 2 * e.size >= longest else None
        while up is not None:
            up.wraps = True
            up = up.parent
    for e in elements:
        if not mains and 4 * e.size > 3 * total:
            e.wraps = True
        if e.wraps and e.tag != "header":
            e.header = False
        e.judge()


def page_blocks(html: str) -> list[tuple[Element, str, int]]:
    """What `blocks` yields, with the innermost element for the open ones, its noise and article settled."""
    out = [(stack[-1], text, links) for stack, text, links in blocks(html)]
    settle([e for e, text, _ in out if not text and e.parent is not None], [(e, len(text)) for e, text, _ in out if text])
    return out


def line(e: Element | None) -> Iterator[Element]:
    """An element and those around it, but the root."""
    while e is not None and e.parent is not None:
        yield e
        e = e.parent


def blocks(html: str) -> Iterator[tuple[list[Element], str, int]]:
    """(open elements, text, length of the part that is links) for each block of text, in page order. Also yields (elements, "", 0) when an element opens."""
    stack, text, links, at, in_link = [Element("", "", "")], [], 0, 0, 0
    find = _TAG.search

    def flush():
        nonlocal text, links
        out = _SPACE.sub(" ", "".join(text)).strip()
        n, text, links = links, [], 0
        return out, n

    def add(raw: str) -> None:
        nonlocal links
        s = unescape(raw) if "&" in raw else raw
        text.append(s)
        if in_link:
            links += len(s.strip())

    while True:
        m = find(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in CELL:
                text.append(" ")
            if tag not in BLOCK:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or stack[k].tag in BLOCK), 0)
                if k and stack[k].tag == tag:
                    had, n = flush() if stack[k].noise != stack[k - 1].noise else ("", 0)
                    if had:
                        yield stack, had, n
                    del stack[k:]
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            had, n = flush()
            if had:
                yield stack, had, n
            if k:
                del stack[k:]
                in_link = stack[-1].links
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*>", re.I).search(html, at)
            at = end.end() if end else (len(html) if tag in ("script", "style") else at)
            continue
        if tag in BLOCK:
            had, n = flush()
            if had:
                yield stack, had, n
            if tag in ENDS_P or tag == "p":
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in BLOCK), 0)
                if k and stack[k].tag == "p":
                    del stack[k:]
            if tag in ("li", "dt", "dd", "tr"):
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}[tag]
                stops = ("ul", "ol", "dl", "table", "menu", "nav", "article", "div")
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ends or stack[k].tag in stops), 0)
                if k and stack[k].tag in ends:
                    del stack[k:]
            in_link = stack[-1].links
        elif tag in CELL:
            text.append(" ")
        if tag in VOID:
            continue
        e = describe(tag, m[3], stack[-1])
        if tag not in BLOCK and e.noise != stack[-1].noise:
            had, n = flush()
            if had:
                yield stack, had, n
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append(e)
        if tag == "a":
            in_link += 1
        yield stack, "", 0
    had, n = flush()
    if had:
        yield stack, had, n


def mostly_links(top: Element, length: int, links: int) -> bool:
    """More than half of the text; of a paragraph, which may quote a link, nine tenths."""
    paragraph = next((e.tag for e in line(top) if e.tag in BLOCK), "") == "p"
    return 10 * links > (9 if paragraph else 5) * length


def extract(html: str | None, noise_nodes: Mapping[str, bool] = MappingProxyType({})) -> str:
    """The main text of a page, given the noise nodes of its host: whether they are noise inside a mark, too."""
    out = []
    for top, text, links in page_blocks(html or ""):
        if not text or top.noise or (not top.article and mostly_links(top, len(text), links)):
            continue
        if noise_nodes and any(noise_nodes.get(e.node, False) if top.article else e.node in noise_nodes for e in line(top)):
            continue
        out.append(text)
    return "\n\n".join(out)


def style_nodes(html: str | None) -> dict[str, tuple[int, int]]:
    """For each style node of a page, but those that are noise by their kind, html and body: hash of its contents and hash of its presentation."""
    content: dict[str, int] = {}
    style: dict[str, int] = {}
    for top, text, _ in page_blocks(html or ""):
        if top.noise:
            continue
        if text:
            data = text.encode()
            for node in {e.node for e in line(top) if e.tag not in WHOLE}:
                content[node] = zlib.crc32(data, content.get(node, 0))
        elif top.parent is not None:
            parent = top.parent
            if top.tag not in WHOLE:
                style.setdefault(top.node, 0)
            if parent.node and parent.tag not in WHOLE:
                style[parent.node] = zlib.crc32(top.label.encode(), style.get(parent.node, 0))
    return {k: (content.get(k, 0), v) for k, v in style.items()}


def page_hash(nodes: dict[str, tuple[int, int]]) -> int:
    return int.from_bytes(hashlib.blake2b(repr(sorted(nodes.items())).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url) -> F.Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """`(host, node, pages, content_entropy, style_entropy, importance)` per style node of each site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, names, contents, styles, ids = [], [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                nodes = style_nodes(html.as_py())
                page = page_hash(nodes)
                for node, (content, style) in nodes.items():
                    hosts.append(host)
                    names.append(node)
                    contents.append(content)
                    styles.append(style)
                    ids.append(page)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.string()), *[pa.array(x, pa.int64()) for x in (contents, styles, ids)]], ["host", "node", "content", "style", "page"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(trimmed(run), "host string, node string, content bigint, style bigint, page bigint").distinct()
    kinds = F.posexplode(F.array("content", "style")).alias("kind", "hash")
    counts = rows.select("host", "node", kinds).groupBy("host", "node", "kind", "hash").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    by = sums.withColumn("e", entropy).groupBy("host", "node").agg(F.max("m").alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("e"))).alias("content_entropy"), F.max(F.when(F.col("kind") == 1, F.col("e"))).alias("style_entropy"))
    return by.withColumn("importance", F.greatest("content_entropy", "style_entropy"))


def extract_pages(pages: DataFrame, max_broadcast: int = MAX_BROADCAST_NODES) -> DataFrame:
    """`(page_id, url, text, n_chars)` per row."""
    spark = pages.sparkSession
    noise = style_tree(pages).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < NOISE_BELOW)).select("host", "node", (F.col("importance") + PRIOR * (1 - F.col("importance")) < NOISE_BELOW).alias("marked"))
    found = noise.limit(max_broadcast + 1).persist()
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__host"))
    try:
        if found.count() <= max_broadcast:
            by: dict[str, dict[str, bool]] = {}
            for r in found.collect():
                by.setdefault(r["host"], {})[r["node"]] = r["marked"]
            sites = spark.sparkContext.broadcast(by)
            rows = rows.withColumn("__nodes", F.lit(None).cast("map<string,boolean>"))
        else:
            sites = None
            rows = rows.join(noise.groupBy(F.col("host").alias("__host")).agg(F.map_from_entries(F.collect_list(F.struct("node", "marked"))).alias("__nodes")), "__host", "left")
    finally:
        found.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, host, nodes in zip(b.column(2), b.column(3), b.column(4), strict=True):
                known = sites.value.get(host.as_py(), {}) if sites is not None else dict(nodes.as_py() or ())
                texts.append(extract(html.as_py(), known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "__host", "__nodes").mapInArrow(trimmed(run), "page_id bigint, url string, text string, n_chars bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
