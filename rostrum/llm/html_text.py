"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a style node is the path of block elements with their
classes (digits dropped); a node holds the text blocks directly in it.  Two entropies say how much a
node varies over the pages that have it: of its presentation (the sequence of its children's tags) and
of its content (a block on all pages has entropy one and counts nothing, a block on one page counts
fully).  A node's importance joins both, ``(1 - g**l) * presentation + g**l * content`` with l styles and
g = 0.9, and is drawn to one half with the weight of ``EVIDENCE`` pages.

What the mark-up says is a prior on the log odds of that importance: ``PRIOR`` against elements, roles and
classes named like menus, adverts, notices, forms or comments and, where a page has an article (or else
a main element), against all outside it; ``PRIOR`` for the inside.  A page loses the blocks whose odds
fall below ``threshold``.  So without names entropy alone decides; a named branch stays only if nearly all
of it varies on dozens of pages, and a part of an article goes only if hundreds of pages repeat it.

The tree is a DataFrame of counts, pre-aggregated in every task, so a host of any size is partial
sums; nodes are named by 64-bit hashes of their path.  Only nodes that can change a verdict go back to the
pages: as a broadcast up to ``BROADCAST_NODES``, beyond that each page's nodes are joined with them.

Edge cases: null or empty html gives empty text; broken markup (unclosed or stray tags, comments,
missing body end) is read as browsers would, as far as text goes, in time and memory linear in the page
however deep it nests; a host with one page has nothing to compare, so only names decide; equal
pages of a host count as one page; a page that would lose all its blocks keeps all but the named
boilerplate; a null url is host ``""``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

# Names of elements, roles and classes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea xmp noembed noframes svg math".split())
NOISE_TAGS = frozenset("head nav footer header aside form menu dialog button select option input object canvas video audio label datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("table ul ol dl article section main body html".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
G = 0.9
#: Log odds for or against a node by its names, and pages that weigh as much as not knowing.
PRIOR, EVIDENCE = 5.0, 2
BROADCAST_NODES = 1 << 20
#: Repeated pages (host and digest, about 100 bytes each) whose counts go to every task.
BROADCAST_COPIES = 100_000


class Element:
    """A block element; ``key`` names its path, ``noise`` and ``root`` ("article", "main") hold for all inside."""

    __slots__ = ("tag", "key", "noise", "root", "article", "children")

    def __init__(self, tag: str, key: int, noise: bool, root: str, article: bool):
        self.tag, self.key, self.noise, self.root, self.article = tag, key, noise, root, article
        self.children: list[str] = []


def parse(html: str | None, host: str = "") -> tuple[list[tuple[Element, str]], list[Element]]:
    """Text blocks in page order, each with its innermost block element, and all block elements."""
    html = html or ""
    top = Element("", xxhash.xxh64_intdigest(host), False, "", False)
    stack: list[Element] = [top]
    held: Counter = Counter()  # open elements by tag
    elements: list[Element] = []
    blocks: list[tuple[Element, str]] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                blocks.append((stack[-1], text))

    def close(names, stop=frozenset()) -> None:
        if not any(held[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                for e in stack[i:]:
                    held[e.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    at, find = 0, _TAG.search
    while m := find(html, at):
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag in BLOCKS or tag in NOISE_TAGS:
                if held[tag]:
                    close({tag})
                elif tag in BLOCKS:
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            if tag == "hr":
                flush()
            elif tag == "br":
                buf.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS or tag in NOISE_TAGS:
            if tag in CLOSES_P:
                close({"p"}, SCOPES | {"td", "th", "li", "dd", "div"})
            if tag in SIBLINGS:
                for _ in range(3):
                    close(SIBLINGS[tag], {"table", "ul", "ol", "dl", "select"})
            if tag == "body":
                close({"head"})
            flush()
            up = stack[-1]
            attr: dict[str, str] = {}
            for a in _ATTR.finditer(m[3]) if m[3] else ():
                attr.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            names = _CAMEL.sub(" ", attr.get("class", "") + " " + attr.get("id", ""))
            words = set(_WORDS.findall(names.lower()))
            role = attr.get("role", "").lower()
            root = up.root or ("article" if tag == "article" else "main" if tag == "main" or role == "main" else "")
            own = tag in NOISE_TAGS and not (tag == "header" and up.root) or role in NOISE_ROLES
            own = own or (bool(words & NOISE_WORDS) and tag not in ("html", "body", "article", "main"))
            klass = ".".join(sorted(_WORDS.findall(attr.get("class", "").lower())))
            up.children.append(tag)
            key = xxhash.xxh64_intdigest(f"{tag}.{klass}", up.key)
            e = Element(tag, key, up.noise or own, root, up.article or tag == "article")
            stack.append(e)
            held[tag] += 1
            elements.append(e)
    if at < len(html):
        buf.append(html[at:])
    flush()
    return blocks, elements


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def log_odds(importance: float) -> float:
    return math.log(importance / (1 - importance))


def main_text(html: str | None, nodes: dict[int, float] | None = None, host: str = "", threshold: float = 0.3) -> str:
    """The main text of one page; ``nodes`` has the log odds of the host's nodes, 0 where missing."""
    blocks, _ = parse(html, host)
    least = log_odds(threshold)
    has = {e.root for e, _ in blocks if not e.noise}
    want = "article" if "article" in has else "main" if "main" in has else ""
    out, own = [], []
    for e, text in blocks:
        inside = e.article if want == "article" else e.root == want
        prior = -PRIOR if e.noise or (want and not inside) else PRIOR if want else 0.0
        if not e.noise:
            own.append(text)
        if (nodes.get(signed(e.key), 0.0) if nodes else 0.0) + prior >= least:
            out.append(text)
    # What all pages share is boilerplate only beside something else.
    return " ".join(out or own)


def signed(key: int) -> int:
    return key - (1 << 63)


def host_column() -> Column:
    """``host_of`` as a Column."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))


def page_counts(pages: DataFrame) -> DataFrame:
    """host, node, kind (0 pages, 1 presentation, 2 content), feature, n: what a task saw, k equal pages as 1/k each."""
    digest = F.md5("html")
    copies = pages.groupBy(host_column().alias("__host"), digest.alias("__digest")).agg(F.count("*").alias("copies")).where("copies > 1")
    copies = scratch(copies, "style-copies")
    if copies.count() <= BROADCAST_COPIES:  # then pages need not move to meet their count
        copies = F.broadcast(copies)
    pages = pages.select("url", "html").join(copies, (host_column() == F.col("__host")) & (digest == F.col("__digest")), "left")

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for url, html, equal in zip(*(b.column(c).to_pylist() for c in ("url", "html", "copies")), strict=True):
                host = host_of(url)
                page = set()
                for e, text in parse(html, host)[0]:
                    k = signed(e.key)
                    page.add((host, k, 0, 0))
                    page.add((host, k, 2, signed(xxhash.xxh64_intdigest(text))))
                    style = [c for c, before in zip(e.children, [None, *e.children], strict=False) if c != before]
                    page.add((host, k, 1, signed(xxhash.xxh64_intdigest(" ".join(style)))))
                for x in page:
                    seen[x] += 1 / (equal or 1)
            keys = list(zip(*seen, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(list(seen.values()), pa.float64())],
                names=["host", "node", "kind", "feature", "n"],
            )

    return pages.select("url", "html", "copies").mapInArrow(run, "host string, node long, kind int, feature long, n double")


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance of every style node that holds text."""
    counts = page_counts(pages).groupBy("host", "node", "kind", "feature").agg(F.round(F.sum("n")).alias("n"))
    # Pages that hold the node, then how evenly its styles and blocks are spread over them.
    per = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.ln("n"))).alias("style_nln"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("style_n"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.avg(F.when(F.col("kind") == 2, F.ln("n"))).alias("block_ln"),
    )
    m = F.ln("pages")
    presentation = F.when(F.col("pages") <= 1, 0.5).otherwise((F.ln("style_n") - F.col("style_nln") / F.col("style_n")) / m)
    content = F.when(F.col("pages") <= 1, 0.5).otherwise(1 - F.coalesce("block_ln", F.lit(0.0)) / m)
    g = F.pow(F.lit(G), F.col("styles"))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - g) * presentation + g * content))
    drawn = (raw * F.col("pages") + 0.5 * EVIDENCE) / (F.col("pages") + EVIDENCE)
    return per.select("host", "node", "pages", drawn.alias("importance"))


def telling(tree: DataFrame, threshold: float) -> DataFrame:
    """node, odds of the nodes whose log odds change a verdict beside some prior."""
    odds = F.ln(F.col("importance") / (1 - F.col("importance")))
    least = log_odds(threshold)
    change = F.lit(False)
    for prior in (-PRIOR, 0.0, PRIOR):
        change = change | ((odds + prior >= least) != F.lit(prior >= least))
    return tree.where(change).select("node", odds.alias("odds"))


def extract(pages: DataFrame, threshold: float = 0.3, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of ``pages``."""
    spark = pages.sparkSession
    known = scratch(telling(style_tree(pages), threshold), "style-tree")
    schema = "page_id long, url string, text string, n_chars long"
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def rows(b, nodes):
        text = [main_text(h, n, host_of(u), threshold) for u, h, n in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), nodes, strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    if known.count() <= broadcast_nodes:
        got = [(r["node"], r["odds"]) for r in known.toLocalIterator()]
        sent = spark.sparkContext.broadcast((np.array([x[0] for x in got], np.int64).tobytes(), np.array([x[1] for x in got]).tobytes()))

        def run(batches):
            keys, odds = sent.value
            nodes = dict(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(odds).tolist(), strict=True))
            for b in batches:
                yield rows(b, [nodes] * b.num_rows)

        return cols.mapInArrow(run, schema)

    def own_nodes(batches):
        for b in batches:
            at, node = [], []
            for row, u, h in zip(*(b.column(c).to_pylist() for c in ("row", "url", "html")), strict=True):
                keys = {signed(e.key) for e, _ in parse(h, host_of(u))[0]}
                at += [row] * len(keys)
                node += keys
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(node, pa.int64())], names=["row", "node"])

    def joined(batches):
        for b in batches:
            yield rows(b, [{x["node"]: x["odds"] for x in n or ()} for n in b.column("nodes").to_pylist()])

    # A node of a large host is a hot key: the few telling nodes are sent once to each of SALT shares.
    keyed = scratch(cols.withColumn("row", F.monotonically_increasing_id()), "style-pages")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = keyed.select("row", "url", "html").mapInArrow(own_nodes, "row long, node long").withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int"))
    per_row = hits.join(salted, ["node", "salt"]).groupBy("row").agg(F.collect_list(F.struct("node", "odds")).alias("nodes"))
    return keyed.join(per_row, "row", "left").select("page_id", "url", "html", "nodes").mapInArrow(joined, schema)


#: Shares of a hot node's pages in the join beyond the broadcast.
SALT = 16
