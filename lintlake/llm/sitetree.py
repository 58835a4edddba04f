"""HTML extraction with a site style tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.urlrules import url_host
from lintlake.sources.storage import shared_folder, stored

MIN_IMPORTANCE = 0.6
CONTENT_SHARE = 0.9  # of a node's importance; the rest is its presentation's
BROADCAST_NODES = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*'|['\"](?=[^<>'\"]*>))*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?", re.S)
SPACE = re.compile(r"\s+")
MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML elements by their kind, and words by which sites mark what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q"
    " ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
OUTSIDE = set(
    "nav footer aside form button select menu dialog head script style noscript template iframe"
    " svg object audio video canvas".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu"
    " menubar toolbar".split()
)
MARKS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer"
    " comment comments respond disqus share sharing social newsletter subscribe signup popup modal"
    " related recommended widget masthead topbar toolbar login search".split()
)
MAIN = {"article", "main"}


@dataclass(slots=True)
class Element:
    tag: str
    node: int  # hash of the path of tags and classes from the root
    gone: bool  # by its kind, no article text
    inside: bool  # in the main element
    weighed: bool  # its importance counts
    children: list = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[int, ...]
    weighed: tuple[int, ...]
    gone: bool
    inside: bool


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def parse(page: str | None) -> tuple[list[Block], dict[int, tuple]]:
    """Text blocks in page order, and each node's parent and children's tags and classes.

    Block elements end a block, inline ones don't.  Open elements are closed as HTML asks for
    (a block closes an open paragraph, an item an open item); stray end tags are passed over.
    """
    root = Element("", 0, False, False, False)
    stack = [root]
    blocks: list[Block] = []
    nodes: dict[int, tuple] = {}
    pieces: list[str] = []

    def end_block() -> None:
        if pieces:
            text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                path = tuple(e.node for e in stack[1:])
                weighed = tuple(e.node for e in stack[1:] if e.weighed)
                blocks.append(Block(text, path, weighed, stack[-1].gone, stack[-1].inside))

    def close(count: int) -> None:
        end_block()
        for e in stack[count:]:
            seen = nodes.setdefault(e.node, (stack[0].node, set()))[1]
            seen.add(tuple(dict.fromkeys(e.children)))
        del stack[count:]

    for m in TOKEN.finditer(page or ""):
        if m["text"] is not None:
            pieces.append(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag in ("br", "img", "wbr") and tag != "wbr":
                pieces.append(" ")
            continue
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at:
                close(at)
            continue
        end_block()
        if tag in CLOSES:
            last = stack[-1].tag
            if last == "p" and len(stack) > 1:
                close(len(stack) - 1)
                last = stack[-1].tag
            while last in CLOSES[tag]:
                close(len(stack) - 1)
                last = stack[-1].tag
        elif stack[-1].tag == "p":
            close(len(stack) - 1)
        attrs = _attributes(m["attrs"]) if m["attrs"].strip(" /") else {}
        name = " ".join(sorted(attrs.get("class", "").split()))
        up = stack[-1]
        node = xxhash.xxh64_intdigest(f"{up.node}/{tag}.{name}") >> 1
        up.children.append(f"{tag}.{name}")
        if tag in VOID:
            continue
        inside = up.inside or tag in MAIN
        marks = {w.lower() for v in (name, attrs.get("id", "")) for w in MARK.findall(v)}
        gone = (
            up.gone
            or tag in OUTSIDE
            or (tag == "header" and not up.inside)
            or attrs.get("role", "").lower() in ROLES
            or "hidden" in attrs
            or bool(marks & MARKS and tag not in ("html", "body") and tag not in MAIN)
        )
        # In the main element only branches with a class of their own are weighed.
        weighed = tag not in ("html", "body") and tag not in MAIN and (not inside or bool(name) or up.weighed)
        stack.append(Element(tag, node, gone, inside, weighed))
    close(1)
    return blocks, nodes


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``site, html`` of each distinct page of a host: copies say nothing about its style."""
    html = F.col("html")
    keys = F.xxhash64(html).alias("p1"), F.xxhash64(F.lit("page"), html, F.length(html)).alias("p2")
    return pages.groupBy("site", *keys).agg(F.first("html").alias("html")).select("site", "html")


def tree_rows(pages: DataFrame) -> DataFrame:
    """``site, node, kind, feature, above``: what each page adds to its host's style tree.

    Kind 0 is a node's presentation on the page (its children), kind 1 a text below it;
    ``above`` has the nodes on the way to a text's node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            out = []
            for site, page in zip(*(c.to_pylist() for c in batch.columns)):
                blocks, nodes = parse(page)
                rows = {
                    (site, node, 0, xxhash.xxh64_intdigest(repr(sorted(seen))) >> 1, ())
                    for node, (_, seen) in nodes.items()
                }
                rows |= {
                    (site, b.path[-1] if b.path else 0, 1, xxhash.xxh64_intdigest(b.text) >> 1, b.path[:-1])
                    for b in blocks
                }
                out += rows
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=k) for c, k in zip(columns, kinds)],
                ["site", "node", "kind", "feature", "above"],
            )

    schema = "site bigint, node bigint, kind bigint, feature bigint, above array<bigint>"
    return pages.select("site", "html").mapInArrow(run, schema)


def importance(rows: DataFrame) -> DataFrame:
    """``site, node, importance`` from the merged tree, between 0 and 1.

    With m pages that have the node, presentation counts as the entropy to base m of its
    styles, and content as 1 minus the mean entropy of the texts below it, where a text on k
    pages has log k / log m: navigation that repeats has little, an article much.  A node on
    one page has importance 1.  The counts are partial sums; no task holds a host.
    """
    used = rows.groupBy("site", "node", "kind", "feature").agg(
        F.count("*").alias("k"), F.first("above").alias("above")
    )
    # read three times below, so that pages are parsed once for it
    used = stored(used, f"{shared_folder(rows.sparkSession)}/tree")
    styles = used.where("kind = 0").groupBy("site", "node").agg(
        F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("klogk")
    )
    leaves = used.where("kind = 1").groupBy("site", "node").agg(
        F.sum(F.log("k")).alias("logs"), F.count("*").alias("texts"), F.first("above").alias("above")
    )
    below = leaves.select(
        "site", F.explode(F.concat(F.array("node"), "above")).alias("node"), "logs", "texts"
    ).groupBy("site", "node").agg(F.sum("logs").alias("logs"), F.sum("texts").alias("texts"))
    both = styles.join(below, ["site", "node"], "left")
    base = F.log("m")
    style = (base - F.col("klogk") / F.col("m")) / base
    content = 1 - F.coalesce(F.col("logs") / F.col("texts"), F.lit(0.0)) / base
    value = (1 - CONTENT_SHARE) * style + CONTENT_SHARE * content
    return both.select(
        "site", "node", F.when(F.col("m") <= 1, 1.0).otherwise(value).alias("importance")
    )


def main_text(page: str | None, low: set[int]) -> str:
    """The blocks that neither their kind nor the tree takes out, joined by line breaks."""
    blocks, _ = parse(page)
    main = any(b.inside for b in blocks)
    kept = [
        b.text
        for b in blocks
        if not b.gone and (b.inside or not main) and not any(n in low for n in b.weighed)
    ]
    return "\n".join(kept)


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", min_importance: float = MIN_IMPORTANCE
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page: its article's text.

    The distinct pages of a host are merged into a style tree of element paths.  Branches whose
    importance is below ``min_importance`` go; so do branches that HTML or their class says are
    menus, footers, adverts, forms or comments.  If a page has an article or main element, only
    what is in it stays, and there the tree judges only branches with a class of their own, so a
    copied article is not lost.  Character references are decoded, white space in a block is one
    blank, a line break element counts as white space, blocks are joined by one line break.

    A null or empty page gives an empty text; a null url is a host of its own; repeated rows are
    extracted each; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(
        F.col("page_id"),
        F.col(url).alias("url"),
        F.xxhash64(url_host(F.col(url))).alias("site"),
        F.col(html).alias("html"),
    )
    nodes = importance(tree_rows(distinct_pages(rows)))
    low = nodes.where(F.col("importance") < min_importance).select("site", "node")
    low = stored(low, f"{shared_folder(pages.sparkSession)}/low")
    by_site = low.groupBy("site").agg(F.collect_list("node").alias("low"))
    small = low.count() <= BROADCAST_NODES
    joined = rows.join(F.broadcast(by_site) if small else by_site, "site", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page, set(low or ()))
                for page, low in zip(*(c.to_pylist() for c in batch.columns[2:]))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "low").mapInArrow(
        run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint"
    )
