"""Main text of web pages: structural rules and removal of the subtrees that a site repeats."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrakiln.llm.common import checkpointed, empty_if_null, url_host, without

#: Where a tag, a comment or a declaration begins.
START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
#: The rest of a tag: quotes count after an equals sign only.
REST = re.compile(r"((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_END = {name: re.compile(rf"</{name}(?:\s[^>]*|/)?>", re.I) for name in RAW}
#: Never shown as text, and what isn't the article by its tag.
INVISIBLE = frozenset("head template svg math object audio video canvas map".split())
DROPPED = INVISIBLE | frozenset("head nav footer aside form button select option dialog menu template svg math object audio video canvas map".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary header hgroup hr center fieldset legend".split()) | DROPPED
#: An opening tag ends these open elements, up to the nearest container named last.
CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - {"html", "body", "head"}
CONTAINERS = frozenset("div section article main body table td th ul ol blockquote aside nav header footer form fieldset figure details dialog".split())
#: Words of class, id and role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert menu navbar nav navigation breadcrumb breadcrumbs sidebar aside widget widgets comment comments commentlist respond disqus related recommended share sharing social newsletter subscribe subscription signup login popup modal overlay toolbar pager pagination footer masthead topbar skip banner contentinfo complementary search".split()
)
MAIN_ROLES = frozenset(("main", "article"))


#: Elements that hold an article's prose, and the article itself.
PROSE = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol td th tr table tbody thead dl dt dd figure figcaption".split())


class Node:
    __slots__ = ("article", "digest", "gone", "inline", "main", "name", "noise", "parent", "size")

    def __init__(self, name: str, parent: Node | None, noise: bool, article: bool, main: bool) -> None:
        self.name, self.parent, self.noise, self.article, self.main = name, parent, noise, article, main
        self.digest = xxhash.xxh64(name.encode("utf-8", "replace"))
        self.inline = name not in BLOCK
        self.size = 0
        self.gone = False

    @property
    def key(self) -> int:
        """The digest as a signed 64-bit number."""
        own = self.digest.intdigest()
        return own - (own >> 63 << 64)


def _attributes(rest: str) -> dict[str, str]:
    """The attributes by lower-case name, the first of each; none has the value ''."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), a or b or c)
    return out


def _is_noise(name: str, rest: str, in_main: bool) -> tuple[bool, str]:
    """Whether tag, class, id or role say that the element isn't the article; and its role."""
    if name in DROPPED or name == "header" and not in_main:
        return True, ""
    found = _attributes(rest) if rest else {}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, role
    for kind in ("class", "id", "role"):
        if value := found.get(kind):
            words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if name not in ("html", "body", "article", "main") and not NOISE.isdisjoint(words):
                return True, role
            if name == "article" and ("comment" in words or "comments" in words):
                return True, role
    return False, role


def parse(page: str, structural: bool = True) -> tuple[list[tuple[str, Node]], list[Node]]:
    """The page's text blocks outside noise, each with the innermost element around it, and all its elements.

    An element's digest covers its tag, its text with white space as one space and its children's digests. Time
    is linear in the page's length. A tag that the page's end cuts off is dropped with what follows it; after
    a quoted value that swallows the rest of the page quotes don't count any more. Without `structural` only
    what is never shown is noise.
    """
    root = Node("#", None, False, False, False)
    opened, depths, containers = [root], {}, [0]
    blocks, found, part = [], [], []

    def text_of(raw: str) -> str:
        return " ".join(html.unescape(raw).split())

    def flush() -> None:
        if part:
            text, node = text_of("".join(part)), opened[-1]
            part.clear()
            if text:
                blocks.append((text, node))
                node.digest.update(text.encode("utf-8", "replace"))
                node.size += len(text)

    def say(raw: str) -> None:
        node = opened[-1]
        if not node.noise:
            part.append(raw)
        elif text := text_of(raw):
            node.digest.update(text.encode("utf-8", "replace"))
            node.size += len(text)

    def close_to(depth: int) -> None:
        """Close the innermost elements until `depth` are open."""
        while len(opened) > depth:
            node = opened[-1]
            if not node.inline and not node.noise:
                flush()
            opened.pop()
            depths[node.name].pop()
            if containers[-1] == len(opened):
                containers.pop()
            opened[-1].digest.update(b"\0" + node.digest.digest())
            opened[-1].size += node.size

    def depth_of(names: tuple[str, ...]) -> int:
        """The innermost open element of these names, 0 if none."""
        return max(depths[n][-1] if depths.get(n) else 0 for n in names)

    at, end, last, quotes = 0, len(page), page.rfind(">"), True
    while at < end:
        m = START.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m[3]:
            stop = page.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        if m.start() > last:
            break
        tag = REST.match(page, m.end()) if quotes else None
        if tag is None:
            quotes = False
            stop = page.find(">", m.end())
            rest, at = page[m.end() : stop], stop + 1
        else:
            rest, at = tag[1], tag.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if depths.get(name):
                close_to(depths[name][-1])
            elif name in BLOCK and not opened[-1].noise:
                flush()
            continue
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "hr" and not opened[-1].noise:
                flush()
            elif name == "br":
                say(" ")
            continue
        if name in BLOCK and not opened[-1].noise:
            flush()
        if name in ENDS_P and depths.get("p") and depths["p"][-1] > containers[-1]:
            close_to(depths["p"][-1])
        if name in CLOSES:
            names, limit = CLOSES[name]
            if (depth := depth_of(names)) > depth_of(limit):
                close_to(depth)
        top = opened[-1]
        if not structural:
            noise, role = name in INVISIBLE, ""
        elif rest or name in DROPPED or name == "header":
            noise, role = _is_noise(name, rest, top.main)
        else:
            noise, role = False, ""
        noise = noise or top.noise
        article = top.article or not noise and name == "article"
        main = top.main or not noise and (name in MAIN_ROLES or role in MAIN_ROLES)
        node = Node(name, top, noise, article, main)
        found.append(node)
        if not (rest.rstrip().endswith("/") and name in ("svg", "path")):
            depths.setdefault(name, []).append(len(opened))
            if name in CONTAINERS:
                containers.append(len(opened))
            opened.append(node)
    close_to(1)
    flush()
    return blocks, found


def _candidates(found: list[Node]) -> Iterator[tuple[Node, bool]]:
    """Elements that may be a site's template, and whether they are prose of the marked article.

    An element with over half of the page's text, unless tag or class call it noise, is the page, not its frame.
    """
    total = sum(n.size for n in found if n.parent.parent is None)
    for node in found:
        if node.size and not node.inline and node.name not in ("html", "body") and (node.noise or 2 * node.size <= total):
            yield node, node.main and not node.noise and node.name in PROSE


def subtree_digests(page: str | None, structural: bool = True) -> set[tuple[int, bool]]:
    """(digest, prose) of the page's candidate subtrees."""
    return {(n.key, prose) for n, prose in _candidates(parse(page or "", structural)[1])}


def main_text(page: str | None, template: frozenset | set = frozenset(), structural: bool = True) -> str:
    """The text of `judged`."""
    return judged(page, template, structural)[0]


def judged(page: str | None, template: frozenset | set = frozenset(), structural: bool = True) -> tuple[str, int]:
    """The page's article, without `template` subtrees ((digest, prose)) and noise, blocks joined by two newlines; and how many subtrees went."""
    blocks, found = parse(page or "", structural)
    removed = 0
    if template:
        for node, prose in _candidates(found):
            node.gone = (node.key, prose) in template
        for node in found:  # parents come before their children
            removed += node.gone and not node.parent.gone
            node.gone = node.gone or node.parent.gone
    inside = "article" if any(n.article for _, n in blocks) else "main" if any(n.main for _, n in blocks) else None
    return "\n\n".join(t for t, n in blocks if not n.gone and (inside is None or getattr(n, inside))), removed


def templates(pages: DataFrame, url: str, html_col: str, min_pages: int, min_ratio: float, prose_pages: int, prose_ratio: float, structural: bool) -> DataFrame:
    """(_host, _subtree, _prose) of the subtrees on many of their host's different pages.

    At least `min_pages` pages and `min_ratio` of all; for the prose of marked articles `prose_pages` and `prose_ratio`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(host, page, *own) for own in subtree_digests(text, structural)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["_host", "_page", "_subtree", "_prose"])

    hosts = pages.select(F.xxhash64(url_host(F.col(url))).alias("_host"), F.xxhash64(empty_if_null(F.col(html_col))).alias("_page"), F.col(html_col).alias("_html"))
    found = hosts.mapInArrow(run, "_host long, _page long, _subtree long, _prose boolean").distinct()
    counts = found.groupBy("_host", "_subtree", "_prose").agg(F.count("*").alias("_n")).where(F.col("_n") >= F.least(F.lit(min_pages), F.lit(prose_pages)))
    totals = hosts.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    least, ratio = F.when(F.col("_prose"), prose_pages).otherwise(min_pages), F.when(F.col("_prose"), prose_ratio).otherwise(min_ratio)
    return counts.join(totals, "_host").where((F.col("_n") >= least) & (F.col("_n") >= ratio * F.col("_pages"))).select("_host", "_subtree", "_prose")


def extract(
    pages: DataFrame,
    url: str = "url",
    html_col: str = "html",
    min_pages: int = 3,
    min_ratio: float = 0.01,
    prose_pages: int = 10,
    prose_ratio: float = 0.5,
    structural: bool = True,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """`pages` with string column text (empty if none), long columns n_chars and n_template.

    First pass: digests of all element subtrees, counted per host over its different pages in Spark. Second
    pass: subtrees found on many of the host's pages go (n_template of them). A paragraph, list or table of a
    marked article is content that other pages may share, so it goes only from half of the host's pages on.
    Then, as the fallback for sites with few pages and unless `structural` is off, menus, forms and the like
    go by tag, class, id and role; the rest is the text. Up to `broadcast_rows` templates (17 bytes each) are
    broadcast; beyond, each page gets its host's found digests by a join on the page's digest. A null page or
    URL counts as empty; repeated rows are one page to the counts and each gets its text. Input columns named
    text, n_chars or n_template are replaced; names that begin with _ are the operator's own way, so a column
    _host, _page or _template raises ValueError.
    """
    if clash := sorted({c.lower() for c in pages.columns} & {"_host", "_page", "_template"}):
        raise ValueError(f"columns in the way: {clash}")
    source = without(pages, "text", "n_chars", "n_template")
    found = checkpointed(templates(source, url, html_col, min_pages, min_ratio, prose_pages, prose_ratio, structural))
    keyed = source.withColumn("_host", F.xxhash64(url_host(F.col(url))))
    kind = "array<struct<_subtree:long,_prose:boolean>>"
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lists: dict[int, set[tuple[int, bool]]] = {}
        for host, *subtree in found.collect():
            lists.setdefault(host, set()).add(tuple(subtree))
        shared = source.sparkSession.sparkContext.broadcast(lists)
        keyed = keyed.withColumn("_template", F.lit(None).cast(kind))
    else:
        shared = None
        keyed = keyed.withColumn("_page", F.xxhash64(empty_if_null(F.col(html_col))))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(h, p, *d) for h, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for d in subtree_digests(x, structural)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_host", "_page", "_subtree", "_prose"])

        per_page = keyed.select("_host", "_page", F.col(html_col).alias("_html")).mapInArrow(own, "_host long, _page long, _subtree long, _prose boolean")
        per_page = per_page.join(found, ["_host", "_subtree", "_prose"]).groupBy("_host", "_page").agg(F.collect_set(F.struct("_subtree", "_prose")).alias("_template"))
        keyed = keyed.join(per_page, ["_host", "_page"], "left").drop("_page")
    added = [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False), T.StructField("n_template", T.LongType(), False)]
    schema = T.StructType([*source.schema.fields, *added])
    keyed = keyed.select(*[F.col(f"`{c}`") for c in source.columns], "_host", "_template")
    width = len(source.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = shared.value if shared is not None else {}
        for batch in batches:
            at = batch.schema.get_field_index(html_col)
            made = [
                judged(page, by_host.get(host, frozenset()) if own is None else {(x["_subtree"], x["_prose"]) for x in own}, structural)
                for page, host, own in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)
            ]
            texts = [t for t, _ in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in made], pa.int64())], names=schema.names
            )

    return keyed.mapInArrow(run, schema)
