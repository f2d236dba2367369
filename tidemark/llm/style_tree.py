"""Main-text extraction with a site style tree.

The pages of one host are merged into a tree of presentation nodes, an element's path
from the body with its classes. Over the host's distinct pages each node has a
distribution of presentation styles (its children's tags) and of contents (its text);
their entropies give its importance: a menu that is the same on every page has none, an
article has much. Each is averaged with a prior of high importance, so that few pages
have to agree more than many. A page's text is then read without the branches that are
low on its host's tree. Elements whose tag, role or class names them as menus, notices,
adverts, forms or comments are low whatever the tree says, since a host's only page has
no statistics and a menu may differ on every page; plain paragraphs of an article are
never low, since copies of a page would make them so.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages' worth of importance 1 that a node's own pages are averaged with: a node that is
#: the same on its host's only two pages is low, one that differs on two of three is not.
PRIOR = 0.4
#: Branches below this composite importance go.
IMPORTANCE = 0.2
#: The weight that presentation loses with each leaf, and content gains.
GAMMA = 0.9
#: With more low nodes than this over all hosts they are joined, not broadcast.
_BROADCAST_NODES = 200_000

# HTML's elements by kind, and names that mark what is not main text.
_RAW = "script|style|noscript|textarea|iframe|title|xmp|noembed|noframes"
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
_HOLDERS = set("object template button applet marquee audio video canvas map svg math noscript".split())
_SPACE = {"br", "td", "th", "img", "input", "wbr"}
_LOW_TAGS = set("nav header footer aside form button select menu dialog head label audio video canvas map datalist svg math object template".split())
_LOW_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
# Names of adverts, notices and comments; of these and other parts; and those that stand
# alone, since inside other names they mark parts of an article (entry-header, side-by-side).
_AD_NAMES = "ads? adverts? advertisement advertising adsense banners? sponsor(?:ed|s)? promo(?:tion|tions|s)? cookies? consent gdpr popup modal newsletter subscribe subscription signup comments? commentlist replies respond disqus"
_PART_NAMES = f"{_AD_NAMES} sidebars? menus? nav navbar navigation breadcrumbs? notices? social sharing recommend(?:ed|ations?)? masthead widgets? toolbar pagination pager"
_WHOLE_NAMES = "header footer side share hidden search skip related overlay login"


def _names(inside: str, whole: str = "") -> re.Pattern:
    any_of = "|".join(inside.split())
    alone = "|" + r"(?<!\S)(?:" + "|".join(whole.split()) + r")(?!\S)" if whole else ""
    return re.compile(rf"(?:^|[\s_-])(?:{any_of})(?:$|[\s_-]){alone}", re.I)


_LOW_AD_NAMES, _LOW_NAMES = _names(_AD_NAMES), _names(_PART_NAMES, _WHOLE_NAMES)
_PLAIN = set("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tbody thead tfoot tr td th dl dt dd figure b i em strong a span code".split())
_CLOSED_BY = {"p": _BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# A quote opens a value only behind =, and only if it is closed again.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<({_RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|$)|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


# Lines are hashed together as a polynomial in _BASE.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


class _Node:
    __slots__ = ("tag", "path", "low", "article", "plain", "kids", "first", "leaves", "content", "saved")

    def __init__(self, tag: str, path: int, low: bool, article: bool, plain: bool) -> None:
        self.tag, self.path, self.low, self.article, self.plain = tag, path, low, article, plain
        self.kids: list[str] = []
        #: The page's lines before it; how many are in it, and the hash of those.
        self.first = self.leaves = self.content = 0
        #: The text of the block before a low element in it, to which it goes back.
        self.saved: list[str] | None = None


def _opened(parent: _Node, tag: str, attributes: str, names: bool) -> _Node:
    name = ""
    # an article's own header has its headline
    low = parent.low or names and tag in _LOW_TAGS and not (tag == "header" and parent.article)
    main = tag in ("article", "main")
    plain_tag = tag in _PLAIN
    if attributes.strip():
        got = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        name = f"{got.get('class', '')} {got.get('id', '')}".strip()
        main = main or got.get("role") == "main"
        low = low or "hidden" in got or got.get("aria-hidden") == "true" or names and got.get("role") in _LOW_ROLES
        if names and name and not low and tag not in ("html", "body", "article", "main"):
            low = bool((_LOW_AD_NAMES if parent.article and plain_tag else _LOW_NAMES).search(name))
    key = ".".join([tag, *sorted(name.split())]) if name else tag
    article = parent.article or main
    return _Node(tag, key_of(f"{parent.path}/{key}"), low, article, article and (main or parent.plain or parent.tag in ("article", "main")) and (main or plain_tag and not name))


def blocks(html: str | None, low_paths: frozenset[int] = frozenset(), nodes: list[_Node] | None = None, names: bool = True) -> list[tuple[bool, str]]:
    """(inside an article, text) of the page's blocks that are not low, in page order.
    nodes gets the closed elements that the style tree judges; without names only low_paths
    are low. The work grows with the
    page's length whatever its depth: an element's lines are those between its start and
    its end, so hashes of the page's first lines give the hash of any element's."""
    text = html or ""
    root = _Node("", 0, False, False, False)
    stack, out, run, at = [root], [], [], 0
    places: dict[str, list[int]] = {}  # where on the stack each tag stands
    open_blocks: list[int] = []  # where blocks do
    hashes, powers = [0], [1]  # of the lines so far, and of _BASE

    def flush() -> None:
        line = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if line:
            top = stack[-1]
            if nodes is not None:
                hashes.append((hashes[-1] * _BASE + key_of(line)) % _PRIME)
                powers.append(powers[-1] * _BASE % _PRIME)
            if not top.low:
                out.append((top.article, line))

    def close() -> None:
        n = stack[-1]
        if run and (n.tag in _BLOCK or n.saved is not None):
            flush()
        stack.pop()
        if n.saved is not None:
            run.extend(n.saved)
        places[n.tag].pop()
        if n.tag in _BLOCK:
            open_blocks.pop()
        if nodes is not None and not n.plain and len(hashes) - 1 > n.first:
            n.leaves = len(hashes) - 1 - n.first
            n.content = (hashes[-1] - hashes[n.first] * powers[n.leaves]) % _PRIME
            nodes.append(n)

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            run.append(text[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag in _SPACE:
            run.append(" ")
        if m[2]:
            if places.get(tag):
                i = places[tag][-1]
                # an inline end tag does not close blocks, but for elements that hold them
                if tag in _BLOCK or tag in _HOLDERS or not open_blocks or open_blocks[-1] < i:
                    while len(stack) > i:
                        close()
            continue
        while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1].tag, ()):
            close()
        if tag in _BLOCK:
            for drawing in ("svg", "math"):
                # a block ends an open drawing
                while places.get(drawing):
                    close()
        if tag in _BLOCK and open_blocks and stack[open_blocks[-1]].tag == "p":
            # a block ends an open paragraph and the inline elements in it
            for _ in range(len(stack) - open_blocks[-1]):
                close()
        stack[-1].kids.append(tag)
        if tag in _VOID or m[4].endswith("/"):
            continue
        n = _opened(stack[-1], tag, m[4], names)
        if low_paths and not n.low and not n.plain:
            n.low = n.path in low_paths
        if n.low and not stack[-1].low and tag not in _BLOCK:
            n.saved = run.copy()
            run.clear()
        n.first = len(hashes) - 1
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            open_blocks.append(len(stack))
        stack.append(n)
    run.append(text[at:])
    while len(stack) > 1:
        close()
    flush()
    return out


def key_of(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(html: str | None, low_paths: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The blocks of the page's articles, or of all of it where it has none."""
    found = blocks(html, low_paths, names=names)
    inside = [t for article, t in found if article]
    return "\n\n".join(inside or [t for _, t in found])


def _host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> host, node, pages, presentation, content, importance.

    A node's appearances are its distinct pairs of style (its children's tags) and text on
    each of the host's distinct pages. presentation and content are the entropies of the
    styles and of the texts over these, to the base of their number; importance weighs
    them, the more leaves the less content. Both content and importance are then averaged
    with PRIOR pages of importance 1. Nodes of a single page are not judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, digest, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                nodes: list[_Node] = []
                blocks(page, nodes=nodes)
                for n in nodes:
                    rows.append((host, n.path, digest, key_of(" ".join(n.kids)), n.content, n.leaves))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "node", "page", "style", "content", "leaves"])

    seen = (
        pages.select(_host().alias("host"), F.xxhash64("html").alias("page"), F.col("html").cast("string"))
        .where("host <> ''")
        .mapInArrow(run, "host string, node long, page long, style long, content long, leaves long")
        .distinct()
    )
    judged = ["host", "node"]
    m = seen.groupBy(*judged).agg(F.count("*").cast("double").alias("m"), F.avg("leaves").alias("leaves"), F.count_distinct("page").alias("pages")).where("pages > 1")

    def entropies(what: str) -> DataFrame:
        # the entropy of one style or text over its n pages is log n; sums of n log n give both
        return seen.groupBy(*judged, what).agg(F.count("*").cast("double").alias("n")).groupBy(*judged).agg(F.sum(F.col("n") * F.log("n")).alias(f"{what}_sum"))

    out = m.join(entropies("style"), judged).join(entropies("content"), judged)
    base = F.log("m")
    presentation = 1 - F.col("style_sum") / F.col("m") / base
    content = 1 - F.col("content_sum") / F.col("m") / base
    weight = F.pow(F.lit(GAMMA), F.col("leaves"))
    smoothed = lambda x: (x * F.col("pages") + PRIOR) / (F.col("pages") + PRIOR)
    importance = (1 - weight) * presentation + weight * content
    return out.select("host", "node", "pages", presentation.alias("presentation"), smoothed(content).alias("content"), smoothed(importance).alias("importance"))


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars, a row each.

    Blocks are joined in page order by a blank line, with character references decoded
    and white space within a block made one blank. Null or empty html: an empty text.
    A null or hostless url has no tree; such pages are read by names alone. Repeated
    pages count once in the tree. A page that has articles gives them, any other all
    that is not low. Without names the tree alone says what is low."""
    low = style_tree(pages).where((F.col("importance") < IMPORTANCE) & (F.col("content") < IMPORTANCE))
    hosts = cut(low.groupBy("host").agg(F.collect_list("node").alias("__low"), F.count("*").alias("__n")).withColumnRenamed("host", "__host"))
    small = (hosts.agg(F.sum("__n")).first()[0] or 0) <= _BROADCAST_NODES
    side = hosts.select("__host", "__low")
    rows = pages.select("page_id", "url", "html").withColumn("__key", _host())
    joined = rows.join(F.broadcast(side) if small else side.hint("merge"), F.col("__key") == F.col("__host"), "left")
    kind = joined.select("page_id", "url").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset(paths or ()), names) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", F.col("html").cast("string"), "__low").mapInArrow(run, kind.add("text", "string").add("n_chars", "long"))
