"""Operator 8: main text of web pages by site style trees.

The DOMs of a host's distinct pages are merged to one tree: elements with the same labels from the root down are
one node. A node's presentation is the sequence of its children's labels, its content the blocks of text right inside
it. What varies between pages is important, what all pages share is not:

* presentation: ``-sum(p * log(p, m))`` over the node's presentations, each on a share ``p`` of its ``m`` pages;
* own content: the mean of ``1 - log(k, m)`` over its blocks of text, each on ``k`` of the ``m`` pages;
* a node: ``PRESENTATION`` of its presentation's and the rest of the mean of its children's and its own content's
  importance, each weighted by the number of pages that have it.

A branch all of which, content and nodes, has a low importance is removed from each page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import materialize, small_batches, table, text_or_empty

#: A branch that fewer distinct pages of its host have is judged by its kind alone.
MIN_PAGES = 8
#: Importance below which a branch is removed, and the share of the presentation in a node's importance.
MIN_IMPORTANCE = 0.2
PRESENTATION = 0.1
#: Levels of the tree; deeper elements are part of their ancestor on the last level.
MAX_LEVELS = 32
#: Rows that a task counts before it sends them.
MAX_COUNTED = 200_000
#: Bytes of branches, and digests of repeated pages, that are sent to all executors; beyond, a shuffle joins them.
MAX_SENT_BYTES, MAX_SENT_DIGESTS = 64 << 20, 1_000_000
#: Parts of a host's pages in that shuffle.
SALTS = 32

# Element names by their role on a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Parts of formulas; rows and cells of their tables stay apart as blocks.
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none semantics".split())
#: What a page doesn't show as text; of formulas their second notation, of drawings their descriptions.
RAW = "script style noscript template iframe textarea title annotation-xml annotation desc metadata select".split()
REMOVED = set("nav footer aside form head button input select menu dialog".split())
CONTENT = {"article", "main"}
# Words in class names, ids and roles of what isn't the article.
REMOVED_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary alert masthead".split()
)
# Words that may stand beside such a word in one name ("cookie-box"); other words make it another name ("share-price").
BESIDE_NAMES = set(
    "area bar block body bottom box button buttons card center column container content desktop fixed footer global group head header heading holder inner item items layer left link links list main mobile outer overlay page panel right row section site slot small sticky tab text title top unit wrap wrapper zone".split()
)
# Words that tell alone, as the first or last of a name, whatever stands beside them ("inline-advert", "reader-comments").
SURE_NAMES = set("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus gdpr navbar newsletter popup promo promoted sidebar sponsored subscribe".split())
# Words beside which they mean something else ("ad-hoc", "expert-comment", "code-comments").
FALSE_FRIENDS = set("author authors code editor editors expert free hoc infinitum lib no source without".split())
# Whole names of lists of other articles.
REMOVED_PHRASES = {"you may also like", "you might also like", "read next", "more stories"}
# How words start in names of what may hold articles that aren't the page's own.
HOLD_OTHERS = ("comment", "disqus", "related", "replies", "respond")
#: Two words written as one ("adbox", "commentlist").
JOINED_NAMES = {a + b for r in REMOVED_NAMES for o in BESIDE_NAMES for a, b in ((r, o), (o, r))}
#: Only outside the article, whose own header holds its title.
REMOVED_OUTSIDE = {"header"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = set("article main section div table ul ol dl td th blockquote body aside nav header footer form figure".split())
ENDS_PARAGRAPH = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\"/>]|/(?!>)|['\"])*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"])*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, label: str) -> int:
    """The number of a node of the tree, remembered as sites repeat their nodes."""
    if (found := _paths.get((parent, label))) is None:
        if len(_paths) > 100_000:
            _paths.clear()
        found = _paths[parent, label] = int.from_bytes(hashlib.blake2b(f"{parent} {label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return found


class Node:
    """An element of a page: its place in the style tree, its kind, its children's labels and its own blocks of text.

    ``kind`` is "content", "neutral" or "removed"; ``form`` says that only a form around it removes it.
    """

    __slots__ = ("name", "parent", "kind", "form", "lineage", "children", "texts", "gone")

    def __init__(self, name: str, label: str, parent: Node | None, kind: str, form: bool = False):
        self.name, self.parent, self.kind, self.form = name, parent, kind, form
        self.children: list[str] = []
        self.texts: list[str] = []
        self.gone = False
        above = parent.lineage if parent else ()
        if len(above) < MAX_LEVELS:
            self.lineage: tuple[int, ...] = (*above, _path(above[-1] if above else 0, label))
        else:
            self.lineage = above
        if parent:
            parent.children.append(label)


def _names(attributes: str) -> tuple[str, bool, bool, bool]:
    """The presentation of an element (its class names without numbers), and whether one names what isn't the article.

    The second flag is for names that count outside the article only, the third for what may hold articles of others.
    """
    given = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    removed = outside = others = False
    for name in given.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words:
            continue
        plain = all(w in REMOVED_NAMES or w in BESIDE_NAMES for w in words)
        sure = (words[0] in SURE_NAMES or words[-1] in SURE_NAMES) and FALSE_FRIENDS.isdisjoint(words)
        mine = sure or (plain and not REMOVED_NAMES.isdisjoint(words)) or (len(words) == 1 and words[0] in JOINED_NAMES) or " ".join(words) in REMOVED_PHRASES
        removed |= mine
        others |= mine and any(w.startswith(HOLD_OTHERS) for w in words)
        outside |= plain and not REMOVED_OUTSIDE.isdisjoint(words)
    return re.sub(r"\d+", "0", given.strip()), removed, outside, others


class Page:
    """One pass over a page: blocks of text in order with the node of each, and all nodes, parents first.

    Open elements are also listed by name, so that a page of many elements that are never closed takes linear time.
    """

    def __init__(self, source: str):
        root = Node("page", "page", None, "neutral")
        self.blocks: list[tuple[Node, str]] = []
        self.nodes, self.stack = [root], [root]
        self.depths: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.contents: list[int] = []
        self.removed: list[int] = []
        self.others: list[int] = []
        self.parts: list[str] = []
        for token in TOKEN.finditer(source):
            if (text := token["text"]) is not None:
                self.parts.append(text)
            elif token["name"]:
                name = token["name"].lower()
                if token["end"]:
                    self._close(name)
                else:
                    self._open(name, token["attributes"] or "")
            elif token["raw"]:
                self._flush()
        self._flush()

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        self.parts = []
        if text:
            self.stack[-1].texts.append(text)
            self.blocks.append((self.stack[-1], text))

    def _push(self, node: Node, others: bool) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.nodes.append(node)
        self.depths.setdefault(node.name, []).append(depth)
        for listed, fits in ((self.holders, node.name in HOLDERS), (self.contents, node.kind == "content" and node.name in CONTENT), (self.removed, node.kind == "removed" and node.name not in ("aside", "form")), (self.others, others)):
            if fits:
                listed.append(depth)

    def _pop_to(self, depth: int) -> None:
        self._flush()
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()
        for listed in (self.holders, self.contents, self.removed, self.others):
            while listed and listed[-1] >= depth:
                listed.pop()

    def _open(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self.parts.append(" ")
            return
        label, named, named_outside, others = _names(attributes) if attributes.strip(" /") else ("", False, False, False)
        if name in INLINE and (name == "a" or not named):
            return
        self._flush()
        if name in CONTENT and self.removed and not self.others:  # menus and adverts that were never closed end where the article starts
            self._pop_to(self.removed[0])
        closes = CLOSED_BY.get(name, ()) or ()
        last = max((self.depths[n][-1] for n in (*closes, *(("p",) if name in ENDS_PARAGRAPH else ())) if self.depths.get(n)), default=0)
        if last and last >= (self.holders[-1] if self.holders else 0):
            self._pop_to(last)
        parent = self.stack[-1]
        inside = parent.kind == "content"
        removed = (name in REMOVED or named or (not inside and (name in REMOVED_OUTSIDE or named_outside))) and name not in CONTENT and name not in ("body", "html", "page")
        form = (name == "form" and not named and parent.kind != "removed") or (parent.form and not removed)
        if name in CONTENT and (parent.kind != "removed" or parent.form):
            kind, form = "content", False
        else:
            kind = "removed" if removed or parent.kind == "removed" else "content" if inside else "neutral"
        self._push(Node(name, f"{name} {label}", parent, kind, form), others and kind == "removed")

    def _close(self, name: str) -> None:
        open_at = self.depths.get(name)
        # An end tag doesn't reach out of the article.
        if open_at and (name in ("body", "html") or not self.contents or open_at[-1] >= self.contents[-1]):
            self._pop_to(open_at[-1])

    def main_text(self, branches: set[int]) -> str:
        """The blocks outside removed elements and, of those of no kind, outside the branches."""
        if branches:
            for node in self.nodes:  # parents come first
                node.gone = (node.parent is not None and node.parent.gone and node.kind != "content") or (node.kind == "neutral" and node.lineage[-1] in branches)
        return " ".join(text for node, text in self.blocks if node.kind != "removed" and not node.gone)


def _digest(values: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(values).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else ""


def style_tree(pages: DataFrame, url: str, source: str) -> DataFrame:
    """The merged DOMs: ``host, path, is_node, value, pages`` with ``lineage`` and ``neutral`` of nodes.

    A row counts the distinct pages on which a node has one presentation (``is_node``) or one block of text. Copies of
    a page say nothing about what a host's pages share, so each of ``n`` copies counts for ``1 / n`` page.
    """
    rows = pages.select(F.col(url).alias("url"), text_or_empty(source).alias("html"), F.xxhash64(host_column(url), text_or_empty(source)).alias("digest"))
    copies = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pages-copies")
    few = copies.count() <= MAX_SENT_DIGESTS
    weighed = rows.join(F.broadcast(copies) if few else copies, "digest", "left").select("url", "html", F.coalesce("n", F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        lineages: dict[tuple, tuple] = {}
        names = ["host", "path", "is_node", "value", "pages", "lineage", "neutral"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.bool_()]

        def flush() -> pa.RecordBatch:
            out = [(*key, n, *(lineages[key[:2]] if key[2] else (None, None))) for key, n in counts.items()]
            counts.clear()
            lineages.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in small_batches(batches, 256):
            for u, text, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                host, met = host_of(u), {}
                for node in Page(text).nodes:
                    children, texts, lineage = met.setdefault(node.lineage[-1], ([], set(), (node.lineage, node.kind == "neutral")))
                    children += node.children
                    texts.update(node.texts)
                for path, (children, texts, lineage) in met.items():
                    lineages[host, path] = lineage
                    counts[host, path, True, _digest(children)] += 1 / n
                    for t in texts:
                        counts[host, path, False, _digest([t])] += 1 / n
            if len(counts) > MAX_COUNTED:
                yield flush()
        yield flush()

    schema = "host string, path long, is_node boolean, value long, pages double, lineage array<long>, neutral boolean"
    counted = weighed.mapInArrow(run, schema).groupBy("host", "path", "is_node", "value")
    return counted.agg(F.round(F.sum("pages"), 6).alias("pages"), F.first("lineage").alias("lineage"), F.max("neutral").alias("neutral"))


def importances(tree: DataFrame) -> DataFrame:
    """``host, path, lineage, pages, importance, highest`` of each node of ``style_tree``.

    ``highest`` is the largest importance of the node, the nodes below it and their content. The importance is a
    linear recursion, so it is the sum over the nodes below, each weighted by the product of the shares on the way down:
    two joins by ancestor, whatever the depth, over tables of the size of the sites' designs. All keys have the
    path, so a large host is no heavier than others for any task.
    """
    entropy = lambda total, s: F.when(total > 1, 1 - s / (total * F.log(total))).otherwise(1.0)
    nodes = tree.where("is_node").groupBy("host", "path").agg(F.sum("pages").alias("m"), F.sum(F.col("pages") * F.log("pages")).alias("s"), F.first("lineage").alias("lineage"), F.max("neutral").alias("neutral"))
    nodes = nodes.select("host", "path", "lineage", "neutral", "m", entropy(F.col("m"), F.col("s")).alias("presentation"))
    texts = tree.where("not is_node").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("pages")).alias("s"))
    content = F.when(F.col("n").isNull(), F.lit(None)).when(F.col("m") > 1, 1 - F.col("s") / (F.col("n") * F.log("m"))).otherwise(1.0)
    nodes = nodes.join(texts, ["host", "path"], "left").select("host", "path", "lineage", "neutral", "m", "presentation", content.alias("content"))
    nodes = materialize(nodes, "pages-tree")
    parent = F.get("lineage", F.size("lineage") - 2)
    below = nodes.where(F.size("lineage") > 1).groupBy("host", parent.alias("path")).agg(F.sum("m").alias("below"))
    # The weights of what is right below a node: its children's pages, and its own pages if it has text.
    weights = nodes.join(below, ["host", "path"], "left").select("host", "path", "m", (F.coalesce("below", F.lit(0.0)) + F.when(F.col("content").isNotNull(), F.col("m")).otherwise(0.0)).alias("total"))
    share = F.lit(1 - PRESENTATION) * F.col("m") / F.col("total")
    up = weights.select("host", F.col("path").alias("up"), "total")
    steps = nodes.where(F.size("lineage") > 1).select("host", F.col("path").alias("step"), parent.alias("up"), "m").join(up, ["host", "up"]).select("host", "step", F.log(share).alias("step_share"))
    chain = nodes.select("host", "path", F.explode("lineage").alias("step")).join(steps, ["host", "step"])
    way = chain.groupBy("host", "path").agg(F.sum("step_share").alias("way"))
    own = PRESENTATION * F.col("presentation") + F.when(F.col("content").isNotNull(), share * F.col("content")).otherwise(0.0)
    known = nodes.join(way, ["host", "path"], "left").join(weights.select("host", "path", "total"), ["host", "path"])
    known = materialize(known.select("host", "path", "lineage", "neutral", "m", "content", F.coalesce("way", F.lit(0.0)).alias("way"), own.alias("own")), "pages-ways")
    top = known.select("host", F.col("path").alias("step"), F.col("way").alias("top_way"))
    under = known.select("host", "path", "way", "own", F.explode("lineage").alias("step")).join(top, ["host", "step"])
    summed = under.groupBy("host", F.col("step").alias("path")).agg(F.sum(F.col("own") * F.exp(F.col("way") - F.col("top_way"))).alias("importance"))
    both = materialize(known.join(summed, ["host", "path"]).select("host", "path", "lineage", "neutral", F.col("m").alias("pages"), "content", F.round("importance", 9).alias("importance")), "pages-importance")
    peaks = both.select("host", F.greatest("importance", F.round(F.coalesce("content", F.lit(0.0)), 9)).alias("peak"), F.explode("lineage").alias("path"))
    return both.join(peaks.groupBy("host", "path").agg(F.max("peak").alias("highest")), ["host", "path"])


def unimportant_branches(tree: DataFrame) -> DataFrame:
    """``host, path, neutral`` of the branches that enough pages of a host share and all of which is unimportant."""
    return importances(tree).where((F.col("pages") >= MIN_PAGES) & (F.col("highest") < MIN_IMPORTANCE)).select("host", "path", "neutral")


def host_column(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract_main_text(pages: DataFrame, url: str = "url", source: str = "html", key: str = "page_id") -> DataFrame:
    """``key, url, text, n_chars``: the main text of each page, one row for each row.

    Elements that HTML or their names mark as menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles or reader comments are removed, and so are branches of neither kind that are unimportant in the
    style tree of their host. What lies in ``article`` or ``main`` is kept otherwise, however often the
    host repeats it, even in a form around the whole page; but an ``article`` inside reader comments or a list of related
    articles goes with them. In the tree, elements below ``MAX_LEVELS`` levels are part of their ancestor there. Null html counts as empty and has an empty text; pages without
    a host share the empty host; an empty table gives no rows. A page that is cut off ends all its open elements. Blocks
    are joined by one space. Pages of any length and depth take time and memory in proportion to their length.

    The branches to remove are joined by host as one list for each host, whose size is that of the site's design; they
    are sent to all executors up to ``MAX_SENT_BYTES``, else hosts are joined in ``SALTS`` parts each.
    """
    tree = materialize(style_tree(pages, url, source), "pages-style")
    branches = unimportant_branches(tree).where("neutral").groupBy("host").agg(F.collect_set("path").alias("paths"))
    branches = materialize(branches, "pages-branches")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text_or_empty(source).alias("html"), host_column(url).alias("host"))
    size = branches.agg(F.sum(64 + F.length("host") + 8 * F.size("paths"))).first()[0] or 0
    if size <= MAX_SENT_BYTES:
        joined = rows.join(F.broadcast(branches), "host", "left")
    else:
        salted = branches.select("host", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html", "key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("key", "url", "html", "paths")
    kinds = f"key {pages.schema[key].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            texts = [Page(text).main_text(set(paths or ())) for text, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return joined.mapInArrow(run, kinds)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")
