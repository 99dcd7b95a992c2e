"""Main-text extraction with a site style tree.

Pages of a host are merged into one tree: an element node is a path of tags and
classes, and under it the tree counts, over the host's pages, the child sequences it
shows (its styles) and the text blocks below it (its content).  From these counts
follow a node's importances:

* presentation: the entropy of its styles over the pages, 0 where all pages look alike;
* content: 1 less the mean entropy of its blocks, where a block on every page has
  entropy 1 and a block on one page 0.

Both make up the importance (the more styles, the more presentation counts).  Branches
below ``LOW`` on at least ``MIN_PAGES`` pages are removed from each page, unless their
content alone reaches ``LOW``: many styles of which one is on nearly all pages would
otherwise outweigh text that is different on every page.  A branch that holds all text
the page has left isn't judged, and a page of which nothing would be left keeps its text.

What a page declares is decided before that: navigation, headers, footers, sidebars,
notices, adverts, forms, comments and the like (by element, role or class) have
importance 0, and text blocks inside a declared article are kept (there a block's class
or id must consist of such words; other elements' names and the ids of headings and
sections are left alone); where a page declares
an article, text outside it isn't part of it.  This is needed: menus and adverts whose
texts differ on every page look like content to entropies alone.

Counting is one map-side combined aggregation over (host, node, value), so a host with
a third of all pages is no single task's work.  Copies of a page count as one: each has
the weight 1 / copies, from a table of the repeated pages' hashes.
"""

from __future__ import annotations

import html as htmllib
import re
import uuid
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, cut, prepare, small_or_shuffled
from duoclass.llm.urlfilter import url_host

LOW = 0.2          # branches of less importance go
MIN_PAGES = 3      # of a host that show a node before it is judged
GAMMA = 0.9        # weight of content, by style
MAX_DEPTH = 512    # open elements; deeper ones are read as their ancestor's text, as browsers do

# HTML names (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg select noframes".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul").split())
CONTAINER = frozenset("aside details div dl figure menu nav ol section table ul".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
P_CLOSERS = BLOCK - {"body", "head", "html", "caption", "li", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "option",
                     "optgroup", "legend", "summary"} | {"li", "dd", "dt"}
STOPS = frozenset("table ul ol dl article section main body html td th".split())
ARTICLE = frozenset(["article", "main"])
NOISE_TAGS = frozenset("nav aside footer form head menu button dialog search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr notice notices newsletter subscribe "
    "subscription popup modal overlay comment comments disqus respond reply share sharing social related recommended widget "
    "toolbar pagination pager login signup").split())
ARTICLE_NOISE = frozenset("comment reply ad advert advertisement sponsored related recommended".split())  # as whole classes
HEADER_WORDS = frozenset(["header", "topbar"])
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())  # their ids are made from titles

# Words that say where something is, not what it is: "site-footer" is a footer.
PLACE_WORDS = frozenset("site page main top bottom left right global primary secondary box bar block container wrapper wrap list item items area inner outer section link links".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")

KEEP, NOISE, OPEN = 0, 1, 2   # declared kinds of a block's place


def _noise_name(name: str) -> bool:
    """Is a class or id made of noise words alone ("social-share", not "social-structure")?"""
    words = _WORD.findall(name)
    return bool(words) and NOISE_WORDS.issuperset(words)


def _noise_place(name: str, more: frozenset = frozenset()) -> bool:
    """The same, with words of place beside the noise words ("site-footer", not "modal-verbs")."""
    words = set(_WORD.findall(name)) - PLACE_WORDS
    return bool(words) and (NOISE_WORDS | more).issuperset(words)


class Page:
    """The elements of a page (parent, signature, tag) and its text blocks in order."""

    __slots__ = ("parent", "sig", "tag", "noise", "blocks")

    def __init__(self, source: str):
        self.parent, self.sig, self.tag, self.noise = [-1], [""], [""], [False]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _add(self, parent: int, tag: str, attrs: str) -> int:
        cls, noise = "", tag in NOISE_TAGS
        if attrs and "=" in attrs or "hidden" in attrs:
            words, names, places = set(), [], []
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "role":
                    noise = noise or value in NOISE_ROLES
                elif name in ("class", "id"):
                    words.update(_WORD.findall(value))
                    places += value.split()
                    if name == "class" or tag not in TITLED:
                        names += value.split()
                    if name == "class":
                        cls = "." + ".".join(value.split())
                else:
                    noise = noise or name == "hidden" or value == "true"
            if tag in ARTICLE:
                noise = noise or not ARTICLE_NOISE.isdisjoint(cls[1:].split("."))
            elif not NOISE_WORDS.isdisjoint(words) and self._inside_article(parent):
                noise = noise or tag in BLOCK and any(map(_noise_name, names))
            elif tag not in ("html", "body"):
                more = frozenset() if HEADER_WORDS.isdisjoint(words) or self._inside_article(parent) else HEADER_WORDS
                noise = noise or any(_noise_place(x, more) for x in places)
        if tag == "header":
            noise = noise or not self._inside_article(parent)
        self.parent.append(parent)
        self.sig.append(tag + cls)
        self.tag.append(tag)
        self.noise.append(noise)
        return len(self.parent) - 1

    def _inside_article(self, i: int) -> bool:
        while i > 0:
            if self.tag[i] in ARTICLE:
                return True
            i = self.parent[i]
        return False

    def _parse(self, source: str) -> None:
        stack = [(0, "")]          # open elements: (node, tag); inline ones share their block's node
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                words = "".join(text).split()
                if words:
                    self.blocks.append((stack[-1][0], " ".join(words)))
                text.clear()

        def close_to(k: int) -> None:
            """Close the open elements from place ``k`` of the stack on."""
            if any(stack[j][0] != stack[j - 1][0] for j in range(k, len(stack))):
                flush()
            del stack[k:]

        n = len(source)
        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            tok = m[0]
            tag = m[2] or m[5]
            if tag is None:
                if not tok.startswith(("<!", "<?", "</")):
                    text.append(htmllib.unescape(tok) if "&" in tok else tok)
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == tag:
                        close_to(k)
                        break
                else:
                    if tag in BLOCK:
                        flush()
                continue
            attrs = m[3] or m[6] or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at) if not attrs.endswith("/") else None
                if not attrs.endswith("/"):
                    at = end.end() if end else n
                continue
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in CLOSES or tag in P_CLOSERS:
                shut = CLOSES.get(tag, frozenset())
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][1]
                    if t in shut or t == "p" and tag in P_CLOSERS:
                        close_to(k)
                        break
                    if t in STOPS:
                        break
            node = stack[-1][0]
            if tag in BLOCK and len(stack) < MAX_DEPTH:
                flush()
                node = self._add(node, tag, attrs)
            elif attrs and len(stack) < MAX_DEPTH:
                made = self._add(node, tag, attrs)
                if self.noise[made]:
                    flush()
                    node = made
                else:
                    for x in (self.parent, self.sig, self.tag, self.noise):
                        x.pop()
            stack.append((node, tag))
        flush()

    def kinds(self) -> list[int]:
        """Each element's declared kind."""
        n = len(self.parent)
        # a name like "sidebar-layout" around the page's first article isn't noise
        i = next((i for i in range(1, n) if self.tag[i] in ARTICLE and not self.noise[i]), 0)
        around = set()
        while i > 0:
            i = self.parent[i]
            around.add(i)
        any_article = False
        out = [OPEN] * n
        for i in range(1, n):
            p = out[self.parent[i]]
            noise = self.noise[i] and (self.tag[i] in NOISE_TAGS or i not in around)
            if p == NOISE or noise:
                out[i] = NOISE
            elif p == KEEP or self.tag[i] in ARTICLE:
                out[i] = KEEP
                any_article = True
        if any_article:
            out = [NOISE if k == OPEN else k for k in out]
        return out

    def paths(self) -> list[int]:
        """Each element's node in the site tree, as a hash of its path."""
        out = [0]
        for i in range(1, len(self.parent)):
            out.append(_hash(f"{out[self.parent[i]]}/{self.sig[i]}"))
        return out


_HASHES: dict[str, int] = {}


def _hash(s: str) -> int:
    h = _HASHES.get(s)
    if h is None:
        if len(_HASHES) > 50_000:
            _HASHES.clear()
        h = _HASHES[s] = int.from_bytes(blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
    return h


def judged(page: Page, kinds: list[int], i: int) -> bool:
    """May the tree remove this element?  Open ones, and containers inside an article."""
    return kinds[i] == OPEN or kinds[i] == KEEP and page.tag[i] in CONTAINER


STYLE, CONTENT = 1, 2


def _tree_rows(batches):
    """(host, node, kind, value, pages) counts of a batch of pages, each of its weight."""
    for rb in batches:
        seen: Counter = Counter()
        weights: Counter = Counter()
        for host, source, weight in zip(*(rb.column(i).to_pylist() for i in range(3))):
            if source:
                weights[host, source] += weight
        for (host, source), weight in weights.items():
            page = Page(source)
            path, kinds = page.paths(), page.kinds()
            children: dict[int, list[str]] = {}
            for i in range(1, len(path)):
                children.setdefault(path[i], [])
                if path[page.parent[i]]:
                    children.setdefault(path[page.parent[i]], []).append(page.sig[i])
            rows = {(host, p, STYLE, _hash(" ".join(c))) for p, c in children.items()}
            for i, text in page.blocks:
                h = None
                while i > 0:
                    if judged(page, kinds, i):
                        h = h or int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                        rows.add((host, path[i], CONTENT, h))
                    i = page.parent[i]
            for row in rows:
                seen[row] += weight
        if seen:
            cols = zip(*((*k, n) for k, n in seen.items()))
            yield batch_of(["host", "node", "kind", "value", "pages"],
                           *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))))


def weighted(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) with the weight of each: 1 / its copies on the host."""
    pages = pages.toDF("host", "html").withColumn("_page", F.xxhash64("host", "html"))
    copies = cut(pages.where("html <> ''").groupBy("_page").agg(F.count("*").alias("_n")).where("_n > 1"), "site-copies")
    return (pages.join(small_or_shuffled(copies, copies.count()), "_page", "left")
            .select("host", "html", (1 / F.coalesce("_n", F.lit(1))).alias("weight")))


def importances(pages: DataFrame) -> DataFrame:
    """(host, node, m, content, importance) of the site trees of ``pages`` (host, html)."""
    # the weights of a page's copies add up to 1 but for the last digits
    counts = (weighted(pages).mapInArrow(_tree_rows, "host string, node long, kind int, value long, pages double")
              .groupBy("host", "node", "kind", "value").agg(F.round(F.sum("pages")).cast("long").alias("pages")))
    style, content = F.col("kind") == STYLE, F.col("kind") == CONTENT
    n = F.col("pages").cast("double")
    node = counts.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("pages"))).alias("m"),
        # sum of n_i log n_i gives the styles' entropy once m is known
        F.sum(F.when(style, n * F.log(n))).alias("s"), F.count(F.when(style, 1)).alias("l"),
        F.sum(F.when(content, n * F.log(n))).alias("c"), F.sum(F.when(content, n)).alias("k"))
    log_m = F.log(F.col("m").cast("double"))
    pres = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * log_m)).otherwise(F.lit(1.0))
    cont = F.when((F.col("m") > 1) & (F.col("k") > 0), 1 - F.col("c") / (F.col("k") * log_m)).otherwise(F.lit(1.0))
    weight = F.pow(F.lit(GAMMA), F.col("l").cast("double"))
    return node.select("host", "node", "m", cont.alias("content"), ((1 - weight) * pres + weight * cont).alias("importance"))


def main_text(page: Page, low: frozenset | set) -> str:
    """The page's kept blocks, joined by one space."""
    kinds = page.kinds()
    gone = [k == NOISE for k in kinds]
    left = [(i, t) for i, t in page.blocks if not gone[i]]
    if low and left:
        path, held = page.paths(), [0] * len(kinds)
        for i, _ in left:
            held[i] += 1
        for i in range(len(kinds) - 1, 0, -1):
            held[page.parent[i]] += held[i]
        for i in range(1, len(kinds)):
            gone[i] = gone[i] or gone[page.parent[i]] or held[i] < len(left) and judged(page, kinds, i) and path[i] in low
        left = [(i, t) for i, t in left if not gone[i]] or left
    return " ".join(t for _, t in left)


def _extract(names: list[str], html_at: int, low_at: int):
    def run(batches):
        for rb in batches:
            texts = []
            for source, low in zip(rb.column(html_at), rb.column(low_at)):
                low = frozenset(low.as_py() or ()) if low.is_valid else frozenset()
                s = source.as_py()
                texts.append(main_text(Page(s), low) if s else "")
            yield batch_of(names, *[rb.column(i) for i in range(low_at)], pa.array(texts, pa.string()))

    return run


def extract_main_text(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows and columns of ``df`` with ``main_text`` (string, empty if there is none).

    A null or empty page has no text.  Pages with a null url, or one without a host, are
    one site.  Rows of a host with the same page count as one page, and each gets its text.
    A page that differs in any character is another one; where the tree would take all of a
    page's text, it takes none.  Pages of any length are read whole.  A column of ``df`` named ``main_text`` is replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("main_text")
    tag = uuid.uuid4().hex[:8]
    own_host, site, gone = (f"{x}_{tag}" for x in ("_host", "_site", "_low"))
    hosted = df.withColumn(own_host, url_host(F.col(url_col)))
    low = (F.col("m") >= MIN_PAGES) & (F.col("importance") < LOW) & (F.col("content") < LOW)
    noise = cut(importances(hosted.select(own_host, html_col)).where(low).select("host", "node"), "site-noise")
    lists = noise.groupBy(F.col("host").alias(site)).agg(F.collect_set("node").alias(gone))
    joined = hosted.join(small_or_shuffled(lists, noise.count()), F.col(own_host) == F.col(site), "left").select(*df.columns, gone)
    out = T.StructType([*df.schema.fields, T.StructField("main_text", T.StringType())])
    return joined.mapInArrow(_extract(out.names, df.columns.index(html_col), len(df.columns)), out)
