"""Main text of web pages by a site style tree.

The DOMs of one host are merged into a tree whose nodes are element paths (tags with
their classes). A node's content importance is one minus the mean entropy of its
texts: a text that returns on every page of the host tells nothing. Its presentation
importance is the entropy of the child sequences that the node shows. Both make the
composite importance, (1 - g ** l) presentation + g ** l content for l child sequences
and g = 0.9; where it is low over enough pages, the texts that return there are taken
out of every page. A branch is noise if it and all below it are, so it is enough to
judge the nodes that bear text. Copies of a page count as one page. What the markup itself declares as no article (navigation, forms, asides,
adverts by class or role, everything outside the article where the page marks one)
has no importance to begin with.

Pages are parsed twice in the order in which they are read; only hashes of pages and
counts of paths and of hashed texts are shuffled, added up before the shuffle. A path is
known by a hash that grows with each element, so depth costs nothing, and parsing takes
time in proportion to the page, whatever is left open or unclosed in it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chunkloom.llm._common import fresh, quoted, table, written

#: A path is low below this importance, if so many pages of the host have it, or half of them and at least two.
LEAST_IMPORTANCE = 0.1
LEAST_PAGES = 20
#: A text of a low path goes if it is on so large a share of the path's pages and on two at least.
RETURNS = 0.01
#: Pages with copies whose numbers are broadcast; more are joined.
COPIES_MOST = 1_000_000
#: Texts of low paths that every task is told, at most; more are joined to the pages of their host.
LOW_MOST = 200_000
_DAMP = 0.9

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)|<[!?/][^>]*>""", re.S)
#: What stands in a tag behind its name, where quotes hold together; looked for in so many characters.
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_REST_CHARS = 8192
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body caption head html option tbody td tfoot th thead title tr".split())
#: Elements that end an open one of these kinds, up to the nearest of those.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
_NO_ARTICLE = frozenset("nav footer aside form script style noscript template head title button select option textarea input svg math iframe object dialog menu canvas audio video".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_NO_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond related recommended login search widget widgets pagination pager toolbar skip".split()
)
_NEVER = frozenset("html body article main".split())


def _declared(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether the markup says that an element is no part of an article."""
    if tag in _NO_ARTICLE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _NO_ROLE or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = re.split(r"[^a-z0-9]+", name)
        if parts[0] in ("no", "has", "with", "without"):
            continue
        if tag in _NEVER and not (tag == "article" and parts[0] in ("comment", "comments", "reply", "ad", "advert")):
            continue
        if any(p in _NO_CLASS and not (inside and p == "header") for p in parts):
            return True
    return False


class Page:
    """blocks: (path, text, in the article, declared as none); styles: element path -> its child sequences, hashed.

    Paths are hashes, see ``path_id``.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.styles: dict[int, set[int]] = {}
        self.marked = False
        self._stack: list[tuple[str, int, bool, bool, list]] = []  # tag, path, in the article, declared as none, last child and hash of all
        self._open_tags: Counter[str] = Counter()
        self._run: list[str] = []
        self._parse(source)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            self._run = []
            if text:
                _, path, inside, none, _ = self._stack[-1] if self._stack else ("", 0, False, False, [])
                self.blocks.append((path, text, inside, none))

    def _pop(self) -> None:
        tag, path, _, _, children = self._stack.pop()
        self._open_tags[tag] -= 1
        self.styles.setdefault(path, set()).add(children[1])

    def _pop_to(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        if not any(self._open_tags[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in stop:
                return

    def _open(self, tag: str, raw: str, block: bool) -> None:
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip("/ \n\t\r\f") else {}
        _, above, inside, none, children = self._stack[-1] if self._stack else ("", 0, False, False, ["", 0])
        declared = _declared(tag, attrs, inside)
        if not block and not declared:
            return
        names = sorted(n for n in attrs.get("class", "").lower().split() if not any(c.isdigit() for c in n))
        name = ".".join([tag, *names])
        if children[0] != name:
            children[:] = name, path_id((name,), children[1])
        article = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        none = none or declared
        if article and not none:
            self.marked = inside = True
        self._stack.append((tag, path_id((name,), above), inside, none, ["", 0]))
        self._open_tags[tag] += 1

    def _parse(self, source: str) -> None:
        at, n, begin = 0, len(source), 0
        last = source.rfind(">")
        while at < n:
            m = _MARKUP.search(source, at) if at <= last else None
            if m and m.start() > last and not m[0].startswith("<!--"):
                m = None  # no tag ends behind here
            end = rest = -1
            if m and m["tag"]:
                # to the first > outside quotes, or where quotes don't hold together to the first > of all
                behind = _REST.match(source, m.end(), min(n, m.end() + _REST_CHARS))
                end = behind.end() if behind else source.find(">", m.end()) + 1
                rest = m.end()
            elif m:
                end = m.end()
            begin = m.start() if m else n
            if begin > at:
                text = source[at:begin]
                self._run.append(entities.unescape(text) if "&" in text else text)
            if not m:
                break
            at = end
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if block:
                self._flush()
            if m["end"]:
                if block:
                    self._pop_to((tag,))
                elif self._open_tags[tag]:
                    self._flush()
                    self._pop_to((tag,))
                continue
            attrs = source[rest : end - 1]
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                self._flush()
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    self._run.append(" ")
                continue
            if tag in _ENDS_P:
                self._pop_to(("p",), ("td", "th", "li", "div", "article", "section", "body", "blockquote"))
            if tag in _IMPLIED:
                self._pop_to(*_IMPLIED[tag])
            depth = len(self._stack)
            if not block:
                run, self._run = self._run, []
                self._open(tag, attrs, block)
                if len(self._stack) > depth:  # an inline element that is no part of the article ends the text before it
                    held = self._stack.pop()  # for a moment only
                    self._run = run
                    self._flush()
                    self._stack.append(held)
                else:
                    self._run = run
            else:
                self._open(tag, attrs, block)
        self._flush()
        while self._stack:
            self._pop()

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The blocks of the main text; low: hashes of the host's blocks that carry too little, unless that is all of them."""
        main = [(p, t) for p, t, inside, none in self.blocks if not none and (inside or not self.marked)]
        kept = [t for p, t in main if _hash(p, t) not in low] if low else []
        return "\n".join(kept or [t for _, t in main])


def path_id(names: tuple[str, ...], above: int = 0) -> int:
    """The hash of the path of elements ``names`` (tags with their classes) below a path; also of a sequence of children."""
    for name in names:
        above = xxhash.xxh64_intdigest(name, seed=above) >> 1
    return above


def _hash(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=path) >> 1


def _host(url_col: str):  # noqa: ANN202
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _counts(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """``host, path, kind, what, n``: on how many pages of the host; and ``host, host_pages``. Copies of a page count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int, int, int], float] = {}
            for host, source, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source)
                seen = {(path, 1, _hash(path, text)) for path, text, _, _ in page.blocks}
                seen |= {(path, 2, s) for path, styles in page.styles.items() for s in styles}
                seen |= {(path, 0, 0) for path in {p for p, _, _ in seen}}
                for key in seen:
                    total[host, *key] = total.get((host, *key), 0.0) + share
            keys = list(zip(*total, strict=True)) if total else [[]] * 4
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types, strict=True)), pa.array(list(total.values()), pa.float64())], ["host", "path", "kind", "what", "n"])

    read = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    page = F.xxhash64("host", "html")
    copies = written(read.groupBy("host", page.alias("page")).agg(F.count(F.lit(1)).alias("copies")), "style-copies")
    many = written(copies.where("copies > 1").select("page", "copies"), "style-many")
    told = read.withColumn("page", page).join(F.broadcast(many) if many.count() <= COPIES_MOST else many, "page", "left")
    told = told.select("host", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    counted = told.mapInArrow(count, "host string, path long, kind int, what long, n double").groupBy("host", "path", "kind", "what").agg(F.round(F.sum("n")).alias("n"))
    return written(counted, "style-counts"), copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Nodes of all hosts' style trees that bear text: ``host, path, pages, presentation, content, importance``; paths as ``path_id``s."""
    return _nodes(_counts(pages, url_col, html_col)[0])


def _nodes(counted: DataFrame) -> DataFrame:
    def total(kind: int, value):  # noqa: ANN001, ANN202
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    n = F.col("n")
    nodes = counted.groupBy("host", "path").agg(
        total(0, F.col("n")).cast("long").alias("pages"),
        total(1, n).alias("texts"),
        total(1, n * F.log(n)).alias("text_log"),
        total(2, n).alias("shows"),
        total(2, n * F.log(n)).alias("show_log"),
        total(2, F.lit(1)).alias("l"),
    )
    many = F.log(F.col("pages").cast("double"))
    content = F.when((F.col("texts") > 0) & (F.col("pages") > 1), 1 - F.col("text_log") / F.col("texts") / many).otherwise(1.0)
    presentation = F.when(F.col("pages") <= 1, 1.0).when(F.col("shows") > 0, (F.log("shows") - F.col("show_log") / F.col("shows")) / many).otherwise(0.0)
    nodes = nodes.where("texts > 0").withColumn("content", content).withColumn("presentation", presentation)
    damp = F.pow(F.lit(_DAMP), F.col("l"))
    return nodes.select("host", "path", "pages", "presentation", "content", ((1 - damp) * F.col("presentation") + damp * F.col("content")).alias("importance"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages plus ``main_text``: the article of each page, its blocks joined by line feeds.

    Null and empty pages give an empty text; a null url is a host of its own. A page
    never loses all of it to the tree. Repeated rows are answered each; an empty table
    gives an empty result; a very long page is parsed whole, by one task. Other columns
    pass unchanged, but one named main_text gives way to the result.
    """
    counted, hosts = _counts(pages, url_col, html_col)
    enough = F.least(F.lit(least_pages), F.greatest(F.lit(2), F.ceil(F.col("host_pages") / 2)))
    low = _nodes(counted).where((F.col("importance") < least) & (F.col("pages") > 1)).join(hosts, "host").where(F.col("pages") >= enough)
    texts = counted.where("kind = 1 and n > 1").join(low.select("host", "path", "pages"), ["host", "path"]).where(F.col("n") >= RETURNS * F.col("pages"))
    low = written(texts.select("host", "what").distinct(), "style-low")
    own = [c for c in pages.columns if c.lower() != "main_text"]
    source, host, gone = (fresh(own, n) for n in ("html_", "host_", "low_"))
    few = low.count() <= LOW_MOST
    rows = pages.select(*quoted(own), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias(source), _host(url_col).alias(host))
    told: dict[str, frozenset[int]] = {}
    if few:  # so few that every task may know them
        by: dict[str, set[int]] = {}
        for r in low.collect():
            by.setdefault(r["host"], set()).add(r["what"])
        told = {h: frozenset(x) for h, x in by.items()}
    else:
        sets = low.groupBy("host").agg(F.collect_set("what").alias(gone)).withColumnRenamed("host", "_of_host")
        rows = rows.join(sets, F.col(host) == F.col("_of_host"), "left").drop("_of_host")
    sent = pages.sparkSession.sparkContext.broadcast(told)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts = batch.column(host).to_pylist(), []
            for k, html in enumerate(batch.column(source)):  # one page at a time in Python's memory
                low = sent.value.get(hosts[k], frozenset()) if few else frozenset(batch.column(gone)[k].as_py() or ())
                texts.append(Page(html.as_py()).text(low))
            kept = batch.select(own)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*own, "main_text"])

    schema = StructType([*pages.select(*quoted(own)).schema.fields, StructField("main_text", StringType())])
    return rows.mapInArrow(extract, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
