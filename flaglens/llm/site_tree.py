"""Main text of web pages by a site style tree.

A page is read leniently into open elements: raw text of scripts and styles, comments and unknown markup are skipped,
void elements and implied end tags (of p, li, table parts and the like) are known, an end tag without its start is
ignored, and elements more than `DEPTH` deep belong to the one above. Container elements (div, section, lists, tables
and such) are nodes of their site's style tree; a node is named by the path of tags and classes that leads to it, and
the pages of a host are merged node by node.

Importance. In the m pages of a site that have a node, its presentation is the sequence of its child elements: with p_i
the share of pages with the i-th sequence, its importance is the entropy -sum(p_i log_m p_i) (1 if m is 1). Its content
is the blocks of text and the link targets that stand in it and in no container below it: a feature that n of the pages
share has the entropy log_m n, and content importance is the mean of 1 minus that. Both are combined as (1 - GAMMA^l) *
presentation + GAMMA^l * content, with l the mean number of children; a node without content of its own has importance
1, so that what is in it decides. The tree of all hosts gives the same numbers, drawn towards 1 as if `PAGES` more pages
said so; a host's number is drawn towards that of all hosts in the same way, which tells for hosts of a few pages.

Removal. What HTML names an element is a prior: 1 for article and main, `NAMED` for nav, footer, aside, form and the like
and for their ARIA roles, `BESIDE` for other containers of a page that has an article or a main outside them, else `PLAIN`.
A container goes, with all below it, if the mean of prior and importance is under `LOW`, unless it holds the page's article
or main; inside an article only containers with a class, id or role are judged, so that a paragraph that many pages
quote stays. Names of classes tell nothing but which node it is, with one exception: readers' comments differ on every
page, so statistics can't see them; an article inside an article, which is HTML's own form of a comment, and what a class
or id calls comments or replies have the prior of nav. Scripts, styles, titles and form fields are no text at all.

Sums go to the style tree as counts of (host, node, kind, value) that are added up before they meet, so a host with a
third of all pages is no single task; nodes of low importance reach the pages as one list for each host, broadcast where
their count allows it.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by two line feeds. Null and empty pages give an empty text; a null url is the host ''. A page is held whole in
memory, and reading it takes time in proportion to its length. Repeated rows are separate rows (each counts as a page);
other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.store import BROADCAST_ROWS, Workspace
from flaglens.llm.worker import lean
from flaglens.session import ship

GAMMA, LOW, PAGES = 0.9, 0.6, 8
PLAIN, BESIDE, NAMED = 0.5, 0.2, 0.05
DEPTH = 512

_set = lambda s: frozenset(s.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title noscript template iframe svg math")
#: Elements that hold no text of the page's own.
SILENT = _set("script style noscript template iframe svg math title textarea button select option input label object canvas audio video head")
#: Containers and landmark roles that HTML and ARIA have for what stands around the main text.
AROUND = _set("nav footer aside form fieldset dialog menu")
ROLES = _set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog")
COMMENTS = _set("comment comments commentlist reply replies respond")
BLOCKS = _set("fieldset dialog menu p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th thead tbody tfoot caption blockquote pre section article main header hgroup figure figcaption address details summary body html hr nav footer aside form center")
CONTAINERS = _set("div section ul ol dl table header nav footer aside form fieldset dialog menu figure details center article main body")
#: Start tag: open elements that it closes, up to one of the scope.
CLOSES = {t: (_set("p"), _set("div section article main td th li blockquote body header footer aside nav figure details form table")) for t in BLOCKS - {"body", "html"}}
CLOSES |= {"li": (_set("li p"), _set("ul ol")), "dt": (_set("dt dd p"), _set("dl")), "dd": (_set("dt dd p"), _set("dl")), "tr": (_set("tr td th p"), _set("table")), "td": (_set("td th p"), _set("tr table")), "th": (_set("td th p"), _set("tr table")), "option": (_set("option"), _set("select"))}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LINK = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
SPACE = re.compile(r"\s+")
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") in page order."""
    at = 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        if mark > at:
            yield "text", page[at:mark], ""
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
        elif not (found := TAG.match(page, mark)):
            yield "text", "<", ""
            at = mark + 1
        else:
            end, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            tag, at = tag.lower(), found.end()
            if end:
                yield "close", tag, ""
                continue
            yield "open", tag, attributes
            if tag in RAW and not attributes.endswith("/"):
                close = ENDS[tag].search(page, at)
                at = close.end() if close else len(page)
                yield "close", tag, ""
            elif attributes.endswith("/") and tag not in BLOCKS:
                yield "close", tag, ""


class _Open:
    """An open element. box: its nearest container, itself included; up: the container above that."""

    __slots__ = ("box", "children", "features", "holds", "inside", "named", "path", "prior", "silent", "tag", "up")

    def __init__(self, tag: str, path: int, silent: bool, inside: int):
        self.tag, self.path, self.silent, self.inside = tag, path, silent, inside
        self.box, self.up, self.holds, self.named, self.prior = self, None, False, False, PLAIN
        self.children: list[str] = []
        self.features: list[int] = []


def _hash(text: str, seed: int = 0) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw, seed) << 31 ^ zlib.crc32(raw, seed ^ 0x5BD1E995)


class Reader:
    """Reads a page: `blocks`, texts with the containers that they are in, and `nodes`, all containers in page order."""

    def __init__(self, page: str | None):
        root = _Open("#", 0, False, 0)
        self.stack, self.nodes, self.blocks = [root], [root], []
        self.part: list[str] = []
        self.open: Counter = Counter()
        for kind, what, attributes in events(page or ""):
            if kind == "text":
                self.part.append(what)
            elif kind == "open":
                self._open(what, attributes)
            else:
                self._close(what)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        if self.part:
            text = SPACE.sub(" ", entities.unescape("".join(self.part))).strip()
            self.part = []
            top = self.stack[-1]
            if text and not top.silent:
                top.box.features.append(_hash(text, 1))
                self.blocks.append((top.box, text))

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.part.append(" ")
            return
        if tag in CLOSES:
            shut, scope = CLOSES[tag]
            if any(self.open[t] for t in shut):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in scope:
                        break
                    if self.stack[i].tag in shut:
                        while len(self.stack) > i:
                            self._pop()
        if tag in BLOCKS or tag in SILENT:
            self._flush()
        above = self.stack[-1]
        above.children.append(tag)
        if tag == "a" and (link := LINK.search(attributes)):
            above.box.features.append(_hash(link[1] or link[2] or "", 2))
        if tag in VOID or len(self.stack) > DEPTH:
            return
        inside = 2 if above.inside == 2 or tag == "article" else 1 if above.inside == 1 or tag == "main" else 0
        node = _Open(tag, above.path, above.silent or tag in SILENT, inside)
        if tag in CONTAINERS:
            self._contain(node, above, attributes)
        else:
            node.box = above.box
        self.stack.append(node)
        self.open[tag] += 1

    def _contain(self, node: _Open, above: _Open, attributes: str) -> None:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMES.finditer(attributes)} if attributes else {}
        node.up, node.named = above.box, bool(named)
        node.path = _hash(f"{node.tag}.{re.sub('[0-9]+', '#', ' '.join(named.values()))}", above.path & 0xFFFFFFFF)
        comment = node.tag == "article" and above.inside == 2 or bool(COMMENTS & set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}")))
        if comment or node.tag in AROUND or named.get("role") in ROLES or node.tag == "header" and node.inside == 0:
            node.prior = NAMED
        elif node.tag in ("article", "main"):
            node.prior = 1.0
            up = above.box
            while up and not up.holds:
                up.holds, up = True, up.up
        self.nodes.append(node)

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            if tag == "p":
                self._flush()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in ("table", "article", "main", "body") and tag not in ("body", "html", "article", "main", "table"):
                return

    def _pop(self) -> None:
        top = self.stack[-1]
        if top.tag in BLOCKS or top.tag in SILENT:
            self._flush()
        self.stack.pop()
        self.open[top.tag] -= 1

    def text(self, importance: dict[int, float]) -> str:
        """The blocks that no removed container holds; importance: that of nodes by path, 1 where none is given."""
        best = max((2 if n.tag == "article" else 1 if n.tag == "main" else 0 for n in self.nodes), default=0)
        gone: set[int] = set()
        for n in self.nodes[1:]:
            if id(n.up) in gone:
                gone.add(id(n))
            elif not n.holds and n.tag != "body" and (n.inside == 0 or n.named or n.prior == NAMED):
                prior = BESIDE if n.prior == PLAIN and best and n.inside < best else n.prior
                if (prior + importance.get(n.path, 1.0)) / 2 < LOW:
                    gone.add(id(n))
        return "\n\n".join(t for box, t in self.blocks if id(box) not in gone)


def main_text(page: str | None, importance: dict[int, float] | None = None) -> str:
    return Reader(page).text(importance or {})


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, n, children): a presentation row and content rows of each node, added up by batch."""
    for b in batches:
        seen: Counter = Counter()
        children: Counter = Counter()
        for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            host = host_of(url)
            found: dict[int, set[int]] = {}
            for node in Reader(page.as_py()).nodes[1:]:
                if node.tag == "body" or node.inside and not node.named or not node.features:
                    continue
                if node.path not in found:  # the first of a page's nodes of one path tells its presentation
                    found[node.path] = set()
                    key = (host, node.path, 0, _hash(" ".join(node.children), 3))
                    seen[key] += 1
                    children[key] += len(node.children)
                found[node.path].update(node.features)
            for path, features in found.items():
                for f in features:
                    seen[host, path, 1, f] += 1
        keys = list(seen)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64()), pa.array([children[k] for k in keys], pa.int64())], ["host", "node", "kind", "value", "n", "children"])


def _importance(tallies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, importance) of nodes."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    spread = F.col("n") * F.log("n")
    df = tallies.groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"), F.sum("children").alias("children"))
    # Means over features: each counts once, however many pages share it.
    df = df.groupBy(*keys).agg(of(0, F.col("n")).alias("pages"), of(0, spread).alias("p"), of(1, F.lit(1.0)).alias("c"), of(1, F.log("n")).alias("q"), F.sum("children").alias("children"))
    log = F.log(F.greatest("pages", F.lit(2.0)))
    presentation = F.when(F.col("pages") > 1, (log - F.col("p") / F.col("pages")) / log).otherwise(1.0)
    content = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("q") / F.col("c") / log)).otherwise(1.0)
    share = F.pow(F.lit(GAMMA), F.col("children") / F.col("pages"))
    return df.select(*keys, "pages", ((1 - share) * presentation + share * content).alias("importance"))


def importance(work: Workspace, pages: DataFrame) -> DataFrame:
    """(host, node, importance) of every node of every host's tree, drawn towards that of all hosts."""
    rows = work.keep(pages.select("url", "html").mapInArrow(lean("site_tree", _tallies), "host string, node long, kind int, value long, n long, children long"), "tallies")
    drawn = lambda n, x, to: (F.col(n) * F.col(x) + PAGES * to) / (F.col(n) + PAGES)
    everywhere = _importance(rows, ["node"]).select("node", drawn("pages", "importance", F.lit(1.0)).alias("common"))
    everywhere = work.keep(everywhere, "everywhere")  # so that a node of all hosts can be split in the join
    own = _importance(rows, ["host", "node"]).join(everywhere, "node")
    return own.select("host", "node", drawn("pages", "importance", F.col("common")).alias("importance"))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages."""
    work = Workspace(ship(spark), "site-tree")
    # BESIDE is the lowest prior of which importance decides; from this on it keeps everything.
    low = importance(work, pages).where(F.col("importance") < 2 * LOW - BESIDE)
    low = work.keep(low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("low")), "low")
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slim = pages.select("page_id", "url", "html", site.alias("_site"))
    nodes = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("n")).first()["n"]
    with_low = slim.join(F.broadcast(low) if nodes <= BROADCAST_ROWS else low, F.col("_site") == F.col("host"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), dict(low.as_py() or ())) for page, low in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_low.mapInArrow(lean("site_tree", run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
