"""Main text of web pages by site style trees.

Pages of one host are merged into a tree of element paths.  For each path two
kinds of evidence are gathered over the host's pages: the presentations (which
sequences of child tags it has) and the contents (which texts stand below it).
A path's importance combines the entropy of its presentations with the
importance of its contents, which falls as the same texts recur from page to
page: with ``n`` presentations, (1 - G**n) * presentation + G**n * content.
Branches of low importance are taken out of each page.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles that say what they are, by tag, role, class or id, go in any case.
Where a page marks its main part, or an article with at least half of its text,
only that is read.  A class or id is a name as a whole token (sidebar), or if it
holds nothing but names and words of place, in words joined by signs or by
capitals (site-footer, mainNav; not related-work).  A name of headers counts
outside of articles only.  A branch that holds the only article or main part of
the page stays, and so do all named branches if nothing else on the page has
text.  A form stays if it holds an article or main part, or if it has paragraphs or
headings and at least half of the page's text.

The tree is a table of (host, path) rows: counts are partial sums in Spark, so
a host with a third of all pages is spread over all tasks.  Copies of one page
count once.  What comes back to the pages is one row for each host with its
unimportant paths, which are few, as a path must recur on many pages; Spark
broadcasts that table if its files are small, and joins by shuffle else.

A page counts once for each path, with all its presentations of that path together.
Reading a page takes time in proportion to its length, whatever its nesting.

Edge cases: null or empty html gives empty text.  Unclosed, misnested and
truncated markup is read as far as it goes.  Hosts with fewer than ``MIN_PAGES``
pages have no tree evidence.  If the tree would take all of a page's text, the
page keeps it.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import bound_batches, cut
from larder.llm.url_filter import url_host

MIN_PAGES, LEAST_IMPORTANCE, G = 6, 0.25, 0.9

# HTML's element kinds, and the names that pages use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select".split())
DROPPED = frozenset("aside button canvas dialog footer head iframe input label map menu nav noscript object select script style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget widgets".split())
CLOSES_P = BLOCK - frozenset("html head body option legend caption tbody thead tfoot tr td th li dt dd".split())
ONE_OF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

NAME = re.compile(r"(/)?([a-zA-Z][^\s/>]*)")
SIGN = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
READ = frozenset("class id role hidden aria-hidden".split())
NAME_PART = re.compile(r"[a-z0-9]+")
CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Words that only say where or what kind of box it is, so that site-footer is a footer, but related-work, no-sidebar and has-menu are no names.
PLACES = frozenset("area article articles bar block bottom box btn button buttons cell col column container content count div feed foot form global google group head holder icon icons inner item items left link links list main message mobile news outer page panel post posts primary reader readers right row secondary section signup site slot standard sticky stories sub tertiary thread threads top trail unit up user users widget wrap wrapper zone".split())
#: With which "header" is the site's; an article's own (post-header) is no name.
HEADER_PLACES = frozenset("area bar box container div global header inner left main mobile outer page primary right secondary section site sticky top wrap wrapper".split())
#: Blocks that make a form with most of the page's text more than a form.
PROSE = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
#: Blocks around a text for whose contents it counts.
EVIDENCE_LEVELS = 64
KEPT, NAMED, BARRED = 0, 1, 2  # what an element's own tag and attributes say


class Node:
    __slots__ = ("tag", "path", "above", "holder", "depth", "low", "dropped", "barred", "scope", "block", "children", "verdict", "number", "named", "outer", "form")

    def __init__(self, tag, path, above, low, dropped, barred, scope, block, verdict=KEPT, number=0):
        self.outer = above.named if above is not None else None  # the nearest named element around it
        self.named = self if verdict == NAMED else self.outer
        self.form = above.form if above is not None and above.form else number if tag == "form" else 0
        self.tag, self.path, self.low, self.dropped, self.barred, self.scope, self.block, self.verdict, self.number = tag, path, low, dropped, barred, scope, block, verdict, number
        self.holder = self if block or above is None else above.holder  # the nearest block
        self.above = above.holder if above is not None else None  # the block around it
        self.children = []


def _names(value: str) -> set[str]:
    """Names that a class or id consists of: whole tokens, and parts of tokens that hold nothing but names and PLACES."""
    found = set()
    for token in value.split():
        parts = NAME_PART.findall(CAPITAL.sub(" ", token).lower())
        if "header" in parts and all(p in HEADER_PLACES or p.isdigit() for p in parts):
            found.add("header")
        if token.lower() in NAMES:
            found.add(token.lower())
        elif parts and all(p in NAMES or p in PLACES or p.isdigit() for p in parts):
            found.update(parts)
    return found


def _verdict(tag: str, attrs: dict[str, str], inside: bool) -> int:
    if tag in DROPPED or (tag == "header" and not inside) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return BARRED
    if attrs.get("role", "") in ROLES:
        return BARRED
    if tag in ("html", "body", "main", "article"):
        return KEPT
    names = _names(attrs.get("class", "") + " " + attrs.get("id", "")) if "class" in attrs or "id" in attrs else ()
    return NAMED if not NAMES.isdisjoint(names) or ("header" in names and not inside) else KEPT


def path_of(above: int, label: str) -> int:
    """The number of an element path: a 63-bit hash of the path above it and the element's label."""
    return int.from_bytes(hashlib.blake2b(b"%d " % above + label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


class Page:
    """The text blocks of one page with their elements, and the presentations of its elements.

    ``unimportant``: paths whose branches are marked as low.  Each element is
    opened and closed once and holds its own path only, so the work is linear in
    the page's length, however deep its elements nest.
    """

    def __init__(self, source: str, unimportant: frozenset = frozenset()):
        self.unimportant = unimportant
        self.spared: frozenset[int] | None = frozenset()  # elements that no name drops, None for all
        self._parse(source)
        narrow = True
        if not self.marked and self.holders:  # the article stands in a named branch
            narrow = not self.blocks
            self.spared = frozenset(self.holders)
            self._parse(source)
        if not self.blocks and self.named:
            self.spared = None
            self._parse(source)
        self._drop_forms()
        if narrow:
            marked = sum(len(text) for node, text in self.blocks if node.scope)
            if marked and (self.main or 2 * marked >= sum(len(text) for _, text in self.blocks)):
                self.blocks = [b for b in self.blocks if b[0].scope]

    def _drop_forms(self) -> None:
        """Drops the text of forms that hold neither an article nor most of the page's text."""
        size, prose, articles = Counter(), set(), set()
        for node, text in self.blocks:
            size[node.form] += len(text)
            if node.tag in PROSE:
                prose.add(node.form)
            if node.scope:
                articles.add(node.form)
        gone = {f for f, n in size.items() if f and f not in articles and (f not in prose or 2 * n < size.total())}
        # a form inside an article is the article's form
        gone |= {f for f in articles if f and f in self.forms_inside}
        self.blocks = [b for b in self.blocks if b[0].form not in gone]

    def _parse(self, source: str) -> None:
        self.blocks: list[tuple[Node, str]] = []
        self.styles: list[tuple[int, int]] = []
        self.text: list[str] = []
        self.stack = [Node("", 0, None, False, False, False, False, True)]
        self.open_tags: dict[str, list[int]] = {}  # depths of the open elements of each tag, ascending
        self.forms_inside: set[int] = set()
        self.unpaired: set[str] = set()  # quotes that do not occur any more
        self.opened, self.marked, self.main, self.named, self.holders = 0, False, False, False, set()
        self._read(source)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        if self.text:
            value = " ".join(html_lib.unescape("".join(self.text)).split())
            self.text = []
            if value:
                self.blocks.append((self.stack[-1].holder, value))

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.block:
            self._flush()
        self.stack.pop()
        self.open_tags[node.tag].pop()
        if node.block and not node.dropped:
            self.styles.append((node.path, zlib.crc32(" ".join(node.children).encode("utf-8", "surrogatepass"))))

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _nearest(self, tags) -> int:
        return max((depths[-1] for t in tags if (depths := self.open_tags.get(t))), default=0)

    def _find(self, tags, stops) -> int:
        """Depth of the nearest open element of ``tags`` not behind one of ``stops``; 0 if there is none."""
        depth = self._nearest(tags)
        return depth if depth and depth >= self._nearest(stops) else 0

    def _open(self, tag: str, raw_attrs: str) -> None:
        if tag in CLOSES_P and (depth := self._find(("p",), ("button", "td", "th", "div", "section", "article", "body", "li"))):
            self._close_to(depth)
        if tag in ONE_OF and (depth := self._find((tag, "dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), ONE_OF[tag])):
            self._close_to(depth)
        attrs = {name: m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw_attrs) if (name := m[1].lower()) in READ} if raw_attrs else {}
        above = self.stack[-1]
        block = tag in BLOCK
        if block:
            self._flush()
        label = f"{tag}.{attrs.get('class', '')}#{re.sub(r'[0-9]+', '0', attrs.get('id', ''))}" if attrs else tag
        holder = above.holder
        holder.children.append(label)
        path = path_of(holder.path, label) if block else holder.path
        self.opened += 1
        verdict = _verdict(tag, attrs, above.scope)
        if verdict == NAMED:
            self.named = True
            if self.spared is None or self.opened in self.spared:
                verdict = KEPT
        low = holder.low or (block and path in self.unimportant)
        node = Node(tag, path, above, low, above.dropped or verdict != KEPT, above.barred or verdict == BARRED, above.scope or tag in ("article", "main"), block, verdict, self.opened)
        self.open_tags.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        if tag == "form" and above.scope and not above.form:
            self.forms_inside.add(node.number)
        if tag in ("article", "main"):
            if not node.dropped:
                self.marked, self.main = True, self.main or tag == "main"
            elif not node.barred:
                around = node.named
                while around is not None and around.number not in self.holders:
                    self.holders.add(around.number)
                    around = around.outer

    def _tag_end(self, source: str, at: int) -> tuple[int, int, bool]:
        """(end of the attributes, start of what follows, whether the tag is closed) of a tag whose name ends at ``at``."""
        first, n = at, len(source)
        while m := SIGN.search(source, at):
            if m[0] == ">":
                return m.start(), m.end(), True
            end = -1 if m[0] in self.unpaired else source.find(m[0], m.end())
            if end < 0:  # the page ends in a quoted value: the tag ends at its next sign
                self.unpaired.add(m[0])
                end = source.find(">", first)
                return m.start(), (n if end < 0 else end + 1), False
            at = end + 1
        return n, n, False

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                start = n
            if start > at and not self.stack[-1].dropped:
                self.text.append(source[at:start])
            if start >= n:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if source[start + 1 : start + 2] in ("!", "?"):
                end = source.find(">", start)
                at = n if end < 0 else end + 1
                continue
            m = NAME.match(source, start + 1)
            if m is None:
                if not self.stack[-1].dropped:
                    self.text.append("<")
                at = start + 1
                continue
            stop, at, _ = self._tag_end(source, m.end())
            raw_attrs, tag = source[m.end() : stop], m[2].lower()
            if m[1]:
                if depth := self._find((tag,), ("td", "th", "table", "article", "body") if tag not in ("td", "th", "tr", "table", "article", "body", "html", "main") and tag in BLOCK else ()):
                    self._close_to(depth)
                elif tag == "p":
                    self._flush()
            elif tag in VOID:
                self.stack[-1].holder.children.append(tag)
                if tag == "hr":
                    self._flush()
                elif tag == "br" and not self.stack[-1].dropped:
                    self.text.append(" ")
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            elif tag == "plaintext":
                at = n
            elif not raw_attrs.endswith("/") or tag in BLOCK:
                self._open(tag, raw_attrs)


def main_text(source: str | None, unimportant: frozenset = frozenset()) -> str:
    """Text blocks of the page joined by newlines, without the branches given."""
    if not source:
        return ""
    blocks = Page(source, unimportant).blocks
    kept = [text for node, text in blocks if not node.low]
    return "\n".join(kept or [text for _, text in blocks])


def tree_evidence(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, page): what each page shows below each of its paths; kind 0 presentation, 1 content.

    A text tells of the EVIDENCE_LEVELS blocks around it.
    """

    def gather(batches):
        for batch in batches:
            out = {c: [] for c in ("host", "path", "kind", "value", "page")}
            for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
                value = source.as_py()
                if not value:
                    continue
                page = Page(value)
                own = zlib.crc32("\n".join(t for _, t in page.blocks).encode("utf-8", "surrogatepass"))
                shapes: dict[int, set[int]] = {}
                for p, v in page.styles:
                    shapes.setdefault(p, set()).add(v)
                rows = {(p, 0, zlib.crc32(str(sorted(v)).encode())) for p, v in shapes.items()}
                for node, text in page.blocks:
                    v = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                    for _ in range(EVIDENCE_LEVELS):
                        if node.above is None:
                            break
                        rows.add((node.path, 1, v))
                        node = node.above
                for p, kind, v in rows:
                    out["host"].append(host.as_py())
                    out["path"].append(p)
                    out["kind"].append(kind)
                    out["value"].append(v)
                    out["page"].append(own)
            yield pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["path"], pa.int64()), pa.array(out["kind"], pa.int8()), pa.array(out["value"], pa.int64()), pa.array(out["page"], pa.int64())], names=list(out))

    return pages.select("host", "html").mapInArrow(gather, "host string, path long, kind byte, value long, page long")


def path_importance(evidence: DataFrame) -> DataFrame:
    """(host, path, pages, importance) for paths on at least MIN_PAGES different pages."""
    seen = evidence.distinct()
    shares = seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a page has one value of kind 0 for each of its paths, so their sum is the number of different pages
    sums = shares.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.ln("n"))).alias("style_log"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.ln("n"))).alias("text_log"),
    )
    m = F.col("m")
    presentation = F.ln(m) - F.col("style_log") / m
    content = F.lit(1.0) - F.coalesce(F.col("text_log") / F.col("texts") / F.ln(m), F.lit(0.0))
    weight = F.pow(F.lit(G), F.col("styles"))
    return sums.where(m >= MIN_PAGES).select("host", "path", m.alias("pages"), ((1 - weight) * presentation / F.ln(m) + weight * F.greatest(content, F.lit(0.0))).alias("importance"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with text and n_chars (columns of these names are replaced)."""
    bound_batches(pages.sparkSession)
    frame = pages.drop("text", "n_chars", "_host", "_unimportant")
    evidence = tree_evidence(frame.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")))
    low = path_importance(evidence).where(F.col("importance") < LEAST_IMPORTANCE)
    of_host = cut(low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("_unimportant")))
    # Spark broadcasts the table if its files are small, and shuffles else
    rows = frame.withColumn("_host", url_host(F.col(url_col))).join(of_host, "_host", "left").drop("_host")
    kept = [c for c in frame.columns if keep_html or c != html_col]
    schema = T.StructType([*(frame.schema[c] for c in kept), *T.StructType.fromDDL("text string, n_chars long")])

    def read(batches):
        for batch in batches:
            texts = [main_text(source.as_py(), frozenset(paths.as_py() or ())) for source, paths in zip(batch.column(html_col), batch.column("_unimportant"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(read, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
