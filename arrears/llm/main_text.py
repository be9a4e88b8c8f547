"""Operator 2: main text of web pages by equivalence-class templates.

The tokens of a page are its tags, told apart by their path in the tree, and
its blocks of text with their path. Over the pages of one host, tokens whose
occurrence vectors (how often on which page) are equal form a class. A class
is kept if it is frequent (missing from at most MISSING of the host's
different pages), large (LEAST tokens) and valid: on KEPT of the pages its
tokens come in one order, repeated as a whole where they repeat, and in one
gap of the host's root class, the largest one that occurs once a page. Valid
classes, nested in those gaps, are the host's template. What stands between
template tokens are its slots.

The main text of a page is its slots, without those inside elements that are
set apart (navigation, headers, footers, asides, forms, adverts, notices,
comments, by element, role or class word). If the page names its article (an
article element, else main, else a class word; of several the one with most
text, what stands nested in it included), all that is inside it counts,
whether other pages of the host have it too or not. Else, if the host has a template, those of
the gap that holds most text over all the host's pages, else all that are not
mostly links. There, blocks of text that belong to the template are dropped,
so constant notices go even where nothing names them.

Vectors are never gathered: a vector is known by the exclusive or of the
hashes of its entries, which partial aggregation combines. A host of a third
of all pages is thus no larger a group than any other. Templates are bounded
by what most pages of a host share; they are broadcast if they measure at most
BROADCAST bytes, else joined by host.

Character references are decoded, white space in a block becomes one space,
blocks are joined by one line break in page order. A line break element
counts as white space. A null or empty page has an empty text. Pages without
a host have no template. Repeated pages weigh as one in what is frequent, and so do pages that differ
only in tags and digits (print, session or dated variants).
An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrears.session import pin

from .common import table
from .html_tokens import Page, parse

MISSING, LEAST, KEPT = 0.1, 3, 0.9
#: different pages a host needs for a template
FEWEST = 4
BROADCAST = 32 << 20

_TOKENS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("times", pa.int32()),
                     ("place", pa.int32()), ("is_text", pa.bool_())])
_TOKENS_DDL = "host string, page long, token long, times int, place int, is_text boolean"


def _find_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its different tokens, how often and where first."""
    for batch in batches:
        rows = []
        for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            own = parse(html)
            seen: dict[int, list] = {}
            for at, token, is_text in sorted([(a, t, False) for a, t in own.tags] + [(b.at, b.token, True) for b in own.blocks]):
                entry = seen.setdefault(token, [0, at, is_text])
                entry[0] += 1
            rows += [(host, page, t, n, at, x) for t, (n, at, x) in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOKENS, strict=True)],
                                             schema=_TOKENS)


class Templates(dict):
    """Templates by host, for the pages of a task; a bounded number."""

    def get_for(self, host: str, column: pa.Array, i: int) -> Template | None:
        """Of row ``i``, whose host's template the column holds."""
        if host not in self:
            if len(self) > 1000:
                self.clear()
            entries = column[i].as_py()
            self[host] = Template(entries) if entries else None
        return self[host]


class Template:
    """A host's classes: for each token its class and place in it; the root
    class's tokens bound the gaps."""

    def __init__(self, entries: list[dict]):
        self.of = {e["token"]: (e["cls"], e["nth"]) for e in entries}
        self.size = defaultdict(int)
        for e in entries:
            self.size[e["cls"]] += 1
        self.root = next((e["cls"] for e in entries if e["root"]), None)
        self.main = next((e["main"] for e in entries if e["main"] is not None), None)

    def gaps(self, page: Page) -> tuple[list[int], list[int]]:
        """Where gaps begin along a page, and which."""
        own = [(at, self.of[t][1]) for at, t in page.tags if self.of.get(t, (None,))[0] == self.root]
        return [at for at, _ in own], [gap for _, gap in own]

    def is_text(self, token: int) -> bool:
        return token in self.of


def gap_of(gaps: tuple[list[int], list[int]], at: int) -> int:
    k = bisect_right(gaps[0], at) - 1
    return gaps[1][k] if k >= 0 else -1


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and class: whether its tokens are in order and in which
    gap they are; and how much text each gap holds (class null)."""
    known = Templates()
    for batch in batches:
        rows = []
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            template = known.get_for(host, batch.column("template"), i)
            page = parse(html)
            gaps = template.gaps(page)
            order = defaultdict(list)
            for at, token in sorted(page.tags + [(b.at, b.token) for b in page.blocks]):
                if token in template.of:
                    cls, nth = template.of[token]
                    order[cls].append((nth, at))
            for cls, seen in order.items():
                k = template.size[cls]
                ordered = len(seen) % k == 0 and all(nth == i % k for i, (nth, _) in enumerate(seen))
                inside = {gap_of(gaps, at) for _, at in seen} if cls != template.root else {-1}
                rows.append((host, cls, ordered, min(inside) if len(inside) == 1 else None, 0))
            mass = defaultdict(int)
            for b in page.blocks:
                if not b.excluded and not template.is_text(b.token):
                    mass[gap_of(gaps, b.at)] += len(b.text) - b.linked
            rows += [(host, None, True, g, n) for g, n in mass.items()]
        if rows:
            host, cls, ordered, gap, mass = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(cls, pa.int64()), pa.array(ordered, pa.bool_()), pa.array(gap, pa.int32()),
                 pa.array(mass, pa.int64())], names=["host", "cls", "ordered", "gap", "mass"])


def main_blocks(page: Page, template: Template | None) -> list[str]:
    """The blocks of a page's main text."""
    blocks = [b for b in page.blocks if not b.excluded]
    inside = [b for b in blocks if b.region]
    if inside:
        # containers inside another belong to it, with all their text
        mass = dict.fromkeys(page.regions, 0)
        for b in inside:
            mass[b.region] += len(b.text)
        for region in reversed(page.regions):
            if page.parents[region]:
                mass[page.parents[region]] += mass[region]
        first = max((r for r in mass if mass[r]), key=lambda r: (page.regions[r], mass[r], -r))
        within = {first}
        for region in page.regions:
            if page.parents[region] in within:
                within.add(region)
        return [b.text for b in inside if b.region in within]
    slots = [b for b in blocks if not (template and template.is_text(b.token))]
    if template is not None and template.main is not None:
        gaps = template.gaps(page)
        own = [b for b in slots if gap_of(gaps, b.at) == template.main]
        if own:
            slots = own
    return [b.text for b in slots if 2 * b.linked <= len(b.text)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Templates()
    for batch in batches:
        texts = []
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            template = known.get_for(host, batch.column("template"), i)
            texts.append("\n".join(main_blocks(parse(html), template)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def _with_templates(pages: DataFrame, entries: DataFrame, how: str) -> DataFrame:
    """``pages`` with the ``template`` of their host. Small by measure:
    broadcast; else a join by host, which Spark splits where it is skewed."""
    held = entries.groupBy("host").agg(F.collect_list(F.struct(*[c for c in entries.columns if c != "host"])).alias("template"))
    bytes_ = entries.agg(F.coalesce(F.sum(F.octet_length("host") + 48), F.lit(0)).alias("n")).first().n
    return pages.join(F.broadcast(held) if bytes_ <= BROADCAST else held, "host", how)


def templates(pages: DataFrame) -> DataFrame:
    """``(host, token, cls, nth, root, main)``: the valid classes of each
    host's template."""
    hosted = pages.where("host is not null")
    words = F.regexp_replace("html", r"<[^>]*>|[0-9\s]+", "")
    hosts = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(F.xxhash64(words)).alias("kinds")).where(F.col("kinds") >= FEWEST)
    tokens = (hosted.withColumn("page", F.monotonically_increasing_id()).select("host", "page", "html")
              .mapInArrow(_find_tokens, _TOKENS_DDL)
              .groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count(F.lit(1)).alias("support"),
                                            F.sum("times").alias("total"), F.avg("place").alias("place"),
                                            F.first("is_text").alias("is_text")))
    frequent = pin(tokens.where("support > 1").join(hosts, "host")
                   .where(F.col("pages") - F.col("support") <= MISSING * F.col("kinds")), "templates")
    same = W.partitionBy("host", "vector", "support", "total")
    classes = (frequent.withColumn("size", F.count(F.lit(1)).over(same)).where(F.col("size") >= LEAST)
               .withColumn("cls", F.xxhash64("vector", "support", "total"))
               .withColumn("nth", F.row_number().over(same.orderBy("place", "token")) - 1))
    biggest = (classes.where("total = support").groupBy("host")
               .agg(F.max_by("cls", F.struct("size", "support", "cls")).alias("root_cls")))
    classes = pin(classes.join(biggest, "host").withColumn("root", F.col("cls") == F.col("root_cls"))
                  .select("host", "token", "cls", "nth", "root", F.lit(None).cast("int").alias("main")), "templates")
    seen = pin(_with_templates(hosted.select("host", "html"), classes, "inner")
               .mapInArrow(_check, "host string, cls long, ordered boolean, gap int, mass long")
               .groupBy("host", "cls", "ordered", "gap").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass")), "templates")
    valid = (seen.where("cls is not null").groupBy("host", "cls")
             .agg((F.max(F.when(F.col("ordered") & F.col("gap").isNotNull(), F.col("n"))) / F.sum("n")).alias("share"))
             .where(F.col("share") >= KEPT).select("host", "cls"))
    main = seen.where("cls is null").groupBy("host").agg(F.max_by("gap", F.struct("mass", -F.col("gap"))).alias("main"))
    return classes.drop("main").join(valid, ["host", "cls"]).join(main, "host", "left").select("host", "token", "cls", "nth", "root", "main")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.when(host != "", host).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return (_with_templates(rows, pin(templates(rows), "templates"), "left")
            .select("page_id", "url", "host", "html", "template")
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
