"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements on the same path of tags and class names are one
node. A node's presentation importance is the entropy of the child sequences it has on the host's
pages; its content importance is how little its texts recur over these pages. Branches in which
every node is of low importance are taken out of each page.

A host of few pages says little, so its importances are shrunk to a prior: the importance of the
same node on all hosts, itself shrunk to what the markup says (text beside ``article`` and ``main``
elements is not the article, other text is). With more pages, and more hosts, the tree outweighs
both. Only elements whose tag or ARIA role says so are no text of an article by kind. Pages of a
host with equal texts count once, so that copies of an article stay whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import attach, small, stored
from parlance.llm.urls import host_of

#: branches under this importance go; so many pages weigh as much as the prior
THRESHOLD, STRENGTH = 0.6, 4.0
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAME = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
SKIP = frozenset("head script style noscript template iframe nav aside footer form button select option textarea menu dialog svg object canvas video audio title".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: what an open element is closed by, without an end tag
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre hr main figure li".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option"])}
#: ARIA roles of what is around a text
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: texts of reader comments differ as those of articles do, so no entropy tells them; their usual name and schema.org's property do
COMMENTS = frozenset(("comment", "comments"))
#: where a text stands: in main text, on a page without any, beside it
INSIDE, ALONE, BESIDE = 0, 1, 2


def key_hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """One page's elements, with their texts and child sequences, and its text blocks."""

    def __init__(self, source: str, noisy: frozenset[int] | set[int] = frozenset()) -> None:
        self.found: set[tuple[int, bool, bool, int]] = set()  # (node, in main text, is a text, text under it or child sequence)
        self.blocks: list[tuple[bool, int, int, str]] = []  # (in main text, node, number of its element, text)
        self.has_main = False
        self._noisy = noisy
        self._above = [-1]  # by number: the element around an element
        # open elements: tag, node, dropped by kind, in main text, child tags, number
        self._open: list[tuple[str, int, bool, bool, list[str], int]] = [("", 0, False, False, [], 0)]
        self._run: list[str] = []
        self._read(source)

    def _side(self, main: bool) -> int:
        return INSIDE if main else BESIDE if self.has_main else ALONE

    def marks(self) -> set[tuple[int, int, bool, int]]:
        """(node, where it stands, is a text, text under it or child sequence)."""
        return {(placed(node, side), side, content, h) for node, main, content, h in self.found for side in (self._side(main),)}

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._run)).split())
        self._run = []
        if not text:
            return
        _, node, dropped, main, _, no = self._open[-1]
        if dropped:
            return
        h = key_hash(text)
        self.found.update((e[1], main, True, h) for e in self._open)
        self.blocks.append((main, node, no, text))

    def _close(self, n: int) -> None:
        """Close all but the first ``n`` open elements."""
        for _, node, dropped, main, kids, _ in self._open[n:]:
            if not dropped:
                self.found.add((node, main, False, key_hash(*kids)))
        del self._open[n:]

    def _start(self, tag: str, attrs: str) -> None:
        while len(self._open) > 1:
            at = next((i for i in range(len(self._open) - 1, 0, -1) if self._open[i][0] not in INLINE), 0)
            if not at or tag not in CLOSED_BY.get(self._open[at][0], ()):
                break
            self._flush()
            self._close(at)
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self._run.append(" ")
        _, parent, dropped, main, kids, above = self._open[-1]
        kids.append(tag)
        if tag in VOID:
            return
        named = [(k.lower(), v.strip("\"'").lower()) for k, v in NAME.findall(attrs)] if attrs else []
        node = key_hash(parent, tag, re.sub(r"\d+", "#", " ".join(v for _, v in named)))
        by_kind = tag in SKIP or (tag == "header" and not main) or (tag == "article" and main and any(e[0] == "article" for e in self._open))
        if named and not by_kind and tag not in ("html", "body"):
            by_kind = any(v in ROLES if k == "role" else not COMMENTS.isdisjoint(v.split()) for k, v in named)
        main = main or (tag in MAIN and not dropped and not by_kind)
        self.has_main |= main
        self._above.append(above)
        self._open.append((tag, node, dropped or by_kind, main, [], len(self._above) - 1))

    def _end(self, tag: str) -> None:
        at = next((i for i in range(len(self._open) - 1, 0, -1) if self._open[i][0] == tag), 0)
        if tag == "p" and not at or tag not in INLINE:
            self._flush()
        if at:
            if any(t[0] not in INLINE for t in self._open[at:]):
                self._flush()
            elif self._open[at][2] != self._open[at - 1][2]:
                self._flush()
            self._close(at)

    def _read(self, source: str) -> None:
        at, end, low = 0, len(source), None
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self._run.append(source[at:lt])
            if lt == end:
                break
            m = TOKEN.match(source, lt) or LOOSE.match(source, lt)
            if not m:
                self._run.append("<")
                at = lt + 1
                continue
            at = m.end()
            if not m.re.groups or m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, m.group(3))
            if tag in RAW and not m.group(3).endswith("/"):
                low = low or source.lower()
                stop = low.find(f"</{tag}", at) if len(low) == end else source.find(f"</{tag}", at)
                at = end if stop < 0 else stop  # what is inside is no markup, and no text of the article
        self._flush()
        self._close(1)

    def main_text(self) -> str:
        """The text by kind, without noisy nodes; a node goes only where all texts under it are in noisy nodes.

        Where the markup names main text, all of it stays if nothing else would, as of near copies that
        fill a site; a page of noisy nodes alone has no text.
        """
        low = [placed(node, self._side(main)) in self._noisy for main, node, _, _ in self.blocks]
        alive = set()  # (element, in main text) with text that is not in a noisy node
        for (main, _, no, _), noise in zip(self.blocks, low):
            while not noise and no >= 0 and (no, main) not in alive:
                alive.add((no, main))
                no = self._above[no]
        kept = [t for main, _, no, t in self.blocks if (no, main) in alive]
        return "\n\n".join(kept or [t for main, _, _, t in self.blocks if main])


def placed(node: int, side: int) -> int:
    """The key of a node that stands inside, without or beside main text."""
    return node ^ (side << 61)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, marks): of the pages of a host with equal main texts by kind one, with its marks (node, side, content, feature)."""
    kinds = [("node", pa.int64()), ("side", pa.int32()), ("content", pa.bool_()), ("feature", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marks, ends = [], [], [0]
            for source in b.column("html").to_pylist():
                page = Page(source or "")
                texts.append(key_hash(*[t for main, _, _, t in page.blocks if main or not page.has_main]))
                marks.extend(sorted(page.marks()))
                ends.append(len(marks))
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*marks)) or [[]] * 4, kinds)], [n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["host", "page", "marks"])

    read = pages.mapInArrow(run, "host string, page long, marks array<struct<node: long, side: int, content: boolean, feature: long>>")
    return read.groupBy("host", "page").agg(F.min("marks").alias("marks"))


def node_statistics(pages: DataFrame) -> DataFrame:
    """From distinct_pages: (host, node, side, content, feature, n): on how many pages a node has that text under it, or that child sequence."""
    return pages.select("host", F.inline("marks")).groupBy("host", "node", "side", "content", "feature").agg(F.count("*").alias("n"))


def own_importance(stats: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(host, node, side, pages, own 0 to 1 or null): what a host's pages alone say; null for a host of one page.

    Presentation: entropy of the child sequences, to the base of the number of pages. Content: 1 less
    the mean over texts of log(pages with the text) to that base; 1 for nodes without text. The
    importance is the mean of both; unless the text stands beside main text it is not under the content
    importance, as a paragraph has no children to vary.
    """
    m = F.when(F.col("pages") > 1, F.log(F.col("pages").cast("double")))
    share = F.col("n") / F.col("pages")
    per = stats.join(small(n_pages), "host").groupBy("host", "node", "side", "pages").agg(
        F.sum(F.when(~F.col("content"), -share * F.log(share) / m)).alias("presentation"), F.avg(F.when(F.col("content"), 1 - F.log(F.col("n").cast("double")) / m)).alias("content")
    )
    content = F.coalesce("content", F.lit(1.0))
    mean = (F.least(F.lit(1.0), F.coalesce("presentation", F.lit(0.0))) + content) / 2
    own = F.when(F.col("side") == BESIDE, mean).otherwise(F.greatest(mean, content))
    return per.select("host", "node", "side", "pages", F.when(F.col("pages") > 1, own).alias("own"))


def importance(own: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(host, node, importance): own importances shrunk to the prior of the node, that one to what the markup says.

    A host of n pages weighs n - 1 against ``strength`` of the prior, as do the hosts together.
    """
    weight, said = F.col("pages") - 1, F.when(F.col("side") == BESIDE, 0.0).otherwise(1.0)
    got = F.coalesce(weight * F.col("own"), F.lit(0.0))
    prior = own.groupBy("node", "side").agg(((F.sum(got) + strength * said) / (F.sum(weight) + strength)).alias("prior")).drop("side")
    return attach(own, prior, ["node"], ["host"]).select("host", "node", ((got + strength * F.col("prior")) / (weight + strength)).alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, strength: float = STRENGTH) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Pages without a host form one site. Broken markup is read
    as far as it goes, long pages whole; repeated rows and null ids are rows of their own; other
    columns are left out; an empty table gives an empty result. A ``threshold`` of 0 turns the tree
    off; then all text that no tag or role excludes stays.
    """
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    distinct = stored(distinct_pages(hosted.select("host", "html")), "site-pages")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    own = stored(own_importance(node_statistics(distinct), sizes), "site-nodes")
    low = importance(own, strength).where(F.col("importance") < threshold)
    noisy = stored(low.groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("noisy")), "site-noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[int]] = {}
        for b in batches:
            texts = []
            for source, nodes in zip(b.column("html").to_pylist(), b.column("noisy").to_pylist()):
                key = tuple(nodes or ())
                texts.append(Page(source or "", sets.setdefault(key, frozenset(key))).main_text())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = attach(hosted, noisy, ["host"], ["url", "page_id"], "left")
    return joined.select("page_id", "url", "html", "noisy").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
