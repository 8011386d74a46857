"""HTML extraction with site style trees.  [operator 4]

Every page is read into styled elements; an element's style is its tag with its
class and id (each run of two or more digits as one sign), its place the path of styles from the root.
The pages of a host are merged on these paths, each different page once: pages
with the same text outside fixed roles are copies.  For each path of the merged tree
Spark counts how often each content (text of a block) and each presentation
(sequence of child styles) occurs; the normalised entropy of those counts is the
node's importance, and an inner node's composite importance also takes in its
children.  Where a host shows the same few contents again and again, as menus,
adverts and footers do, importance is low, and those branches are removed from
each of its pages; so is a single block whose content at its path is on SAME_PAGES
of the host's different pages.  Both hold inside an article too.  Hosts with few
pages tell little; roles that tags and class names state (nav, aside, "comments",
...) are removed on every page.

A page's mark of an article or main part is evidence.  What surrounds it does not
make it unimportant.  Where more than half of it (in characters) repeats, it is
a copy of an article and stays whole.  A block outside it is kept where the host's
tree shows its path to be important.

Text: character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined in page order by a line feed; empty blocks go.

Cases with a defined result
  null html       text "" and n_chars 0
  empty html      the same
  null url        all such pages form one host
  broken markup   elements left open are closed by their parents' ends; an end
                  without a start is ignored; a tag that never ends, or in which a
                  quote stays open, is text
  deep markup     read as it stands; a path is a number, so memory and time stay
                  linear in the page
  very long html  read whole
  ties            a path of just MIN_IMPORTANCE stays, a content on just SAME_PAGES
                  of the pages goes
  repeated rows   each row is extracted
  empty table     an empty result
  extra columns   not returned
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .wordarrays import slices

#: Different pages of a host that have a path before its tree may remove it.
MIN_PAGES = 12
#: Composite importance below which a branch is removed.
MIN_IMPORTANCE = 0.5
#: Share of the different pages that have a path on which a content there is no article's own.
SAME_PAGES = 0.5
#: Weight of what lies below in a node's composite importance.
GAMMA = 0.9
#: Hosts with branches to remove whose list is broadcast.
MOST_BROADCAST_HOSTS = 50_000

# fixed values: tags that hold no text of the article, tags without content, tags
# that divide blocks, and words of class names or ids that state a role
SKIPPED = set("head nav footer aside form script style noscript template iframe svg math button select option textarea dialog menu canvas object audio video label fieldset".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr address header details summary hgroup center".split()
) | SKIPPED
ROLES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget related recommended share sharing social "
    "comment comments disqus reply replies respond notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search form pagination pager skip toolbar alert".split()
)
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>", re.I)
# a whole tag without "<" in it, looked at up to the next "<" once: nothing is given back
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)(?=[\s/>])([^>"'<]*+(?:(?:"[^"<]*+"|'[^'<]*+')[^>"'<]*+)*+)>""")
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile("[>\"']")
_STYLE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d{2,}")
_PART = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


@functools.lru_cache(1 << 16)
def _path(parent: int, style: str) -> int:
    """The number of a path: a hash of its parent's and of the last style, so that a path takes the same room at any depth."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + style.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Tags:
    """Where the tags of a text end, each place of which is looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes; where a quote stays open there is no tag.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self._name = self._first = (0, -1)  # from where a search went, and what it found
        self._open: set[int] = set()  # quotes behind which no tag ends

    def name_end(self, at: int) -> int:
        if not self._name[0] <= at <= self._name[1]:
            m = _NAME_END.search(self.source, at)
            self._name = at, m.start() if m else len(self.source)
        return self._name[1]

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin here, or -1."""
        passed: list[int] = []
        p = at
        while True:
            if not passed and self._first[0] <= p <= self._first[1]:
                q = self._first[1]
            else:
                m = _SPECIAL.search(self.source, p)
                q = m.start() if m else len(self.source)
                if not passed:
                    self._first = p, q
            if q < len(self.source) and self.source[q] == ">":
                return q
            close = -1 if q == len(self.source) or q in self._open else self.source.find(self.source[q], q + 1)
            passed.append(q)
            if close < 0:
                self._open.update(passed)
                return -1
            p = close + 1


class Element:
    __slots__ = ("tag", "path", "keep", "low", "rooted", "children", "parent", "block")

    def __init__(self, tag: str, path: int, keep: bool, low: bool, rooted: bool, parent: int, block: int):
        self.tag, self.path, self.keep, self.low, self.rooted, self.children = tag, path, keep, low, rooted, []
        self.parent, self.block = parent, block  # the path above, and where in the stack the nearest block is


class Page:
    """Blocks (path, text, keep, rooted, low) of one page in order, elements seen (path, children), and
    the (parent, depth, rooted) of each path.  A path is a number.  Time and memory are linear in the page."""

    def __init__(self, source: str, low: frozenset[int] | set[int] = frozenset()):
        self.blocks: list[tuple[int, str, bool, bool, bool]] = []
        self.elements: list[tuple[int, str]] = []
        self.paths: dict[int, tuple[int, int, bool]] = {0: (0, 0, False)}
        self._low = low
        self._text: list[str] = []
        self._stack = [Element("", 0, True, False, False, 0, 0)]
        self._places: dict[str, list[int]] = {}
        self._read(source)
        self._flush()
        while len(self._stack) > 1:
            self._pop()

    def _read(self, source: str) -> None:
        tags, n, pos = Tags(source), len(source), 0
        while pos < n:
            at = source.find("<", pos)
            if at < 0:
                at = n
            if at > pos:
                self._text.append(source[pos:at])
                pos = at
                continue
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                pos = n if end < 0 else end + 3
                continue
            closed = tags.last > at  # else no tag can end
            raw = _RAW.match(source, at) if closed and source[at + 1] in "sStTnNiI" else None
            if raw:
                end = re.compile(rf"</{raw[1]}\s*>", re.I).search(source, raw.end())
                pos = end.end() if end else n
                continue
            plain = _PLAIN.match(source, at) if closed else None
            if plain:
                if plain[1]:
                    self._close(plain[2].lower())
                else:
                    self._open(plain[2].lower(), plain[3])
                pos = plain.end()
                continue
            name = at + 2 if source.startswith("</", at) else at + 1
            if closed and source[name : name + 1].isascii() and source[name : name + 1].isalpha():
                stop = tags.name_end(name)
                end = tags.end(stop)
                if end >= 0:
                    tag = source[name:stop].lower()
                    if name > at + 1:
                        self._close(tag)
                    else:
                        self._open(tag, source[stop:end])
                    pos = end + 1
                    continue
            if closed and source[at + 1 : at + 2] in ("!", "?", "/"):
                pos = source.find(">", at) + 1
                continue
            self._text.append("<")
            pos = at + 1

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            closes = _CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
            # an open element of these is ended by the new one, with the inline ones inside it
            while (k := self._stack[-1].block) and self._stack[k].tag in closes:
                while len(self._stack) > k:
                    self._pop()
            if tag == "body":
                while len(self._stack) > 1 and self._stack[-1].tag != "html":
                    self._pop()
        up = self._stack[-1]
        style, roles = tag, ()
        if attributes:
            named = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _STYLE.findall(attributes)]
            if named:
                style += "".join(("." if k == "class" else "#" if k == "id" else "@") + _DIGITS.sub("0", v) for k, v in named)
                roles = [p for _, v in named for p in _PART.split(v)]
        path = _path(up.path, style)
        rooted = up.rooted or tag in ("article", "main")
        keep = up.keep and tag not in SKIPPED and not (tag == "header" and not up.rooted) and (tag in ("html", "body") or ROLES.isdisjoint(roles))
        # what stands around an article does not make it unimportant
        low = up.low and rooted == up.rooted
        if tag in BLOCKS and tag not in ("html", "body") and path in self._low:
            low = True
        up.children.append(style)
        place = len(self._stack)
        self.paths[path] = (up.path, place, rooted)
        self._places.setdefault(tag, []).append(place)
        self._stack.append(Element(tag, path, keep, low, rooted, up.path, place if tag in BLOCKS else up.block))

    def _close(self, tag: str) -> None:
        places = self._places.get(tag)
        # an inline element ends inside its block only
        if tag in VOID or not places or tag not in BLOCKS and places[-1] < self._stack[-1].block:
            return
        if tag in BLOCKS:
            self._flush()
        for _ in range(len(self._stack) - places[-1]):
            self._pop()

    def _pop(self) -> None:
        e = self._stack.pop()
        self._places[e.tag].pop()
        if e.tag in BLOCKS:
            self.elements.append((e.path, " ".join(e.children)))

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            self._text.clear()
            text = _SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                own = self._stack[-1]
                holder = self._stack[own.block]
                self.blocks.append((holder.path, text, own.keep, own.rooted, own.low))

    def main_text(self, high: Collection[int] = (), repeated: Collection[tuple[int, int]] = (), at: Sequence[tuple[int, int]] = ()) -> str:
        """The kept blocks.  ``high``: important paths outside an article; ``repeated``: contents at their
        paths that many pages show, as (path, hash), where ``at`` has each block's."""
        again = [b[4] or (k < len(at) and at[k] in repeated) for k, b in enumerate(self.blocks)]
        rooted = [k for k, b in enumerate(self.blocks) if b[2] and b[3]]
        if not rooted:
            return "\n".join(b[1] for b, r in zip(self.blocks, again) if b[2] and not r)
        copied = 2 * sum(len(self.blocks[k][1]) for k in rooted if again[k]) > sum(len(self.blocks[k][1]) for k in rooted)
        return "\n".join(b[1] for b, r in zip(self.blocks, again) if b[2] and (copied or not r if b[3] else not r and b[0] in high))


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, parent, depth, inside, kind, value, n, pages): how often each content (kind 0) or presentation (1) occurs
    at a path of a host, over its different pages, and how many of those show it; kind 2 counts the pages that have the path."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                out: list[tuple] = []
                copy: list[str] = []
                for row, (host, source) in enumerate(zip(rows.column("host").to_pylist(), rows.column("html").to_pylist())):
                    page = Page(source or "")
                    copy.append(page.main_text())
                    seen = Counter((path, 0, text) for path, text, *_ in page.blocks)
                    seen.update((path, 1, children) for path, children in page.elements)
                    seen.update((path, 2, "") for path in {path for path, _, _ in seen})
                    out += [(host, row, path, *page.paths[path], kind, value, n) for (path, kind, value), n in seen.items()]
                if out:
                    host, row, path, parent, depth, inside, kind, value, n = zip(*out)
                    page_of = _hashes(tuple(copy))[list(row)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "host": host, "page": page_of, "path": pa.array(path, pa.int64()), "parent": pa.array(parent, pa.int64()), "depth": pa.array(depth, pa.int32()), "inside": inside,
                            "kind": pa.array(kind, pa.int32()), "value": _hashes(value), "n": pa.array(n, pa.int64()),
                        }
                    )

    found = pages.mapInArrow(scan, "host string, page long, path long, parent long, depth int, inside boolean, kind int, value long, n long")
    # a path has one parent, depth and place inside or outside an article
    once = found.groupBy("host", "page", "path", "parent", "depth", "inside", "kind", "value").agg(F.max("n").alias("n"))
    return once.groupBy("host", "path", "parent", "depth", "inside", "kind", "value").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


def _hashes(values: Sequence[str]) -> np.ndarray:
    from .wordarrays import Words

    w = Words(pa.array(values, pa.large_string()))
    return w.range_hash(w.offsets[:-1], w.offsets[1:]).view(np.int64)


def importance(counts: DataFrame) -> DataFrame:
    """(host, path, inside, n, importance): different pages that have a node, and composite importance, of each node of each host's tree."""
    # entropy of the shares n_i / N over log N; a value met once in every place gives 1
    per_path = counts.groupBy("host", "path", "parent", "depth", "inside", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("n") > 1, 1 - F.col("s") / F.col("n") / F.log("n")).otherwise(1.0)
    nodes = per_path.select("host", "path", "parent", "depth", "inside", "kind", "n", entropy.alias("entropy"))
    wide = nodes.groupBy("host", "path", "parent", "depth", "inside").agg(
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("n"),
        F.max(F.when(F.col("kind") == 0, F.col("entropy"))).alias("content"),
        F.max(F.when(F.col("kind") == 1, F.col("entropy"))).alias("presentation"),
    )

    def compose(tree: pd.DataFrame) -> pd.DataFrame:
        """Bottom-up over one host's styles: content where a node has text of its own, else presentation and children."""
        tree = tree.sort_values(["depth", "path"], ascending=[False, True])
        below: dict[int, list[float]] = {}
        out = []
        for path, parent, content, presentation in zip(tree["path"], tree["parent"], tree["content"], tree["presentation"]):
            kids = below.get(path, [])
            if kids and not pd.isna(content):
                value = max(content, GAMMA * float(np.mean(kids)))
            elif kids:
                own = 0.0 if pd.isna(presentation) else presentation
                value = max((1 - GAMMA) * own + GAMMA * float(np.mean(kids)), max(kids))
            else:
                value = content if not pd.isna(content) else presentation
            value = 0.0 if pd.isna(value) else float(value)
            out.append(value)
            below.setdefault(parent, []).append(value)
        return tree.assign(importance=out)[["host", "path", "inside", "n", "importance"]]

    # one task per host sees its styles, a number that does not grow with its pages
    return wide.groupBy("host").applyInPandas(compose, "host string, path long, inside boolean, n long, importance double")


def extract_main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    counts = materialize(style_counts(pages.select("host", "html")), "style-counts")
    tree = importance(counts).filter(F.col("n") >= min_pages)
    weak = F.col("importance") < min_importance
    paths = tree.groupBy("host").agg(F.collect_set(F.when(weak, F.col("path"))).alias("low"), F.collect_set(F.when(~weak & ~F.col("inside"), F.col("path"))).alias("high"))
    # contents on so large a share of a path's pages are few for each path, whatever the number of pages
    having = counts.filter("kind = 2").select("host", "path", F.col("n").alias("of"))
    shown = counts.filter((F.col("kind") == 0) & (F.col("pages") >= SAME_PAGES * min_pages)).join(having, ["host", "path"])
    shown = shown.filter((F.col("of") >= min_pages) & (F.col("pages") >= SAME_PAGES * F.col("of")))
    shown = shown.groupBy("host").agg(F.collect_set(F.struct("path", "value")).alias("repeated"))
    low = materialize(paths.join(shown, "host", "left"), "low-importance")
    if low.limit(MOST_BROADCAST_HOSTS + 1).count() <= MOST_BROADCAST_HOSTS:
        joined = pages.join(F.broadcast(low), "host", "left")
    else:
        # many hosts, one of which may hold a third of the pages: salt it
        salts = 64
        spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], frozenset[int], frozenset[tuple[int, int]]]] = {}
        for batch in batches:
            for rows in slices(batch, "html"):
                pages, blocks = [], [0]
                lows, highs, repeats = (rows.column(c) for c in ("low", "high", "repeated"))
                for k, (name, source) in enumerate(zip(rows.column("host").to_pylist(), rows.column("html").to_pylist())):
                    if name not in known:
                        known[name] = frozenset(lows[k].as_py() or ()), frozenset(highs[k].as_py() or ()), frozenset((r["path"], r["value"]) for r in repeats[k].as_py() or ())
                    pages.append((Page(source or "", known[name][0]), known[name]))
                    blocks.append(blocks[-1] + len(pages[-1][0].blocks))
                at = _hashes([b[1] for page, _ in pages for b in page.blocks]).tolist()
                texts = [page.main_text(high, repeated, [(b[0], h) for b, h in zip(page.blocks, at[first : first + len(page.blocks)])]) for (page, (_, high, repeated)), first in zip(pages, blocks)]
                yield pa.RecordBatch.from_pydict({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return joined.select("page_id", "url", "html", "host", "low", "high", "repeated").mapInArrow(work, "page_id long, url string, text string, n_chars long")
