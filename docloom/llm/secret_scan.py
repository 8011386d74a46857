"""Secret scans with a trigram index.  [operator 12]

Each rule is a regular expression.  From its parse tree a Boolean query over trigrams is
derived that every matching text meets: a text with ``api_?key`` has all trigrams of
``apikey`` or all of ``api_key``.  Blocks of documents get an inverted index, from each
trigram that some rule asks for to the documents that have it; a rule's query unites and
intersects postings, and the rule's expression runs over the documents that are left.  A
rule without mandatory trigrams runs over all documents.  The index of a block lives
while its task does: no posting and no text is shuffled, and memory is that of a block.

Trigrams are of UTF-8 bytes with A-Z in lower case, for rules of either case and others
alike: that lets more texts through to be verified, and none less.

Cases with a defined result
  null text        an empty text: no spans
  long texts       searched whole; a text over a block's bytes is a block of its own
  ties             spans that start alike stand in the order of their rules
  overlaps         spans of one rule never overlap, those of different rules may
  repeated rows    each is searched
  empty table      an empty result
  extra columns    kept; ``spans`` is added and replaces a column of that name
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import begin_task
from .wordarrays import slices, utf8

#: Strings that a part of an expression may stand for before they are no longer listed.
MOST_STRINGS = 64
SPAN = "struct<kind:string,start:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """An expression; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    either_case: bool = False

    @cached_property
    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))

    @cached_property
    def query(self) -> "Query":
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap; those that are too short are dropped."""
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# fixed values: the three base kinds.  Hexadecimal runs are maximal, so only those long enough are looked for.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds beyond the base ones, by the published forms of their tokens.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("login_url", r"(?:https?|ftp|postgres|mysql)://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+-]{4,64}@"),
)
RULES = (*BASE, *FURTHER)


# -- queries -------------------------------------------------------------------------


@dataclass(frozen=True)
class Query:
    """All of ``grams`` and, of each of ``choices``, one query at least; empty: any text."""

    grams: frozenset[bytes] = frozenset()
    choices: frozenset[frozenset["Query"]] = frozenset()

    def __and__(self, other: "Query") -> "Query":
        return Query(self.grams | other.grams, self.choices | other.choices)

    @property
    def any_text(self) -> bool:
        return not self.grams and not self.choices

    def all_grams(self) -> frozenset[bytes]:
        return reduce(frozenset.union, (q.all_grams() for c in self.choices for q in c), self.grams)


def one_of(queries: Sequence[Query]) -> Query:
    if any(q.any_text for q in queries):
        return Query()
    shared = reduce(frozenset.intersection, (q.grams for q in queries))
    # a query that asks for more than another is covered by it
    least = frozenset(q for q in queries if not any(p != q and p.grams <= q.grams and p.choices <= q.choices for p in queries))
    if len(least) == 1:
        return next(iter(least))
    return Query(shared, frozenset([least]))


def _of_strings(strings: frozenset[str]) -> Query:
    found = []
    for s in strings:
        b = s.encode("utf-8", "replace").lower()
        found.append(Query(frozenset(b[k : k + 3] for k in range(len(b) - 2))))
    return one_of(found) if found else Query()


def _part(op, argument) -> tuple[frozenset[str] | None, Query]:
    """(all strings that a part of an expression can match, or None for too many; what a match must have)."""
    if op is sre.LITERAL:
        return frozenset(chr(argument)), Query()
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in argument:
            low, high = (value, value) if kind is sre.LITERAL else value if kind is sre.RANGE else (0, 1 << 20)
            if high - low >= MOST_STRINGS or kind is sre.NEGATE:
                return None, Query()
            chars.update(map(chr, range(low, high + 1)))
        return (frozenset(chars), Query()) if len(chars) <= 8 else (None, Query())
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return frozenset([""]), Query()
    if op is sre.SUBPATTERN:
        return _sequence(argument[3])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in argument[1]]
        if all(s is not None for s, _ in parts):
            strings = frozenset().union(*(s for s, _ in parts))
            if len(strings) <= MOST_STRINGS:
                return strings, Query()
        return None, one_of([q if s is None else _of_strings(s) for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = argument
        strings, query = _sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, Query()
        if least == 0:
            return None, Query()
        if strings is None:
            return None, query
        whole = frozenset([""])
        for _ in range(least):
            longer = frozenset(a + b for a in whole for b in strings)
            if len(longer) > MOST_STRINGS:
                return None, _of_strings(whole)
            whole = longer
        return (whole, Query()) if least == most else (None, _of_strings(whole))
    return None, Query()


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    whole, current, query = True, frozenset([""]), Query()
    for op, argument in items:
        strings, inner = _part(op, argument)
        joined = frozenset(a + b for a in current for b in strings) if strings is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            current = joined
            continue
        query, whole = query & _of_strings(current) & inner, False
        current = strings if strings is not None else frozenset([""])
    if whole:
        return current, Query()
    return None, query & _of_strings(current)


def trigram_query(pattern: str) -> Query:
    """What a text must have so that the expression can match anywhere in it."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


# -- index -----------------------------------------------------------------------------


class BlockIndex:
    """Postings of the given trigrams over a block of texts: sorted rows for each."""

    def __init__(self, column: pa.Array, grams: np.ndarray, place: np.ndarray):
        """``grams`` are the trigrams as numbers, ``place`` the 2**24 numbers' places in it, from 1."""
        raw, offsets = utf8(column)
        self.rows = len(column)
        self.postings: dict[int, np.ndarray] = {}
        if len(raw) < 3:
            return
        low = raw + (np.uint8(32) * ((raw >= 65) & (raw <= 90)))
        number = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
        which = place[number]
        at = np.flatnonzero(which)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]  # not over the end of a text
        pairs = np.unique(which[at[inside]].astype(np.int64) * self.rows + row[inside])
        gram, row = pairs // self.rows, pairs % self.rows
        bounds = np.searchsorted(gram, np.arange(1, len(grams) + 2))
        self.postings = {int(g): row[bounds[k] : bounds[k + 1]] for k, g in enumerate(grams)}

    def find(self, query: Query) -> np.ndarray:
        """The rows that meet a query."""
        out = None
        parts = [self.postings.get(_number(g), np.zeros(0, np.int64)) for g in query.grams]
        for rows in sorted(parts, key=len):  # the rarest first
            out = rows if out is None else np.intersect1d(out, rows, assume_unique=True)
            if not len(out):
                return out
        for choice in query.choices:
            rows = reduce(np.union1d, (self.find(q) for q in choice))
            out = rows if out is None else np.intersect1d(out, rows, assume_unique=True)
        return np.arange(self.rows) if out is None else out


def _number(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def _places(rules: Sequence[Rule]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.array(sorted({_number(g) for r in rules for g in r.query.all_grams()}), np.int64)
    place = np.zeros(1 << 24, np.uint16)
    place[grams] = np.arange(1, len(grams) + 1)
    return grams, place


def candidates(column: pa.Array, rules: Sequence[Rule] = RULES) -> list[np.ndarray]:
    """The rows of a block that each rule is to be run on."""
    index = BlockIndex(column, *_places(rules))
    return [index.find(r.query) for r in rules]


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with ``spans``: kind, start and end (code points, end exclusive) by start, then by rule."""
    docs = docs.drop("spans")
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules of one kind")
    rules = tuple(rules)
    kinds = pa.array([r.kind for r in rules], pa.string())
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T._parse_datatype_string(f"array<{SPAN}>"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("secret_scan")
        grams, place = _places(rules)
        for batch in batches:
            for block in slices(batch):
                column = block.column("text")
                index = BlockIndex(column, grams, place)
                texts: dict[int, str] = {}
                found: list[tuple[int, int, int, int]] = []
                for k, rule in enumerate(rules):
                    for row in index.find(rule.query).tolist():
                        if row not in texts:
                            texts[row] = column[row].as_py() or ""
                        found += [(row, start, k, end) for start, end in rule.spans(texts[row])]
                found.sort()
                row, start, k, end = np.array(found, np.int64).reshape(-1, 4).T
                span = pa.StructArray.from_arrays([kinds.take(pa.array(k)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["kind", "start", "end"])
                bounds = np.searchsorted(row, np.arange(block.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.ListArray.from_arrays(pa.array(bounds), span)], [*block.schema.names, "spans"])

    return docs.mapInArrow(work, schema)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
