"""BPE encoding and decoding.  [operator 10]

Short texts are encoded word by word: a tokenizer whose pieces never span white
space gives a word the same ids wherever it stands, so a worker encodes a word
once and looks it up from then on, for all words of many texts at once.  Words
are found by 64-bit hashes and compared byte by byte.  Whether a tokenizer is of that kind is tried
out on sample words; with any other, texts are encoded whole.

Long texts are encoded by tree concatenation.  Spark cuts a text over
``split_chars`` into equal segments that different tasks encode; a task does the
same inside a word over ``leaf_chars`` (long unsplit text).  Two encoded
halves are joined by re-encoding a window around the joint and growing it until
it shares two consecutive tokens (same ids, same places) with the left half and
two with the right; what lies beyond those is kept.  A sequence of BPE tokens
is the encoding of its text when each neighbouring pair is, and every pair of
the joined sequence comes from one of three encodings.  If a side never agrees
the window has grown to that whole side.

Cases with a defined result
  null text       encoded as an empty text: no ids, an empty decoded text
  no white space  one long word, encoded by tree concatenation
  very long text  cut, encoded and joined by many tasks; its last joints in one, which holds
                  the text and its ids, as the result's row does
  special tokens  their strings in a text give their ids, as the library does
  repeated rows   each is encoded; repeated long texts are encoded once
  empty table     an empty result
  extra columns   kept; ``ids`` and ``decoded`` are added and replace columns of
                  these names
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import begin_task, kept
from .wordarrays import Words, same_bytes, slices

#: Texts over this many code points are cut up by Spark.
SPLIT_CHARS = 1 << 16
#: Words over this many code points are cut up inside a task.
LEAF_CHARS = 2048
#: Words whose ids a worker remembers, and the bytes from which on it forgets some.
REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 26
#: Neighbouring segments of a text that one task joins, before the rest of it is joined.
FAN = 16
_WINDOW = 8
# words by which it is seen whether a tokenizer splits at white space and lowers case
_PROBES = ["a", "The", "it's", "'Ve", "x1Y2", "ÀÉî", "...", "#A-b", "1", "\"Ab,", "漢字", "I'LL", "E\u0301"]
# fixed values: the pattern by which the tokenizer splits, with its classes spelled out for Latin-1
_PIECES = re.compile("\0|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x21, 0x7F), 0xC2, 0xC3, *range(0x80, 0xC0)]] = True
_LOWER_CASE = {c: c + 32 for c in range(65, 91)}


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte, by its rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden) if b != 32}


_BYTE_CHARS = _byte_chars()
_coders: dict[str, "Coder"] = {}
kept.append(_coders)


def coder(path: str) -> "Coder":
    """The process's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


@dataclass
class Encoded:
    """A text with its ids and each id's code point range in the text."""

    text: str
    ids: np.ndarray = field(repr=False)
    start: np.ndarray = field(repr=False)
    end: np.ndarray = field(repr=False)


class WordTable:
    """The ids of up to ``most`` words by the words' 64-bit hashes: an open-addressing table in numpy arrays.

    The words' bytes stand beside their ids, so that a word is known for certain.  When it
    is full, words that were not asked for again since the last time make room.
    """

    def __init__(self, most: int):
        self.most = most
        self._mask = (1 << (2 * most - 1).bit_length()) - 1
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self._mask + 1, np.uint64)
        self._entry = np.zeros(self._mask + 1, np.int32)
        self._hash = np.zeros(self.most, np.uint64)
        self._used = np.zeros(self.most, bool)
        self.first = np.zeros(self.most + 1, np.int64)
        self.ids = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(self.most + 1, np.int64)
        self.bytes = np.zeros(1 << 12, np.uint8)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        todo, at = np.arange(len(h)), (h & np.uint64(self._mask)).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == h
            out[todo[hit]] = self._entry[at[hit]]
            on = ~hit & (there != 0)
            todo, h, at = todo[on], h[on], (at[on] + 1) & self._mask
        self._used[out[out >= 0]] = True
        return out

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> None:
        """New words: different hashes that the table lacks, the number of ids of each, all ids in turn, and the same of bytes."""
        n, m = self.n, len(h)
        self.at[n + 1 : n + m + 1] = self.at[n] + np.cumsum(lengths)
        end = int(self.at[n + m])
        if end + 24 > len(self.bytes):  # room to read whole 64-bit words
            self.bytes = np.concatenate([self.bytes, np.zeros(-(-(end + 24) // 8) * 8, np.uint8)])
        self.bytes[end - len(raw) : end] = raw
        self._hash[n : n + m] = h
        self.first[n + 1 : n + m + 1] = self.first[n] + np.cumsum(counts)
        end = int(self.first[n + m])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, np.int32)])
        self.ids[end - len(ids) : end] = ids
        todo, at = np.arange(m), (h & np.uint64(self._mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == 0)
            place, which = np.unique(at[free], return_index=True)  # one word to a place
            won = free[which]
            self.keys[place], self._entry[place] = h[todo[won]], n + todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self._mask
        self.n = n + m

    def make_room(self, m: int) -> None:
        if self.n + m > self.most or self.at[self.n] > REMEMBERED_BYTES:
            keep = np.flatnonzero(self._used[: self.n])[: max(0, self.most // 2 - m)]
            keep = keep[np.cumsum(np.diff(self.at)[keep]) <= REMEMBERED_BYTES // 2]
            h, counts, ids = self._hash[keep], np.diff(self.first)[keep], self.take(keep)
            lengths = np.diff(self.at)[keep]
            raw = self.bytes[places(self.at[keep], lengths)]
            self._clear()
            self.add(h, counts, ids, lengths, raw)

    def is_word(self, entries: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
        """Whether each entry is of the word with that number, byte for byte."""
        start, length = words.start[which], words.end[which] - words.start[which]
        out = self.at[entries + 1] - self.at[entries] == length
        alike = np.flatnonzero(out)
        out[alike] = same_bytes(words.aligned, start[alike], self.bytes.view("<u8"), self.at[entries[alike]], length[alike])
        return out

    def take(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, in turn."""
        start = self.first[entries]
        return self.ids[places(start, self.first[entries + 1] - start)]


def places(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of ranges, in turn."""
    at = np.repeat(start - np.cumsum(counts) + counts, counts)
    return at + np.arange(len(at))


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._arrow_strings = pa.array([self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary_size)])
        self._splits = all(self._one(a + s + b) == self._one(a) + self._one(b) for a in _PROBES for b in _PROBES for s in (" ", "\n", "\t \r\x0b\x0c"))
        self._lowers = all(self._one(p) == self._one(p.translate(_LOWER_CASE)) for p in _PROBES)
        self._special = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        # The model alone, for pieces that are already normalised and split.
        self._bare = Tokenizer(self.tokenizer.model)
        self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        mark = self._bare.encode(_BYTE_CHARS[0], add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else -1
        letters = "".join(map(chr, [*range(33, 127), *range(161, 256)]))
        sample = [letters, "It's", "we'll", "x1y2²z", "don't?!", "ÀÉÎõü--Ab'RE", *[f"a{c}b" for c in letters]]
        self._pieced = self._splits and self._mark >= 0 and self._by_pieces(sample)[1].tolist() == self._one(" ".join(sample))
        self._table = WordTable(REMEMBERED)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _odd(self, words: Words) -> np.ndarray:
        """Which words are not of printable ASCII and Latin-1 alone, or may hold a special token."""
        raw = words.raw
        odd = ~_PLAIN[raw]
        odd[:-1] |= (raw[:-1] == 0xC2) & (raw[1:] <= 0xA0)
        for start in self._special:
            at = raw == start[0]
            if len(start) > 1:
                at[:-1] &= raw[1:] == start[1]
            odd |= at
        odd = np.concatenate(([0], np.cumsum(odd)))
        return odd[words.end] > odd[words.start]

    def _lower(self, words: Words, odd: np.ndarray) -> None:
        """A-Z in lower case in all but the odd words, so that both forms are one word."""
        low = words.raw + (np.uint8(32) * ((words.raw >= 65) & (words.raw <= 90)))
        odd = np.flatnonzero(odd)
        n = words.end[odd] - words.start[odd]
        at = np.repeat(words.start[odd] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        low[at] = words.raw[at]
        words.raw = low

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each, all ids in turn) of plain words: split by a pattern, and each piece encoded by the model."""
        pieces = _PIECES.sub(r"\g<0> ", "\0".join(texts).lower())
        shown = pieces.encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = np.array(self._bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int32)
        marks = np.flatnonzero(ids == self._mark)
        counts = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
        return counts, np.delete(ids, marks)

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        owner = np.searchsorted(begins, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
        return np.bincount(owner, minlength=len(texts)), np.array(e.ids, np.int32)

    def _by_tree(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encode_tree(t).ids.astype(np.int32) for t in texts]
        return np.array([len(p) for p in parts]), np.concatenate(parts)

    def _learn(self, words: Words, odd: np.ndarray, which: np.ndarray, h: np.ndarray) -> None:
        """Enter words into the table: plain ones by pieces, odd ones by one call of the library, very long ones by tree."""
        long = words.end[which] - words.start[which] > LEAF_CHARS
        plain = ~long & ~odd[which] if self._pieced else np.zeros(len(which), bool)
        whole = words.raw.tobytes()
        for mine, encode in ((plain, self._by_pieces), (~long & ~plain, self._by_library), (long, self._by_tree)):
            if mine.any():
                start, end = words.start[which[mine]], words.end[which[mine]]
                texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
                self._table.add(h[mine], *encode(texts), end - start, words.raw[places(start, end - start)])

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text; a null reads as an empty text."""
        if not self._splits:
            parts = [self.encode_tree(t or "").ids.astype(np.int32) for t in column.to_pylist()]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
        words = Words(column)
        odd = self._odd(words)
        if self._lowers:
            self._lower(words, odd)
        h = np.maximum(words.hashes(), np.uint64(1))
        table, step = self._table, max(1, self._table.most // 4)
        counts, parts = np.zeros(len(h), np.int64), [np.zeros(0, np.int32)]
        wrong: list[np.ndarray] = []  # words whose hash is another word's
        for at in range(0, len(h), step):  # so few that what is new always finds room
            some = h[at : at + step]
            entries = table.find(some)
            for room in (True, False):  # making room may remove words of this range: they are entered again
                unknown = np.flatnonzero(entries < 0)
                if not len(unknown):
                    break
                new, first = np.unique(some[unknown], return_index=True)
                if room:
                    table.make_room(len(new))
                self._learn(words, odd, at + unknown[first], new)
                entries = table.find(some)
            wrong.append(at + np.flatnonzero(~table.is_word(entries, words, np.arange(at, at + len(some)))))
            counts[at : at + step] = table.first[entries + 1] - table.first[entries]
            parts.append(table.take(entries))
        bounds, ids = np.concatenate(([0], np.cumsum(counts)))[words.first], np.concatenate(parts)
        if any(map(len, wrong)):  # such texts are encoded whole
            again = set(words.doc[np.concatenate(wrong)].tolist())
            each = [self.encode_tree(column[r].as_py()).ids.astype(np.int32) if r in again else ids[bounds[r] : bounds[r + 1]] for r in range(len(column))]
            bounds, ids = np.cumsum([0, *map(len, each)]), np.concatenate(each)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """The text of each id list: token strings joined by one space, as a tokenizer without a decoder gives."""
        if self.tokenizer.decoder is None:
            tokens = pa.ListArray.from_arrays(ids.offsets, self._arrow_strings.take(ids.values))
            return pc.binary_join(tokens, " ")
        return pa.array(self.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())

    # -- tree concatenation ---------------------------------------------------

    def encode_leaf(self, text: str) -> Encoded:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Encoded(text, np.array(e.ids, np.int64), spans[:, 0], spans[:, 1])

    def encode_tree(self, text: str, leaf: int = LEAF_CHARS) -> Encoded:
        if len(text) <= leaf:
            return self.encode_leaf(text)
        half = len(text) // 2
        return self.concatenate(self.encode_tree(text[:half], leaf), self.encode_tree(text[half:], leaf))

    def concatenate(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of both texts together, exactly as if encoded at once."""
        text, cut = left.text + right.text, len(left.text)
        back = ahead = _WINDOW
        while True:
            a = 0 if back >= len(left.ids) else int(left.start[len(left.ids) - back])
            b = len(text) if ahead >= len(right.ids) else cut + int(right.end[ahead - 1])
            window = self.encode_leaf(text[a:b])
            start, end = window.start + a, window.end + a
            i = _shared(left.ids, left.start, left.end, window.ids, start, end, first=True) if a else (0, 0)
            j = _shared(right.ids, right.start + cut, right.end + cut, window.ids, start, end, first=False) if b < len(text) else (len(right.ids), len(window.ids))
            if i is not None and j is not None and i[1] <= j[1]:
                keep, more = slice(None, i[0]), slice(j[0], None)
                inside = slice(i[1], j[1])
                return Encoded(
                    text,
                    np.concatenate([left.ids[keep], window.ids[inside], right.ids[more]]),
                    np.concatenate([left.start[keep], start[inside], right.start[more] + cut]),
                    np.concatenate([left.end[keep], end[inside], right.end[more] + cut]),
                )
            if i is None or i is not None and j is not None:
                back *= 2
            if j is None or i is not None and j is not None:
                ahead *= 2


def _shared(ids, start, end, w_ids, w_start, w_end, first: bool) -> tuple[int, int] | None:
    """Where a half and the window have two consecutive tokens alike: the first
    such place (left half), or the place after the last one (right half)."""
    place = {(int(s), int(e), int(k)): n for n, (s, e, k) in enumerate(zip(w_start, w_end, w_ids))}
    low, high = (int(w_start[0]), int(w_end[-1])) if len(w_ids) else (0, -1)
    lo, hi = int(np.searchsorted(start, low)), int(np.searchsorted(end, high, "right"))
    steps = range(lo, hi - 1) if first else range(hi - 1, lo, -1)
    for n in steps:
        pair = (n, n + 1) if first else (n - 1, n)
        at = [place.get((int(start[k]), int(end[k]), int(ids[k]))) for k in pair]
        if at[0] is not None and at[1] == at[0] + 1:
            return (pair[0], at[0]) if first else (pair[1] + 1, at[1] + 1)
    return None


def encode_documents(docs: DataFrame, tokenizer_path: str, *, decoded: bool = True, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """The input with ``ids array<int>`` and, if asked for, ``decoded string``."""
    added = ["ids", *(["decoded"] if decoded else [])]
    docs = docs.drop(*added)
    result = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def columns(c: Coder, ids: pa.ListArray) -> list[pa.Array]:
        return [ids, *([c.decode_column(ids)] if decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bpe")
        c = coder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(c, c.encode_column(part.column("text")))], [*part.schema.names, *added])

    length = F.coalesce(F.length("text"), F.lit(0))
    short = docs.filter(length <= split_chars).mapInArrow(encode, T.StructType([*docs.schema.fields, *result.fields]))

    # Long texts: equal segments to many tasks, joined pairwise afterwards.
    long = docs.filter(length > split_chars).withColumn("_bpe_key", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("_bpe_key").to_pylist(), batch.column("text").to_pylist()):
                for part, at in enumerate(range(0, len(text), split_chars)):  # each code point is copied once
                    yield pa.RecordBatch.from_pydict({"_bpe_key": [key], "_bpe_part": pa.array([part], pa.int32()), "_bpe_segment": [text[at : at + split_chars]]})

    # dealt by segment, so that the segments of a text are encoded by many tasks; copies of a text meet there
    segments = long.select("_bpe_key", "text").mapInArrow(cut, "_bpe_key string, _bpe_part int, _bpe_segment string").dropDuplicates(["_bpe_key", "_bpe_part"])

    def encoded_row(key: pa.Scalar, part: pa.Scalar, e: Encoded) -> pa.RecordBatch:
        spans = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (e.ids, e.start, e.end)]
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([part.as_py()], pa.int32()), pa.array([e.text]), *spans], ["_bpe_key", "_bpe_part", "_bpe_segment", "ids", "start", "end"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bpe")
        c = coder(tokenizer_path)
        for batch in batches:
            for n in range(batch.num_rows):
                yield encoded_row(batch.column("_bpe_key")[n], batch.column("_bpe_part")[n], c.encode_tree(batch.column("_bpe_segment")[n].as_py()))

    def joined(table: pa.Table, c: Coder) -> Encoded:
        level = [
            Encoded(r["_bpe_segment"], *[np.frombuffer(r[k], "<i4").astype(np.int64) for k in ("ids", "start", "end")])
            for r in table.sort_by("_bpe_part").to_pylist()
        ]
        while len(level) > 1:
            level = [c.concatenate(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def join_some(key, table):
        begin_task("bpe")
        e = joined(table, coder(tokenizer_path))
        return pa.Table.from_batches([encoded_row(key[0], pa.scalar(key[1].as_py(), pa.int32()), e)])

    def join(key, table):
        begin_task("bpe")
        c = coder(tokenizer_path)
        e = joined(table, c)
        ids = pa.ListArray.from_arrays(pa.array([0, len(e.ids)], pa.int32()), pa.array(e.ids.astype(np.int32)))
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), *columns(c, ids)], ["_bpe_key", *added])

    parted = "_bpe_key string, _bpe_part int, _bpe_segment string, ids binary, start binary, end binary"
    encoded = segments.mapInArrow(leaves, parted)
    # neighbouring segments by FAN in tasks of their own, then what is left of a text
    some = encoded.groupBy("_bpe_key", F.floor(F.col("_bpe_part") / FAN).cast("int").alias("_bpe_some")).applyInArrow(join_some, parted)
    whole = some.groupBy("_bpe_key").applyInArrow(join, T.StructType([T.StructField("_bpe_key", T.StringType()), *result.fields]))
    return short.unionByName(long.join(whole, "_bpe_key").drop("_bpe_key"))
