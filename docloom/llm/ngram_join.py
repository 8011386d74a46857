"""N-gram Jaccard self-join with signature trees.  [operator 9]

Texts with equal shingle sets are one *node*; nodes whose sets have a Jaccard
similarity of ``percent``/100 or more are linked, and every document gets the
smallest doc_id that links reach.  The join is exact.

1. ``shingle_sets``  One pass over the texts: the size of each set and a 128-bit
   key of the set.  The same pass counts, inside each task, shingles that several
   sets share; their sum over tasks ranks common shingles.
2. ``postings``      A second pass emits, for each different set, its prefix: the
   n - ceil(p n) + 1 shingles that come first when common ones are put last.  Two
   sets that qualify share a shingle of their prefixes, under any ranking.  A
   shingle that very many sets share is dealt out under several salts.
3. ``blocks``        A block is the sets that have a prefix shingle in common.  Over
   each block of up to ``SMALL_BLOCK`` sets stands a signature tree.  Its records
   are (size, bitmap of shingles); a tree node holds the OR of the bitmaps below it
   and the range of their sizes.  The tree is joined with itself by dual traversal:
   a pair of tree nodes is dropped when its size ranges are too far apart, or when
   the bits that both bitmaps have are too few for the overlap that any pair below
   would need.  Of a larger block each set is paired with the block's leader first.
4. The number of blocks in which a pair survives bounds its overlap once more
   (``possible``).  The texts of all sets that are left in a pair or a large block
   are written once with wider bitmaps (``contested``).  Pairs that these do not rule
   out (``sifted``) are verified on the texts: first each set with one candidate, then
   those pairs that are still in different components, with more leaders for large
   blocks that hold several components: a few pairs of each two components, and the
   others where these are still apart (``linked``).
5. Large blocks that then still hold sets of different components are split into
   bounded chunks and traversed as in 3: chunks of the block's main component only
   against those of others, node pairs that lie in one component are dropped, and
   pairs of records are held against bitmaps of 512 bits, then against the wider
   ones.  A large group of near
   copies thus costs a number of pairs that grows with its size.
6. Components by alternating large-star and small-star rounds, each written to
   the shared folder.

Cases with a defined result
  null text       like a text without words: n_shingles 0, linked with nothing
  empty text      the same
  under 5 words   the whole sequence is the one shingle
  null doc_id     takes part in no link; component_id is null
  repeated rows   each row is returned; they are in one component
  empty table     an empty result
  extra columns   ignored; only doc_id and text are read
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import begin_task, materialize
from .wordarrays import Words, mix, shingles, slices

SIZE = 5
PERCENT = 75
#: Blocks of more sets are traversed only after a first round of links.
SMALL_BLOCK = 24
#: Rows of one chunk of a large block.
CHUNK = 1024
#: Entries of the ranking of common shingles.  It only orders shingles: any
#: ranking gives the same links, a longer one gives fewer pairs to look at.
RANKED = 200_000
#: A shingle is ranked if tasks that saw it twice or more saw it this often.
COMMON = 16
#: Sets in a part of a block whose shingle is dealt out under several salts.
SPLIT = 1024
#: Documents whose texts are broadcast-joined by id up to this many.
MOST_BROADCAST = 300_000
#: Pairs that share one copy of a text in a verification task.
GROUP = 256
#: Pairs of two components that are verified before the others between the two.
FIRST = 4
#: Up to so many pairs are verified all at once.
FEW_PAIRS = 8192
#: Keys of sets that a task remembers, so as not to emit copies again.
REMEMBERED = 200_000
#: A dealt-out shingle is posted as -1 less its rank and, in the lowest bits, a salt; none is under -_DEALT.
_SALT_BITS = 16
_DEALT = 1 << 35
#: Leaders that the blocks of one group share, in the first and in the second round.
_SEEDS, _MORE_SEEDS = 8, 64
#: Bits of a meta value: a bitmap, above it a place in the prefix, above that the size.
_BITS, _PLACE = 32, 8
_FANOUT = 8
_U = np.uint64


#: The sets of the rows of a batch: (row, sorted different 64-bit values) of each row whose set is not empty.
Sets = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def shingles_of(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted different shingles) of each row with a word."""
    h, bounds = shingles(Words(rows.column("text"), lower=True), SIZE)
    for r in np.flatnonzero(np.diff(bounds)):
        yield int(r), np.unique(h[bounds[r] : bounds[r + 1]])


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, sets_of: Sets = shingles_of) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of every row, and (shingle, seen) of common shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("ngram_join")
        met: set[bytes] = set()
        tokens: list[np.ndarray] = []
        counts = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def fold() -> None:
            """Add the shingles of the last sets to this task's counts of repeated ones."""
            nonlocal tokens, counts
            if not tokens:
                return
            t, n = np.unique(np.concatenate(tokens), return_counts=True)
            tokens = []
            twice = n > 1
            t, n = np.concatenate([counts[0], t[twice]]), np.concatenate([counts[1], n[twice]])
            u, where = np.unique(t, return_inverse=True)
            counts = [u, np.bincount(where, weights=n, minlength=len(u)).astype(np.int64)]

        held = 0
        for batch in batches:
            for rows in slices(batch):
                n, keys = np.zeros(rows.num_rows, np.int64), [b""] * rows.num_rows
                for r, values in sets_of(rows):
                    n[r], keys[r] = len(values), _key(values)
                    if keys[r] not in met and len(met) < REMEMBERED:
                        met.add(keys[r])
                        tokens.append(values)
                        held += len(values)
                if held > 1_000_000:
                    fold()
                    held = 0
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "n": n, "key": pa.array(keys, pa.binary()), "shingle": pa.nulls(rows.num_rows, pa.int64())})
        fold()
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(counts[0]), pa.int64()), "text_hash": pa.nulls(len(counts[0]), pa.int64()), "n": counts[1], "key": pa.nulls(len(counts[0]), pa.binary()), "shingle": counts[0].view(np.int64)})

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, "doc_id long, text_hash long, n long, key binary, shingle long")
    both = materialize(both, "shingle-sets")
    node = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")
    sets = both.filter("key is not null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, node).alias("node"))
    common = both.filter("key is null").groupBy("shingle").agg(F.sum("n").alias("seen")).filter(F.col("seen") >= COMMON)
    return sets, common


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def postings(docs: DataFrame, common: DataFrame, percent: int, sets_of: Sets = shingles_of) -> DataFrame:
    """(shingle, node, meta): the prefix of each different set; meta packs size, place in the prefix and bitmap."""
    ranking = common.orderBy(F.desc("seen"), "shingle").limit(RANKED).toArrow()
    ranked = ranking.column("shingle").to_numpy().view(np.uint64)
    seen = ranking.column("seen").to_numpy().astype(np.int64)
    salts = np.clip(-(-seen // SPLIT), 1, 1 << _SALT_BITS)
    order = np.argsort(ranked)
    table = ranked[order], seen[order], order, salts[order]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # RANKED entries at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("ngram_join")
        ranked, seen, rank, salts = shared.value
        met: set[bytes] = set()
        for batch in batches:
            for rows in slices(batch):
                out: list[tuple[np.ndarray, int, int]] = []
                for _, values in sets_of(rows):
                    key = _key(values)
                    if key in met:
                        continue
                    if len(met) < REMEMBERED:
                        met.add(key)
                    node = int.from_bytes(key[:8], "big") >> 4
                    length = _prefix_length(len(values), percent)
                    if len(ranked):
                        at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
                        common_at = ranked[at] == values
                        prefix = values[~common_at][:length]
                        if len(prefix) < length:
                            often = at[common_at]
                            often = often[np.lexsort((values[common_at], seen[often]))][: length - len(prefix)]
                            prefix = np.concatenate([prefix, _dealt(ranked, rank, salts, often, node)])
                    else:
                        prefix = values[:length]
                    out.append((prefix, node, pack(values)))
                if out:
                    n = [len(p) for p, _, _ in out]
                    place = np.concatenate([(np.arange(k) << _PLACE) // k for k in n]) << _BITS
                    yield pa.RecordBatch.from_pydict({
                        "shingle": np.concatenate([p for p, _, _ in out]).view(np.int64),
                        "node": np.repeat(np.array([k for _, k, _ in out], np.int64), n),
                        "meta": np.repeat(np.array([m for _, _, m in out], np.int64), n) | place,
                    })

    return docs.select("text").mapInArrow(emit, "shingle long, node long, meta long")


def _dealt(ranked: np.ndarray, rank: np.ndarray, salts: np.ndarray, at: np.ndarray, node: int) -> np.ndarray:
    """The shingles at these places of the ranking; those with several salts as rank and salt."""
    out = ranked[at].copy()
    many = np.flatnonzero(salts[at] > 1)
    if len(many):
        r = rank[at[many]].astype(np.uint64)
        # one salt for all shingles that share leaders
        salt = mix(np.uint64(node) + (r % _U(_SEEDS)) * _U(0x9E3779B97F4A7C15)) % salts[at[many]].astype(np.uint64)
        out[many] = ~((r << _U(_SALT_BITS)) | salt)
    return out


def _block(shingle: Column) -> Column:
    """The shingle without its salt."""
    dealt = (shingle < 0) & (shingle >= -_DEALT)
    return F.when(dealt, F.shiftright(-1 - shingle, _SALT_BITS)).otherwise(shingle)


def _by_leader(rows: DataFrame, seeds: int) -> DataFrame:
    """Blocks together, copies side by side, and first in each block its leader, which many blocks share."""
    order = F.xxhash64("node", F.pmod(_block(F.col("shingle")), F.lit(seeds)))
    return rows.repartition("shingle").sortWithinPartitions("shingle", order)


_MOST = (1 << 23) - 1


def pack(values: np.ndarray) -> int:
    """Size (at most _MOST) and bitmap of a set in one signed 64-bit integer, with room for a place in its prefix."""
    bits = np.bitwise_or.reduce(_U(1) << (mix(values) % _U(_BITS)))
    return (min(len(values), _MOST) << (_BITS + _PLACE)) | int(bits)


def unpack(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return meta >> (_BITS + _PLACE), meta & ((1 << _BITS) - 1)


def rest_of(meta: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set come, in the order of prefixes, from this posting's on, at most."""
    n = meta >> (_BITS + _PLACE)
    before = ((meta >> _BITS & ((1 << _PLACE) - 1)) * _prefix_length(n, percent)) >> _PLACE
    return np.where(n == _MOST, 1 << 40, n - before)


def forest_pairs(
    group: np.ndarray, meta: np.ndarray, percent: int, side: np.ndarray | None = None, comp: np.ndarray | None = None, first: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of records of one group each that may qualify.

    One signature tree stands over each group; all trees are traversed at once.
    ``side``: of two records with the same side, 0 or 1, no pair is wanted (-1:
    no side).  ``comp``: nor of two records of one component.  ``first``: only pairs
    that may qualify if the group's shingle is the first that they share.
    """
    n, bits = unpack(meta)
    order = np.lexsort((bits, n, group))
    group, n, bits = group[order], n[order], bits[order]
    # Of a record's shingles at most (1 - p) n are missing in a partner, and so
    # are at most as many of its bits.
    need = np.where(n == _MOST, 0, np.bitwise_count(bits).astype(np.int64) - (100 - percent) * n // 100)
    most = rest_of(meta[order], percent) if first else np.full(len(n), 1 << 40)
    marks = [m[order] for m in (side, comp) if m is not None]
    levels = [_Level(n, n, bits, need, most, marks, group, None)]
    while len(levels[-1].group) > 1 and (levels[-1].group[1:] == levels[-1].group[:-1]).any():
        levels.append(levels[-1].above())
    x = y = np.arange(len(levels[-1].group))
    for k in range(len(levels) - 1, -1, -1):
        x, y = levels[k].joinable(x, y, percent)
        if k:
            x, y = levels[k].children(x, y)
    apart = x != y
    return order[x[apart]], order[y[apart]]


class _Level:
    """The nodes of all trees at one height, as arrays."""

    def __init__(self, low, high, bits, need, most, marks, group, first):
        self.low, self.high, self.bits, self.need, self.most, self.marks, self.group, self.first = low, high, bits, need, most, marks, group, first

    def above(self) -> "_Level":
        """Nodes over ``_FANOUT`` of these nodes each, within each group."""
        starts = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        rank = np.arange(len(self.group)) - np.repeat(starts, np.diff(np.append(starts, len(self.group))))
        at = np.flatnonzero(rank % _FANOUT == 0)
        marks = []
        for m in self.marks:  # what all below have in common, else -1
            low, high = np.minimum.reduceat(m, at), np.maximum.reduceat(m, at)
            marks.append(np.where(low == high, low, -1))
        return _Level(np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.need, at), np.maximum.reduceat(self.most, at), marks, self.group[at], np.append(at, len(self.group)))

    def joinable(self, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        # too far apart in size, whichever records are taken (a full size field may stand for more)
        keep = (self.high[x] == _MOST) | (100 * self.high[x] >= percent * self.low[y])
        keep &= (self.high[y] == _MOST) | (100 * self.high[y] >= percent * self.low[x])
        # the most bits that an overlap can set, against the fewest that a record needs
        keep &= np.bitwise_count(self.bits[x] & self.bits[y]).astype(np.int64) >= np.maximum(self.need[x], self.need[y])
        # the most shingles that can be shared from here on, against the fewest that a pair needs
        keep &= (100 + percent) * np.minimum(self.most[x], self.most[y]) >= percent * (self.low[x] + self.low[y])
        for m in self.marks:
            keep &= (m[x] != m[y]) | (m[x] < 0)
        return x[keep], y[keep]

    def children(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nx, ny = self.first[x + 1] - self.first[x], self.first[y + 1] - self.first[y]
        total = nx * ny
        within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        ny = np.repeat(ny, total)
        cx, cy = np.repeat(self.first[x], total) + within // ny, np.repeat(self.first[y], total) + within % ny
        keep = cx <= cy
        return cx[keep], cy[keep]


_PAIR = "a long, b long, c long, shingle long, node long, meta long"


def blocks(posted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, c): pairs of small blocks (c = 1) and of large blocks' sets with their leaders (c = 0); and the postings of large ones."""

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last block as far as it came, while it is small
        goes_on, leader = None, 0  # the large block that goes on
        last = (None, None)

        def work(s: np.ndarray, v: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal goes_on, leader
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(starts, len(s)))
            first = np.repeat(v[starts], size)
            size = np.repeat(size, size)
            big = (size > SMALL_BLOCK) | ((s < 0) & (s >= -_DEALT))
            if goes_on is not None:
                on = s == goes_on
                big |= on
                first[on] = leader
            goes_on, leader = (int(s[-1]), int(first[-1])) if big[-1] else (None, 0)
            small = (size > 1) & ~big
            s2, v2, m2 = s[small], v[small], m[small]
            group = np.cumsum(np.concatenate(([0], s2[1:] != s2[:-1]))) if len(s2) else s2
            x, y = forest_pairs(group, m2, percent) if len(s2) else (s2, s2)
            led = np.unique(np.stack([first[big], v[big]], 1), axis=0) if big.any() else np.zeros((0, 2), np.int64)
            led = led[led[:, 0] != led[:, 1]]
            a, b = np.concatenate([v2[x], led[:, 0]]), np.concatenate([v2[y], led[:, 1]])
            k, n = len(a), int(big.sum())
            pair, row = pa.nulls(k, pa.int64()), pa.nulls(n, pa.int64())
            columns = [np.minimum(a, b), np.maximum(a, b), (np.arange(k) < len(x)).astype(np.int64)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(c), row]) for c in columns] + [pa.concat_arrays([pair, pa.array(c[big])]) for c in (s, v, m)],
                ["a", "b", "c", "shingle", "node", "meta"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            # copies of a set come from many tasks and stand side by side
            same = np.concatenate(([(columns[0][0], columns[1][0]) == last], (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])))
            last = (columns[0][-1], columns[1][-1])
            columns = [np.concatenate([h, c[~same]]) for h, c in zip(held, columns)]
            cut = len(columns[0])
            if not cut:
                continue
            begin = int(np.searchsorted(columns[0], columns[0][-1]))
            if columns[0][-1] != goes_on and cut - begin <= SMALL_BLOCK:
                cut = begin
            held = [c[cut:] for c in columns]
            if cut:
                yield work(*[c[:cut] for c in columns])
        if len(held[0]):
            yield work(*held)

    done = materialize(_by_leader(posted, _SEEDS).mapInArrow(traverse, _PAIR), "blocks")
    return done.filter("a is not null").select("a", "b", "c"), done.filter("shingle is not null").select("shingle", "node", "meta")


def more_leaders(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): sets of a large block with one of more leaders, where the two lie in different components."""
    rows = large.select("shingle", "node").join(roots, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("comp"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leader, of = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            s, v, c = (x.to_numpy() for x in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(starts, len(s)))
            first, comp = np.repeat(v[starts], size), np.repeat(c[starts], size)
            if s[0] == block:
                first[: size[0]], comp[: size[0]] = leader, of
            block, leader, of = s[-1], first[-1], comp[-1]
            first, v = first[comp != c], v[comp != c]
            both = np.unique(np.stack([np.minimum(first, v), np.maximum(first, v)], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})

    return _by_leader(rows, _MORE_SEEDS).mapInArrow(pair, "a long, b long").distinct()


def bitmap(values: np.ndarray, least: int = 9, most: int = 16) -> bytes:
    """Four bits or more for each value, a power of two of them from 2**least to 2**most."""
    size = 1 << min(most, max(least, (4 * len(values) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(mix(values) >> _U(20)) % _U(size)] = 1
    return np.packbits(bits).tobytes()


class Bitmaps:
    """Sizes and bitmaps of sets, as one matrix for each length of bitmap."""

    def __init__(self, n: np.ndarray, maps: list[bytes]):
        self.n = n
        self.length = np.array([len(m) for m in maps], np.int64)
        self.at = np.zeros(len(maps), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for length in np.unique(self.length).tolist():
            mine = np.flatnonzero(self.length == length)
            self.at[mine] = np.arange(len(mine))
            self.rows[length] = np.frombuffer(b"".join([maps[k] for k in mine]), np.uint64).reshape(len(mine), -1)

    def enough(self, x: np.ndarray, other: "Bitmaps", y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets x and the other's sets y can overlap enough, by the bits that one has and the other lacks."""
        keep = np.zeros(len(x), bool)
        kinds = self.length[x] << 32 | other.length[y]
        for kind in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == kind)
            p, q = kind >> 32, kind & ((1 << 32) - 1)
            step = max(1, (1 << 24) // max(p, q))
            for first in range(0, len(mine), step):
                k = mine[first : first + step]
                u, v = self.rows[p][self.at[x[k]]], other.rows[q][other.at[y[k]]]
                u, v = _folded(u, min(p, q) // 8), _folded(v, min(p, q) // 8)
                both = u & v
                only_u, only_v = (np.bitwise_count(w ^ both).sum(1).astype(np.int64) for w in (u, v))
                most = np.minimum(self.n[x[k]] - only_u, other.n[y[k]] - only_v)
                keep[k] = (100 + percent) * most >= percent * (self.n[x[k]] + other.n[y[k]])
        return keep


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of so many 64-bit words, which are what the same values give in shorter bitmaps."""
    while maps.shape[1] > words:
        maps = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :]
    return maps


def sifted(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs(a, b, c) whose bitmaps do not rule them out."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (Bitmaps(batch.column(f"n{k}").to_numpy(), batch.column(f"bits{k}").to_pylist()) for k in "ab")
            every = np.arange(batch.num_rows)
            yield batch.select(["a", "b", "c"]).filter(pa.array(u.enough(every, v, every, percent)))

    return pairs.select("a", "b", F.col("c").cast("long").alias("c"), "na", "bitsa", "nb", "bitsb").mapInArrow(sift, "a long, b long, c long").distinct()


def _of_few(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of ``nodes(node)`` where these are few; of further nodes too where they are many."""
    if nodes.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return texts
    return texts.join(F.broadcast(nodes), "node", "left_semi")


def contested(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, sets_of: Sets) -> DataFrame:
    """(node, n, bits, few, text) of the wanted nodes: size, bitmap and bitmap of 512 bits of its set, and the text of its representative."""
    reps = wanted.join(nodes.select("node", "rep"), "node")
    if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        reps = F.broadcast(reps)
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null").join(reps, "rep").select("node", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text has the node's set: another text may have the same doc_id, and the same text may come twice."""
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                node = part.column("node").to_pylist()
                found = [(r, len(v), bitmap(v), bitmap(v, 9, 9)) for r, v in sets_of(part) if int.from_bytes(_key(v)[:8], "big") >> 4 == node[r] and node[r] not in met]
                if len(met) < REMEMBERED:
                    met.update(node[r] for r, *_ in found)
                kept = part.take(pa.array([r for r, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column("node"), pa.array([n for _, n, *_ in found], pa.int64()), *[pa.array([f[k] for f in found], pa.binary()) for k in (2, 3)], kept.column("text")], ["node", "n", "bits", "few", "text"])

    return rows.mapInArrow(own, "node long, n long, bits binary, few binary, text string")


def open_pairs(large: DataFrame, roots: DataFrame, percent: int, texts: DataFrame) -> DataFrame | None:
    """(a, b): pairs of different components in large blocks, by dual traversal of bounded chunks."""
    comp = F.coalesce("root", "node").alias("comp")
    n = F.shiftright("meta", _BITS + _PLACE)
    place = F.shiftright("meta", _BITS).bitwiseAND((1 << _PLACE) - 1)
    prefix = n - F.expr(f"(shiftright(meta, {_BITS + _PLACE}) * {percent} + 99) div 100") + 1
    share = F.when(n == _MOST, 2.0).otherwise((n - F.shiftright(place * prefix, _PLACE)) / n).alias("share")
    with_comp = large.join(roots, "node", "left").select(_block(F.col("shingle")).alias("shingle"), "node", "meta", comp, share)
    # the main component of each block that holds several
    sizes = with_comp.groupBy("shingle", "comp").agg(F.count("*").alias("k"), F.max("share").alias("share"))
    mains = sizes.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("total"), F.max("share").alias("most"), F.count("*").alias("comps"))
    # Let r be what a set has from its posting on, and s the share r / n.  A pair that first
    # meets here has r1, r2 >= p / (1 + p) (n1 + n2), so n2 <= g1 n1 and n1 <= g2 n2 for
    # g = s (1 + p) / p - 1: it needs g1 g2 >= 1.
    gain = lambda s: s * ((100.0 + percent) / percent) - 1
    mains = mains.filter((F.col("comps") > 1) & (gain(F.col("most")) * gain(F.col("most")) >= 1 - 1e-9))
    rest = with_comp.join(mains.select("shingle", "main", "total", "most"), "shingle").filter(gain(F.col("share")) * gain(F.col("most")) >= 1 - 1e-9)
    rest = materialize(rest.drop("share", "most"), "open-blocks")
    if rest.isEmpty():
        return None
    # A block of up to CHUNK rows is one group.  In a larger one, a lane is a band of
    # sizes, one for each factor 1/p, times two: odd for the block's main component.
    # Chunks of a lane are bounded; pairs within main lanes are not wanted.
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rest = rest.withColumn("lane", 2 * band + (F.col("comp") == F.col("main")).cast("int"))
    counts = rest.filter(F.col("total") > CHUNK).groupBy("shingle", "lane").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("s"))
    maps = counts.groupBy("shingle").agg(F.map_from_entries(F.collect_list(F.struct("lane", "s"))).alias("chunks"))
    rest = rest.join(maps, "shingle", "left")
    lane, mine = F.col("lane"), F.pmod(F.xxhash64("node"), F.element_at("chunks", F.col("lane"))).cast("int")

    def keys(other: Column, wanted: Column, make) -> Column:
        n = F.coalesce(F.try_element_at("chunks", other), F.lit(0))
        empty = F.array().cast("array<struct<b1:int,t1:int,b2:int,t2:int,side:int>>")
        return F.when(wanted & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), make)).otherwise(empty)

    def key(b1: Column, t1: Column, b2: Column, t2: Column, side: Column) -> Column:
        return F.struct(b1.alias("b1"), t1.alias("t1"), b2.alias("b2"), t2.alias("t2"), side.cast("int").alias("side"))

    minor = F.pmod(lane, F.lit(2)) == 0
    floor = lane - F.pmod(lane, F.lit(2))
    every = [keys(lane, minor, lambda t: key(lane, F.least(t, mine), lane, F.greatest(t, mine), F.when(t == mine, -1).when(mine < t, 0).otherwise(1)))]

    def against(other: Column, wanted: Column) -> list[Column]:
        return [
            keys(other, wanted & (lane < other), lambda t: key(lane, mine, other, t, F.lit(0))),
            keys(other, wanted & (lane > other), lambda t: key(other, t, lane, mine, F.lit(1))),
        ]

    for step in (-2, -1, 0, 1, 2, 3):
        every += against(floor + step, (floor + step != lane) & (minor | F.lit(step % 2 == 0)))
    zero = F.lit(0)
    whole = F.array(key(zero, zero, zero, zero, F.lit(-1)))
    spread = rest.select("shingle", "node", "meta", "comp", F.explode(F.when(F.col("total") > CHUNK, F.concat(*every)).otherwise(whole)).alias("k")).select("shingle", "node", "meta", "comp", "k.*")
    spread = spread.join(_of_few(texts, rest.select("node").distinct()).select("node", "n", "few"), "node")

    names = ["shingle", "b1", "t1", "b2", "t2"]

    def pairs(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        meta, node, n, comp, side = (rows.column(c).to_numpy().astype(np.int64) for c in ("meta", "node", "n", "comp", "side"))
        x, y = forest_pairs(group, meta, percent, side, comp, first=True)
        maps = Bitmaps(n, rows.column("few").to_pylist())
        keep = maps.enough(x, maps, y, percent)
        x, y = node[x[keep]], node[y[keep]]
        return pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group, which the next batch may go on with
        for batch in chain(batches, [None]):
            if batch is not None:
                both = pa.Table.from_batches([batch])
                held = (both if held is None else pa.concat_tables([held, both])).combine_chunks()
            if held is None or not held.num_rows:
                continue
            columns = [held.column(c).to_numpy() for c in names]
            starts = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
            end = held.num_rows if batch is None else int(starts[-1])
            at = 0
            while at < end:  # as many whole groups as have about the rows of one pair of chunks
                to = int(np.append(starts, held.num_rows)[np.searchsorted(starts, at + 2 * CHUNK, "right") - 1])
                to = min(end, to if to > at else int(np.append(starts, held.num_rows)[np.searchsorted(starts, at, "right")]))
                yield pairs(held.slice(at, to - at), np.searchsorted(starts, np.arange(at, to), "right"))
                at = to
            held = held.slice(end)

    return spread.repartition(*names).sortWithinPartitions(*names).mapInArrow(traverse, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, sets_of: Sets = shingles_of) -> DataFrame:
    """The different (a, b) whose whole texts(node, text) qualify.

    Pairs are grouped by a, at most about ``GROUP`` to a group, so a's text moves
    once for a group and b's once for a pair.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("s"))
    salted = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "s").cast("int").alias("salt"))
    heads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rows = heads.unionByName(salted.withColumn("node", F.col("b")))
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = _of_few(texts.select("node", "text"), wanted)
    with_text = rows.join(texts, "node").select("a", "salt", "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, against = None, None
        for batch in batches:
            for part in slices(batch):
                sets = dict(sets_of(part))
                found: list[tuple[int, int]] = []
                for r, (a, salt, b) in enumerate(zip(*[part.column(k).to_pylist() for k in ("a", "salt", "b")])):
                    if b is None:
                        head, against = (a, salt), sets[r]
                    else:
                        assert head == (a, salt)
                        common = _overlap(against, sets[r])
                        if 100 * common >= percent * (len(against) + len(sets[r]) - common):
                            found.append((a, b))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    ordered = with_text.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(check, "a long, b long").distinct()  # a text may be there twice


def roots_of(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs with their sets' components, ra and rb."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    return roots_of(pairs, roots).filter("ra <> rb").select("a", "b")


def _overlap(u: np.ndarray, v: np.ndarray) -> int:
    if len(u) > len(v):
        u, v = v, u
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach, for every node of an edge."""

    def cut(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        """The different rows, written, with their number and the sum of their hashes."""
        seen = Observation()
        out = materialize(df.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        return out, (seen.get["n"], seen.get["h"])

    now, state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    before = None
    while state != before:
        before = state
        # large star: every larger neighbour of u is tied to the least around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        tied = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now, state = cut(tied, "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all links: ``roots`` of earlier ones, and further links between their components."""
    between = roots_of(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    over = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # a component's own root, and sets that had no link so far
    new = over.select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialize(old.unionByName(new), "roots")


def linked(pairs: DataFrame, roots: DataFrame, texts: DataFrame, percent: int, sets_of: Sets) -> DataFrame:
    """``joined`` with the links among the written ``pairs(a, b)`` of different components.

    Two components need one link, however many pairs lie between them: up to ``FIRST``
    of these are verified first, and the others only where the two are then still apart.
    """
    n = pairs.count()
    if n <= FEW_PAIRS:
        return joined(roots, materialize(verified(pairs, texts, percent, sets_of), "links"))
    between = roots_of(pairs, roots).withColumns({"low": F.least("ra", "rb"), "high": F.greatest("ra", "rb")})
    one = between.groupBy("low", "high", F.pmod(F.xxhash64("a", "b"), F.lit(FIRST))).agg(F.min(F.struct("a", "b")).alias("p"))
    some = materialize(one.select("p.*"), "first")
    if 2 * some.count() > n:  # too few others for a round of their own
        return joined(roots, materialize(verified(pairs, texts, percent, sets_of), "links"))
    roots = joined(roots, materialize(verified(some, texts, percent, sets_of), "links"))
    left = materialize(apart(pairs, roots).join(some, ["a", "b"], "left_anti"), "apart")
    return roots if left.isEmpty() else joined(roots, materialize(verified(left, texts, percent, sets_of), "links"))


def possible(counts: DataFrame, nodes: DataFrame, percent: int, more: Column) -> DataFrame:
    """The rows of counts(a, b, c) whose overlap can be large enough.

    Of the two prefixes' ends, take the one that comes first in the ranking: what
    the sets share up to there lies in both prefixes, so it is among the ``c``
    shingles known to be shared or among the ``more`` that were not counted; what
    they share after it lies behind that prefix.
    """
    for side in ("a", "b"):
        counts = counts.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("large").alias(f"l{side}")), side)
    behind = lambda n: F.expr(f"({n} * {percent} + 99) div 100") - 1  # noqa: E731  n less the prefix
    needed = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return counts.filter(near & (F.col("c") + more + F.greatest(behind("na"), behind("nb")) >= needed)).select("a", "b", "c")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return jaccard_members(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each component of rows one stays.

    It is the row with the least doc_id, of several with that doc_id the one with the
    least hash of its text, and of rows with both alike the one whose other columns
    sort first.  Rows without a doc_id or without a word stay.
    """
    columns = docs.columns
    linked = jaccard_members(docs, percent).filter("class is not null and doc_id is not null")
    texts = linked.groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = texts.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    marks = texts.join(first, "class").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.when(F.struct("doc_id", "text_hash") != F.col("first"), "drop").when(F.col("copies") > 1, "several").alias("_mark")
    )
    marks = materialize(marks.filter("_mark is not null"), "marks")
    if marks.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        marks = F.broadcast(marks)
    marked = docs.withColumns({"_id0": F.col("doc_id").cast("long"), "_hash0": F.xxhash64("text")})
    marked = marked.join(marks, (F.col("_id0") == F.col("_id")) & (F.col("_hash0") == F.col("_hash")), "left")
    rest = [F.col(c) for c in columns if c not in ("doc_id", "text")]
    order = F.struct(*[c.cast("string") for c in rest]) if rest else F.lit(0)
    several = marked.filter("_mark = 'several'").groupBy("_id", "_hash").agg(F.min_by(F.struct(*columns), order).alias("r")).select("r.*")
    return marked.filter("_mark is null").select(*columns).unionByName(several)


def jaccard_members(docs: DataFrame, percent: int = PERCENT, sets_of: Sets = shingles_of) -> DataFrame:
    """doc_id, text_hash, n_shingles, class and component_id of every row.

    ``sets_of`` says what the sets are that rows are compared by: shingles, or others.
    ``class`` tells components apart, null for a row without a word; two of them
    have the same component_id only where different texts have one doc_id.
    """
    sets, common = shingle_sets(docs, sets_of)
    pairs, large = blocks(postings(docs.filter("doc_id is not null"), common, percent, sets_of), percent)
    known = sets.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    in_large = large.groupBy("node").agg(F.count("*").alias("large"))
    nodes = materialize(known.join(in_large, "node", "left").fillna(0, ["large"]), "nodes")
    counted = materialize(pairs.groupBy("a", "b").agg(F.sum("c").alias("c")), "counted")
    candidates = materialize(possible(counted, nodes, percent, F.least("la", "lb")), "candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).union(nodes.filter("large > 0").select("node")).distinct()
    texts = materialize(contested(wanted, nodes, docs, sets_of), "contested")
    candidates = materialize(sifted(candidates, texts, percent), "sifted")
    # first each set with the candidate that it meets most often; most others are then in one component
    star = candidates.groupBy("b").agg(F.min_by("a", F.struct(-F.col("c"), "a")).alias("a")).select("a", "b")
    roots = components(verified(star, texts, percent, sets_of))
    rest = apart(candidates, roots)
    if not large.isEmpty():
        # pairs that also meet in a small block are candidates already, or cannot qualify
        found = more_leaders(large, roots).join(counted, ["a", "b"], "left_anti").withColumn("c", F.lit(0))
        rest = rest.union(sifted(possible(found, nodes, percent, F.least("la", "lb")), texts, percent).select("a", "b")).distinct()
    rest = materialize(rest.join(star, ["a", "b"], "left_anti"), "apart")
    if not rest.isEmpty():
        roots = linked(rest, roots, texts, percent, sets_of)
    opened = None if large.isEmpty() else open_pairs(large, roots, percent, texts)
    if opened is not None:
        # pairs that also meet in a small block have been looked at
        left = opened.distinct().join(counted, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_anti").withColumn("c", F.lit(0))
        left = materialize(sifted(materialize(left, "open-pairs"), texts, percent), "open-pairs")
        if not left.isEmpty():
            roots = linked(left, roots, texts, percent, sets_of)
    tied = sets.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    least = tied.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return tied.join(least, "comp", "left").select(
        "doc_id", "text_hash", "n_shingles", F.col("comp").alias("class"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )
