"""Near sets by partitions of set length and pruned Jaccard: the search of SpotSigs.  [operator 6]

1. ``different``  Texts with equal sets are one *node*, which carries the set.
2. ``postings``   A node is posted under its rarest signatures, n - ceil(p n) + 1 of
   them: two sets that qualify share one of those, whatever the order of signatures.
   A list is (band, signature), where bands part sets by length.  A set is at home in
   the band of its length, and a guest of the next one if a partner may lie there; no
   partner lies farther away.
3. ``compatible`` Two sets of a list are a candidate unless lengths, their places in
   the list's order or their bitmaps rule out the overlap that they need.  Places
   count as if the list's signature were the first that both share, which for every
   pair is true in one list.
4. A list of over ``LIST`` sets is *hot*.  Each of its sets is first paired with the
   list's leader.  Once these and the candidates of other lists are verified, only hot
   lists that still have sets of several components are left.  They are dealt into tiles
   of about ``TILE`` sets, and each two tiles are compared in a task of their own for
   pairs of different components.

No list is cut and no candidate dropped that is not ruled out: the search is exact for
sets of signatures as given.  ``LIST``, ``TILE``, ``RANKED``, ``MOST_BROADCAST`` and
``GROUP`` choose between ways with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import apart, components, joined
from .scratch import begin_task, materialize
from .wordarrays import mix

#: Lists of more sets are hot.
LIST = 32
#: Sets of one tile of a hot list, about.
TILE = 2048
#: Signatures in the ranking, the most common ones; all others come before them, in the order of a hash.
RANKED = 200_000
#: Nodes that a ranked signature has at least.
COMMON = 8
#: Hot lists that are broadcast up to this many, 24 bytes each.
MOST_BROADCAST = 200_000
#: Parts of a list where hot lists are too many to be broadcast.
_SALTS = 32
#: Pairs that share one copy of a set when they are verified.
GROUP = 256
#: Powers of 1/p between the lengths at which bands begin.
_WIDTH = 4
#: Places of a tile's comparison, and signatures of sets, that are gone through at once.
_CELLS = 1 << 18
_SIGNATURES = 1 << 18
_U = np.uint64


def band_starts(percent: int) -> np.ndarray:
    """The least length of each band; the next band's is at least 1/p times as large."""
    starts = [1]
    while starts[-1] < 1 << 40:
        # by a hundredth at least, so that bands are few where only equal sets are near
        starts.append(max(starts[-1] + 1, starts[-1] + starts[-1] // 100, -(-starts[-1] * 100**_WIDTH // percent**_WIDTH)))
    return np.array(starts, np.int64)


def different(rows: DataFrame) -> DataFrame:
    """(node, rep, n, sigs): the different sets of rows(doc_id, node, n, sigs), each with its least doc_id."""
    known = rows.filter("node is not null and doc_id is not null")
    # a task gives a set that it met before without its signatures
    return known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sigs", ignorenulls=True).alias("sigs"))


def ranking(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The RANKED most common signatures, sorted, and their ranks; rank 0 is the most common."""
    counts = nodes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    found = counts.filter(F.col("df") >= COMMON).orderBy(F.desc("df"), "sig").limit(RANKED).select("sig").toArrow()
    sigs = found.column("sig").to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(sigs)
    return sigs[order], order


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_SIGNATURES`` signatures; a larger set stands alone."""
    ends = np.cumsum(batch.column("sigs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _SIGNATURES, "right")))
        yield batch.slice(first, last - first)
        first = last


_POSTING = "list long, node long, n int, rest int, bits long, guest boolean"


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """A row for each list that a node is in.  ``rest``: how many signatures of the set come from the list's on."""
    shared = nodes.sparkSession.sparkContext.broadcast(ranking(nodes))  # RANKED entries at most
    starts = band_starts(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("lengthbands")
        ranked, rank = shared.value
        for batch in (some for whole in batches for some in _in_parts(whole)):
            column = batch.column("sigs")
            flat, offsets = column.flatten().to_numpy().view(np.uint32), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy().astype(np.int64))))
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            h = mix(flat.astype(np.uint64))
            at = np.minimum(np.searchsorted(ranked, flat), max(len(ranked) - 1, 0))
            common = ranked[at] == flat if len(ranked) else np.zeros(len(flat), bool)
            late = np.where(common, len(ranked) - rank[at], 0) if len(ranked) else np.zeros(len(flat), np.int64)
            order = np.lexsort((h, late, row))  # rare ones first; ``row`` stays as it is
            place = np.arange(len(flat)) - offsets[row]
            length = n - -(-n * percent // 100) + 1
            posted = np.flatnonzero(place < length[row])
            bits = np.bitwise_or.reduceat(_U(1) << (h >> _U(58)), offsets[:-1]) if len(n) else np.zeros(0, np.uint64)
            own = np.searchsorted(starts, n, "right") - 1
            r, sig = row[posted], flat[order][posted].astype(np.int64)
            also = np.flatnonzero((100 * n >= percent * starts[own + 1])[r])
            take = np.concatenate([np.arange(len(r)), also])
            guest = np.arange(len(take)) >= len(r)
            at_row = r[take]
            yield pa.RecordBatch.from_pydict({
                "list": ((own[at_row] + guest) << 32) | sig[take],
                "node": batch.column("node").to_numpy()[at_row],
                "n": n[at_row].astype(np.int32),
                "rest": (n[r] - place[posted])[take].astype(np.int32),
                "bits": bits[at_row].view(np.int64),
                "guest": guest,
            })

    return nodes.select("node", "sigs").mapInArrow(emit, _POSTING)


def compatible(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs x, y of rows of one list may qualify and are looked for in it."""
    n, rest = rows["n"].astype(np.int64), rows["rest"].astype(np.int64)
    needed = -(-percent * (n[x] + n[y]) // (100 + percent))
    keep = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    keep &= np.minimum(rest[x], rest[y]) >= needed
    keep &= ~(rows["guest"][x] & rows["guest"][y])  # both are at home in the band before
    bits = rows["bits"].view(np.uint64)
    # each bit that only one of them has stands for a signature that the other lacks
    keep &= np.bitwise_count(bits[x] & ~bits[y]) <= n[x] - needed
    keep &= np.bitwise_count(bits[y] & ~bits[x]) <= n[y] - needed
    if "comp" in rows:
        keep &= rows["comp"][x] != rows["comp"][y]
    return keep


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _joined(a: dict[str, np.ndarray] | None, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return b if a is None else {c: np.concatenate([a[c], b[c]]) for c in b}


def _cut(rows: dict[str, np.ndarray], at: slice) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in rows.items()}


def _counted(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """(a, b, c): different pairs of nodes with the number of times that each is there."""
    both = np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1)
    pairs, c = np.unique(both, axis=0, return_counts=True) if len(both) else (both, np.zeros(0, np.int64))
    return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1], "c": c})


def list_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b, c): candidates of lists that are not hot, c counting lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("lengthbands")
        held = None  # the last list as far as it came, LIST rows at most

        def pairs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            key = rows["list"]
            after = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1  # rows of the list behind each
            x = np.repeat(np.arange(len(key)), after)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
            keep = compatible(rows, x, y, percent)
            return _counted(rows["node"], x[keep], y[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = _joined(held, _columns(batch))
            first = int(np.searchsorted(held["list"], held["list"][-1]))
            if first:
                yield pairs(_cut(held, slice(0, first)))
                held = _cut(held, slice(first, None))
        if held is not None:
            yield pairs(held)

    return posted.repartition("list").sortWithinPartitions("list").mapInArrow(work, "a long, b long, c long")


def hot_lists(posted: DataFrame) -> DataFrame:
    """(list, size, leader) of every hot list; lists of the same sets have the same leader."""
    sized = posted.groupBy("list").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("l"))
    return sized.filter(F.col("size") > LIST).select("list", "size", F.col("l.node").alias("leader"))


def marked(posted: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``posted`` joined with ``hot`` by list; no task gets all rows of a list."""
    if hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return posted.join(F.broadcast(hot), "list", how)
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return posted.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(salted, ["list", "salt"], how).drop("salt")


def tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidates of hot lists rows(list, size, node, ..., comp where pairs of one component are not wanted)."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    cells = other.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("size", "tiles", "other")
    cells = cells.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("lengthbands")
        held = None  # one cell, two tiles at most

        def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            i, j = int(rows["i"][0]), int(rows["j"][0])
            left, right = np.flatnonzero(rows["tile"] == i), np.flatnonzero(rows["tile"] == j)
            step = max(1, _CELLS // max(len(right), 1))
            for k in range(0, len(left), step):
                some = left[k : k + step]
                x, y = np.repeat(some, len(right)), np.tile(right, len(some))
                if i == j:
                    x, y = x[x < y], y[x < y]
                keep = compatible(rows, x, y, percent)
                yield _counted(rows["node"], x[keep], y[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = _joined(held, _columns(batch))
            new = (held["list"][1:] != held["list"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])
            ends = np.flatnonzero(new) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                yield from pairs(_cut(held, slice(a, b)))
            if len(ends):
                held = _cut(held, slice(int(ends[-1]), None))
        if held is not None:
            yield from pairs(held)

    return cells.mapInArrow(work, "a long, b long, c long").select("a", "b").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, likeness) of the pairs whose sets qualify; each copy of a set serves up to about GROUP pairs."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("s"))
    salted = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("salt"))
    sets = nodes.select("node", "n", "sigs")
    heads = groups.join(sets.withColumnsRenamed({"node": "a", "n": "na", "sigs": "sa"}), "a").withColumn("salt", F.explode(F.expr("sequence(0, s - 1)"))).drop("s")
    both = salted.join(sets.withColumnsRenamed({"node": "b", "n": "nb", "sigs": "sb"}), "b").join(heads, ["a", "salt"])
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = both.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).cast("long").alias("n"))
    return counted.filter((100 + percent) * F.col("common") >= percent * F.col("n")).select("a", "b", (F.col("common") / (F.col("n") - F.col("common"))).alias("likeness"))


def near_roots(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every node that is linked with another: the components of links of ``percent``/100 or more."""
    posted = materialize(postings(nodes, percent), "spot-postings")
    hot = materialize(hot_lists(posted), "hot-lists")
    in_hot = marked(posted, hot, "inner")
    led = in_hot.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.lit(1).alias("c"))
    small = list_pairs(marked(posted, hot.select("list"), "left_anti"), percent)
    candidates = materialize(small.union(led).groupBy("a", "b").agg(F.sum("c").alias("c")), "spot-candidates")
    # first each set with the candidate that it meets most often; most others are then in one component
    star = candidates.groupBy("b").agg(F.min_by("a", F.struct(-F.col("c"), "a")).alias("a")).select("a", "b")
    roots = components(verified(star, nodes, percent).select("a", "b"))
    rest = materialize(apart(candidates, roots).join(star, ["a", "b"], "left_anti"), "spot-apart")
    if not rest.isEmpty():
        roots = joined(roots, materialize(verified(rest, nodes, percent).select("a", "b"), "spot-links"))
    if hot.isEmpty():
        return roots
    comps = in_hot.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "leader")
    comps = materialize(comps, "spot-hot")
    several = comps.groupBy("list").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l < h").select("list")
    found = tile_pairs(marked(comps, materialize(several, "open-lists"), "inner"), percent)
    found = materialize(found.join(candidates.select("a", "b"), ["a", "b"], "left_anti"), "spot-tiles")
    if not found.isEmpty():
        roots = joined(roots, materialize(verified(found, nodes, percent).select("a", "b"), "spot-links"))
    return roots


def near_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, likeness): every two nodes that are linked; their number may be the square of that of near sets."""
    posted = materialize(postings(nodes, percent), "spot-postings")
    hot = materialize(hot_lists(posted), "hot-lists")
    small = list_pairs(marked(posted, hot.select("list"), "left_anti"), percent).select("a", "b")
    tiles = tile_pairs(marked(posted, hot.select("list", "size"), "inner"), percent)
    return verified(small.union(tiles).distinct(), nodes, percent)
