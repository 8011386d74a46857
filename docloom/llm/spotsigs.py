"""Document fingerprints by SpotSigs.  [operator 6]

A signature is a common word (the anchor) with the next ``CHAIN`` content words
after it.  A text's fingerprint is the set of its signatures, as sorted 32-bit
hashes written in Base64; the likeness of two fingerprints is the Jaccard
similarity of the sets.

``near_components`` finds all documents whose sets have a Jaccard similarity over a
threshold, without a pair for each two of them, by partitions of set length and
pruned comparisons (``lengthbands``).  ``near_documents`` lists the pairs themselves,
for tables of few near documents.

A word counts without the punctuation around it, in lower case (A-Z).

Cases with a defined result
  null text       like an empty text: 0 code points, fingerprint ""
  no anchor       one signature: the hash of the whole sequence of words
  no word         the empty set; two empty sets have likeness 1, one empty 0
  null doc_id     sorts before all others
  equal doc_ids   ordered by a hash of the text; equal rows are alike
  very long text  fingerprinted and edited whole
  one document    is its own next document
  empty table     an empty result
  extra columns   ignored; only doc_id and text are read
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lengthbands
from .scratch import begin_task, materialize, n_partitions
from .wordarrays import Words, mix, slices

CHAIN = 2
#: Keys of sets that a task remembers, so as not to give copies' signatures again.
REMEMBERED = 200_000
# fixed values: common words of the languages of the corpus
ANCHORS = {
    "en": "the a an of to in is was are and that it for with as by on this be from or at not but have has which",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce se il elle ne par",
    "de": "der die das und ist in den von zu mit im dem ein eine nicht auf sich des es an als auch für er sie",
    "es": "el la los las de y en que un una es no se por con para su al lo del como más o pero sus le",
}
_WORDS = sorted({w for words in ANCHORS.values() for w in words.split()})
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]{}*#$%&|<>-_/")] = True
_LANES = np.random.default_rng(5).integers(1, 2**63, CHAIN + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = 2**63 - 1


def _trimmed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without punctuation; a word of punctuation alone stays as it is."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        end -= (end > start + 1) & _PUNCTUATION[words.raw[end - 1]]
        start += (end > start + 1) & _PUNCTUATION[words.raw[start]]
    return start, end


_anchor_hashes: list[np.ndarray] = []


def signatures(column: pa.Array) -> list[np.ndarray]:
    """The sorted different signatures of each text, as unsigned 32-bit integers."""
    if not _anchor_hashes:
        listed = Words(pa.array(_WORDS))
        _anchor_hashes.append(np.sort(listed.range_hash(listed.start, listed.end)))
    words = Words(column, lower=True)
    h = words.range_hash(*_trimmed(words))
    known = _anchor_hashes[0]
    anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    nxt = np.searchsorted(content, spots)
    ends = words.first[1:][words.doc[spots]] if len(spots) else spots
    inside = nxt + CHAIN - 1 < len(content)
    spots, nxt, ends = spots[inside], nxt[inside], ends[inside]
    inside = content[nxt + CHAIN - 1] < ends if len(nxt) else np.zeros(0, bool)
    spots, nxt = spots[inside], nxt[inside]
    total = h[spots] * _LANES[0]
    for k in range(CHAIN):
        total += h[content[nxt + k]] * _LANES[k + 1]
    sig = (mix(total) >> np.uint64(32)).astype("<u4")
    bounds = np.searchsorted(spots, words.first)
    out = []
    for r in range(len(words.count)):
        values = np.unique(sig[bounds[r] : bounds[r + 1]])
        if not len(values) and words.count[r]:
            row = h[words.first[r] : words.first[r + 1]]
            order = np.arange(1, len(row) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            values = (mix((mix(row) * order).sum(dtype=np.uint64).reshape(1)) >> np.uint64(32)).astype("<u4")
        out.append(values)
    return out


def fingerprint(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return common / (len(a) + len(b) - common)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text), sorted: in each part, a row's next document is the
    row after it.  The last rows of a part are guests, the first of the next part.

    Rows are ordered by (doc_id, hash of the text), 16 bytes a row, which Spark deals into
    ranges first.  The head of each range begins a part, so rows with one doc_id, or with
    none, are parted by their texts; only the heads, one for each part, go to the driver
    and back as a sorted array.  The texts move once.  Rows that are alike in both
    columns stay in one part, and a task sends one of them to the part before.
    """
    n = 4 * n_partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-_LAST - 1)).alias("o"), F.xxhash64("text").alias("h"))
    ranges = rows.select("o", "h").repartitionByRange(n, "o", "h").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("o", "h")).alias("head"))
    heads = np.array(sorted((r["head"]["o"], r["head"]["h"]) for r in ranges.collect()), np.int64).reshape(-1, 2)
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # 16 bytes a part

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("spotsigs")
        heads = shared.value
        sent = np.zeros(len(heads), bool)
        for batch in batches:
            o, h = batch.column("o").to_numpy(), batch.column("h").to_numpy()
            # heads up to (o, h): all with a smaller o, then by h among those with this one
            low, high = np.searchsorted(heads[:, 0], o, "left"), np.searchsorted(heads[:, 0], o, "right")
            while (open_ := low < high).any():
                mid = (low + high) // 2
                up = open_ & (heads[np.minimum(mid, len(heads) - 1), 1] <= h)
                low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
            part = low - 1
            at_head = np.flatnonzero((heads[np.maximum(part, 0)] == np.stack([o, h], 1)).all(1) & (part >= 0))
            new, which = np.unique(part[at_head], return_index=True)
            guests = at_head[which[~sent[new]]]
            sent[new] = True
            own = np.maximum(part, 0)
            for some, to, guest in ((None, own, 0), (guests, (own[guests] - 1) % len(heads), 1)):  # the first head goes to the last part
                out = batch if some is None else batch.take(pa.array(some))
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int64()), pa.array(np.full(out.num_rows, guest, np.int32))], [*out.schema.names, "part", "guest"])

    own = rows.mapInArrow(dealt, "doc_id long, text string, o long, h long, part long, guest int")
    return own.repartition(n // 4, "part").sortWithinPartitions("part", "guest", "o", "h").select("part", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the head of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row whose next document is still to come
        for batch in batches:
            for rows in slices(batch):
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1, 1)
                part, guest = rows.column("part").to_numpy(), rows.column("guest").to_numpy()
                mine = np.flatnonzero((guest[:-1] == 0) & (part[1:] == part[:-1]))
                if not len(mine):
                    continue
                texts = rows.column("text").fill_null("")
                words = texts.to_pylist()
                new = [edited(words[k], words[k + 1]) for k in mine]
                sets, new_sets = signatures(texts), signatures(pa.array(new, pa.large_string()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id").take(pa.array(mine)),
                    "n_chars": pa.array([len(words[k]) for k in mine], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in new],
                    "fingerprint": [fingerprint(sets[k]) for k in mine],
                    "edited_fingerprint": [fingerprint(x) for x in new_sets],
                    "near_edited": [likeness(sets[k], x) for k, x in zip(mine, new_sets)],
                    "near_next": [likeness(sets[k], sets[k + 1]) for k in mine],
                })

    return with_neighbours(docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signature_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, sigs array<int>) of every document; node tells sets apart and is null for the empty one.

    A task gives a set that it met before without its signatures.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("spotsigs")
        met: set[int] = set()
        for batch in batches:
            for rows in slices(batch):
                sets = signatures(rows.column("text"))
                nodes: list[int | None] = []
                shown: list[np.ndarray | None] = []
                linked = rows.column("doc_id").is_valid().to_pylist()
                for values, has_id in zip(sets, linked):
                    node = int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "big") >> 1 if len(values) else None
                    new = node is not None and has_id and node not in met
                    if new and len(met) < REMEMBERED:
                        met.add(node)
                    nodes.append(node)
                    shown.append(values.view("<i4") if new else None)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "node": pa.array(nodes, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sigs": pa.array(shown, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, node long, n long, sigs array<int>")


def near_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_signatures, component_id of every row: the smallest doc_id that links of likeness
    ``percent``/100 or more reach.  A row without a word is linked with nothing, and its
    component_id is its doc_id; a row without a doc_id is linked with nothing and has none."""
    rows = materialize(signature_sets(docs), "signature-sets")
    nodes = materialize(lengthbands.different(rows), "signature-nodes")
    tied = nodes.select("node", "rep").join(lengthbands.near_roots(nodes, percent), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("rep").alias("least"))
    # by sets, so that copies of one set are no rows of the join by components
    named = tied.join(least, "root").select("node", "least")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.select("doc_id", "node", "n").join(named, "node", "left").select("doc_id", F.col("n").alias("n_signatures"), own.alias("component_id"))


def near_documents(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, likeness): pairs of representatives of different signature sets; a < b.

    Documents with equal sets have one representative, the smallest doc_id, so
    that copies are not expanded into pairs.  ``threshold`` counts in hundredths.
    """
    nodes = materialize(lengthbands.different(materialize(signature_sets(docs), "signature-sets")), "signature-nodes")
    pairs = lengthbands.near_pairs(nodes, round(100 * threshold))
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("rep").alias(f"r{side}")), side)
    return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "likeness")
