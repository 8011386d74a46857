"""Sharding by vector bin packing.  [operator 8]

Documents with equal texts form a group.  A group is a vector (bytes, tokens,
rows); groups go, largest first, to the shard where the dot product of the
group's vector with the shard's residual capacity is highest among the shards
that still have room for its bytes.  The law that the result keeps is
``bytes``: the shards' sizes are near equal.

What is placed one by one is bounded at any input size.  A group over
1/(shards * GRAIN) of all bytes stands for itself, so there are at most
shards * GRAIN of them, and lies whole in one shard.  Only one that no shard has
room for is split into pieces of whole documents: one over a shard's share into about
PIECES for each share.  All other groups are hashed whole into ``lots``, which
even out the rest.
Only the vectors of those items, a few thousand rows, are placed on the driver;
documents then find their shard by a broadcast of that bounded list.

Cases with a defined result
  null text       no bytes: size 16; all null texts form one group with the
                  empty text (crc 0)
  null doc_id     placed like any other
  repeated rows   each takes a slot of its own; they are one group, and lie in one
                  shard unless it had no room for the group
  very long text  its size counts whole; over a shard's share it is a shard's main item
  ties            of equally good shards the lowest is taken
  empty table     an empty result
  extra columns   not returned; the result has doc_id and the columns it names
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

SHARDS = 40
#: Fineness: items of at most 1/GRAIN of a shard's share of bytes.
GRAIN = 48
#: Pieces for each shard's share of a group that outgrows a share.
PIECES = 4
_SALTS = 4096
_SUBS = 64


def place(vectors: np.ndarray, shards: int, total: np.ndarray | None = None, must: bool = True) -> np.ndarray:
    """The shard of each row of (bytes, tokens, rows), by residual dot products.

    Every dimension is measured in shards' shares.  A shard has room while the
    item's bytes fit in what is left of its share; when none has, the one with
    most bytes left is taken.  Ties go to the lower shard.
    ``total``: what the shards share, if it is more than these rows; without
    ``must``, what fits nowhere is left out (-1).
    """
    total = vectors.sum(axis=0) if total is None else total
    share = np.where(total > 0, vectors / np.where(total > 0, total, 1), 0.0) * shards
    residual = np.ones((shards, share.shape[1]))
    out = np.empty(len(share), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.sum(axis=1), -share[:, 0])):
        fits = residual[:, 0] >= share[i, 0]
        if fits.any():
            score = np.where(fits, residual @ share[i], -np.inf)
            out[i] = int(np.argmax(score))
        elif must:
            out[i] = int(np.argmax(residual[:, 0]))
        else:
            out[i] = -1
            continue
        residual[out[i]] -= share[i]
    return out


def pieces_of(groups: np.ndarray, shards: int, total: np.ndarray, limit: float) -> np.ndarray:
    """Into how many pieces each of the large groups goes: 1 for all that a shard has room for."""
    share = total[0] / shards
    pieces = np.ones(len(groups), np.int64)
    while True:
        owner = np.repeat(np.arange(len(groups)), pieces)
        at = place(groups[owner] / pieces[owner, None], shards, total, must=False)
        homeless = np.unique(owner[at < 0])
        homeless = homeless[pieces[homeless] == 1]
        # a piece for each salt at most; two at least, so that this ends
        size = groups[homeless, 0]
        pieces[homeless] = np.clip(np.ceil(np.where(size > share, PIECES * size / share, size / limit)), 2, _SALTS)
        if not len(homeless):
            return pieces


def shard_documents(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.trim(F.translate(text, "\t\n\x0b\f\r", " " * 5))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(words != "", F.size(F.split(words, " +"))).otherwise(0).cast("long").alias("tokens"),
        F.xxhash64(text, F.octet_length(text)).alias("g"),
        # rows that are alike in all columns are spread as well
        F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int").alias("salt"),
    )
    rows = materialize(rows, "sizes")  # all that follows reads these few bytes a row
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")]
    total = np.array([x or 0 for x in rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).head()], float)
    limit = max(1, int(total[0]) // (shards * grain))
    # A hot group is summed by (group, salt) first: no task holds all of it.
    parts = rows.withColumn("n", F.lit(1)).groupBy("g", "salt").agg(*sums)
    large = parts.groupBy("g").agg(*sums).filter(F.col("size") > limit)
    # at most shards * grain rows, each of over 1/(shards * grain) of all bytes
    found = large.orderBy("g").collect()
    pieces = pieces_of(np.array([[r["size"], r["tokens"], r["n"]] for r in found], float).reshape(-1, 3), shards, total, limit)
    large_rows = spark.createDataFrame([(r["g"], int(k)) for r, k in zip(found, pieces)], "g long, pieces int")
    lots = shards * grain * 2
    item = F.when(F.col("pieces").isNull(), F.pmod("g", F.lit(lots))).otherwise(lots + F.pmod(F.xxhash64("g", F.pmod("salt", "pieces")), F.lit(2**62)))

    def with_item(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(large_rows), "g", "left").withColumn("item", item)

    items = with_item(parts).groupBy("item").agg(*sums).orderBy("item").collect()
    shard_of = place(np.array([[r["size"], r["tokens"], r["n"]] for r in items], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, shard_of)], "item long, shard int")
    found = with_item(rows).join(F.broadcast(placed), "item").withColumn("sub", F.pmod(F.xxhash64("salt", F.lit(13)), F.lit(_SUBS)).cast("int"))
    # Slots: each (shard, sub) is numbered by itself, after the rows of the subs before it.
    before = found.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = before.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    numbered = found.withColumn("r", F.row_number().over(inside) - 1).join(F.broadcast(before), ["shard", "sub"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
