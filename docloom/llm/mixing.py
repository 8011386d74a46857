"""Mixing sources to target weights by Poisson replication.  [operator 7]

Every source has a target weight; its repetition rate is the mean number of
copies of each of its documents that gives the source its share of the target
size.  A document's count is the inverse of the Poisson distribution with that
mean at a uniform number hashed from (seed, doc_id), so a rerun, a lost task
or another partitioning gives the same counts.  Documents are then exploded by
their counts and ordered by a hash of (seed, doc_id, copy).

Cases with a defined result
  null text       size 16, like an empty text; it is drawn like any other
  null source     a source of its own
  null doc_id     drawn with the key "null"; such rows share one draw
  repeated rows   each row is drawn, all with the same count
  very long text  drawn and copied whole
  ties            rows with equal order keys stand in any order
  empty table     an empty result
  extra columns   kept as they are; ``copy`` and ``order_key`` are added last and
                  replace columns of these names
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Exponent on a source's size for its default target weight: 1 leaves the mix
#: as it is, 0 gives every source the same share.
TEMPERATURE = 0.5
#: A table of per-source rates is broadcast up to this many sources.
MOST_BROADCAST_SOURCES = 10_000
#: Mean above which one Poisson draw is the sum of several smaller ones.
_STEP = 16.0


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability with mean ``rate`` is over u.

    The sum stops 12 standard deviations above the mean, past the last double under 1.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), (u >= F.exp(-rate)).cast("int").alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        total = s["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), (s["k"] + (u >= total).cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = TEMPERATURE, target_size: float | None = None) -> DataFrame:
    """(source, size, rate): the mean number of copies for each source.

    ``weights`` are relative; a source that they leave out gets none.  Without
    weights a source's weight is its size to the power ``temperature``.  The
    target size is that of the input unless given.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    sizes = materialize(docs.groupBy("source").agg(F.sum(size).alias("size")), "source-sizes")
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighted = sizes.join(given.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total, size_all = weighted.agg(F.sum("weight"), F.sum("size").cast("double")).head()
    goal = float(target_size) if target_size is not None else size_all or 0.0
    scale = goal / total if total else 0.0
    return weighted.select("source", "size", (F.col("weight") * F.lit(scale) / F.col("size")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, seed: int = 7, temperature: float = TEMPERATURE, target_size: float | None = None) -> DataFrame:
    """The mixed documents with ``copy`` (from 0) and ``order_key``, globally ordered by it."""
    docs = docs.drop("copy", "order_key")
    table = rates(docs, weights, temperature=temperature, target_size=target_size).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    n_sources = table.limit(MOST_BROADCAST_SOURCES + 1).count()
    if n_sources <= MOST_BROADCAST_SOURCES:
        drawn = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_mix_source")))
    else:
        # Many sources, one of which may hold a third of the rows: salt it.
        salts = 64
        salted = docs.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        spread = table.withColumn("_mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        drawn = salted.join(spread, (F.col("_mix_salt") == F.col("_mix_salt2")) & F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_salt", "_mix_salt2")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # Poisson(a + b) is Poisson(a) + Poisson(b): large means are drawn in parts,
    # so that exp(-rate) never underflows.
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / _STEP).cast("int"))
    count = F.when(F.col("_mix_rate") <= 0, 0).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), parts),
            F.lit(0),
            lambda total, part: total + _poisson(_uniform(F.lit(str(seed)), key, part.cast("string")), F.col("_mix_rate") / parts),
        )
    )
    copies = drawn.withColumn("_mix_n", count).filter("_mix_n > 0")
    exploded = copies.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string")))
    return exploded.withColumn("order_key", order).orderBy("order_key")
