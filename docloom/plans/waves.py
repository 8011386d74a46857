"""Dependency graphs of many plans: validation, waves and deadlocks.

``steps(plan, ord, id, deps array<string>)`` holds all plans at once; a plan is a graph
of its own, of any shape.  A wave is the set of steps whose dependencies were all done
before it and whose id is not done yet.  So of steps with one id those run that are ready
first, and the others never do.  What waits for a cycle, for itself or for an unknown id
never runs; a null among the dependencies is an unknown id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Plans with more steps than this are cut into blocks of about as many, with the same result.
MOST_STEPS = 1 << 17


#: Bytes of input, as the optimizer counts them, for each partition of steps.
PARTITION_BYTES = 4 << 20


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys in the session's number of partitions, or in more where there are many, so that a task's share is bounded."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // PARTITION_BYTES) if size < 1 << 60 else 0
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 16)), *keys)


def duplicate_ids(steps: DataFrame) -> DataFrame:
    """(plan, id, n) of ids that several steps of a plan have."""
    return steps.groupBy("plan", "id").agg(F.count("*").alias("n")).filter("n > 1")


def unknown_dependencies(steps: DataFrame) -> DataFrame:
    """(plan, id, dep): dependencies on ids that the plan lacks."""
    asked = steps.select("plan", "id", F.explode("deps").alias("dep")).distinct()
    return asked.join(steps.select("plan", F.col("id").alias("dep")), ["plan", "dep"], "left_anti").select("plan", "id", "dep")


def validate(steps: DataFrame) -> DataFrame:
    """(plan, problem): the first duplicate id, else the first unknown dependency of each faulty plan."""
    # An id with its steps and the steps that ask for it in one group.  Where no id stands
    # twice, a step's own place is its id's; where one does, what is unknown does not matter.
    steps = steps.filter("plan is not null and id is not null")
    kind = steps.schema["ord"].dataType
    entry = lambda key, own, ord, problem: F.struct(key.alias("key"), own.cast(kind).alias("own"), ord.cast(kind).alias("ord"), problem.cast("string").alias("problem"))
    text = lambda dep: F.concat(F.lit("Step "), "id", F.lit(" depends on unknown step "), F.coalesce(dep, F.lit("null")))
    asked = F.transform(F.coalesce("deps", F.array().cast("array<string>")), lambda dep: entry(dep, F.lit(None), F.col("ord"), text(dep)))
    each = steps.select("plan", F.explode(F.concat(F.array(entry(F.col("id"), F.col("ord"), F.lit(None), F.lit(None))), asked)).alias("e")).select("plan", "e.*")
    place = lambda rank, ord, problem: F.struct(F.lit(rank).alias("rank"), ord.alias("ord"), problem.alias("problem"))
    found = each.groupBy("plan", "key").agg(F.count_if(F.col("problem").isNull()).alias("n"), F.min("own").alias("own"), F.min(F.when(F.col("problem").isNotNull(), F.struct("ord", "problem"))).alias("asked"))
    twice = F.when(F.col("n") > 1, place(0, F.col("own"), F.concat(F.lit("Duplicate step ID: "), "key")))
    unknown = F.when(F.col("n") == 0, place(1, F.col("asked.ord"), F.col("asked.problem")))
    faults = found.select("plan", F.coalesce(twice, unknown).alias("fault")).filter("fault is not null")
    return faults.groupBy("plan").agg(F.min("fault").alias("fault")).select("plan", F.col("fault.problem").alias("problem"))


#: Steps of a wave up to which they are gone through one by one.
_FEW = 64


# -- waves --------------------------------------------------------------------------------


def peel(ids: np.ndarray, owner: np.ndarray, deps: np.ndarray, given: np.ndarray | None = None, given_waves: np.ndarray | None = None) -> np.ndarray:
    """The wave of each step, -1 where it never runs; all plans are peeled at once.

    ``ids`` are numbers of the steps' ids, ``owner`` and ``deps`` the step and the id of each
    dependency.  Ids are different numbers in different plans, and the numbers of
    dependencies that no step has are not among ``ids``; ``given`` are those of them that
    steps elsewhere run, in the order of their waves.
    """
    given, given_waves = (np.zeros(0, np.int64),) * 2 if given is None else (given, given_waves)
    wave = np.full(len(ids), -1, np.int64)
    edges = np.divmod(np.unique(deps * max(1, len(ids)) + owner), max(1, len(ids)))
    waits = np.bincount(edges[1], minlength=len(ids))
    width = int(max(ids.max(initial=-1), deps.max(initial=-1), given.max(initial=-1))) + 1
    first = np.searchsorted(edges[0], np.arange(width + 1))
    done = np.zeros(width, bool)
    ids, after = np.ascontiguousarray(ids), np.ascontiguousarray(edges[1])
    # few steps at once, as in a chain, are gone through one by one
    v_ids, v_first, v_after, v_waits, v_wave, v_done = map(memoryview, (ids, first, after, waits, wave, done))
    ready, n, at_given = np.flatnonzero(waits == 0), 0, 0
    while len(ready) or at_given < len(given):
        if not len(ready):
            n = int(given_waves[at_given])
        settled = given[:0]
        if at_given < len(given) and given_waves[at_given] == n:
            end = int(np.searchsorted(given_waves, n, "right"))
            settled, at_given = given[at_given:end], end
        if len(ready) + len(settled) <= _FEW:
            ran, some = [s for s in ready if not v_done[v_ids[s]]], set(settled.tolist())
            for s in ran:
                v_wave[s] = n
                some.add(v_ids[s])
            ready = []
            for i in some:
                v_done[i] = True
                for at in range(v_first[i], v_first[i + 1]):
                    v_waits[v_after[at]] -= 1
                    if not v_waits[v_after[at]]:
                        ready.append(v_after[at])
        else:
            ready = np.asarray(ready, np.int64)
            ready = ready[~done[ids[ready]]]
            wave[ready] = n
            settled = np.concatenate([np.unique(ids[ready]), settled])
            done[settled] = True
            many = first[settled + 1] - first[settled]
            at = np.repeat(first[settled] - np.cumsum(many) + many, many) + np.arange(many.sum())
            freed, less = np.unique(after[at], return_counts=True)
            waits[freed] -= less
            ready = freed[waits[freed] == 0]
        n += 1
    return wave


def _scheduled(table: pa.Table) -> pa.RecordBatch:
    """Steps of whole plans, sorted by plan, with their waves."""
    plans = table.column("plan").combine_chunks()
    ids = table.column("id").combine_chunks()
    listed = table.column("deps").combine_chunks()
    n = len(ids)
    plan = pd.factorize(plans.to_pandas(), use_na_sentinel=False)[0].astype(np.int64)
    counts = listed.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(n), counts)
    names = pa.concat_arrays([ids, listed.flatten()]).dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy().astype(np.int64)  # -1: null, which is no other step's id
    own = np.where(code[:n] >= 0, plan * (n + len(owner) + 1) + code[:n], -1 - np.arange(n))
    wanted = np.where(code[n:] >= 0, plan[owner] * (n + len(owner) + 1) + code[n:], np.iinfo(np.int64).min)
    number = pd.factorize(np.concatenate([own, wanted]))[0]
    wave = peel(number[:n], owner, number[n:])
    carried = [c for c in table.column_names if c not in ("plan", "ord", "id", "deps")]
    columns = [pa.array(wave, pa.int64(), mask=wave < 0) if c == "wave" else table.column(c).combine_chunks() for c in ("plan", "ord", "id", "wave", *carried)]
    return pa.RecordBatch.from_arrays(columns, ["plan", "ord", "id", "wave", *carried])


def _by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans follow each other; those that are whole are scheduled together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        plans = batch.column("plan")
        last = plans[batch.num_rows - 1]
        changes = pd.factorize(plans.to_pandas(), use_na_sentinel=False)[0]
        start = int(np.flatnonzero(changes == changes[-1])[0])  # of the last plan in the batch
        if held and (start > 0 or held[-1].column("plan")[held[-1].num_rows - 1].as_py() != last.as_py()):
            yield _scheduled(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        elif start > 0:
            yield _scheduled(pa.Table.from_batches([batch.slice(0, start)]))
        held.append(batch.slice(start))
    if held:
        yield _scheduled(pa.Table.from_batches(held))


def schedule(steps: DataFrame, *, most_steps: int | None = None, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), carried: tuple[str, ...] = ()) -> DataFrame:
    """(plan, ord, id, wave, *carried) of every step; a null wave for one that never runs.

    Plans are dealt out whole by one shuffle and peeled where they lie.  A plan of over
    ``most_steps`` steps is never gathered in one task but peeled in blocks.
    """
    most_steps = MOST_STEPS if most_steps is None else most_steps
    steps = steps.select("plan", "ord", "id", "deps", *carried)
    kinds = steps.schema
    sizes = steps.groupBy("plan").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > most_steps).select(F.col("plan").alias("_large"))
    result = f"plan {kinds['plan'].dataType.simpleString()}, ord {kinds['ord'].dataType.simpleString()}, id string, wave long"
    result += "".join(f", {c} {kinds[c].dataType.simpleString()}" for c in carried)
    if large.isEmpty():
        return steps.repartition("plan").sortWithinPartitions("plan").mapInArrow(_by_partition, result)
    same = F.col("plan").eqNullSafe(F.col("_large"))
    small = steps.join(large, same, "left_anti").repartition("plan").sortWithinPartitions("plan").mapInArrow(_by_partition, result)
    return small.unionByName(_by_blocks(steps.join(large, same, "left_semi"), most_steps, checkpoint).select("plan", "ord", "id", "wave", *carried))


#: Rounds after which the blocks' waves are written together again.
_ROUNDS = 40


def _block_waves(table: pa.Table) -> pa.Table:
    """The waves of a block's steps that run, from those that other blocks have found for their ids (rows without a set)."""
    block = table.column("block")[0].as_py()
    outside = table.column("_set").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    steps, other = table.filter(pa.array(~outside)).combine_chunks(), table.filter(pa.array(outside)).combine_chunks().sort_by("wave")
    listed = steps.column("deps").combine_chunks()
    counts = listed.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    n, owner = steps.num_rows, np.repeat(np.arange(steps.num_rows), counts)
    plans = pd.factorize(np.concatenate([t.column("plan").to_numpy() for t in (steps, other)]), use_na_sentinel=False)[0].astype(np.int64)
    wanted = listed.flatten().to_numpy(zero_copy_only=False)
    code = pd.factorize(np.concatenate([steps.column("id").to_numpy(), other.column("id").to_numpy(), wanted]))[0].astype(np.int64)
    plan = np.concatenate([plans, plans[owner]])
    # a null is no other step's id
    number = pd.factorize(np.where(code >= 0, plan * (len(code) + 1) + code, -1 - np.arange(len(code))))[0].astype(np.int64)
    wave = peel(number[:n], owner, number[n + other.num_rows :], number[n : n + other.num_rows], other.column("wave").to_numpy())
    runs = np.flatnonzero(wave >= 0)
    found = steps.select(["plan", "id", "_set"]).take(pa.array(runs))
    return pa.table([pa.array(np.full(len(runs), block), pa.int32()), *found.columns, pa.array(wave[runs], pa.int64())], ["block", "plan", "id", "_set", "wave"])


def _by_blocks(steps: DataFrame, most_steps: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The schedule of plans that no task gathers.  Steps with one id and one set of dependencies go alike.

    Ids lie in blocks by the place where they first stand in their plans.  A block is
    peeled in one task with the waves that are known of ids in other blocks, and again
    whenever one of those is found or found to be less; waves only become less, so this
    ends.  A chain along the plan's order takes about a round for each block, and no
    graph takes more than one for each wave of its longest way between blocks.
    """
    kind = steps.schema["plan"].dataType.simpleString()
    steps = checkpoint(steps.withColumn("_set", F.coalesce(F.sha2(F.to_json(F.array_sort(F.array_distinct("deps"))), 256), F.lit(""))))
    sets = steps.groupBy("plan", "id", "_set").agg(F.min("ord").alias("ord"), F.first("deps").alias("deps"))
    firsts = checkpoint(sets.groupBy("plan", "id").agg(F.min("ord").alias("ord"), F.count("*").alias("n")))
    n_blocks = min(10_000, -(-(firsts.agg(F.sum("n")).head()[0] or 1) // most_steps))
    placed = checkpoint(firsts.repartitionByRange(n_blocks, "plan", "ord", "id").select("plan", "id", F.spark_partition_id().alias("block")))
    home = placed.select(F.col("plan").alias("_p"), F.col("id").alias("_i"), "block")
    blocks = checkpoint(sets.join(home, F.col("plan").eqNullSafe(F.col("_p")) & F.col("id").eqNullSafe(F.col("_i"))).select("block", "plan", "id", "_set", F.array_distinct("deps").alias("deps")))
    asked = blocks.select("block", "plan", F.explode("deps").alias("id")).distinct()
    asked = asked.join(home.withColumnRenamed("block", "home"), F.col("plan").eqNullSafe(F.col("_p")) & (F.col("id") == F.col("_i"))).filter("block <> home")
    imports = checkpoint(asked.select("block", "plan", "id", "home", F.lit(None).cast("long").alias("wave"), F.lit(False).alias("new")))
    active = [r.block for r in placed.select("block").distinct().collect()]
    found: list[tuple[list[int], DataFrame]] = []
    while active:
        rows = blocks.filter(F.col("block").isin(active)).withColumn("wave", F.lit(None).cast("long"))
        known = imports.filter(F.col("block").isin(active) & F.col("wave").isNotNull())
        rows = rows.unionByName(known.select("block", "plan", "id", "wave"), allowMissingColumns=True)
        now = checkpoint(rows.groupBy("block").applyInArrow(_block_waves, f"block int, plan {kind}, id string, _set string, wave long"))
        found = [([b for b in some if b not in set(active)], df) for some, df in found] + [(active, now)]
        if len(found) > _ROUNDS:
            found = [(sorted(b for some, _ in found for b in some), checkpoint(_last(found)))]
        ours = now.groupBy("plan", "id").agg(F.min("wave").alias("_wave")).select(F.col("plan").alias("_p"), F.col("id").alias("_i"), "_wave")
        later = imports.join(ours, F.col("plan").eqNullSafe(F.col("_p")) & (F.col("id") == F.col("_i")), "left")
        less = F.coalesce((F.col("_wave") < F.col("wave")) | (F.col("_wave").isNotNull() & F.col("wave").isNull()), F.lit(False))
        imports = checkpoint(later.select("block", "plan", "id", "home", F.least("wave", "_wave").alias("wave"), less.alias("new")))
        active = sorted(r.block for r in imports.filter("new").select("block").distinct().collect())
    waves_of = _last(found).select(F.col("plan").alias("_p"), F.col("id").alias("_i"), F.col("_set").alias("_s"), "wave")
    ran = steps.join(waves_of, F.col("plan").eqNullSafe(F.col("_p")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("_set") == F.col("_s")), "left")
    return ran.drop("_p", "_i", "_s", "_set", "deps")


def _last(found: list[tuple[list[int], DataFrame]]) -> DataFrame:
    """The waves of each block from the round that peeled it last."""
    return reduce(DataFrame.unionByName, [df.filter(F.col("block").isin(some)) for some, df in found if some])


def waves(steps: DataFrame, *, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """(plan, id, wave) of every id that can run; ids that never can are left out."""
    return schedule(steps, checkpoint=checkpoint).filter("wave is not null").select("plan", "id", "wave").distinct()


def stalled(scheduled: DataFrame) -> DataFrame:
    """(plan, n_steps, n_done, deadlocked) of a schedule: a plan stops short when fewer different ids
    ran than it has steps, so a cycle, an unknown dependency and a repeated id all count."""
    counts = scheduled.groupBy("plan").agg(F.count("*").alias("n_steps"), F.count_distinct(F.when(F.col("wave").isNotNull(), F.col("id"))).alias("n_done"))
    return counts.withColumn("deadlocked", F.col("n_done") != F.col("n_steps"))


def deadlocks(steps: DataFrame, settled: DataFrame) -> DataFrame:
    """``stalled`` from ``steps`` and their ``waves``."""
    total = steps.groupBy("plan").agg(F.count("*").alias("n_steps"))
    ran = settled.groupBy("plan").agg(F.count_distinct("id").alias("n_done"))
    return total.join(ran, "plan", "left").fillna(0, ["n_done"]).withColumn("deadlocked", F.col("n_done") != F.col("n_steps"))


def execution_order(steps: DataFrame, settled: DataFrame) -> DataFrame:
    """(plan, wave, ord, id): steps by wave and, within one, in plan order."""
    return steps.select("plan", "ord", "id").join(settled, ["plan", "id"]).select("plan", "wave", "ord", "id")
