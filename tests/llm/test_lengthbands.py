"""The search by length bands against a comparison of every two sets, with limits so low that every way is taken."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import lengthbands, spotsigs


def jaccard(a, b):
    return len(a & b) / len(a | b)


def families(seed):
    """Sets of 1 to 130 numbers: near copies in chains, sets around a passage that all have, and nested short ones."""
    rng = random.Random(seed)
    common = list(range(12))
    out = []
    for _ in range(12):
        base = set(rng.sample(range(100, 5000), rng.choice([1, 3, 4, 9, 20, 60, 110]))) | set(rng.choice([[], common]))
        now = sorted(base)
        for _ in range(rng.randint(1, 9)):
            out.append(frozenset(now))
            now = [x if rng.random() > 0.08 else rng.randint(100, 5000) for x in now] + [rng.randint(100, 5000)] * rng.randint(0, 1)
    out += [frozenset(common[:k]) for k in range(1, 13)] + [frozenset([*common, 6000 + k]) for k in range(8)]
    return sorted(set(out), key=sorted)


def as_nodes(spark, sets):
    return spark.createDataFrame([(k, k, len(s), sorted(s)) for k, s in enumerate(sets)], "node long, rep long, n long, sigs array<int>").repartition(5)


@pytest.mark.parametrize("low, percent", [(False, 75), (True, 75), (True, 60), (True, 90)])
def test_search_is_exact(spark, monkeypatch, low, percent):
    if low:
        for name, value in {"LIST": 2, "TILE": 3, "MOST_BROADCAST": 0, "GROUP": 2, "COMMON": 2, "RANKED": 9, "_CELLS": 4}.items():
            monkeypatch.setattr(lengthbands, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sets = families(percent)
        nodes = as_nodes(spark, sets)
        want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = lengthbands.near_pairs(nodes, percent).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 10
        assert all(abs(r.likeness - jaccard(sets[r.a], sets[r.b])) < 1e-12 for r in got)
        group = list(range(len(sets)))
        for a, b in want:
            group = [group[a] if g == group[b] else g for g in group]
        least = {g: min(k for k, h in enumerate(group) if h == g) for g in group}
        roots = {r.node: r.root for r in lengthbands.near_roots(nodes, percent).collect()}
        assert [roots.get(k, k) for k in range(len(sets))] == [least[g] for g in group]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def emitter(monkeypatch, most_common):
    """What a task of ``postings`` does, without a cluster."""
    monkeypatch.setattr(lengthbands, "ranking", lambda nodes: (np.arange(most_common, dtype=np.uint32), np.arange(most_common)))
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
    nodes = SimpleNamespace(sparkSession=session, select=lambda *names: SimpleNamespace(mapInArrow=lambda work, schema: work))
    return lengthbands.postings(nodes, 75)


def test_a_full_batch_is_posted_in_little_memory(monkeypatch):
    """A task's memory does not grow with the signatures of a batch, which has 10,000 sets in large inputs."""
    n, size = 6000, 400
    sigs = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, np.arange(n * size, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), sigs], ["node", "sigs"])
    emit = emitter(monkeypatch, 900)
    tracemalloc.start()
    try:
        rows = [0, 0]
        for out in emit(iter([batch])):
            home = ~out.column("guest").to_numpy(zero_copy_only=False)
            rows[0] += int(home.sum())
            rows[1] += int(out.column("node").to_numpy()[home].sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    posted = size - 300 + 1
    assert rows == [n * posted, posted * n * (n - 1) // 2]
    assert peak < 60e6


@pytest.mark.parametrize("most", [1, 40])
def test_parts_of_a_batch_are_posted_like_the_whole(monkeypatch, most):
    sets = families(5)
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(sets)), pa.int64()), "sigs": pa.array([sorted(s) for s in sets], pa.list_(pa.int32()))})
    emit = emitter(monkeypatch, 300)
    rows = lambda: [sorted(map(tuple, (r.values() for out in emit(iter([batch])) for r in out.to_pylist())))]
    whole = rows()
    monkeypatch.setattr(lengthbands, "_SIGNATURES", most)
    assert rows() == whole and len(list(lengthbands._in_parts(batch))) > 20


def test_bands():
    for percent in (50, 75, 99, 100):
        starts = lengthbands.band_starts(percent)
        for n in [*range(1, 400), 10**6]:
            own = np.searchsorted(starts, n, "right") - 1
            most = n * 100 // percent  # the longest partner
            far = np.searchsorted(starts, most, "right") - 1
            assert far <= own + 1 and (far == own or 100 * n >= percent * starts[own + 1])


def test_cases(spark, odd, empty):
    """Odd rows all come back; rows without a word or without an id are linked with nothing."""
    got = spotsigs.near_components(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].component_id == 3 and by_id[102].component_id == 102 and by_id[103].n_signatures == 0 and by_id[None].component_id is None
    assert spotsigs.near_components(empty).count() == 0 and spotsigs.near_documents(empty).count() == 0
