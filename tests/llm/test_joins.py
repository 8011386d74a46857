import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ngram_join, spotsigs

from .conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    """(doc_id, n_shingles, component) of each row."""
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)].append(i)
    return Counter((i, len(shingles(t)), None if i is None else min(least[top(k)])) for k, (i, t) in enumerate(rows))


def copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    common = [f"boiler{k}" for k in range(40)]
    out = []
    for _ in range(groups):
        n = rng.choice([4, 6, 20, 60, 150])
        base = [f"w{rng.randint(0, 400)}" for _ in range(n)] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 9)}"
            out.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("small,chunk,seed", [(24, 2048, 1), (2, 2, 2)])
def test_components_match_brute_force(spark, monkeypatch, small, chunk, seed):
    for name, value in (("SMALL_BLOCK", small), ("CHUNK", chunk), ("COMMON", 3), ("GROUP", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_component_cases(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, ngram_join.jaccard_components(odd).collect())) == brute(rows)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_blocks_of_copies_go_on_over_batches(spark):
    """Two texts with a copy in each of 30 tasks: their postings come in different Arrow batches."""
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join([*words[:-1], "changed"])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "30")
    try:
        meta = ngram_join.pack(np.arange(50, dtype=np.uint64))
        posted = spark.createDataFrame([(7, 1 + k // 30, meta) for k in range(60)], "shingle long, node long, meta long").coalesce(1)
        pairs, large = ngram_join.blocks(posted, 75)
        assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2)} and large.count() == 0
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(k, a if k < 30 else b) for k in range(60)], 60), "doc_id long, text string")
        assert {r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {0}
    finally:
        spark.conf.set(key, before)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = []
        for _ in range(40):
            base = rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64) if not sets or rng.random() < 0.5 else np.append(sets[rng.integers(len(sets))], rng.integers(0, 60, 2).astype(np.uint64))
            sets.append(np.unique(base))
        group = rng.integers(0, 3, 40)
        meta = np.array([ngram_join.pack(s) for s in sets])
        x, y = ngram_join.forest_pairs(group, meta, 75)
        got = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
        assert len(got) == len(x)
        for a in range(40):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if group[a] == group[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    assert frozenset((a, b)) in got


@pytest.mark.parametrize("split,seed", [(3, 5), (1024, 6)])
def test_large_blocks_match_brute_force(spark, monkeypatch, split, seed):
    """Chains of near copies in large blocks, whose ends are not alike, with dealt-out shingles and small chunks."""
    for name, value in (("SMALL_BLOCK", 3), ("CHUNK", 6), ("COMMON", 2), ("SPLIT", split), ("_SEEDS", 1), ("_MORE_SEEDS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    if split == 3:  # as with more texts than may be broadcast
        monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 1)
        monkeypatch.setattr(ngram_join, "REMEMBERED", 2)
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        text = [f"g{g}w{k}" for k in range(rng.choice([30, 60]))]
        for step in range(24):
            rows.append(" ".join(text))
            for _ in range(rng.choice([1, 1, 2])):
                text[(3 * step + g) % len(text)] = f"e{rng.randint(0, 10**6)}"
    for k in range(20):  # texts that share a passage and are otherwise their own
        rows.append(" ".join([f"p{j}" for j in range(30)] + [f"own{k}x{j}" for j in range(rng.choice([4, 6, 25]))]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, n + 1)) and got[101] == 100


def spots(text):
    def bare(w):
        edge = ".,;:!?\"'()[]{}*#$%&|<>-_/"
        for _ in range(4):
            if len(w.encode()) > 1 and w[-1] in edge:
                w = w[:-1]
            if len(w.encode()) > 1 and w[0] in edge:
                w = w[1:]
        return w

    words = [bare(w) for w in re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))]
    anchors = set(spotsigs._WORDS)
    content = [k for k, w in enumerate(words) if w not in anchors]
    out = set()
    for k, w in enumerate(words):
        after = [c for c in content if c > k][: spotsigs.CHAIN]
        if w in anchors and len(after) == spotsigs.CHAIN:
            out.add((w, *[words[c] for c in after]))
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return float(not a and not b) if not a or not b else len(a & b) / len(a | b)


def test_fingerprints(spark, odd):
    rows = sorted(((r.doc_id, r.text) for r in odd.filter("doc_id is not null and doc_id not in (106, 110, 111)").collect()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        x, y = text or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(x) // 2
        e = x[: len(x) - h] + y[:h]
        r = got[i]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(spots(x), spots(e))) < 1e-9 and abs(r.near_next - jaccard(spots(x), spots(y))) < 1e-9
    assert got[3].fingerprint == got[100].fingerprint


def test_fingerprint_cases(spark, odd, empty):
    assert spotsigs.fingerprints(odd).count() == odd.count()
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(odd.filter("doc_id = 1")).head()
    assert one.near_next == 1.0


def test_documents_without_ids_are_parted_by_their_texts(spark):
    rng = random.Random(12)
    texts = [sentence(rng, "en", 12) for _ in range(400)]
    rows = [(None, t) for t in texts[:300]] + [(7, t) for t in texts[300:]] + [(k, texts[k]) for k in range(100, 140)] + [(None, texts[0])] * 5 + [(7, texts[350])] * 5 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ordered = docs.withColumn("h", F.xxhash64("text")).collect()
    ordered.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = Counter()
    for r, following in zip(ordered, [*ordered[1:], ordered[0]]):
        want[(r.doc_id, hashlib.sha256(spotsigs.edited(r.text or "", following.text or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in spotsigs.fingerprints(docs).collect()) == want
    assert spotsigs.with_neighbours(docs).filter("doc_id is null and guest = 0").select("part").distinct().count() > 4


def test_near_documents(spark, odd):
    # the odd rows are too short for near pairs: a long text, its copy, and two with one word changed
    long = sentence(random.Random(3), "en", 300).split(" ")
    texts = [" ".join(long), " ".join(long), *[" ".join([*long[:k], "changed", *long[k + 1 :]]) for k in (50, 200)]]
    more = spark.createDataFrame([(200 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.filter("doc_id < 106").select("doc_id", "text").unionByName(more)
    got = {(r.a, r.b) for r in spotsigs.near_documents(docs).collect()}
    sets = {r.doc_id: frozenset(spots(r.text)) for r in docs.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = [i for i in sets if sets[i] and first[sets[i]] == i]
    assert got == {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.75} and got


def test_near_components(spark):
    """Near copies of texts with anchors, and rows that are linked with nothing, against a plain search."""
    rng = random.Random(11)
    rows = []
    for _ in range(8):
        words = sentence(rng, "en", rng.choice([30, 80, 200])).split(" ")
        for _ in range(rng.randint(1, 7)):
            text = list(words)
            for _ in range(rng.choice([0, 1, 2, 12])):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 99)}"
            rows.append(" ".join(text))
    rows = list(enumerate([*rows, "", None, "word", "word"])) + [(None, rows[0])]
    sets = [spots(t) if i is not None else set() for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.75 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = Counter((i, len(spots(t)), None if i is None else min(j for (j, _), h in zip(rows, group) if h == g)) for (i, t), g in zip(rows, group))
    got = spotsigs.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, got.collect())) == want and len(set(group)) < len(rows) - 5
