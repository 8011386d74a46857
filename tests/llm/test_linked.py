"""op9 verifies few of the pairs that lie between the same two components."""

import random

from pyspark.sql import functions as F

from docloom.llm import ngram_join


def test_few_pairs_of_near_copies_are_verified(spark, monkeypatch):
    rng = random.Random(5)
    words, texts = [f"w{k}" for k in range(300)], []
    for _ in range(150):  # a chain of texts, each near to those of some steps before and behind
        texts.append(" ".join(words))
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    for name, value in (("SMALL_BLOCK", 200), ("FEW_PAIRS", 20)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    looked_at = []
    verified = ngram_join.verified

    def counted(pairs, *args):
        looked_at.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(k for k, h in enumerate(group) if h == g) for g in set(group)}
    assert got == {k: least[g] for k, g in enumerate(group)}
    assert sum(looked_at[1:]) < len(texts), looked_at  # the first are one of each text


def test_components_with_several_pairs_between_them(spark, monkeypatch):
    """A link among the pairs that were not verified first is found; of two components without one every pair is looked at."""
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    near = " ".join(f"w{k}" for k in range(60))
    texts = {**{k: f"a{k} " + " ".join(f"x{k}x{j}" for j in range(20)) for k in range(30)}, **{k: f"b{k} " + " ".join(f"y{k}y{j}" for j in range(20)) for k in range(30, 60)}}
    texts |= {17: near, 44: near + " end"}
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    roots = spark.createDataFrame([(k, 0 if k < 30 else 30) for k in texts] + [(60, 60), (61, 60)], "node long, root long")
    pairs = ngram_join.materialize(spark.createDataFrame([(a, b) for a in range(30) for b in range(30, 60)], "a long, b long"), "pairs")
    got = ngram_join.linked(pairs, roots, rows, 75, ngram_join.shingles_of)
    assert {r.root for r in got.filter(F.col("node") < 60).collect()} == {0} and {r.root for r in got.filter("node >= 60").collect()} == {60}
