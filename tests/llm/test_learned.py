import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import crf, passages

from .conftest import sentence


def noisy(rng, k):
    text = sentence(rng, "en", rng.randint(15, 90))
    return text.upper() + " !! ###" if k % 4 == 0 else text


def test_quality_held_out(spark):
    import random

    rng = random.Random(4)
    docs = spark.createDataFrame([(k, noisy(rng, k)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)], "doc_id long, quality int")
    model = passages.learn(docs, labels, F.col("doc_id") < 300)
    got = passages.score(docs.filter("doc_id >= 300"), model).collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 != 0) for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    x = passages.passages(pa.array(["a b c " * 30, "DEF ! # " * 50, "", "q"]))
    y = np.array([1, 0, 1, 0], np.float32)
    model = passages.Model(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        z = model.forward(x)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = model.gradients(x, y)
    for name in "WXbVUwcd":
        p = model.p[name].reshape(-1)
        k = int(rng.integers(len(p)))
        p[k] += 1e-5
        up = loss()
        p[k] -= 2e-5
        down = loss()
        p[k] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[k]) < 1e-4, name


def test_passages_cover_whole_texts():
    x = passages.passages(pa.array(["w " * 100, None, "a b"]))
    assert np.diff(x.docs).tolist() == [3, 1, 1] and np.diff(x.words).tolist() == [40, 40, 20, 0, 2]


def test_quality_cases(spark, odd, empty, marks):
    model = passages.learn(odd, marks, F.lit(True))
    out = passages.score(odd, model)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert sorted(out.columns) == sorted(odd.columns)
    assert passages.score(empty, model).count() == 0
    one = passages.score(odd, passages.learn(odd, marks.filter("quality = 0"), F.lit(True)))
    assert {r.score for r in one.collect()} == {0.0}
    assert {r.score for r in passages.score(odd, passages.learn(empty, marks, F.lit(True))).collect()} == {1.0}


def test_forward_backward_matches_plain():
    model = crf.Crf(["a", "b", "c"])
    rng = np.random.default_rng(0)
    model.switch = rng.normal(size=(3, 3))
    first = np.array([0, 70, 70, 71, 200])
    pot = rng.random((200, 3)) + 0.01
    got = model.marginals(pot, first)
    a = np.exp(model.switch)
    for s, e in zip(first[:-1], first[1:]):
        fore, back = [], [np.ones(3)]
        for k in range(s, e):
            v = pot[k] if k == s else (fore[-1] @ a) * pot[k]
            fore.append(v / v.sum())
        for k in range(e - 1, s, -1):
            back.append(a @ (pot[k] * back[-1]))
            back[-1] = back[-1] / back[-1].sum()
        if e > s:
            q = np.array(fore) * np.array(back[::-1])
            assert np.allclose(got[s:e], q / q.sum(1, keepdims=True))


def test_language_held_out_and_switches(spark):
    import random

    rng = random.Random(6)
    docs = [(k, sentence(rng, "fr" if k % 3 == 0 else "en", rng.randint(5, 60)), "fr" if k % 3 == 0 else "en") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = crf.learn(df, F.col("doc_id") < 200)
    got = crf.predict(df.filter("doc_id >= 200"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert model.languages == ["en", "fr"] and np.diag(model.switch).min() > model.switch[0, 1]
    mixed = sentence(rng, "en", 30) + " " + sentence(rng, "fr", 30)
    f = crf.features(pa.array([mixed]))
    e = model.emissions(f)[f.word]
    g = model.marginals(np.exp(e - e.max(1, keepdims=True)), f.words.first)
    assert g[:25, 0].mean() > 0.9 and g[35:, 1].mean() > 0.9


def test_language_cases(spark, odd, empty):
    model = crf.learn(odd, F.lit(True))
    out = crf.predict(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.lang_score <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {102, 103, 104, 108} <= und and 109 not in und and 105 not in und
    assert crf.predict(empty, model).count() == 0
    assert {r.lang_pred for r in crf.predict(odd, crf.learn(empty, F.lit(True))).collect()} == {"und"}


def test_sample_is_one_text_for_each_id(spark):
    """Repeated doc_ids give the text with the least hash, whatever the order of rows."""
    rows = [(1, "good words here", "en"), (1, "AND THESE !!", "en"), (2, "mauvais mots", "fr"), (2, "mauvais mots", "fr"), (3, "x " * 5000, "en")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    a, b = (spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, rows[::-1]))
    x, y = (passages.learn(d.repartition(2), labels, F.lit(True)) for d in (a, b))
    assert all(np.array_equal(x.p[k], y.p[k]) for k in x.p)
    x, y = (crf.learn(d.repartition(2), F.lit(True)) for d in (a, b))
    assert np.array_equal(x.table, y.table) and x.languages == ["en", "fr"]


def test_all_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"  # digits at a word's edge are no part of it
    word = lambda k: 3 * letters[k // 26] + 3 * letters[k % 26]
    docs = spark.createDataFrame([(k, f"{word(k % 80)} " * 12, f"l{k % 80:02d}") for k in range(400)], "doc_id long, text string, lang string")
    model = crf.learn(docs, F.lit(True))
    assert len(model.languages) == 80
    got = crf.predict(docs, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_attention_matches_plain():
    """The score of each text against loops over its passages and words."""
    texts = ["Alpha beta. " * 45, "one two three", "", "x! " * 130]
    model = passages.Model(5)
    rng = np.random.default_rng(2)
    model.mean, model.scale = rng.normal(size=passages._SHAPE).astype(np.float32), rng.random(passages._SHAPE).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for text, score in zip(texts, model.scores(pa.array(texts))):
        x = passages.passages(pa.array([text]))
        words = text.split()
        n = max(1, -(-len(words) // passages.PASSAGE_WORDS))
        assert len(x.shape) == n and x.words[-1] == len(words)
        hidden, raw = [], []
        for k in range(n):
            buckets = x.bucket[k * passages.PASSAGE_WORDS : (k + 1) * passages.PASSAGE_WORDS]
            mean = sum((p["E"][b] for b in buckets), np.zeros(passages._VECTOR)) / max(1, len(buckets))
            h = np.tanh((x.shape[k] - model.mean) * model.scale @ p["W"] + mean @ p["X"] + p["b"])
            hidden.append(h)
            raw.append(float(p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))))
        weights = np.exp(raw) / np.exp(raw).sum()
        z = sum(a * h for a, h in zip(weights, hidden))
        assert abs(score - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-4


def test_document_language_matches_all_labellings():
    """The winning language and its share against a sum over every labelling of the words."""
    from itertools import product

    model = crf.fit(["the house and the river", "la maison et la pierre", "das haus und der stein"] * 4, ["en", "fr", "de"] * 4)
    model.switch = np.array([[0.5, -0.2, 0.1], [0.0, 0.7, -0.4], [0.3, -0.1, 0.2]])
    texts = ["the maison und 12", "la la stein", "x", "12 the !! haus river"]
    names, scores = model.predict(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        f = crf.features(pa.array([text]))
        e = model.emissions(f)[f.word]
        total = np.zeros(3)
        for labels in product(range(3), repeat=len(e)):
            weight = np.exp(sum(e[k, j] for k, j in enumerate(labels)) + sum(model.switch[a, b] for a, b in zip(labels, labels[1:])))
            for k, j in enumerate(labels):
                total[j] += weight * any(map(str.isalpha, text.split()[k]))
        share = np.array(total) / total.sum()
        assert name == model.languages[int(share.argmax())] and abs(score - share.max()) < 1e-6


def test_blocks_and_ranges_give_the_same_languages(spark, monkeypatch):
    """Texts taken by ranges, and long ones by blocks of words, against all at once."""
    import random

    rng = random.Random(3)
    texts = [sentence(rng, lang, n) for lang in ("en", "fr") for n in (3, 40, 400, 90)] + [None, "", "12 !", sentence(rng, "en", 50) + " " + sentence(rng, "fr", 300)]
    model = crf.fit(texts[:4] * 3 + texts[4:8] * 3, ["en"] * 12 + ["fr"] * 12)
    names, scores = model.predict(pa.array(texts))
    for cells in (1, 700, 3000, 9000):
        monkeypatch.setattr(crf, "CELLS", cells)
        again, other = model.predict(pa.array(texts))
        assert again == names and np.allclose(other, scores, atol=1e-9)


def test_many_languages_are_bounded(spark, monkeypatch):
    """A model of 300 languages keeps its bounds, still tells them apart, and predicts long texts in bounded memory."""
    import tracemalloc

    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: 3 * letters[k // 26] + 3 * letters[k % 26]
    texts = [f"{word(k % 300)} " * 12 for k in range(900)]
    model = crf.fit(texts, [f"l{k % 300:03d}" for k in range(900)], rounds=2)
    assert model.table.size <= crf.TABLE_CELLS and model.lexicon.size <= crf.TABLE_CELLS
    monkeypatch.setattr(crf, "CELLS", 1 << 20)
    tracemalloc.start()
    names, _ = model.predict(pa.array([*texts[:300], f"{word(7)} " * 5000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.mean([a == f"l{k:03d}" for k, a in enumerate(names[:300])]) > 0.9 and names[300] == "l007"
    assert peak < 16 * 8 * crf.CELLS


def test_the_commonest_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(crf, "MOST_LANGUAGES", 2)
    rows = [(k, "the house and the river" if k % 5 else "la maison et la rivière", "en" if k % 5 else "fr") for k in range(50)] + [(99, "das haus und der fluss", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.learn(docs, F.lit(True))
    assert model.languages == ["en", "fr"] and crf.predict(docs, model).filter("lang_pred = 'de'").count() == 0
