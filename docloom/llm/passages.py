"""Quality classifier by attention-based multiple-instance learning.  [operator 2]

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded: shape statistics and the mean of learned vectors of its hashed words go
through one hidden layer.  Gated attention weighs the passages,
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), and a logistic unit scores the
weighted sum of the passages' representations.  All of it is learned together,
from document labels alone.

Fitting takes a bounded sample: the ``SAMPLE_DOCS`` labelled documents with the
least hashes of their ids, each with all its passages.  Scoring takes every
passage of every whole text.

Cases with a defined result
  null text       scored like an empty text: one passage without words
  null doc_id     scored; never learned from
  repeated rows   each is scored; of rows with one doc_id the text with the least
                  hash, and of its labels the least, are learned from
  very long text  all its passages count, in fitting and in scoring
  ties            a score of exactly 0.3 or more is label 1
  no labels, or labels of one kind: every score is the share of label 1 (1 if none)
  empty table     an empty result
  extra columns   kept; ``score`` is added and replaces a column of this name
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import begin_task
from .wordarrays import Words, mix, slices

PASSAGE_WORDS = 40
SAMPLE_DOCS = 5000
BUCKETS = 1 << 12
_VECTOR, _HIDDEN, _ATTENTION = 16, 24, 12
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&|<>", "stop": b".,;:", "loud": b"!?", "rest": b"\"'()[]{}@/\\=+-_~^`", "line": b"\n", "wide": bytes(range(128, 256)),
}
_SHAPE = len(_CLASSES) + 6


@dataclass
class Passages:
    """Passages of some texts: shape (n, _SHAPE), buckets of words, bounds of each
    passage's words, and bounds of each text's passages (one each, at least)."""

    shape: np.ndarray
    bucket: np.ndarray
    words: np.ndarray
    docs: np.ndarray


_byte_class = np.zeros((len(_CLASSES), 256), np.float32)
for _k, _members in enumerate(_CLASSES.values()):
    _byte_class[_k, list(_members)] = 1


def passages(column: pa.Array) -> Passages:
    words = Words(column)
    n = np.maximum(1, -(-words.count // PASSAGE_WORDS))
    docs = np.concatenate(([0], np.cumsum(n)))
    within = np.arange(docs[-1]) - np.repeat(docs[:-1], n)
    first = np.repeat(words.first[:-1], n) + within * PASSAGE_WORDS
    last = np.minimum(first + PASSAGE_WORDS, np.repeat(words.first[1:], n))
    bounds = np.append(first, last[-1] if len(last) else 0)
    size = np.maximum(1, last - first).astype(np.float32)
    shape = np.zeros((docs[-1], _SHAPE), np.float32)
    has = np.flatnonzero(last > first)
    if len(has):
        a, b = words.start[first[has]], words.end[last[has] - 1]
        length = (b - a).astype(np.float32)
        for k in range(len(_CLASSES)):
            sums = np.concatenate(([0], np.cumsum(_byte_class[k][words.raw], dtype=np.float32 if len(words.raw) < 1 << 23 else np.float64)))
            shape[has, k] = (sums[b] - sums[a]) / length
        lengths = np.concatenate(([0], np.cumsum(words.end - words.start)))
        shape[has, len(_CLASSES)] = (lengths[last[has]] - lengths[first[has]]) / size[has] / 10
        h = words.hashes()
        of = np.repeat(np.arange(docs[-1]), last - first)
        # words met before in the passage, and pairs of words met elsewhere in the text
        shape[:, len(_CLASSES) + 1] = _again(mix(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), of, docs[-1], True) / size
        doc = words.doc.astype(np.uint64)
        pair = mix(h[:-1] * np.uint64(3) + mix(h[1:]) + mix(doc[:-1] + np.uint64(1))) if len(h) > 1 else h[:0]
        pair = pair[words.doc[1:] == words.doc[:-1]] if len(h) > 1 else pair
        of_pair = of[:-1][words.doc[1:] == words.doc[:-1]] if len(h) > 1 else of[:0]
        shape[:, len(_CLASSES) + 2] = _again(pair, of_pair, docs[-1], False) / size
    else:
        h = words.hashes()
    shape[:, len(_CLASSES) + 3] = np.log1p(last - first) / 4
    shape[:, len(_CLASSES) + 4] = np.log1p(np.repeat(words.count, n)) / 8
    shape[:, len(_CLASSES) + 5] = last == first
    return Passages(shape, (h % np.uint64(BUCKETS)).astype(np.int64), bounds, docs)


def _again(values: np.ndarray, of: np.ndarray, n: int, but_first: bool) -> np.ndarray:
    """For each passage, how many of its values occur twice or more (but for each value's first place)."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = v[1:] == v[:-1]
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    if not but_first:
        twice[:-1] |= same
    return np.bincount(of[order[twice]], minlength=n).astype(np.float32)


class Model:
    """The parameters and the network."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.constant: float | None = None
        self.mean = np.zeros(_SHAPE, np.float32)
        self.scale = np.ones(_SHAPE, np.float32)
        self.p = {
            "E": (rng.normal(size=(BUCKETS, _VECTOR)) * 0.1).astype(np.float32),
            "W": make(_SHAPE, _HIDDEN), "X": make(_VECTOR, _HIDDEN), "b": np.zeros(_HIDDEN, np.float32),
            "V": make(_HIDDEN, _ATTENTION), "U": make(_HIDDEN, _ATTENTION), "w": make(_ATTENTION, 1)[:, 0],
            "c": make(_HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32),
        }

    def forward(self, x: Passages) -> dict[str, np.ndarray]:
        p = self.p
        n = np.diff(x.words)
        vectors = np.zeros((len(x.shape), _VECTOR), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            vectors[full] = np.add.reduceat(p["E"][x.bucket], x.words[:-1][full], axis=0) / n[full, None]
        shape = (x.shape - self.mean) * self.scale
        h = np.tanh(shape @ p["W"] + vectors @ p["X"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * s) @ p["w"]
        at, count = x.docs[:-1], np.diff(x.docs)
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, at), count))
        a = e / np.repeat(np.add.reduceat(e, at), count)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"vectors": vectors, "shape": shape, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return 1 / (1 + np.exp(-self.forward(passages(column))["logit"].astype(np.float64)))

    def gradients(self, x: Passages, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x)
        count = np.diff(x.docs)
        up = ((1 / (1 + np.exp(-f["logit"])) - y) / len(y)).astype(np.float32)
        dz = np.repeat(up, count)[:, None] * p["c"]
        h, a, t, s = f["h"], f["a"], f["t"], f["s"]
        da = (dz * h).sum(1)
        draw = a * (da - np.repeat(np.add.reduceat(a * da, x.docs[:-1]), count))
        dg = draw[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        n = np.diff(x.words)
        dv = np.repeat((du @ p["X"].T) / np.maximum(1, n)[:, None], n, axis=0)
        de = np.stack([np.bincount(x.bucket, weights=dv[:, k], minlength=BUCKETS) for k in range(_VECTOR)], 1)
        return {
            "E": de.astype(np.float32), "W": f["shape"].T @ du, "X": f["vectors"].T @ du, "b": du.sum(0),
            "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ draw, "c": f["z"].T @ up, "d": up.sum(keepdims=True),
        }


def _take(x: Passages, rows: np.ndarray) -> Passages:
    """The bags of some documents."""
    chosen = np.concatenate([np.arange(x.docs[r], x.docs[r + 1]) for r in rows])
    n = np.diff(x.words)[chosen]
    words = np.concatenate([np.arange(x.words[k], x.words[k + 1]) for k in chosen])
    return Passages(x.shape[chosen], x.bucket[words], np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(np.diff(x.docs)[rows]))))


def fit(bags: Passages, labels: np.ndarray, *, steps: int = 300, rate: float = 0.01, seed: int = 1) -> Model:
    model = Model(seed)
    if len(labels) == 0 or labels.min() == labels.max():
        model.constant = float(labels.mean()) if len(labels) else 1.0
        return model
    model.mean, deviation = bags.shape.mean(0), bags.shape.std(0)
    model.scale = (1 / np.maximum(deviation, 1e-3)).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    # small samples: smaller batches and more rounds, so that as many steps are made
    batch = int(np.clip(len(labels) // 12, 16, 200))
    epochs = max(8, -(-steps * batch // len(labels)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows, step = order[at : at + batch], step + 1
            for k, g in model.gradients(_take(bags, rows), labels[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                size = rate * (1 - 0.9 * epoch / epochs)
                model.p[k] -= (size * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + 1e-5 * model.p[k]).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, *, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from ``labels(doc_id, quality)`` of the rows for which ``usable`` (on doc_id) holds."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_docs rows at most
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    rows = rows.groupBy("doc_id").agg(text.alias("text"), F.min("quality").cast("int").alias("quality"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("passages")
        for batch in batches:
            for part in slices(batch):
                x = passages(part.column("text"))
                for r in range(part.num_rows):
                    k = np.arange(x.docs[r], x.docs[r + 1])
                    n = np.diff(x.words)[k]
                    bucket = np.concatenate([x.bucket[x.words[i] : x.words[i + 1]] for i in k])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id").slice(r, 1), "quality": part.column("quality").slice(r, 1),
                        "shape": [x.shape[k].tobytes()], "bucket": [bucket.astype("<u2").tobytes()], "n": [n.astype("<i4").tobytes()],
                    })

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality")
    got = rows.mapInArrow(bags, "doc_id long, quality int, shape binary, bucket binary, n binary").toArrow().to_pandas().sort_values("doc_id")
    if not len(got):
        return fit(Passages(np.zeros((0, _SHAPE), np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)), np.zeros(0))
    n = [np.frombuffer(b, "<i4") for b in got["n"]]
    x = Passages(
        np.concatenate([np.frombuffer(b, np.float32).reshape(-1, _SHAPE) for b in got["shape"]]),
        np.concatenate([np.frombuffer(b, "<u2").astype(np.int64) for b in got["bucket"]]),
        np.concatenate(([0], np.cumsum(np.concatenate(n)))),
        np.concatenate(([0], np.cumsum([len(k) for k in n]))),
    )
    return fit(x, (got["quality"].to_numpy() == 1).astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The input with ``score``, the likelihood of label 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("passages")
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column("text")))], [*part.schema.names, "score"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
