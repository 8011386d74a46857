"""Language identification by a linear-chain conditional random field.  [operator 5]

Words are labelled with languages.  A word's emission sums learned weights of
hashed features: the word itself, its first and last 1 to 3 bytes, its byte
trigrams, and a lexicon feature, how often the sample has the word in each
language; between words stand learned transition weights.  Forward-backward
gives each word's label distribution in code-switched text; a document's
language has the largest sum of them over its words with letters, and the score
is its share of the sum.

Fitting takes a bounded sample: about ``SAMPLE_DOCS`` labelled documents of each
language, fewer where there are many languages so that all together are about
``SAMPLE_ALL``, or where texts are long so that all are about ``SAMPLE_BYTES``, chosen
by hashes of their ids, with their whole texts.  Their words
carry the document's language; sequences are spliced from two languages as well,
so that transitions are learned from switches.  Prediction takes every word of
every whole text.  The ``MOST_LANGUAGES`` most common languages are learned, and
others are never predicted.

Forward-backward runs over all words of a slice at once: texts are cut into
chunks, products of the chunks' transfer matrices carry the exact messages
from chunk to chunk, and then all chunks are completed side by side.  What that holds
grows with the square of the number of languages, so a slice is taken by ranges of
texts of about ``CELLS`` numbers, and a text beyond that by blocks of words: forwards
with the message into each block kept, then backwards.  The model is bounded as well:
with many languages it has fewer buckets and a lexicon of the commonest words.

Cases with a defined result
  null text       ``und`` with score 0
  no letter       ``und`` with score 0
  null lang       never learned from; predicted like any other
  null doc_id     predicted; never learned from
  nothing to learn from   ``und`` with score 0 for every text
  ties            the language that sorts first
  repeated rows   each is predicted; of rows with one doc_id the text with the least
                  hash is learned from
  very long text  all its words count, in fitting and in prediction
  empty table     an empty result
  extra columns   kept; ``lang_pred`` and ``lang_score`` are added and
                  replace columns of these names
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

SAMPLE_DOCS = 300
SAMPLE_ALL = 6000
SAMPLE_BYTES = 256 << 20
MOST_LANGUAGES = 1000
BUCKETS = 1 << 17
#: Weights of a model at most, and logarithms of its lexicon: buckets or words times languages.
TABLE_CELLS = 1 << 22
#: Numbers that are held at once for the words of a slice, about.
CELLS = 1 << 24
UNKNOWN = "und"
_AFFIX = 3
_CHUNK = 32
_SEQUENCE = 32
_U = np.uint64
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}*#$%&|<>-_/0123456789")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True


def _lower(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        after = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][after] += 32
    return out


@dataclass
class Features:
    """Hashed features of the different words of some texts.

    ``word[i]`` is the place of word i of the texts among the different words,
    ``key`` the hash of each different word, ``fixed`` its (word, affix) buckets,
    ``gram`` buckets of trigrams with ``bounds`` for each different word.
    """

    words: Words
    letters: np.ndarray
    word: np.ndarray
    key: np.ndarray
    fixed: np.ndarray
    gram: np.ndarray
    bounds: np.ndarray


def features(column: pa.Array, buckets: int = BUCKETS) -> Features:
    w = Words(column)
    w.raw = _lower(w.raw)
    letter = np.concatenate(([0], np.cumsum(_LETTER[w.raw])))
    letters = letter[w.end] > letter[w.start]
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end -= (end > start + 1) & _EDGE[w.raw[end - 1]]
        start += (end > start + 1) & _EDGE[w.raw[start]]
    key, first, word = np.unique(w.range_hash(start, end), return_index=True, return_inverse=True)
    a, b = start[first], end[first]
    fixed = [mix(key)]
    for k in range(1, _AFFIX + 1):
        fixed.append(mix(w.range_hash(a, np.minimum(a + k, b)) + _U(100 + k)))
        fixed.append(mix(w.range_hash(np.maximum(b - k, a), b) + _U(200 + k)))
    n = np.maximum(0, b - a - 2)
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - a, n)
    raw = w.raw.astype(np.uint64)
    gram = mix(raw[at] | raw[at + 1] << _U(8) | raw[at + 2] << _U(16) | _U(3 << 32)) if len(at) else np.zeros(0, np.uint64)
    place = lambda h: (h % _U(buckets)).astype(np.int64)
    return Features(w, letters, word.reshape(-1), key, place(np.stack(fixed, 1)) if len(key) else np.zeros((0, 1 + 2 * _AFFIX), np.int64), place(gram), bounds)


class Crf:
    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.buckets = BUCKETS
        while self.buckets * n > TABLE_CELLS and self.buckets > 1:
            self.buckets //= 2
        self.table = np.zeros((self.buckets, n))
        self.switch = np.zeros((n, n))
        self.lexicon_keys = np.zeros(0, np.uint64)
        self.lexicon = np.zeros((0, n))
        self.lexicon_weight = np.ones(1)
        self.bias = np.zeros(n)

    def lexicon_of(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), len(self.languages)))
        if len(self.lexicon_keys) and len(key):
            at = np.minimum(np.searchsorted(self.lexicon_keys, key), len(self.lexicon_keys) - 1)
            found = self.lexicon_keys[at] == key
            out[found] = self.lexicon[at[found]]
        return out

    def emissions(self, f: Features) -> np.ndarray:
        """(different words, languages)"""
        out = self.table[f.fixed[:, 0]]
        for k in range(1, f.fixed.shape[1]):
            out = out + self.table[f.fixed[:, k]]
        out = out + self.bias + self.lexicon_weight * self.lexicon_of(f.key)
        full = np.flatnonzero(np.diff(f.bounds))
        for some in np.array_split(full, max(1, -(-len(f.gram) * len(self.languages) // CELLS))):
            if len(some):
                a, b = f.bounds[some[0]], f.bounds[some[-1] + 1]
                out[some] += np.add.reduceat(self.table[f.gram[a:b]], f.bounds[some] - a, axis=0) / np.diff(f.bounds)[some, None]
        return out

    def potentials(self, f: Features, a: int, b: int) -> np.ndarray:
        """(words, languages) of the words a to b, over 0."""
        word = f.word[a:b]
        if b - a < len(f.word):
            different, word = np.unique(word, return_inverse=True)
            f = Features(f.words, f.letters, word, f.key[different], f.fixed[different], *_grams(f, different))
        e = self.emissions(f)
        return np.maximum(np.exp(e - e.max(1, keepdims=True)), 1e-30)[word]

    def most_words(self) -> int:
        """Words whose numbers are held at once."""
        n = len(self.languages)
        return max(1, CELLS // (16 * n + n * n // _CHUNK))

    def long_sums(self, f: Features, a: int, b: int, use: np.ndarray) -> np.ndarray:
        """The summed label distributions of those words a to b of one text that ``use`` marks, by blocks."""
        move = np.exp(self.switch - self.switch.max())
        blocks = [(k, min(k + self.most_words(), b)) for k in range(a, b, self.most_words())]

        def forward(m: np.ndarray | None, potential: np.ndarray) -> np.ndarray:
            out = np.empty_like(potential)
            for k, here in enumerate(potential):
                m = here if m is None else (m @ move) * here
                m = m / m.sum()
                out[k] = m
            return out

        into: list[np.ndarray | None] = [None]
        for low, high in blocks[:-1]:
            into.append(forward(into[-1], self.potentials(f, low, high))[-1])
        total, back = np.zeros(len(self.languages)), np.ones(len(self.languages))
        for (low, high), m in zip(reversed(blocks), reversed(into)):
            potential = self.potentials(f, low, high)
            alpha = forward(m, potential)
            for k in range(high - low - 1, -1, -1):
                if use[low - a + k]:
                    g = alpha[k] * back
                    total += g / g.sum()
                back = move @ (potential[k] * back)
                back = back / back.sum()
        return total

    def marginals(self, potential: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(label) of each word; ``potential`` (words, languages) > 0, first[r]:first[r + 1] the words of text r."""
        size, n = potential.shape
        a = np.exp(self.switch - self.switch.max())
        count = np.diff(first)
        chunks = -(-count // _CHUNK)
        top = np.concatenate(([0], np.cumsum(chunks)))
        within = np.arange(top[-1]) - np.repeat(top[:-1], chunks)
        begin = np.repeat(first[:-1], chunks) + within * _CHUNK
        length = np.minimum(_CHUNK, np.repeat(first[1:], chunks) - begin)
        opens = within == 0
        place = np.minimum(begin[:, None] + np.arange(_CHUNK), size - 1)
        valid = np.arange(_CHUNK) < length[:, None]
        # transfer matrix of each chunk
        p = np.broadcast_to(np.eye(n), (len(begin), n, n)).copy()
        for c in range(_CHUNK):
            live = np.flatnonzero(valid[:, c])
            q = p[live]
            moved = (q.reshape(-1, n) @ a).reshape(-1, n, n)
            if c == 0:
                moved[opens[live]] = q[opens[live]]
            moved *= potential[place[live, c]][:, None, :]
            p[live] = moved / moved.max(axis=(1, 2), keepdims=True)
        # messages into and out of each chunk
        fore, back = np.ones((len(begin), n)), np.ones((len(begin), n))
        for j in range(1, int(chunks.max(initial=0))):
            k = top[:-1][chunks > j] + j
            m = (fore[k - 1][:, None, :] @ p[k - 1])[:, 0]
            fore[k] = m / m.sum(1, keepdims=True)
        for j in range(int(chunks.max(initial=0)) - 1, 0, -1):
            k = top[:-1][chunks > j] + j
            m = (p[k] @ back[k][:, :, None])[:, :, 0]
            back[k - 1] = m / m.sum(1, keepdims=True)
        # all chunks side by side
        alpha = np.empty((len(begin), _CHUNK, n))
        m = fore
        for c in range(_CHUNK):
            m = np.where((opens & (c == 0))[:, None], m, m @ a) * potential[place[:, c]]
            m = m / m.sum(1, keepdims=True)
            alpha[:, c] = m
        out = np.empty((size, n))
        m = back
        for c in range(_CHUNK - 1, -1, -1):
            live = valid[:, c]
            g = alpha[:, c] * m
            out[place[live, c]] = (g / g.sum(1, keepdims=True))[live]
            s = (m * potential[place[:, c]]) @ a.T
            m = np.where(live[:, None], s / s.sum(1, keepdims=True), m)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        names, score = [UNKNOWN] * n, np.zeros(n)
        f = features(column, self.buckets)
        if not self.languages or not len(f.word):
            return names, score
        first, most = f.words.first, self.most_words()
        texts = column.to_pylist()
        with_letters = np.concatenate(([0], np.cumsum(f.letters)))[first]
        r = 0
        while r < n:
            stop = max(r + 1, int(np.searchsorted(first, first[r] + most, "right")) - 1)
            base, end = int(first[r]), int(first[stop])
            alone = end - base > most
            if not alone and end > base:
                g = self.marginals(self.potentials(f, base, end), first[r : stop + 1] - base)
            for k in range(r, stop):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    continue
                use = f.letters[a:b]
                if with_letters[k + 1] == with_letters[k]:
                    if not any(map(str.isalpha, texts[k])):
                        continue
                    use = np.ones(b - a, bool)
                elif not _has_ascii_letter(f, a, b) and not any(map(str.isalpha, texts[k])):
                    continue
                total = self.long_sums(f, a, b, use) if alone else g[a - base : b - base][use].sum(0)
                best = int(total.argmax())
                names[k], score[k] = self.languages[best], total[best] / total.sum()
            r = stop
        return names, np.minimum(score, 1.0)


def _has_ascii_letter(f: Features, a: int, b: int) -> bool:
    raw = f.words.raw[f.words.start[a] : f.words.end[b - 1]]
    return bool(((raw >= 97) & (raw <= 122)).any())


def fit(texts: list[str], langs: list[str], *, rounds: int = 4, batch: int = 256, rate: float = 0.5, seed: int = 1) -> Crf:
    names = sorted(set(langs))
    model = Crf(names)
    n = len(names)
    if n < 2:
        return model
    f = features(pa.array(texts, pa.large_string()), model.buckets)
    if not len(f.word):
        return Crf([])
    label_of_text = np.searchsorted(names, langs)
    label = np.repeat(label_of_text, f.words.count)
    # words met once say little of the language and all of the text that they are in
    met = np.bincount(f.word, minlength=len(f.key))
    often = np.flatnonzero(met > 1)
    if len(often) > TABLE_CELLS // n:
        often = np.sort(often[np.lexsort((f.key[often], -met[often]))[: TABLE_CELLS // n]])
    row = np.full(len(f.key), -1)
    row[often] = np.arange(len(often))
    listed = row[f.word] >= 0
    counts = np.zeros((len(often), n))
    np.add.at(counts, (row[f.word[listed]], label[listed]), 1)
    share = (counts + 0.5) / (np.bincount(label, minlength=n) + 0.5 * len(f.key))
    model.lexicon_keys = f.key[often]
    model.lexicon = np.log(share) - np.log(share).mean(1, keepdims=True)
    rng = np.random.default_rng(seed)
    sequences = _sequences(f, label_of_text, rng)
    gram_count = np.diff(f.bounds)
    sums = {"table": np.full((model.buckets, n), 1e-3), "switch": np.full((n, n), 1e-3), "bias": np.full(n, 1e-3), "lexicon_weight": np.full(1, 1e-3)}
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
            place = sequences[at]
            word, truth = f.word[place], label[place]
            different, where = np.unique(word, return_inverse=True)
            part = Features(f.words, f.letters, where, f.key[different], f.fixed[different], *_grams(f, different))
            e = model.emissions(part)
            scores = e[where.reshape(word.shape)]
            gamma, pairs = _expectations(scores, model.switch)
            gamma[np.arange(len(at))[:, None], np.arange(_SEQUENCE), truth] -= 1
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[:, :-1], truth[:, 1:]), 1)
            scale = 1 / gamma.shape[0] / _SEQUENCE
            g = np.zeros((len(different), n))
            np.add.at(g, where.reshape(word.shape), gamma)
            g *= scale
            table = np.zeros((model.buckets, n))
            per_gram = np.repeat(g / np.maximum(1, gram_count[different])[:, None], gram_count[different], axis=0)
            for k in range(n):
                table[:, k] = np.bincount(part.fixed.ravel(), weights=np.repeat(g[:, k], part.fixed.shape[1]), minlength=model.buckets) + np.bincount(part.gram, weights=per_gram[:, k], minlength=model.buckets)
            grads = {"table": table, "switch": (pairs - seen) * scale, "bias": g.sum(0), "lexicon_weight": np.array([(g * model.lexicon_of(part.key)).sum()])}
            for name, value in grads.items():
                sums[name] += value * value
                setattr(model, name, getattr(model, name) - rate * value / np.sqrt(sums[name]) * (0.2 if name != "lexicon_weight" else 0.05))
    model.table = model.table.astype(np.float32)
    return model


def _grams(f: Features, different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(f.bounds)[different]
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - f.bounds[:-1][different], n)
    return f.gram[at], bounds


def _sequences(f: Features, label_of_text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(sequences, _SEQUENCE) places of words: runs within a text, and as many spliced from two texts."""
    runs = []
    for r in range(len(label_of_text)):
        a, b = f.words.first[r], f.words.first[r + 1]
        if b > a:
            places = np.arange(a, b)
            if len(places) < _SEQUENCE:
                places = np.resize(places, _SEQUENCE)
            runs.append(places[: len(places) // _SEQUENCE * _SEQUENCE].reshape(-1, _SEQUENCE))
    whole = np.concatenate(runs)
    other = whole[rng.permutation(len(whole))]
    cut = rng.integers(4, _SEQUENCE - 4, len(whole))[:, None]
    spliced = np.where(np.arange(_SEQUENCE) < cut, whole, other)
    return np.concatenate([whole, spliced])


def _expectations(scores: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (sequences, length, n) and summed pair marginals (n, n)."""
    s, t, n = scores.shape
    e = np.maximum(np.exp(scores - scores.max(2, keepdims=True)), 1e-30)
    a = np.exp(switch - switch.max())
    alpha, beta = np.empty((s, t, n)), np.empty((s, t, n))
    m = e[:, 0]
    for k in range(t):
        m = e[:, 0] if k == 0 else (m @ a) * e[:, k]
        m = m / m.sum(1, keepdims=True)
        alpha[:, k] = m
    m = np.ones((s, n))
    for k in range(t - 1, -1, -1):
        beta[:, k] = m
        m = (m * e[:, k]) @ a.T
        m = m / m.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pairs = np.zeros((n, n))
    for k in range(t - 1):
        right = e[:, k + 1] * beta[:, k + 1]
        z = ((alpha[:, k] @ a) * right).sum(1, keepdims=True)
        pairs += a * ((alpha[:, k] / z).T @ right)
    return gamma, pairs


def learn(docs: DataFrame, usable: Column, *, sample_docs: int = SAMPLE_DOCS, sample_all: int = SAMPLE_ALL, sample_bytes: int = SAMPLE_BYTES) -> Crf:
    """A model from ``docs(doc_id, text, lang)`` of the rows for which ``usable`` (on doc_id) holds."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & usable)
    totals = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = totals.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return Crf([])
    sample_docs = max(2, min(sample_docs, sample_all // len(sizes)))
    sample_bytes = sample_bytes // len(sizes)
    # the share of each language's rows whose hashes give sample_docs of them, or sample_bytes, on average
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["n"], sample_bytes / max(1, r["bytes"])))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(u < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang", "text")).alias("r")
    rows = sample.groupBy("doc_id").agg(one).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """The input with ``lang_pred`` and ``lang_score``."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: buckets, languages, sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("crf")
        for batch in batches:
            for part in slices(batch):
                names, score = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
