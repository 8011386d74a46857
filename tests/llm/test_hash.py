"""Words are told apart: no operator takes two texts for one because of a hash."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import bpe, ngram_join, queries, spotsigs, tokenfiles, wordarrays


def thue_morse(n, complement=False):
    return "".join("ab"[(bin(k).count("1") + complement) % 2] for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, True)) for n in (1024, 2048)]


def test_hashes_follow_the_bytes():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)} | {w for p in PAIRS for w in p} | {"a", "a\0", "a\0\0"})
    for before in ("", "x", "four ", "12345678"):  # at any place
        w = wordarrays.Words(pa.array([before + " " + " ".join(words)]))
        h = w.hashes()[-len(words) :]
        assert len(set(h.tolist())) == len(words)
        if before == "":
            first = h
        assert (h == first).all()
    low = wordarrays.Words(pa.array(["ABCdef ÀB"]), lower=True).hashes()
    assert (low == wordarrays.Words(pa.array(["abcdef", "Àb"])).hashes()).all()


def test_same_bytes():
    rng = random.Random(2)
    a, b = (np.frombuffer("".join(rng.choice("ab") for _ in range(4000)).encode(), np.uint8).copy() for _ in range(2))
    b[1000:3000] = a[1000:3000]
    x, n = np.array([rng.randrange(900, 3100) for _ in range(500)]), np.array([rng.choice([0, 1, 7, 8, 9, 64, 65, 300]) for _ in range(500)])
    got = wordarrays.same_bytes(wordarrays.aligned(a), x, wordarrays.aligned(b), x, n)
    assert got.tolist() == [a[i : i + k].tobytes() == b[i : i + k].tobytes() for i, k in zip(x, n)] and 50 < got.sum() < 490


def test_words_of_one_hash_have_their_own_ids(monkeypatch):
    hashes = wordarrays.Words.hashes
    monkeypatch.setattr(wordarrays.Words, "hashes", lambda self: hashes(self) & np.uint64(15))
    coder = bpe.Coder(queries.tokenizer_file())
    rng = random.Random(3)
    for _ in range(3):
        texts = [" ".join(rng.choice(["the", "house", "Ünder", "x" * 3000, "don't", "1a2", "漢字"]) + str(rng.randrange(9)) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""]
        assert coder.encode_column(pa.array(texts)).to_pylist() == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_table_of_few_bytes_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 500)
    coder = bpe.Coder(queries.tokenizer_file())
    rng = random.Random(4)
    for _ in range(6):
        texts = [" ".join(rng.choice("abcd") * rng.randint(1, 40) for _ in range(40)) for _ in range(10)]
        assert coder.encode_column(pa.array(texts)).to_pylist() == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder._table.at[coder._table.n] < 20_000


@pytest.mark.parametrize("parts", [1, 4])
def test_colliding_words_in_operators(spark, tmp_path, parts):
    rows = []
    for n, pair in enumerate(PAIRS):
        for k, w in enumerate(pair):
            rows += [(10 * n + k, w), (100 + 10 * n + k, f"{w} and then the same four the {w} a {w} of is {w}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    texts, library = dict(rows), bpe.coder(queries.tokenizer_file()).tokenizer
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: list(r.ids) for r in bpe.encode_documents(df, queries.tokenizer_file()).collect()} == ids
    folder = f"file://{tmp_path}/t{parts}"
    read = tokenfiles.read_token_files(tokenfiles.write_token_files(df, folder, queries.tokenizer_file()), folder)
    assert {r.doc_id: r.ids_crc32 for r in read.collect()} == {i: zlib.crc32(np.array([*v, 1], "<u4").tobytes()) for i, v in ids.items()}
    joined = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert joined == {i: i for i in texts}
    prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(df).collect()}
    assert len(set(prints.values())) == len(rows)
    near = spotsigs.near_components(df).collect()
    assert {r.doc_id: r.component_id for r in near} == {i: i for i in texts}
