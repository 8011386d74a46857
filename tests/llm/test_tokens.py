import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import bpe, queries, tokenfiles


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(queries.tokenizer_file())


ALPHABETS = ["ab", "a", "the er in on abcdefgh", "é a'sÉ<|endoftext|>!!", "xyz'st.,!?12 ", "́e \x1c\x85a", "漢字 かな", "!'s'S##"]


def whole(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [3, 11, 50])
def test_tree_equals_whole(coder, leaf):
    rng = random.Random(leaf)
    for _ in range(250):
        letters = rng.choice(ALPHABETS)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        e = coder.encode_tree(text, leaf)
        assert e.ids.tolist() == whole(coder, text), text


def test_words_equal_whole(coder):
    rng = random.Random(1)
    texts = ["".join(rng.choice("".join(ALPHABETS) + "\n\t ²½ßÀ") for _ in range(rng.randint(0, 200))) for _ in range(300)] + [None, "", "a" * 9000, "<|startoftext|>x"]
    ids = coder.encode_column(pa.array(texts))
    assert ids.to_pylist() == [whole(coder, t) for t in texts]
    assert coder.decode_column(ids).to_pylist() == coder.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False)


def test_long_texts_are_split(spark, coder, odd):
    got = bpe.encode_documents(odd, queries.tokenizer_file(), split_chars=100)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) | {"decoded"} == set(got.columns)
    assert all(list(r.ids) == whole(coder, r.text) for r in rows)
    assert all(r.decoded == coder.tokenizer.decode(list(r.ids), skip_special_tokens=False) for r in rows)


def test_segments_are_joined_in_groups(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "FAN", 3)
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ALPHABETS for n in (699, 700, 2101)]
    rows = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    got = bpe.encode_documents(rows, queries.tokenizer_file(), split_chars=70).collect()
    assert len(got) == len(texts) + 1
    assert all(list(r.ids) == whole(coder, r.text) for r in got)


def test_digests(spark, coder):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, None)], "doc_id long, text string")
    for r in queries.digests(bpe.encode_documents(df, queries.tokenizer_file())).collect():
        ids = whole(coder, {1: "Hello hello world", 2: ""}[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_empty_table(spark, empty):
    assert bpe.encode_documents(empty, queries.tokenizer_file()).count() == 0


def test_files(spark, coder, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfiles.write_token_files(odd, folder, queries.tokenizer_file())
    got = tokenfiles.read_token_files(manifest, folder).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    start = 0
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(zlib.crc32(np.array([*whole(coder, r.text), 1], "<u4").tobytes()))
    for r in order:
        assert r.start == start and r.ids_crc32 in texts[r.doc_id]
        start += r.n_tokens
    parts = manifest.collect()
    assert sum(p.n_tokens for p in parts) == start and all(p.item_bytes == 2 for p in parts)
    flat = b"".join(open(f"{tmp_path}/tokens/part-{p.part}.bin", "rb").read() for p in sorted(parts, key=lambda p: p.part))
    assert len(flat) == 2 * start
    none = tokenfiles.write_token_files(empty, f"{folder}-none", queries.tokenizer_file())
    assert tokenfiles.read_token_files(none, f"{folder}-none").count() == 0
