import random

import pytest

WORDS = {
    "en": "the of and to in that house river stone market winter under morning green paper window answer letter garden bread".split(),
    "fr": "le la et de dans que maison rivière pierre marché hiver sous matin vert papier fenêtre réponse lettre jardin pain".split(),
}
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy string, ids string, n_words string, node string, key string, part string, size string, lang_pred int, base_failed int"


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 99) if rng.random() < 0.3 else "") for _ in range(n))


def odd_rows():
    rng = random.Random(9)
    base = [sentence(rng, "en", rng.randint(20, 60)) for _ in range(20)] + [sentence(rng, "fr", rng.randint(20, 60)) for _ in range(15)]
    texts = list(enumerate(base))
    near = base[3].split(" ")
    near[2] = "changed"
    texts += [(100, base[3]), (101, " ".join(near)), (102, None), (103, ""), (104, " \t\n\x0b\x0c\r "), (105, "x" * 70_000), (106, "word " * 30_000), (107, "one two three"), (108, "12 34 !!"), (109, "ß é 漢字     😀"), (110, base[5]), (110, base[5]), (111, base[6]), (111, base[7]), (None, base[8]), (None, None)]
    langs = ["en"] * 20 + ["fr"] * 15
    rows = []
    for k, (i, t) in enumerate(texts):
        lang = langs[k] if k < 35 else None
        rows.append((i, t, lang, None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), None, "c", None, "w", None, "k", None, "z", None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, and further columns with names that operators use."""
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(k, k % 2, None, "n") for k in range(35)] + [(None, 1, 0, "n"), (5, None, 0, "n"), (1, 1, 1, "n"), (999, 0, 0, "n")], "doc_id long, quality int, toxic int, n_words string")
