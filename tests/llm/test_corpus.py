import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docloom.llm import mixing, queries, sharding, sitestyle

from ..conftest import SF, same_rows
from .conftest import sentence
from .test_joins import shingles


def test_mixing_against_sql(spark, duck):
    same_rows(queries.op7_mixing(spark, SF), duck, queries.ORACLES["op7_mixing"])


def test_mixing_means(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 84).alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    got = {r.source: r.n for r in mixing.mix_sources(docs, {"a": 3, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 3000) < 5 * math.sqrt(3000) and abs(got["b"] - 1000) < 5 * math.sqrt(1000)
    counts = Counter(r.n for r in mixing.mix_sources(docs.limit(1000), {"a": 1}, target_size=100.0 * 20_000).groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert abs(sum(k * n for k, n in counts.items()) / 1000 - 20) < 0.8


def test_mixing_cases(spark, odd, empty):
    out = mixing.mix_sources(odd)
    assert set(out.columns) == set(odd.columns) | {"order_key"} and out.count() > 0
    keys = [r.order_key for r in out.select("order_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mix_sources(odd, {"nothing": 1.0}).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    same = mixing.mix_sources(odd, temperature=1.0).filter("doc_id = 110").count()
    assert same % 2 == 0


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    return max(sizes) - min(sizes), max(r["size"] for r in rows)


def test_sharding_balances(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "same text " * 20 if k % 3 == 0 else "w " * int(rng.lognormal(4, 1))) for k in range(3000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    spread, largest = check_shards(out, 10)
    assert len(out) == 3000 and spread <= largest
    assert sum(r["size"] for r in out) == sum(len(t.encode()) + 16 for _, t in rows)
    n = Counter(r.shard for r in out)
    assert max(n.values()) < 1.5 * min(n.values())


def test_groups_under_a_share_lie_in_one_shard(spark):
    """1,000 copies of a text (0.4 of a share), two of a long one; only a group over a share is split, into few pieces."""
    rng = np.random.default_rng(4)
    texts = ["a" * 984] * 1000 + ["b" * 60_000] * 2 + ["c" * 984] * 4000
    texts += [f"{k} " + "w " * int(rng.lognormal(5, 1)) for k in range(40_000)]
    share = sum(len(t) + 16 for t in texts) / 8
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    spread, largest = check_shards(out, 8)
    assert len(out) == len(texts) and spread <= largest
    shards = [{r.shard for r in out if texts[r.doc_id][0] == c and len(texts[r.doc_id]) > 900 and texts[r.doc_id][1] == c} for c in "abc"]
    assert 1000 * 1000 < share < 4000 * 1000
    assert len(shards[0]) == 1 and len(shards[1]) == 1 and 2 <= len(shards[2]) <= 4 * 4000 * 1000 / share + 1


def test_sharding_cases(spark, odd, empty):
    out = sharding.shard_documents(odd, 4).collect()
    check_shards(out, 4)
    assert len(out) == odd.count() and {r.law for r in out} == {"bytes"}
    assert all(r["size"] == 16 and r.text_crc32 == 0 for r in out if r.doc_id in (102, 103))
    assert sharding.shard_documents(empty).count() == 0


def test_placing_prefers_the_dot_product():
    got = sharding.place(np.array([[9.0, 1, 1], [8, 8, 1], [1, 1, 9], [2, 2, 2]]), 2)
    assert sorted(got.tolist()).count(0) == 2
    assert sharding.place(np.zeros((0, 3)), 3).tolist() == []


def test_placing_matches_plain():
    """Each item, largest first, goes where its dot product with what is left is highest."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(1, 100, (60, 3)).astype(float)
    got = sharding.place(vectors, 5)
    share = vectors / vectors.sum(0) * 5
    left = [[1.0] * 3 for _ in range(5)]
    for i in sorted(range(60), key=lambda i: (-share[i][0], -share[i].sum(), i)):
        fits = [s for s in range(5) if left[s][0] >= share[i][0]]
        if fits:
            best = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(left[s], share[i])), 12), -s))
        else:
            best = max(range(5), key=lambda s: (left[s][0], -s))
        assert got[i] == best
        left[best] = [a - b for a, b in zip(left[best], share[i])]


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="top menu">m</div>
<article><h1>T &amp; &eacute;</h1><p>a\n  b<b>c</b><br>d<p>e<ul><li>1<li>2</ul><div class="comments"><p>bad</div><form><p>x</p></form></article>
<script>var t="</p>";</script><!-- no --><aside>s</aside><footer>f</footer>"""


def test_page():
    assert sitestyle.Page(PAGE).main_text() == "T & é\na bc d\ne\n1\n2"
    assert sitestyle.Page("<p>x</div></b>y<p>z").main_text() == "xy\nz"
    assert sitestyle.Page("").main_text() == "" and sitestyle.Page("a < b &lt;").main_text() == "a < b <"


def test_low_importance_branches_go(spark):
    """Without roles in names, what a host repeats is found by entropy."""
    rows = [(k, f"http://h.example/{k}", f"<body><div class='x1'><p>Same slogan {k % 2}</div><div class='x2'><p>Own text number {k} of many</div></body>") for k in range(40)]
    rows += [(100 + k, "http://small.example/", "<body><div class='x1'><p>Kept</div></body>") for k in range(3)]
    out = {r.page_id: r.text for r in sitestyle.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"Own text number {k} of many" for k in range(40)) and out[100] == "Kept"


def test_one_article_copied_stays(spark):
    rows = [(k, "http://h.example/", "<body><nav>n</nav><article><h1>T</h1><p>The same article</article></body>") for k in range(30)]
    out = sitestyle.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"T\nThe same article"}


def test_copied_pages_without_article_keep_their_text(spark):
    """Copies of a page count once, and four pages with three blocks each are not twelve pages."""
    five = "".join(f"<p>Paragraph {k} of the page" for k in range(5))
    rows = [(k, "http://copies.example/", f"<body><div>{five}</div></body>") for k in range(30)]
    rows += [(100 + k, "http://block.example/", "<body><div>One block</div></body>") for k in range(30)]
    rows += [(200 + k, "http://four.example/", f"<body><div><p>Alpha<p>Beta<p>Gamma</div><h2>{k}</h2></body>") for k in range(4)]
    out = {r.page_id: r.text for r in sitestyle.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == "\n".join(f"Paragraph {j} of the page" for j in range(5)) and out[100 + k] == "One block" for k in range(30))
    assert all(out[200 + k] == f"Alpha\nBeta\nGamma\n{k}" for k in range(4))


def test_tree_decides_inside_and_outside_articles(spark):
    """What different articles repeat goes, plain or not; what is a page's own stays beside the article; near copies of an article stay."""
    own = "An article about thing {0} and a further {0} of them."
    rows = [(k, "http://h.example/", f"<body><div>Slogan of the site</div><article><h1>Title {k}</h1><h2>Share this</h2><p>{own.format(k)}<p>Read more about us here</article><section>Own addition {k}</section></body>") for k in range(30)]
    rows += [(100 + k, "http://near.example/", f"<body><article><h1>T</h1><p>The same article with many words in it<p>Copy {k}</article></body>") for k in range(30)]
    rows += [(200 + k, "http://few.example/", f"<body><div>Top {k}</div><article><p>Few {k}<p>The same</article></body>") for k in range(3)]
    out = {r.page_id: r.text for r in sitestyle.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"Title {k}\n{own.format(k)}\nOwn addition {k}" for k in range(30))
    assert all(out[100 + k] == f"T\nThe same article with many words in it\nCopy {k}" for k in range(30))
    assert all(out[200 + k] == f"Few {k}\nThe same" for k in range(3))


def test_page_cases(spark):
    rows = [(1, None, None, "z"), (2, "", "", "z"), (None, "x", "<p>a", None), (4, "http://a.b", "<p>" + "w " * 200_000, "z"), (5, "u", "<" * 1000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in sitestyle.extract_main_text(df).collect()}
    assert len(out) == 5 and out[1].text == "" and out[1].n_chars == 0 and out[None].text == "a" and out[4].n_chars == 399_999
    assert sitestyle.extract_main_text(df.limit(0)).count() == 0


def test_pipeline_stages(spark, odd, empty):
    docs = odd
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
        assert stage(spark, empty, SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == docs.count() and last(spark, empty, SF).count() == 0


def test_near_duplicates_leave_one(spark, odd):
    kept = [r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, odd, SF).collect()]
    assert 3 in kept and 100 not in kept and 101 not in kept and kept.count(110) == 0 and kept.count(None) == 2
    assert 102 in kept and 103 in kept


def test_near_duplicates_by_row(spark):
    """Rows with clashing doc_ids against a plain search: no different text is lost, and one row of each group stays."""
    rng = random.Random(8)
    rows = []
    for _ in range(14):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 12, 40]))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 9)}"
            rows.append((rng.choice([None, *range(8)]) if rng.random() < 0.9 else rng.randint(50, 60), " ".join(text), "en", f"s{rng.randint(0, 1)}", rng.randint(0, 3)))
    rows += [(1, "A " * 9, "en", "s", 1), (1, None, "en", "s", 1), (1, None, "en", "s", 1), (2, "", "en", "s", 1)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    sets = [shingles(t) if i is not None else frozenset() for i, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = Counter()
    for g in set(group):
        mine = [r for r, s, h in zip(rows, sets, group) if h == g and s]
        want.update([min(mine, key=lambda r: (r[0], hashes[r[1]], r[2:4], str(r[4])))] if mine else [])
    want.update(r for r, s in zip(rows, sets) if not s)
    assert Counter(map(tuple, corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect())) == want
    four = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (2, "o p q r s t u")], "doc_id long, text string")
    four = four.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(13)})
    assert {(r.doc_id, r.text[0]) for r in corpus_pipeline.ngram_jaccard_join(spark, four, SF).collect()} == {(1, "a"), (1, "h"), (2, "o")}


def test_repeated_rows_over_a_share_spread_out(spark):
    """Rows alike in all columns, a third of all: over several shards and numbered without gaps."""
    rows = [(7, "same " * 40)] * 900 + [(k, f"own {k} " * rng) for k, rng in enumerate([20, 30, 10] * 600)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    spread, _ = check_shards(out, 8)
    share = sum(r["size"] for r in out) / 8
    assert len(out) == len(rows) and spread < share / 2 and len({r.shard for r in out if r.doc_id == 7 and r["size"] == 216}) > 1


def test_pipeline_end_to_end(spark, tmp_path):
    """run() against its parts: scores and languages of the operators, a plain search for near duplicates, SQL, and the library."""
    import duckdb

    from docloom.llm import bpe

    rng = random.Random(12)
    texts = [sentence(rng, "en" if k % 3 else "fr", rng.randint(20, 60)) for k in range(120)]
    texts = [t.upper() + " !! ###" if k % 5 == 0 else t for k, t in enumerate(texts)] + texts[:25] + [None, "", "12 !!"]
    rows = [(k, t, None if t is None else "en" if k % 3 else "fr", f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, str(tmp_path)).collect()}
    left = [r for r in rows if score[r[0]] >= queries.KEEP_SCORE]
    first = spark.createDataFrame(left, docs.schema)
    lang = {r.doc_id: (r.lang_pred, r.lang_score) for r in queries.languages(first).collect()}
    left = [r for r in left if lang[r[0]][0] != "und" and lang[r[0]][1] >= corpus_pipeline.KEEP_LANGUAGE]
    sets = {r[0]: shingles(r[1]) for r in left}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    left = [r for r in left if group[r[0]] == r[0]]
    assert 40 < len(left) < 110
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into documents values (?, ?, ?, ?, ?)", left)
    mixed = c.execute(f"select doc_id, text from ({queries.OP7_SQL})").fetchall()
    t = bpe.coder(queries.tokenizer_file()).tokenizer
    want = Counter((i, len(ids := t.encode(x, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, x in mixed)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
