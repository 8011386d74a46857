import re
from collections import Counter

import pytest
from docloom.llm import rules


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
TEXTS = ["a b c d e f a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "# | <b> & $5 *%", "a b c d e " * 3 + "z", "\x0ba\x0cb\rc\td", "é 漢字 é 漢字 é 漢字", "a b", None, "", "1 2 3 4 5 6 1 2 3 4 5 9 9 2 3 4 5 6"]


def test_statistics(spark, odd):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = rules.text_statistics(df).select("doc_id", *NAMES).collect()
    assert Counter(tuple(r) for r in got) == Counter((r.doc_id, *plain(r.text)) for r in df.collect())


def test_statistics_under_a_filter(spark):
    """A filter on a statistic does not repeat the expressions that it is made of."""
    df = spark.createDataFrame([(1, "a b c d e f g " * 9), (2, " ".join(map(str, range(60))))], "doc_id long, text string")
    stats = rules.text_statistics(df)
    assert [r.doc_id for r in stats.filter("n_repeat_words > 5 and n_words > 3").collect()] == [1]
    assert [r.doc_id for r in stats.filter("n_repeat_words = 0").collect()] == [2]


def test_learns_a_threshold(spark):
    rows = [(k, "word " * 3 + f"w{k} " + " ".join(f"u{k}x{j}" for j in range(12)) + (" ### $$$" if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k in range(400)], "doc_id long, quality int")
    judged = rules.apply_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in judged)


def test_cases(spark, odd, empty, marks):
    out = rules.apply_rules(odd, marks)
    assert out.count() == odd.count() and out.filter("kept is null or base_failed is null").count() == 0
    assert rules.apply_rules(empty, marks).count() == 0
    none = rules.apply_rules(odd, marks.limit(0))
    assert none.filter("kept = base_failed").count() == 0


def test_kept_matches_plain(spark):
    """base_failed and kept against loops over the learned rules and plain statistics."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(8 + k % 30)) + (" ###" * (k % 5) if k % 3 == 0 else "") + (" a b c d e" * 9 if k % 11 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(300)], "doc_id long, quality int")
    learned = rules.learn(rules.text_statistics(docs).cache(), labels)
    assert learned
    got = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    for k, text in rows:
        words = text.split()
        n, chars, symbols, dup, repeat = plain(text)
        values = {
            "words": n, "word_length": chars / n, "symbol_share": symbols / chars, "upper_share": sum(c.isupper() for c in text) / chars,
            "repeat_share": repeat / n, "dup_line_share": dup / 1, "distinct_share": len(set(words)) / n,
        }
        failed = n < 10 or 100 * repeat > 20 * n
        hit = [i + 1 for i, rule in enumerate(learned) if all((values[x.feature] > x.threshold) == x.above for x in rule)]
        assert got[k].base_failed == failed and got[k].kept == (not failed and not hit) and got[k].rule == (hit[0] if hit else None)


def test_native(spark, odd, marks):
    plan = rules.apply_rules(odd.select("doc_id", "text"), marks)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("above", [True, False])
def test_literal(spark, above):
    df = spark.createDataFrame([(10, 50), (0, 0)], "n_words long, word_chars long")
    got = [r[0] for r in df.select(rules.Literal("word_length", above, 4.0).column()).collect()]
    assert got == ([True, False] if above else [False, True])
