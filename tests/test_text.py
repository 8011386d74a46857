import random

import pytest
from pyspark.sql import functions as F

from docloom.errors import DocloomError, error_text, format_error
from docloom.functions import jsons
from docloom.functions.render import escape, render, render_variant
from docloom.functions.text import category, category_directory, document_path, first_block, safe_name, topic_file, trim_space, unfence, utf8_lossy, utf8_strict, with_extension

SPACE = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("o")).orderBy("i").select("o").collect()]


def unfence_plain(x):
    x = x.strip(SPACE)
    for opening in ("```json", "```"):
        if x.startswith(opening):
            while x.startswith(opening):
                x = x[len(opening):]
            while x.endswith("```"):
                x = x[:-3]
            return x.strip(SPACE)
    return x


def test_unfence_random(spark):
    rng = random.Random(1)
    parts = ["```json", "```", "{}", "a", "\n", " ", " ", "`", "json", "​", "\x1c"]
    xs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    assert column(spark, xs, unfence) == [unfence_plain(x) for x in xs]


def block_plain(md):
    rows = md.split("\n")
    rows = [r.removesuffix("\r") for r in (rows[:-1] if rows[-1] == "" else rows)]
    at = [k for k, r in enumerate(rows) if r.strip(SPACE).startswith("```")]
    if not at:
        return None
    end = at[1] if len(at) > 1 else len(rows)
    body = "".join(r + "\n" for r in rows[at[0] + 1 : end])
    info = rows[at[0]].strip(SPACE)
    while info.startswith("```"):
        info = info[3:]
    return ("json" if info.strip(SPACE) == "json" else "yaml", body) if body else None


def test_first_block_random(spark):
    rng = random.Random(2)
    parts = ["```json\n", "```\n", "```yaml\r\n", " ``` json \n", "text\n", "a: 1\n", "\n", "x"]
    xs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(800)]
    assert [r and tuple(r) for r in column(spark, xs, first_block)] == [block_plain(x) for x in xs]


def test_trim_takes_all_white_space(spark):
    assert column(spark, [SPACE + "a b" + SPACE, SPACE, None], trim_space) == ["a b", "", None]


def test_names_and_paths(spark):
    assert column(spark, ["My Topic", "ΑΣ"], topic_file) == ["my_topic.md", "ας.md"]
    assert column(spark, ["a.txt", "a", "a.md", ".hidden", "a.b.c"], lambda c: with_extension(c, "md")) == ["a.md", "a.md", "a.md", ".hidden.md", "a.b.md"]
    assert column(spark, ["a.md", "../a", "a/b", "..", "", None], safe_name) == [True, False, False, False, False, False]
    assert column(spark, ["how_to", "how-to", "tutorial", "x"], category) == ["how-to", "how-to", "tutorial", None]
    assert column(spark, ["tutorial", "how-to", "explanation", "reference"], category_directory) == ["docs/tutorials", "docs/how_to", "docs/explanation", "docs/reference"]
    assert column(spark, ["x.txt"], lambda c: document_path(F.lit("out"), F.lit("how-to"), c)) == ["out/docs/how_to/x.md"]


def test_errors(spark):
    assert format_error("config.validation", "no such colour") == "Configuration error: Validation error: no such colour"
    assert str(DocloomError("io", "x")) == "IO error: x"
    with pytest.raises(DocloomError):
        raise DocloomError("config.load", "lost key")
    assert column(spark, ["provider.auth", "nothing"], lambda c: error_text(c, F.lit("m"))) == ["Provider error: Authentication failed: m", None]


def test_json_is_strict(spark):
    xs = ['{"path": "a"}', '{"path": 5}', '{"path": null}', "{}", "no", None]
    assert column(spark, xs, lambda c: jsons.text_at(jsons.parsed(c), "$.path")) == ["a", None, None, None, None, None]
    more = ['{"a": 1}}', "1 2", "1, 2", "1], [2", '1}, {"b": 2', '1, "v": 2', "", " ", "null", "[1]", ' {"a": []} ']
    assert column(spark, more, lambda c: jsons.parsed(c).isNotNull()) == [False] * 8 + [True] * 3


def test_utf8(spark):
    df = spark.createDataFrame([(b"a\xffb",), (b"ok",)], "b binary")
    assert [tuple(r) for r in df.select(utf8_lossy("b"), utf8_strict(F.col("b"))).collect()] == [("a�b", None), ("ok", "ok")]


def test_render(spark):
    data = '{"title": "Nets <T>", "introduction": "a & b", "steps": [{"number": 1, "title": "Find Twine", "content": "Do \\"this\\""}]}'
    got = column(spark, [data], lambda c: render_variant(F.lit("tutorial"), jsons.parsed(c)))[0]
    assert got.startswith("# Nets &lt;T&gt;\n") and "### Step 1: Find Twine\nDo &quot;this&quot;\n" in got and "a &amp; b" in got and "## Conclusion\n\n" in got
    how = column(spark, ["x"], lambda c: render("how-to", {"title": F.lit("Mend a Net"), "steps": F.array(F.lit("cut"), F.lit("knot"))}))[0]
    assert how.startswith("# How to Mend a Net\n") and "1. cut\n1. knot\n" in how
    assert column(spark, ["{}"], lambda c: render_variant(F.lit("nothing"), jsons.parsed(c))) == [None]
    assert column(spark, ["&<'`=>\"", None], escape) == ["&amp;&lt;&#x27;&#x60;&#x3D;&gt;&quot;", ""]
