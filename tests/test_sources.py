import subprocess

import pytest
from pyspark.sql import functions as F

from docloom.operators import docgen
from docloom.sources import files, git, ignore
from docloom.streaming import chunks


def test_rules():
    def hit(rules, path, directory=False):
        return ignore.ignored(path, directory, [("", ignore.rules(rules))])

    assert hit("*.log", "a/b.log") and not hit("/*.log", "a/b.log") and hit("/*.log", "b.log")
    assert hit("build/", "x/build", True) and not hit("build/", "x/build")
    assert hit("a/**/z", "a/z") and hit("a/**/z", "a/b/c/z") and hit("**/q", "q") and hit("d/**", "d/e/f") and not hit("d/**", "d", True)
    assert not hit("*.log\n!keep.log", "keep.log") and hit("# c\n\nfoo?[a-c]", "foo1b") and not hit("foo[!a]", "fooa")
    assert hit("a\\*", "a*") and not hit("a\\*", "ab")


def test_tree(spark, tmp_path):
    files.register(spark)
    for name, text in {".hidden": "h", "_x/y.txt": "y", "a.log": "l", "sub/.gitignore": "*.tmp\n!k.tmp\n", "sub/b.tmp": "", "sub/k.tmp": "", "sub/c.py": "c", "target/o": "", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad").write_bytes(b"\xff")
    (tmp_path / "link").symlink_to(tmp_path / "bad")
    read = spark.read.format("tree").option("ignore", "target\n.git")
    rows = {r.path: r for r in read.load(str(tmp_path)).collect()}
    assert set(rows) == {".gitignore", ".hidden", "_x/y.txt", "bad", "sub/.gitignore", "sub/c.py", "sub/k.tmp"}
    assert rows["sub/c.py"].content == b"c" and rows["sub/c.py"].length == 1
    assert read.option("gitignore", "false").option("content", "false").load(str(tmp_path)).count() == 9


def test_documents_sink(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([("docs/how_to/a.md", "A"), ("docs/tutorials/b.md", "B")], "path string, content string")
    df.write.format("documents").mode("append").save(str(tmp_path))
    assert (tmp_path / "docs/how_to/a.md").read_text() == "A"
    with pytest.raises(Exception, match="already exists"):
        df.write.format("documents").mode("append").save(str(tmp_path))
    df.withColumn("content", F.lit("new")).write.format("documents").mode("overwrite").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*.md")) == ["a.md", "b.md"] and (tmp_path / "docs/how_to/a.md").read_text() == "new"
    with pytest.raises(Exception, match="leaves the folder"):
        spark.createDataFrame([("../x.md", "")], "path string, content string").write.format("documents").mode("append").save(str(tmp_path / "in"))


def test_guard(spark):
    docs = spark.createDataFrame([("tutorial", "a.md"), ("tutorial", "b.md"), ("how-to", "c.md"), ("how-to", "c.txt")], "category string, file string")
    taken = spark.createDataFrame([("o/docs/tutorials/a.md",)], "path string")
    write, refused = docgen.guard(docs, taken, "o")
    assert [r.path for r in write.collect()] == ["o/docs/tutorials/b.md"]
    assert sorted(r.error.message.split(":")[0].split(" for")[0] for r in refused.collect()) == ["File already exists", "several documents", "several documents"]
    assert docgen.guard(docs, taken, "o", overwrite=True)[0].count() == 2


def test_git(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", "-C", str(tmp_path), *a], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a").write_text("1\n2\n")
    run("add", "a")
    run("commit", "-qm", "x")
    repositories = spark.createDataFrame([(str(tmp_path),)], "repository string")
    assert git.status_text(repositories).head().text == "Clean"
    (tmp_path / "a").write_text("1\n3\n4\n")
    (tmp_path / "b c").write_text("")
    assert git.status_text(repositories).head().text == "M a\n?? b c\n"
    assert tuple(git.diff_stats(repositories).head())[1:] == ("a", 2, 1, None)
    gone = spark.createDataFrame([("/no/such",)], "repository string")
    assert git.status(gone).head().error and git.diff_stats(gone).head().error
    row = git.status_text(gone).head()
    assert row.text is None and "/no/such" in row.error


LINES = ['data: {"choices":[{"delta":{"role":"assistant","content":"He"}}]}', "data: [DONE]", "data: {bad", 'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":"x"}}]}', "other"]


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_streams(spark, tmp_path):
    for name, rows in {"events": LINES, "objects": ['{"message":{"role":"assistant","content":"a"}}', '{"message":{"content":"a"}}', "{"], "prompts": [" a ", "", "Quit", "b"]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.txt").write_text("\n".join(rows))
    assert drain(chunks.event_stream(spark, str(tmp_path / "events")), "events_out") == [("He",)] + [("",)] * 5
    objects = drain(chunks.object_stream(spark, str(tmp_path / "objects")), "objects_out")
    assert objects[0] == ("a", None) and [o[0] for o in objects[1:]] == [None, None] and all(o[1].kind == "provider.serialization" for o in objects[1:])
    assert drain(chunks.prompt_stream(spark, str(tmp_path / "prompts")), "prompts_out") == [("a",), ("b",)]


def test_completions(spark):
    rows = [(200, '{"message":{"role":"a","content":"x"}}'), (200, '{"choices":[{"message":{"role":"a","content":"y"}}]}'), (200, '{"choices":[]}'), (500, "")]
    got = chunks.completions(spark.createDataFrame(rows, "status int, body string")).collect()
    assert [(r.content, r.error and r.error.kind) for r in got] == [("x", None), ("y", None), (None, "provider.serialization"), (None, "provider.api")]
