"""Work that grows with the input and no faster: sinks, trees, plans in large graphs."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import tools
from docloom.plans import parse, waves
from docloom.sources import documents, files

from .conftest import SF


def test_a_large_folder_is_listed_once_for_each_partition(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 10)
    monkeypatch.setattr(files, "MOST_ENTRIES", 50)
    for folder, n in (("a", 400), ("b/c", 90), ("d", 3)):
        (tmp_path / folder).mkdir(parents=True)
        for k in range(n):
            (tmp_path / folder / f"f{k}").write_text("")
    for wanted in (1, 2, 3):
        reader = files.TreeReader({"path": str(tmp_path), "partitions": str(wanted), "ignore": "f1*"})
        packed = reader.partitions()
        assert len(packed) <= wanted and max(p.of for part in packed for p in part.pieces) <= wanted
        paths = [row[0] for part in packed for row in reader.read(part)]
        assert sorted(paths) == sorted(f"{folder}/f{k}" for folder, n in (("a", 400), ("b/c", 90), ("d", 3)) for k in range(n) if not str(k).startswith("1"))


def test_documents_are_dealt_out_and_listed_in_runs(spark, tmp_path, monkeypatch):
    rows = spark.range(100).coalesce(1).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("content"))
    assert documents.dealt(rows).rdd.getNumPartitions() == 4
    monkeypatch.setattr(documents, "LISTED", 7)
    monkeypatch.setattr(documents, "MOVED", 5)
    for overwrite, root in ((False, tmp_path), (True, tmp_path)):
        writer = documents.DocumentWriter(str(root), overwrite)
        messages = [writer.write({"path": f"d/{k}", "content": str(k)} for k in range(part, 100, 3)) for part in range(3)]
        assert all(len(m.manifests) > 1 for m in messages)
        writer.commit(messages)
        assert {n: open(tmp_path / "d" / n).read() for n in os.listdir(tmp_path / "d")} == {str(k): str(k) for k in range(100)}
        assert os.listdir(tmp_path) == ["d"]
    writer = documents.DocumentWriter(str(tmp_path), False)
    messages = [writer.write([{"path": "e/1", "content": ""}, {"path": "d/7", "content": ""}])]
    with pytest.raises(FileExistsError, match="already exists: d/7"):
        writer.commit(messages)
    assert os.listdir(tmp_path) == ["d"]


def test_plans_in_a_folder_are_those_of_the_text_source(spark, tmp_path):
    for name in ("a b%.md", "q?{}#[]`^.json", "plain", "é.yml", "_x=1", "_hidden", ".hidden", "w._COPYING_"):
        (tmp_path / name).write_bytes(b"x\n\xff" + name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.json").write_text("{}")
    (tmp_path / ".gitignore").write_text("*")
    want = spark.read.text(str(tmp_path), wholetext=True).select("_metadata.file_path", F.col("value").cast("binary").alias("v")).collect()
    found = parse.read_plans(spark, str(tmp_path)).select("path", F.col("content").cast("binary").alias("v")).collect()
    assert sorted((p, bytes(v)) for p, v in found) == sorted((p, bytes(v)) for p, v in want) and len(want) == 5
    assert parse.read_plans(spark, str(tmp_path / "plain")).count() == 1


def test_long_chains_in_blocks(spark):
    """Two thousand waves in plans over the most steps, in the plans' order, against it and across it."""
    n, rng = 2000, random.Random(5)
    rows = [("chain", k, str(k), [str(k - 1)] if k else []) for k in range(n)]
    rows += [("back", k, str(k), [str(k + 1)] if k < n - 1 else []) for k in range(n)]
    rows += [("near", k, str(k), [str(rng.randrange(max(0, k - 9), k))] if k else []) for k in range(n)]
    # an id whose other steps come into another block: the one that is ready first runs
    rows += [("far", k, str(k), [str((k + 1500) % n)] if k % 500 else []) for k in range(n)] + [("far", n + 1, "7", ["0"]), ("far", n + 2, "x", ["7", "gone"]), ("far", n + 3, "y", ["7"])]
    df = spark.createDataFrame(rows, "plan string, ord int, id string, deps array<string>").repartition(3)
    whole = {(r.plan, r.ord): r.wave for r in waves.schedule(df).collect()}
    cut = waves.schedule(df, most_steps=700)
    assert {(r.plan, r.ord): r.wave for r in cut.collect()} == whole and len(whole) == len(rows)
    assert whole["chain", n - 1] == n - 1 == whole["back", 0] and whole["far", n + 3] == 2 and whole["far", n + 2] is None
    assert {r.plan: r.deadlocked for r in waves.stalled(cut).collect()}["chain"] is False


def test_tool_files_alone():
    """In a process of its own: what another query has registered is not there."""
    code = """
import tempfile
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
print("rows", __spark_entry__.queries()["tool_files"](spark, {sf!r}).count())
"""
    root = str(Path(__file__).parents[1])
    done = subprocess.run([sys.executable, "-c", code.format(sf=SF)], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": root}, cwd=root)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_calls_of_effects_are_dealt_out(spark):
    measure = lambda a: (str(len(a["text"])), None)
    registry = tools.Registry()
    registry.register(tools.Tool("measure", "Count", tools._schema(text="Any text"), tools._each(measure), ("text",), effect=measure))
    calls = spark.range(200).coalesce(1).select("id", F.lit("measure").alias("name"), F.to_json(F.struct(F.col("id").cast("string").alias("text"))).alias("arguments"))
    done = registry.execute(calls).filter("result is not null").select("id", "result.output", F.spark_partition_id().alias("part")).collect()
    assert {r.id: r.output for r in done} == {k: str(len(str(k))) for k in range(200)} and len({r.part for r in done}) > 1


def test_validation_in_one_grouping(spark):
    rng, rows = random.Random(11), []
    for p in range(200):
        size = rng.randrange(1, 7)
        pool = [*"abcdefg"[:size], None] if p % 3 else [*"abcdefgh"]
        for k in range(size):
            i = "abcdefg"[k] if rng.random() < 0.9 else rng.choice([*"abc", None])
            rows.append((None if p == 5 else p, k, i, [rng.choice(pool) for _ in range(rng.randrange(3))] if rng.random() < 0.9 else None))
    want = {}
    for p in {r[0] for r in rows} - {None}:
        mine = [r[1:] for r in rows if r[0] == p and r[2] is not None]
        ids = [i for _, i, _ in mine]
        first = {i: min(o for o, j, _ in mine if j == i) for i in ids}
        faults = [(0, first[i], f"Duplicate step ID: {i}") for i in ids if ids.count(i) > 1]
        faults += [(1, first[i], f"Step {i} depends on unknown step {'null' if d is None else d}") for _, i, deps in mine for d in deps or [] if d not in ids]
        if faults:
            want[p] = min(faults)[2]
    df = spark.createDataFrame(rows, "plan long, ord int, id string, deps array<string>")
    found = waves.validate(df)
    assert {r.plan: r.problem for r in found.collect()} == want and len(want) > 50
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
