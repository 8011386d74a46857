"""Work and memory of the documentation dataflow's queries that must not grow faster than their input."""

import json
import random

import yaml
from pyspark.sql import functions as F

from docloom.functions.text import utf8_lossy
from docloom.plans import parse
from docloom.streaming.recorded import ChunkReader


def test_bad_bytes_are_replaced_as_by_python_without_python(spark):
    rng = random.Random(4)
    some = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    rows = [bytes([a, b, c]) for a in some for b in some for c in some] + [bytes(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(20_000)] + [b"", None, "aß漢😀".encode()]
    data = spark.createDataFrame([(r,) for r in rows], "b binary")
    text = data.select("b", utf8_lossy(F.col("b")).alias("t"))
    assert all(r.t == (None if r.b is None else bytes(r.b).decode("utf-8", "replace")) for r in text.collect())
    assert "Python" not in text._jdf.queryExecution().executedPlan().toString()


def test_a_step_s_type_is_looked_up_once(spark):
    files = spark.createDataFrame([("a", "json", "{}")], "path string, format string, content string")
    plan = parse.parse_plans(files)._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("$.action.type") <= 2, plan.count("$.action.type")  # its kind and its text


def test_plain_yaml_is_what_the_loader_gives():
    loader = parse._yaml_loader()
    deep = "[" * 400 + "]" * 400
    texts = ["", "a", "a: b", "- a\n- 1\n- 1.5\n- ~\n- yes\n- true", "a: 1\na: b", "? [x]\n: y", "? 1\n: y", "a: &x [b]\nc: *x", "a: &x\n  b: *x", "!!str {a: b}", "!!map x", "!!set {a, b}", "!!binary aGk=", "!own x",
             "<<: {a: b}\nc: d", "a: 'é\\n'\nb: |\n  two\n  lines\n", "a: [b", "--- a\n--- b", "{}", "[]", "{a: {b: [c, {d: e}]}}", "a: ''", "a:", "2001-01-01", "a & b", deep]

    def outcome(load):
        try:
            return json.dumps(load(), allow_nan=False)
        except (yaml.YAMLError, ValueError, TypeError) as e:
            return type(e), str(e).split("\n")[0]

    for text in texts:
        assert outcome(lambda: parse._loaded(text, loader)) == outcome(lambda: yaml.load(text, loader)), text


def test_small_recordings_share_a_task(tmp_path):
    for k in range(500):
        (tmp_path / f"r{k:04}").write_text("".join(json.dumps({"response": f"{k}-{j}", "chunk": "YQ=="}) + "\n" for j in range(3)))
    reader = ChunkReader(str(tmp_path))
    for start, end, first, last in ((reader.initialOffset(), reader.latestOffset(), 0, 1500), ({"file": "r0010", "chunks": 2}, {"file": "r0450", "chunks": 1}, 32, 1351)):
        parts = reader.partitions(start, end)
        assert len(parts) <= 10
        assert [r[2] for p in parts for r in reader.read(p)] == [f"{k}-{j}" for k in range(500) for j in range(3)][first:last]
    assert reader.partitions(end, end) == []
