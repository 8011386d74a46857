import random

import pytest

from docloom.plans import parse, waves

YAML = """
name: Harbour guide
description: What the ferries need
steps:
  - id: quay
    description: Look at every pier
    action:
      type: scan_repository
      params: null
"""
JSON = '{"name": "Harbour guide", "description": "d", "steps": [{"id": "s", "description": "on", "action": {"type": "agent_task", "params": {"prompt": "p"}}, "dependencies": ["t"]}], "deliverables": []}'


def parsed(spark, *plans):
    files = spark.createDataFrame([(str(k), *p) for k, p in enumerate(plans)], "path string, format string, content string")
    return parse.parse_plans(files)


def test_three_formats(spark):
    rows = parsed(spark, ("yaml", YAML), ("json", JSON), ("md", f"Ferries\n=======\nas agreed\n\n```yaml{YAML}```\n"), ("md", f"```json\n{JSON}\n```")).orderBy("path").collect()
    assert [r.error for r in rows] == [None] * 4
    assert [r.plan.name for r in rows] == ["Harbour guide"] * 4
    assert rows[0].plan.steps[0].action.type == "scan_repository" and len(rows[0].plan.steps) == 1
    assert rows[1].plan.steps[0].dependencies == ["t"]


@pytest.mark.parametrize(
    "change",
    [
        ("scan_repository", "ScanRepository"), ("params: null", "params: {x: 1}"), ("name: Harbour guide", "name: 5"), ("description: What the ferries need", ""), ("steps:", "stages:"),
        ("type: scan_repository\n      params: null", "type: generate_docs\n      params: {category: how-to}"),
        ("type: scan_repository\n      params: null", "type: generate_docs"),
        ("type: scan_repository\n      params: null", "type: execute_command\n      params: {command: 3}"),
        ("type: scan_repository\n      params: null", "type: scan_repository\n    dependencies: [1]"),
    ],
)
def test_wrong_plans_are_errors(spark, change):
    row = parsed(spark, ("yaml", YAML.replace(*change))).head()
    assert row.plan is None and row.error.kind == "workflow.parse"


def test_right_variants(spark):
    good = YAML.replace("type: scan_repository\n      params: null", "type: generate_docs\n      params: {category: how_to}\n    dependencies: [yes, 'no']")
    row = parsed(spark, ("yml", good)).head()
    assert row.error is None and row.plan.steps[0].dependencies == ["yes", "no"]


def test_formats_and_blocks(spark):
    rows = parsed(spark, ("toml", "x"), ("md", "no block"), ("md", "```\n```\n```yaml\na: 1\n```"), ("json", "{"), ("yaml", "a: [")).orderBy("path").collect()
    assert [r.plan for r in rows] == [None] * 5
    assert "Unsupported format: toml" in rows[0].error.message and "No code block" in rows[1].error.message and "No code block" in rows[2].error.message


def test_strict_raises(spark):
    files = spark.createDataFrame([("p", "json", "{")], "path string, format string, content string")
    with pytest.raises(Exception, match="Plan parsing failed"):
        parse.parse_plans(files, strict=True).collect()


def test_reads_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "plain").write_text(YAML)
    (tmp_path / "b.json").write_text(JSON)
    plans = parse.parse_plans(parse.read_plans(spark, str(tmp_path)))
    assert plans.filter("error is null").count() == 3
    assert parse.steps(plans).count() == 3 and parse.deliverables(plans).count() == 0


def loop(steps):
    """The plain loop: waves of ids whose dependencies are done before the wave."""
    done, out, wave = set(), {}, 0
    while True:
        now = {i for i, d in steps if i not in done and set(d) <= done}
        if not now:
            return out, len(done) != len(steps)
        out |= dict.fromkeys(now, wave)
        done |= now
        wave += 1


def test_random_graphs(spark):
    rng = random.Random(5)
    plans = {}
    for p in range(60):
        ids = [f"s{k}" for k in range(rng.randint(0, 7))]
        steps = [(i, rng.sample([*ids, "gone"] if rng.random() < 0.2 else ids[:k] or ids, k=min(rng.randint(0, 2), max(1, k)) if ids[:k] or rng.random() < 0.1 else 0)) for k, i in enumerate(ids)]
        if ids and rng.random() < 0.2:
            steps.append((rng.choice(ids), []))
        # a repeated id waits for any of its dependency lists in the loop; keep them alike
        first = {}
        plans[p] = [(i, first.setdefault(i, d)) for i, d in steps]
    rows = [(p, k, i, d) for p, steps in plans.items() for k, (i, d) in enumerate(steps)]
    df = spark.createDataFrame(rows, "plan int, ord int, id string, deps array<string>")
    settled = waves.waves(df)
    got = {(r.plan, r.id): r.wave for r in settled.collect()}
    want = {(p, i): w for p, steps in plans.items() for i, w in loop(steps)[0].items()}
    assert got == want
    dead = {r.plan for r in waves.deadlocks(df, settled).filter("deadlocked").collect()}
    assert dead == {p for p, steps in plans.items() if loop(steps)[1]} and dead


def test_validation(spark):
    df = spark.createDataFrame([(1, 0, "a", []), (1, 1, "a", ["x"]), (2, 0, "a", ["y"]), (3, 0, "a", [])], "plan int, ord int, id string, deps array<string>")
    assert {r.plan: r.problem for r in waves.validate(df).collect()} == {1: "Duplicate step ID: a", 2: "Step a depends on unknown step y"}
    order = waves.execution_order(df, waves.waves(df.filter("plan = 3")))
    assert [(r.plan, r.wave, r.id) for r in order.filter("plan = 3").collect()] == [(3, 0, "a")]
