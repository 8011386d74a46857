"""Plans that run, graphs, streams with state, sinks and ledgers."""

import base64
import json
import os
import random
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import jsons, text
from docloom.model import LOG, TOOL_CALLS
from docloom.operators import agent, conversation, docgen, tools
from docloom.plans import run, waves
from docloom.sources import files
from docloom.streaming import recorded, state

STEPS = "plan string, ord int, id string, action struct<type:string,params:struct<category:string,command:string,prompt:string>>, deps array<string>"


def task(prompt):
    return ("agent_task", (None, None, prompt))


OTHER = ("execute_command", (None, "rm -rf /", None))


def loop(steps):
    """The plain loop over (ord, id, deps): (ord, wave) of the steps that run."""
    done, out, wave = set(), {}, 0
    while True:
        now = [(o, i) for o, i, d in steps if i not in done and set(d) <= done]
        if not now:
            return out
        out |= {o: wave for o, _ in now}
        done |= {i for _, i in now}
        wave += 1


def graphs(seed, n=80):
    rng, rows = random.Random(seed), []
    for p in range(n):
        size = rng.choice([0, 1, 3, 6, 12])
        ids = [f"s{rng.randrange(size) if rng.random() < 0.1 else k}" for k in range(size)]  # some repeat
        for k, i in enumerate(ids):
            many = rng.choice([0, 1, 1, 2, 4])
            pool = ids[:k] if rng.random() < 0.9 else [*ids, "gone"]
            rows.append((None if p == 7 else f"p{p}", k, i, [rng.choice(pool) for _ in range(many)] if pool else []))
    rows += [("chain", k, str(k), [str(k - 1)] if k else []) for k in range(2000)]
    rows += [("diamond", 0, "a", []), ("diamond", 1, "b", ["a"]), ("diamond", 2, "c", ["a", "a"]), ("diamond", 3, "d", ["b", "c"])]
    rows += [("cycle", 0, "a", ["b"]), ("cycle", 1, "b", ["a"]), ("cycle", 2, "c", []), ("self", 0, "a", ["a"]), ("self", 1, "b", ["a"])]
    return rows


@pytest.mark.parametrize("most_steps,records", [(None, 10_000), (None, 7), (5, 10_000)])
def test_schedules_of_any_graph(spark, most_steps, records):
    """In one pass, over batches that cut plans, and by rounds of joins for all plans over five steps."""
    rows = graphs(3)
    if most_steps is not None:
        rows = [r for r in rows if r[0] != "chain"]  # two thousand rounds
    df = spark.createDataFrame(rows, "plan string, ord int, id string, deps array<string>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        found = waves.schedule(df, most_steps=most_steps)
        got = Counter((r.plan, r.ord, r.wave) for r in found.collect())
        stopped = {r.plan for r in waves.stalled(found).collect() if r.deadlocked}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for p, o, i, d in rows:
        by[p].append((o, i, d))
    want = {p: loop(steps) for p, steps in by.items()}
    assert got == Counter((p, o, want[p].get(o)) for p, o, _, _ in rows)
    assert stopped == {p for p, steps in by.items() if len({i for o, i, _ in steps if o in want[p]}) != len(steps)}
    assert {"cycle", "self"} <= stopped and "diamond" not in stopped


def test_null_ids_and_dependencies_wait_for_nothing_and_forever(spark):
    df = spark.createDataFrame([("p", 0, None, []), ("p", 1, "a", [None]), ("p", 2, "b", None), ("p", 3, None, ["b"])], "plan string, ord int, id string, deps array<string>")
    for most in (None, 1):
        assert {r.ord: r.wave for r in waves.schedule(df, most_steps=most).collect()} == {0: 0, 1: None, 2: 0, 3: 1}


def test_a_plan_runs_in_one_conversation(spark):
    rows = [
        ("good", 0, "b", task("second"), ["a"]), ("good", 1, "a", task("first"), []), ("good", 2, "c", OTHER, ["b"]),
        ("bad", 0, "a", task("fine"), []), ("bad", 1, "b", task("fail here"), ["a"]), ("bad", 2, "c", task("never"), ["b"]), ("bad", 3, "d", OTHER, []),
        ("stuck", 0, "a", task("only"), []), ("stuck", 1, "b", task("x"), ["c"]), ("stuck", 2, "c", OTHER, ["b"]),
        ("asks", 0, "a", task("measure it"), []), ("asks", 1, "b", task("and now"), ["a"]), ("lost", 0, "a", task("unknown tool"), []), ("lost", 1, "b", task("x"), []),
        (None, 0, "a", OTHER, []), ("null prompt", 0, "a", task(None), []),
    ]
    registry = tools.Registry()
    registry.register(tools.Tool("length", "", "{}", lambda a: tools.result(F.length(tools.argument(a, "text")).cast("string"), F.lit(None)), ("text",), native=True))
    last = F.regexp_extract("request", r'"role":"([a-z]+)","content":"([^"]*)"\}\]$', 2)
    role = F.regexp_extract("request", r'"role":"([a-z]+)","content":"([^"]*)"\}\]$', 1)
    call = lambda name: F.array(F.struct(F.lit("c").alias("id"), F.struct(F.lit(name).alias("name"), F.lit('{"text": "abcd"}').alias("arguments")).alias("function")))
    calls = F.when((role == "user") & (last == "measure it"), call("length")).when(last == "unknown tool", call("nope"))
    responder = agent.Template(F.concat(F.regexp_count("request", F.lit('"role"')).cast("string"), F.lit(" of "), role, F.lit(" "), last), calls, answers=~last.contains("fail"))
    ran, plans, log = run.run_plans(spark.createDataFrame(rows, STEPS), responder, registry)
    got = {(r.plan, r.id): (r.place, r.state, r.output) for r in ran.collect()}
    assert got == {
        ("good", "a"): (1, "done", "1 of user first"), ("good", "b"): (2, "done", "3 of user second"), ("good", "c"): (3, "done", None),
        ("bad", "a"): (1, "done", "1 of user fine"), ("bad", "d"): (2, "done", None), ("bad", "b"): (3, "failed", None), ("bad", "c"): (4, "skipped", None),
        ("stuck", "a"): (1, "done", "1 of user only"), ("stuck", "b"): (None, "skipped", None), ("stuck", "c"): (None, "skipped", None),
        ("asks", "a"): (1, "done", "3 of tool 4"), ("asks", "b"): (2, "done", "5 of user and now"), ("lost", "a"): (1, "failed", None), ("lost", "b"): (2, "skipped", None),
        ("null prompt", "a"): (1, "done", "1 of user "),
    }
    ended = {r.plan: (r.n_steps, r.n_done, r.error and r.error.message) for r in plans.collect()}
    assert ended["good"] == (3, 3, None) and ended["bad"] == (4, 2, "step b: no answer") and ended["stuck"] == (3, 1, run.DEADLOCK)
    assert ended["lost"] == (2, 0, "step a: Tool not found: nope") and ended["asks"] == (2, 2, None)
    said = defaultdict(list)
    for r in log.orderBy("conv_id", "turn").collect():
        said[r.conv_id].append((r.turn, r.role, r.content))
    assert [m[1] for m in said["asks"]] == ["user", "assistant", "tool", "assistant", "user", "assistant"] and [m[0] for m in said["asks"]] == list(range(6))
    assert said["bad"][-1] == (2, "user", "fail here")


def test_steps_are_read_twice_and_each_request_is_made_once(spark):
    """Once for the plans' sizes and once for all else, however many tasks a plan has; prompts go along with the schedule."""
    read, made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(counter):
        def count(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        return count

    class Echo:
        def complete(self, requests):
            asked = requests.mapInArrow(counting(made), requests.schema)
            return asked.select("conv_id", F.regexp_count("request", F.lit('"role"')).cast("string").alias("content"), F.lit(None).cast(TOOL_CALLS).alias("tool_calls"))

    rows = [(f"p{p}", k, f"s{k}", task(f"t{k}"), [f"s{k - 1}"] if k else []) for p in range(5) for k in range(4)]
    steps = spark.createDataFrame(rows, STEPS)
    ran, plans, _ = run.run_plans(steps.mapInArrow(counting(read), steps.schema), Echo(), tools.Registry())
    assert {(r.plan, r.id): r.output for r in ran.collect()} == {(f"p{p}", f"s{k}"): str(2 * k + 1) for p in range(5) for k in range(4)}
    assert plans.filter("n_done = 4 and error is null").count() == 5
    assert read.value <= 2 * len(rows) and made.value == len(rows)


def test_no_plans_and_plans_without_tasks(spark):
    for rows in ([], [("p", 0, "a", OTHER, [])]):
        ran, plans, log = run.run_plans(spark.createDataFrame(rows, STEPS), agent.Template(F.lit("x")), tools.Registry())
        assert (ran.count(), plans.filter("error is null").count(), log.count()) == (len(rows), len(rows), 0)


# -- streams ----------------------------------------------------------------------------


def messages(seed, conversations=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "", "é" * rng.randint(1, 20), "word " * rng.randint(1, 12)])) for c in range(conversations) for t in range(rng.randint(1, 9))]


def test_log_state_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = messages(2)
    arriving = list(rows)
    random.Random(5).shuffle(arriving)  # late turns, too
    schema = "conv_id long, turn long, role string, content string"
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for k in range(3):
        spark.createDataFrame(arriving[k::3], schema).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        state.start(state.conversation_logs(stream, most=20, most_calls=2), out, progress).awaitTermination()
    written = spark.read.parquet(out)
    got = {(r.conv_id, m.turn, m.role, m.content) for r in state.latest(written).collect() for m in r.log}
    log = spark.createDataFrame([(*r, None, None, None) for r in rows], LOG)
    assert got == {(r.conv_id, r.turn, r.role, r.content) for r in conversation.compact(log, 20).collect()}
    counted = {r.conv_id: (r.calls, r.over) for r in state.latest(written).collect()}
    batch = {r.conv_id: (r.calls, r.over) for r in conversation.call_counts(log, 2).collect()}
    assert counted == {c: batch.get(c, (0, False)) for c in {r[0] for r in rows}}
    assert written.groupBy("conv_id").count().agg(F.max("count")).head()[0] > 2


def test_sessions_end_at_their_exit_word(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    parts = [[(1, 0, " a "), (2, 0, "b"), (2, 1, " QUIT\n")], [(1, 1, ""), (1, 2, "c"), (2, 2, "d"), (3, 0, "exit"), (3, 1, "e")], [(1, 3, "Exit"), (2, 3, "f"), (1, 4, "g"), (4, 0, None)]]
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        state.start(state.session_prompts(spark.readStream.schema(schema).parquet(folder)), out, progress).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert got == sorted(tuple(r) for r in agent.prompts(whole).collect()) == [(1, 0, "a"), (1, 2, "c"), (2, 0, "b")]


def test_recorded_chunks_come_once(spark, tmp_path):
    files.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    whole = '{"message":{"role":"assistant","content":"é"}}'
    event = 'data: {"choices":[{"delta":{"role":"assistant","content":"x"}}]}\n\n'
    texts = [whole, whole[:10], whole[10:], event, event + event, "data: [DONE]\n\n", b"\xff", ""]
    want, out, progress = [], str(tmp_path / "out"), str(tmp_path / "progress")

    def record(name, chunks):
        raw = [c if isinstance(c, bytes) else c.encode() for c in chunks]
        (folder / name).write_text("".join(json.dumps({"response": name, "chunk": base64.b64encode(c).decode()}) + "\n" for c in raw))
        want.extend((name, k, c) for k, c in enumerate(raw))

    for k in range(3):
        record(f"r{k}", texts)
        if k != 1:  # the second is there when the third is read
            state.start(spark.readStream.format("chunks").load(str(folder)), out, progress).awaitTermination()
    read = spark.read.parquet(out)
    assert sorted((r.file, r.seq, bytes(r.data)) for r in read.collect()) == sorted(want)
    objects = {r.seq: (r.content, r.error is None) for r in recorded.objects(read).filter("file = 'r1'").collect()}
    assert objects == {0: ("é", True)} | {k: (None, False) for k in range(1, 8)}
    assert {r.seq: r.content for r in recorded.events(read).filter("file = 'r2'").collect()} == {k: "x" if k == 3 else "" for k in range(8)}


# -- sinks, trees, tools ----------------------------------------------------------------


def everything(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n)).read() for d, _, names in os.walk(folder) for n in names}


def write(spark, rows, folder, mode="append", tasks=3):
    spark.createDataFrame(rows, "path string, content string").repartition(tasks).write.format("documents").mode(mode).save(str(folder))


def test_a_write_is_whole_or_absent(spark, tmp_path):
    files.register(spark)
    write(spark, [(f"a/{k}.md", f"{k}") for k in range(20)] + [("n.md", None)], tmp_path)
    before = everything(tmp_path)
    assert len(before) == 21 and before["n.md"] == "" and before["a/7.md"] == "7"
    fresh = [(f"b/{k}.md", "new") for k in range(20)]
    for bad, why in (([("a/3.md", "new")], "already exists"), ([("b/4.md", "twice")], "several documents"), ([("../x", "")], "leaves the folder"), ([(None, "")], "without a path")):
        with pytest.raises(Exception, match=why):
            write(spark, fresh + bad, tmp_path)
        assert everything(tmp_path) == before

    @F.udf("string")
    def broken(x):
        if x == "b/19.md":
            raise RuntimeError("lost")
        return "new"

    with pytest.raises(Exception, match="lost"):
        spark.createDataFrame(fresh, "path string, content string").repartition(4).withColumn("content", broken("path")).write.format("documents").mode("append").save(str(tmp_path))
    assert everything(tmp_path) == before
    write(spark, [("a/3.md", "over"), ("b/x.md", "new")], f"file://{tmp_path}", "overwrite")
    assert everything(tmp_path) == before | {"a/3.md": "over", "b/x.md": "new"}
    with pytest.raises(Exception, match="several documents"):
        write(spark, [("a/3.md", "1"), ("a/3.md", "2")], tmp_path, "overwrite")


def test_a_move_that_fails_is_undone(spark, tmp_path):
    files.register(spark)
    write(spark, [("a.md", "old"), ("d", "a file")], tmp_path)
    before = everything(tmp_path)
    with pytest.raises(Exception):  # d is a file, so nothing can be put below it
        write(spark, [("a.md", "new"), ("c.md", "new"), ("d/e.md", "new")], tmp_path, "overwrite")
    assert everything(tmp_path) == before


def test_unknown_file_systems_are_refused(spark):
    files.register(spark)
    with pytest.raises(Exception, match="(?i)unrecognized filesystem|unknown"):
        write(spark, [("a", "b")], "nosuch://host/x")
    with pytest.raises(Exception, match="(?i)unrecognized filesystem|unknown"):
        spark.read.format("tree").load("nosuch://host/x").collect()


def test_a_tree_is_packed_alike_however_many_partitions(spark, tmp_path):
    files.register(spark)
    rng = random.Random(2)
    top = tmp_path / "only" / "top"
    for k in range(300):
        folder = top / "/".join(f"d{rng.randrange(3)}" for _ in range(rng.randint(0, 4)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}{rng.choice(['.py', '.tmp', ''])}").write_text(str(k))
    (top / ".gitignore").write_text("*.tmp\n")
    (top / "d1").mkdir(exist_ok=True)
    (top / "d1" / ".gitignore").write_text("!f1*.tmp\nd2/\n")
    found = []
    for n in (1, 2, 50):
        df = spark.read.format("tree").option("ignore", "/only/top/d0/d0/").option("partitions", n).load(str(tmp_path))
        found.append(sorted((r.path, bytes(r.content)) for r in df.collect()))
        parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts == 1 if n == 1 else parts > min(n, 20) // 2
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_effects_of_a_ledger_happen_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    def note(arguments):
        with open(f"{notes}/{arguments['k']}", "a") as f:
            f.write("x")
        return f"noted {arguments['k']}", None

    registry = tools.Registry()
    registry.register(tools.Tool("note", "", "{}", tools._each(note), effect=note))
    calls = spark.createDataFrame([(f"c{k}", "note", f'{{"k": {k}}}') for k in range(6)] + [("c0", "note", '{"k": 9}'), (None, "note", '{"k": 10}')], "id string, name string, arguments string")
    flag = tmp_path / "failed"

    @F.pandas_udf("string")
    def fails_once(output: pd.Series) -> pd.Series:
        if not flag.exists():
            flag.write_text("")
            raise RuntimeError("the task is lost behind its effects")
        return output

    def all_calls():
        done = registry.execute(calls, ledger=f"{tmp_path}/ledger")
        return sorted(r.o for r in done.select(fails_once("result.output").alias("o")).collect())

    with pytest.raises(Exception, match="lost behind"):
        all_calls()
    assert all_calls() == all_calls() == sorted(f"noted {k}" for k in (*range(6), 9, 10))
    assert {p.name: p.read_text() for p in notes.iterdir()} == {str(k): "x" for k in (*range(6), 9, 10)}


def plain_matches(events):
    """First come, first served, over (turn, ord, kind, id) of one conversation."""
    waiting, out = defaultdict(list), []
    for turn, ord_, kind, ident in sorted(events, key=lambda e: e[:2]):
        if kind == "call":
            waiting[ident].append((turn, ord_)) if ident is not None else out.append((ident, turn, ord_, None, "open"))
        elif ident is not None and waiting[ident]:
            out.append((ident, *waiting[ident].pop(0), turn, "answered"))
        else:
            out.append((ident, None, None, turn, "orphan"))
    return Counter(out + [(i, *c, None, "open") for i, cs in waiting.items() for c in cs])


def test_results_find_their_calls(spark):
    rng = random.Random(4)
    rows, want = [], Counter()
    for conv in range(60):
        events = []
        for turn in range(rng.randint(0, 14)):
            ident = lambda: rng.choice(["x", "x", "y", "z", None])
            if rng.random() < 0.5:
                ids = [ident() for _ in range(rng.randint(0, 3))]
                rows.append((conv, turn, "assistant", "", None, [(i, ("t", "{}")) for i in ids] or rng.choice([None, []]), None))
                events += [(turn, k, "call", i) for k, i in enumerate(ids)]
            else:
                i = ident()
                rows.append((conv, turn, "tool", f"out {turn}", "t", None, i))
                events.append((turn, -1, "result", i))
        want.update({(conv, *k): n for k, n in plain_matches(events).items()})
    found = conversation.match_results(spark.createDataFrame(rows, LOG).repartition(3))
    assert Counter((r.conv_id, r.call_id, r.call_turn, r.ord, r.result_turn, r.state) for r in found.collect()) == want
    assert conversation.match_results(spark.createDataFrame([], LOG)).count() == 0


def test_requests_with_equal_and_null_ids(spark):
    rows = [(1, "reference", "One", "c"), (1, "reference", "Two", "c"), (None, "reference", "Three", "c"), (None, "reference", "Three", "c"), (2, "poem", "x", "c"), (2, None, None, None)]
    asked = spark.createDataFrame(rows, "id long, category string, topic string, context string")
    title = F.regexp_extract("request", 'about "([^"]*)"', 1)
    made = docgen.generate(asked, agent.Template(F.to_json(F.struct(title.alias("title"))))).collect()
    assert sorted((r.topic or "", (r.document or "").split("\n")[0]) for r in made) == [("", ""), ("One", "# One"), ("Three", "# Three"), ("Three", "# Three"), ("Two", "# Two"), ("x", "")]


def test_compaction_of_equal_turns_is_settled(spark):
    log = spark.createDataFrame([(1, 0, "user", c * 8, None, None, None) for c in "abcdef"], LOG)
    got = {tuple(sorted(r.content for r in conversation.compact(log.repartition(n), 6).collect())) for n in (1, 2, 5)}
    assert got == {("d" * 8, "e" * 8, "f" * 8)}


# -- texts ------------------------------------------------------------------------------


def test_trimming_is_linear(spark):
    inner = "a" + " " * 1_000_000 + "b"
    ticks = "```" * 200_000 + "x" + "```" * 3
    start = time.time()
    row = spark.createDataFrame([(" \t　" + inner + " \n", ticks)], "a string, b string").select(text.trim_space(F.col("a")).alias("a"), text.strip_all_suffixes(F.col("b"), "```").alias("b"), text.unfence(F.col("a")).alias("c")).head()
    assert (row.a, row.b, row.c) == (inner, "```" * 200_000 + "x", inner) and time.time() - start < 30
    odd = spark.createDataFrame([("\x1ca\x85",), (" ",), ("",), (None,)], "a string").select(text.trim_space(F.col("a")).alias("a")).collect()
    assert [r.a for r in odd] == ["\x1ca", "", "", None]


def test_only_whole_json_is_json(spark):
    texts = ["1", "null", '"a"', "[1, 2]", '{"a": 1}', " true ", "", " ", "1, 2", "1] , [2", '1,"x"],["', '"a","b', "}", '{"a":1}}', "{", "1 2", '1,"c4ca4238a0b923820dcc509a6f75849b"', None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.to_json(jsons.parsed(F.col("t"))).alias("j"), jsons.parsed(F.col("t")).isNotNull().alias("ok"))
    assert {texts[r.k] for r in rows.collect() if r.ok} == {"1", "null", '"a"', "[1, 2]", '{"a": 1}', " true "}


def test_tool_definitions_from_rows(spark):
    rows = [(1, "a", "old", ["x"], ["x"]), (2, "a", "new", ["y", "z"], ["z"]), (0, "b", None, [], [])]
    got = {r.name: (r.description, json.loads(r.parameters)) for r in tools.definition_rows(spark.createDataFrame(rows, "seq int, name string, description string, properties array<string>, required array<string>")).collect()}
    text_ = {"type": "string"}
    assert got == {"a": ("new", {"type": "object", "properties": {"y": text_, "z": text_}, "required": ["z"]}), "b": (None, {"type": "object", "properties": {}, "required": []})}


def test_recordings_of_one_request_answer_once(spark):
    log = spark.createDataFrame([(c, 0, "user", "same", None, None, None) for c in range(3)], LOG)
    key = agent.requests(log).select(agent.request_key(F.col("request")).alias("request_sha"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("content"), F.lit(None).cast(TOOL_CALLS).alias("tool_calls"))
    out = agent.run(log, agent.Recorded(key), tools.Registry())[1].collect()
    assert sorted((r.conv_id, r.answer) for r in out) == [(0, "r0"), (1, "r0"), (2, "r0")]


def test_tools_from_sql_tell_what_execute_tells(spark, tmp_path):
    (tmp_path / "x").write_text("42")
    registry = tools.file_tools()
    tools.register_sql(spark, registry)
    rows = [("read_file", f'{{"path": "{tmp_path}/x"}}'), ("read_file", '{"path": "/no/such"}'), ("read_file", '{"path": 5}'), ("read_file", "{"), ("read_file", "[1]"), ("nope", "{}"), (None, None), ("read_file", None)]
    df = spark.createDataFrame([(k, *r, "old") for k, r in enumerate(rows)], "k int, name string, arguments string, output string")
    got = {r.k: (r.output, r.failure, r.problem) for r in spark.sql("SELECT * FROM call_tools(TABLE({calls}))", calls=df).collect()}
    want = {r.k: (r.result and r.result.output, r.result and r.result.error, r.error and r.error.message) for r in registry.execute(df).collect()}
    assert got == want and got[0] == ("42", None, None)
    with pytest.raises(Exception, match="needs the column arguments"):
        spark.sql("SELECT * FROM call_tools(TABLE({calls}))", calls=df.drop("arguments")).collect()


def test_run_command(spark, tmp_path, capfd, monkeypatch):
    from docloom import cli

    plan = {"name": "n", "description": "d", "steps": [{"id": i, "description": "s", "action": {"type": "agent_task", "params": {"prompt": p}}, "dependencies": d} for i, p, d in (("b", "Second", ["a"]), ("a", "First", []), ("c", "Third", ["b"]))]}
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    first = agent.requests(spark.createDataFrame([("p", 0, "user", "First", None, None, None)], LOG.replace("conv_id long", "conv_id string")))
    second = agent.requests(spark.createDataFrame([("p", k, r, c, None, None, None) for k, (r, c) in enumerate([("user", "First"), ("assistant", "One."), ("user", "Second")])], LOG.replace("conv_id long", "conv_id string")))
    answers = [{"request_sha": df.select(agent.request_key(F.col("request"))).head()[0], "content": c} for df, c in ((first, "One."), (second, "Two."))]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    monkeypatch.chdir(tmp_path)
    cli.main(["run", str(tmp_path / "plan.json"), "--answers", str(tmp_path / "answers.jsonl")])
    out = capfd.readouterr().out
    assert "One." in out and "Two." in out and "failed" in out and "step c: no answer" in out
    cli.main(["run", str(tmp_path / "plan.json")])
    assert re.search(r"\|2 *\|2 *\|c *\|", capfd.readouterr().out)
