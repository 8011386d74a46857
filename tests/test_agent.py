import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom import config
from docloom.errors import DocloomError
from docloom.model import LOG
from docloom.operators import agent, conversation, docgen, tools


def log(spark, rows):
    return spark.createDataFrame([(c, t, r, x, None, None, None) for c, t, r, x in rows], LOG)


def test_messages(spark):
    for role in ("user", "system", "assistant"):
        m = spark.range(1).select(conversation.message(role, F.lit("hi")).alias("m")).head().m
        assert (m.role, m.content, m.tool_calls) == (role, "hi", None)


def test_log_grows_and_clears(spark):
    one = log(spark, [(1, 0, "user", "Hello")])
    more = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), conversation.message("assistant", F.lit("Hi there")).alias("message"), F.lit(0).alias("ord"))
    two = conversation.append(one, more)
    assert [(r.turn, r.role) for r in two.orderBy("turn").collect()] == [(0, "user"), (1, "assistant")]
    assert conversation.cleared(two, two.select("conv_id")).count() == 0


def test_compaction_to_nothing(spark):
    long = log(spark, [(1, 0, "user", "a" * 40)])
    assert conversation.token_totals(long).head().tokens == 10
    assert conversation.compaction_flags(long, 5).head().compacted
    assert conversation.compact(long, 5).count() == 0


def test_compaction_random(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice("aé漢") * rng.randint(0, 30)) for c in range(30) for t in range(rng.randint(0, 8))]
    want = set()
    for c in range(30):
        left = [r for r in rows if r[0] == c]
        while left and sum(len(r[3].encode()) for r in left) // 4 > 12:
            left.pop(0)
        want |= {(c, r[1]) for r in left}
    assert {(r.conv_id, r.turn) for r in conversation.compact(log(spark, rows), 12).collect()} == want


def test_wire_json(spark):
    rows = [r.json for r in conversation.wire_json(log(spark, [(1, 0, "user", 'say "x"')])).collect()]
    assert rows == ['{"role":"user","content":"say \\"x\\"","tool_call_id":null}']


def test_file_tools(spark, tmp_path):
    path = str(tmp_path / "f.txt")
    registry = tools.file_tools()

    def call(name, arguments):
        df = spark.createDataFrame([("c1", name, arguments)], "id string, name string, arguments string")
        return registry.execute(df).head()

    wrote = call("write_file", f'{{"path": "{path}", "content": "Hello Tool"}}')
    assert wrote.error is None and "Successfully wrote" in wrote.result.output
    assert call("read_file", f'{{"path": "{path}"}}').result.output == "Hello Tool"
    gone = call("read_file", '{"path": "/no/such"}')
    assert gone.error is None and gone.result.error == "File not found: /no/such" and gone.result.output == ""
    assert call("read_file", '{"path": 5}').error.message == "Missing path parameter"
    assert call("read_file", "{").error.message.startswith("Invalid arguments")
    assert call("unknown", "{}").error.message == "Tool not found: unknown"
    assert [r.name for r in registry.definitions(spark).collect()] == ["read_file", "write_file"]


def test_refused_calls_have_no_effect(spark, tmp_path):
    """Neither a call of another tool nor one that is refused writes, and a good one writes once."""
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text("old")
    rows = [
        ("read_file", f'{{"path": "{tmp_path}/a", "content": "new"}}'), ("delete_file", f'{{"path": "{tmp_path}/b", "content": "new"}}'),
        ("write_file", f'{{"path": "{tmp_path}/c"}}'), ("write_file", f'{{"path": "{tmp_path}/d", "content": "new"}}'), (None, None),
    ]
    done = tools.file_tools().execute(spark.createDataFrame(rows, "name string, arguments string")).checkpoint()
    assert [(tmp_path / n).read_text() for n in ("a", "b", "c", "d")] == ["old"] * 3 + ["new"]
    got = {r.name: r for r in done.filter("error is null").collect()}
    assert got["read_file"].result.output == "old" and set(got) == {"read_file", "write_file"}
    assert sorted(r.error.message for r in done.filter("error is not null").collect()) == ["Missing content parameter", "Tool not found: ", "Tool not found: delete_file"]


def test_effects_happen_once(spark, tmp_path):
    log_file = f"{tmp_path}/calls"

    @F.pandas_udf("struct<output:string,error:string>")
    def note(a: pd.Series) -> pd.DataFrame:
        with open(log_file, "a") as f:
            f.writelines(f"{x}\n" for x in a)
        return pd.DataFrame([(x, None) for x in a], columns=["output", "error"])

    registry = tools.Registry()
    registry.register(tools.Tool("note", "", "{}", note.asNondeterministic()))
    calls = spark.createDataFrame([("note", f'{{"k": {k}}}') for k in range(5)] + [("other", "{}")], "name string, arguments string")
    done = registry.execute(calls).checkpoint()
    assert done.filter("error is null").count() == 5 and done.filter("result.output like '%3%'").count() == 1
    with open(log_file) as f:
        assert sorted(f) == [f'{{"k": {k}}}\n' for k in range(5)]


def test_responder_by_settings(spark):
    asked = log(spark, [(1, 0, "user", "q")])
    made = agent.responder(config.Config(responder="template"), content=F.lit("a"))
    assert agent.run(asked, made, tools.Registry())[1].head().answer == "a"
    for settings in (config.Config(responder="live"), config.Config(responder="recorded")):
        with pytest.raises(DocloomError):
            agent.responder(settings)


CALL = "array(named_struct('id', 'c', 'function', named_struct('name', '{}', 'arguments', '{}')))"


def test_answer_without_calls(spark):
    grown, out = agent.run(log(spark, [(1, 0, "user", "q"), (2, 0, "user", "r")]), agent.Template(F.lit("a")), tools.Registry())
    assert {(r.conv_id, r.answer) for r in out.collect()} == {(1, "a"), (2, "a")} and grown.count() == 4


def test_rounds_end(spark):
    always = agent.Template(F.lit(""), F.expr(CALL.format("read_file", '{"path": "/no/such"}')))
    grown, out = agent.run(log(spark, [(1, 0, "user", "q")]), always, tools.file_tools())
    assert out.head().error.message == "no answer after 5 rounds" and grown.count() == 11
    assert [r.content for r in grown.filter("role = 'tool'").collect()] == [""] * 5


def test_unknown_tool_ends_a_conversation(spark):
    grown, out = agent.run(log(spark, [(1, 0, "user", "q")]), agent.Template(F.lit(""), F.expr(CALL.format("nope", "{}"))), tools.file_tools())
    assert out.head().error.message == "Tool not found: nope" and grown.count() == 2


def test_tool_then_answer(spark, tmp_path):
    (tmp_path / "x").write_text("42")
    calls = F.expr(CALL.format("read_file", f'{{"path": "{tmp_path}/x"}}'))
    responder = agent.Template(F.when(F.col("request").contains('"tool"'), "it is 42").otherwise(""), F.when(~F.col("request").contains('"tool"'), calls))
    grown, out = agent.run(log(spark, [(1, 0, "user", "q")]), responder, tools.file_tools())
    assert out.head().answer == "it is 42"
    assert [(r.role, r.content, r.tool_call_id) for r in grown.orderBy("turn").collect()][2] == ("tool", "42", "c")


def test_recorded_and_missing(spark):
    asked = log(spark, [(1, 0, "user", "q"), (2, 0, "user", "other")])
    key = agent.requests(asked).filter("conv_id = 1").select(agent.request_key(F.col("request")).alias("request_sha"), F.lit("yes").alias("content"), F.lit(None).alias("tool_calls"))
    out = {r.conv_id: r for r in agent.run(asked, agent.Recorded(key), tools.Registry())[1].collect()}
    assert out[1].answer == "yes" and out[2].error.kind == "provider.api"


def test_prompts(spark):
    df = spark.createDataFrame([(1, 0, " a "), (1, 1, " "), (1, 2, "EXIT"), (1, 3, "b"), (2, 0, "c")], "conv_id int, turn int, text string")
    assert [(r.conv_id, r.prompt) for r in agent.prompts(df).orderBy("conv_id").collect()] == [(1, "a"), (2, "c")]


def test_generate(spark):
    asked = spark.createDataFrame([(1, "how_to", "Do It", "ctx"), (2, "poem", "x", "c"), (3, "reference", "a/b", "c")], "id long, category string, topic string, context string")
    out = {r.id: r for r in docgen.generate(asked, agent.Template(F.lit('```json\n{"title": "do it", "steps": ["a"]}\n```'))).collect()}
    assert out[1].document.startswith("# How to do it\n") and out[1].file == "do_it.md"
    assert out[2].error.message == "unknown category: poem" and "no file name" in out[3].error.message
    bad = docgen.generate(asked, agent.Template(F.lit("sorry"))).filter("id = 1").head()
    assert bad.document is None and "not JSON" in bad.error.message


def test_config(tmp_path, monkeypatch):
    assert (config.load(tmp_path / "none").responder, config.load(tmp_path / "none").max_rounds) == ("recorded", 5)
    (tmp_path / "c.yaml").write_text("max_rounds: 7\n")
    monkeypatch.setenv(config.ENVIRONMENT, "template")
    assert (config.load(tmp_path / "c.yaml").max_rounds, config.load(tmp_path / "c.yaml").responder) == (7, "template")
