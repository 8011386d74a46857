"""Queries of whole dataflows: plans from files, agent rounds, tools, sources, sinks and streams.

Importing this module adds them to ``queries.QUERIES``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsons
from .functions.render import render_variant
from .functions.text import extension, utf8_lossy, utf8_strict, with_extension
from .model import TOOL_CALLS
from .operators import agent, conversation, docgen, tools
from .plans import parse, waves
from .queries import _WAVES, _cut, _sql_escape, _steps, log_of, query, table
from .sources import documents, files
from .streaming import chunks


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that executors and driver share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- plans from texts -----------------------------------------------------------


def _plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a plan file: JSON, YAML, Markdown with either, and three kinds of wrong ones.

    Parsing takes far more time than bytes, so the files are dealt out by number.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.col("o_orderkey") % 8
    action = F.when(kind == 5, "agent_tasks").otherwise("agent_task")

    def text(x: Column) -> Column:
        return x.cast("string")

    name = F.concat(F.lit("order "), text(F.col("o_orderkey")))
    step_json = lambda s: F.concat(
        F.lit('{"id": "'), text(s["l_linenumber"]), F.lit('", "description": "part '), text(s["l_partkey"]), F.lit('", "action": {"type": "'), action,
        F.lit('", "params": {"prompt": "p"}}, "dependencies": ['), F.when(s["l_linenumber"] > 1, F.concat(F.lit('"'), text(s["l_linenumber"] - 1), F.lit('"'))).otherwise(""), F.lit("]}"),
    )
    as_json = F.concat(F.lit('{"name": "'), name, F.lit('", "description": "d", "steps": ['), F.array_join(F.transform("lines", step_json), ", "), F.lit("]}"))
    step_yaml = lambda s: F.concat(
        F.lit('  - id: "'), text(s["l_linenumber"]), F.lit('"\n    description: part '), text(s["l_partkey"]), F.lit("\n    action: {type: agent_task, params: {prompt: p}}\n    dependencies: ["),
        F.when(s["l_linenumber"] > 1, F.concat(F.lit("'"), text(s["l_linenumber"] - 1), F.lit("'"))).otherwise(""), F.lit("]\n"),
    )
    as_yaml = F.concat(F.lit("name: "), name, F.lit("\ndescription: d\nsteps:\n"), F.array_join(F.transform("lines", step_yaml), ""))
    content = (
        F.when(kind.isin(0, 4, 5), as_json)
        .when(kind == 1, as_yaml)
        .when(kind == 2, F.concat(F.lit("# Plan\r\n\r\n```yaml\r\n"), as_yaml, F.lit("```\nrest\n")))
        .when(kind == 3, F.concat(F.lit("text\n  ``` json \n"), as_json))
        .when(kind == 6, F.concat(F.lit("```\n```\n```json\n"), as_json, F.lit("\n```")))
        .otherwise(F.concat(as_json, F.lit("}")))
    )
    form = F.when(kind == 1, "yml").when(kind.isin(2, 3, 6), "md").when(kind == 4, "toml").otherwise("json")
    made = orders.select(text(F.col("o_orderkey")).alias("path"), form.alias("format"), content.alias("content"))
    return made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 8 < 4 THEN 'order ' || o_orderkey END AS name, CASE WHEN o_orderkey % 8 < 4 THEN n END AS n_steps,
  CASE o_orderkey % 8 WHEN 4 THEN 'Unsupported format: toml' WHEN 5 THEN 'unknown action' WHEN 6 THEN 'No code block found in markdown' WHEN 7 THEN 'not valid JSON' END AS problem
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = parse.parse_plans(_plan_files(spark, sf_dir))
    return plans.select("path", F.col("plan.name").alias("name"), F.when(F.col("plan").isNotNull(), F.size("plan.steps")).cast("long").alias("n_steps"), F.col("error.message").alias("problem"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS plan, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS ord, CAST(l_linenumber AS VARCHAR) AS id,
  'part ' || l_partkey AS description, 'agent_task' AS action, 'p' AS prompt, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS VARCHAR) ELSE '' END AS needs
FROM lineitem WHERE l_orderkey % 8 < 4 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = parse.steps(parse.parse_plans(_plan_files(spark, sf_dir)))
    return steps.select("plan", "ord", "id", "description", F.col("action.type").alias("action"), F.col("action.params.prompt").alias("prompt"), F.array_join("deps", ",").alias("needs"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS plan, 'out ' || o_orderkey AS name, o_orderpriority AS description, 'docs/' || o_orderkey || '.md' AS path
FROM orders WHERE o_orderkey % 3 = 0""")
def plan_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans without steps; those of a third have a deliverable."""
    key = F.col("o_orderkey").cast("string")
    listed = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.concat(F.lit("out "), key).alias("name"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("docs/"), key, F.lit(".md")).alias("path"))))
    plan = F.struct(F.lit("n").alias("name"), F.lit("d").alias("description"), F.array().cast("array<string>").alias("steps"), listed.alias("deliverables"))
    asked = table(spark, sf_dir, "orders").select(key.alias("path"), F.lit("json").alias("format"), F.to_json(plan).alias("content"))
    return parse.deliverables(parse.parse_plans(asked))


@query("""
WITH steps AS (SELECT l_orderkey AS plan, l_linenumber AS id, min(ord) AS ord, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem) GROUP BY 1, 2),
twice AS (SELECT plan, 0 AS rank, ord, 'Duplicate step ID: ' || id AS problem FROM steps WHERE n > 1),
unknown AS (SELECT s.plan, 1 AS rank, s.ord, 'Step ' || s.id || ' depends on unknown step ' || (s.id - 1) AS problem
  FROM steps s LEFT JOIN steps t ON s.plan = t.plan AND t.id = s.id - 1 WHERE s.id > 1 AND t.id IS NULL)
SELECT plan, problem FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY rank, ord) AS k FROM (SELECT * FROM twice UNION ALL SELECT * FROM unknown)) WHERE k = 1""")
def plan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.validate(_steps(spark, sf_dir))


@query(_WAVES + """
SELECT l.plan, d.wave, l.ord, l.id FROM (
  SELECT l_orderkey AS plan, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord, CAST(l_linenumber AS VARCHAR) AS id FROM lineitem) l
JOIN done d ON d.plan = l.plan AND d.id = l.id""")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.schedule(_steps(spark, sf_dir), checkpoint=_cut(spark)).filter("wave is not null").select("plan", "wave", "ord", "id")


# -- conversations ----------------------------------------------------------------


@query("""
SELECT conv_id, turn, '{"role":' || to_json(role) || CASE WHEN text IS NULL THEN '' ELSE ',"content":' || to_json(text) END || ',"tool_call_id":null}' AS json FROM conversations""")
def wire_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = {"name": F.lit(None).cast("string"), "tool_calls": F.lit(None).cast(TOOL_CALLS), "tool_call_id": F.lit(None).cast("string")}
    return conversation.wire_json(log_of(spark, sf_dir).withColumns(nothing))


@query("""
SELECT conv_id, turn, role, text AS content FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'noted' FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, max(turn) + 2, 'user', 'thanks' FROM conversations GROUP BY 1""")
def conv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages behind each conversation's last turn."""
    log = _log(spark, sf_dir)
    ids = log.select("conv_id").distinct()
    more = ids.select("conv_id", conversation.message("user", F.lit("thanks")).alias("message"), F.lit(1).alias("ord"))
    more = more.unionByName(ids.select("conv_id", conversation.message("assistant", F.lit("noted")).alias("message"), F.lit(0).alias("ord")))
    return conversation.append(log, more).select("conv_id", "turn", "role", "content")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 6)")
def conv_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return conversation.cleared(log, log.groupBy("conv_id").count().filter("count > 6")).select("conv_id", "turn", "role")


@query("""
SELECT conv_id, turn, prompt FROM (
  SELECT conv_id, turn, trim(text) AS prompt, max(CASE WHEN turn % 7 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS gone
  FROM conversations) WHERE gone = 0 AND prompt <> ''""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines are an exit word, in any case and with white space around it."""
    t = F.col("turn")
    word = F.when(t % 7 == 5, F.get(F.array(F.lit(" exit"), F.lit("QUIT\n"), F.lit("\tExit ")), (F.col("conv_id") % 3).cast("int")))
    lines = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(word, F.concat(F.lit("  "), "text", F.lit(" "))))
    return agent.prompts(lines)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return log.select("conv_id", "turn", "role", "content", F.lit(None).cast("string").alias("name"), F.lit(None).cast(TOOL_CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))


# -- agents and tools ---------------------------------------------------------------


def _counting() -> tools.Registry:
    """Tools that are expressions: the length of a text, and one that always fails."""
    out = tools.Registry()
    schema = tools._schema(text="Any text")
    out.register(tools.Tool("measure", "Count code points", schema, lambda a: tools.result(F.length(tools.argument(a, "text")).cast("string"), F.lit(None)), ("text",), native=True))
    out.register(tools.Tool("refuse", "Fail", tools._schema(), lambda a: tools.result(F.lit(None), F.lit("refused")), (), native=True))
    return out


@query("""
WITH sizes AS (SELECT conv_id, count(*) AS n, conv_id % 5 AS k FROM conversations GROUP BY 1)
SELECT conv_id, CASE k WHEN 0 THEN 'plain' WHEN 1 THEN 'length 5' WHEN 3 THEN 'length ' END AS answer,
  CASE k WHEN 2 THEN 'Tool not found: nope' WHEN 4 THEN 'no answer after 5 rounds' END AS problem,
  CAST(n + CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 10 END AS BIGINT) AS n_messages
FROM sizes""")
def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that are answered at once, after a tool, after a tool that fails, never, or that ask for a tool that is none."""
    _cut(spark)
    kind = F.col("conv_id") % 5
    said = F.regexp_extract("request", r'\{"role":"tool"(?:,"content":"([^"]*)")?\}\]$', 1)
    answered = F.col("request").contains('{"role":"tool"')
    call = lambda name, arguments: F.array(F.struct(F.lit("c").alias("id"), F.struct(F.lit(name).alias("name"), F.lit(arguments).alias("arguments")).alias("function")))
    calls = (
        F.when((kind == 1) & ~answered, call("measure", '{"text": "abcde"}')).when(kind == 2, call("nope", "{}"))
        .when((kind == 3) & ~answered, call("refuse", "{}")).when(kind == 4, call("measure", '{"text": ""}'))
    )
    content = F.when(kind == 0, "plain").when(answered, F.concat(F.lit("length "), said)).otherwise("")
    grown, outcomes = agent.run(_log(spark, sf_dir), agent.Template(content, calls), _counting())
    n = grown.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return outcomes.select("conv_id", "answer", F.col("error.message").alias("problem")).join(n, "conv_id")


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(len(event_type) AS VARCHAR) WHEN 5 THEN '' END AS output, CASE WHEN event_id % 6 = 5 THEN 'refused' END AS failure,
  CASE event_id % 6 WHEN 1 THEN 'Missing text parameter' WHEN 2 THEN 'Invalid arguments: {"text": ' WHEN 3 THEN 'Tool not found: ' || event_type WHEN 4 THEN 'Missing text parameter' END AS problem
FROM events""")
def tool_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are right, lack a parameter, are no JSON, name no tool, have a number for a text, or fail."""
    kind = F.col("event_id") % 6
    name = F.when(kind == 3, F.col("event_type")).when(kind == 5, "refuse").otherwise("measure")
    arguments = F.when(kind.isin(1, 5), "{}").when(kind == 2, '{"text": ').when(kind == 4, '{"text": 7}').otherwise(F.to_json(F.struct(F.col("event_type").alias("text"))))
    calls = table(spark, sf_dir, "events").select("event_id", name.alias("name"), arguments.alias("arguments"))
    done = _counting().execute(calls)
    return done.select("event_id", F.col("result.output").alias("output"), F.col("result.error").alias("failure"), F.col("error.message").alias("problem"))


@query("""
SELECT event_id, 'tool' AS role, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS content, 'measure' AS name, 'c' || event_id AS tool_call_id,
  CASE WHEN event_id % 2 = 1 THEN 'failed' END AS failure FROM events""")
def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as messages; a failed one's text is empty and its error stays in the result."""
    good = F.col("event_id") % 2 == 0
    made = tools.result(F.when(good, F.col("event_type")), F.when(~good, "failed"))
    message = tools.result_message(F.concat(F.lit("c"), F.col("event_id").cast("string")), F.lit("measure"), F.col("r"))
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("r")).select("event_id", "r", message.alias("m"))
    return rows.select("event_id", "m.role", "m.content", "m.name", "m.tool_call_id", F.col("r.error").alias("failure"))


@query("""
WITH said AS (SELECT event_type, event_id, 'last by user ' || user_id AS description, list_sort(json_keys(props)) AS names FROM events),
last AS (SELECT event_type AS name, arg_max(description, event_id) AS description, arg_max(names, event_id) AS names FROM said GROUP BY 1)
SELECT name, description, '{"type":"object","properties":{' || array_to_string(list_transform(names, lambda n: to_json(n) || ':{"type":"string"}'), ',')
  || '},"required":[' || array_to_string(list_transform(names, lambda n: to_json(n)), ',') || ']}' AS parameters FROM last""")
def tool_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools that events name; a later event of a name registers it again, with the fields of its props."""
    names = F.array_sort(F.json_object_keys("props"))
    said = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.concat(F.lit("last by user "), F.col("user_id").cast("string")).alias("description"), names.alias("properties"), names.alias("required")
    )
    return tools.definition_rows(said)


@query("""
SELECT event_id, responder, coalesce(given, model) AS model, tools, streaming, CASE WHEN model IS NULL THEN 'Unknown provider: ' || responder END AS problem
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'recorded' WHEN 1 THEN 'template' ELSE event_type END AS responder, CASE WHEN event_id % 2 = 0 THEN 'own' END AS given FROM events)
LEFT JOIN (VALUES ('recorded', 'recordings', true, false), ('template', 'expression', true, false)) t(name, model, tools, streaming) ON name = responder""")
def responder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    asked = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == 0, "recorded").when(kind == 1, "template").otherwise(F.col("event_type")).alias("responder"), F.when(F.col("event_id") % 2 == 0, "own").alias("model")
    )
    return agent.chosen(asked).select("event_id", "responder", "model", "tools", "streaming", F.col("error.message").alias("problem"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS content,
  CASE event_id % 6 WHEN 2 THEN 'no message in the answer' WHEN 3 THEN 'status 500' WHEN 4 THEN 'status unknown' WHEN 5 THEN 'no message in the answer' END AS problem
FROM events""")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers of both forms, one without choices, two with bad states, and one that is no JSON."""
    kind = F.col("event_id") % 6
    one = F.concat(F.lit('{"message":{"role":"assistant","content":"'), "event_type", F.lit('"}}'))
    first = F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":"'), "event_type", F.lit('"}},{"message":{"role":"assistant","content":"no"}}]}'))
    body = F.when(kind == 1, first).when(kind == 2, '{"choices":[]}').when(kind == 5, "<html>").otherwise(one)
    status = F.when(kind == 3, 500).when(kind == 4, F.lit(None)).when(kind == 1, 201).otherwise(200)
    answers = table(spark, sf_dir, "events").select("event_id", status.cast("int").alias("status"), body.alias("body"))
    return chunks.completions(answers).select("event_id", "content", F.col("error.message").alias("problem"))


@query("""
SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS content, count(*) AS n FROM events GROUP BY 1""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines from files, read as a stream, mapped and written; then counted."""
    kind = F.col("event_id") % 3
    line = F.when(kind == 0, F.concat(F.lit('data: {"choices":[{"delta":{"role":"assistant","content":"'), "event_type", F.lit('"}}]}'))).when(kind == 1, "data: [DONE]").otherwise(": keep-alive")
    lines, out, marks = (_folder(spark, name) for name in ("lines", "chunks", "progress"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(lines)
    done = chunks.event_stream(spark, lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("content string").parquet(out).groupBy("content").agg(F.count("*").alias("n"))


# -- documents ------------------------------------------------------------------------


@query(f"""
SELECT p_partkey, '# ' || {_sql_escape("p_name")} || chr(10) || chr(10) || '## Overview' || chr(10) || {_sql_escape("p_type")} || chr(10) || chr(10)
  || '## Concepts' || chr(10) || '&lt;' || {_sql_escape("p_brand")} || '&gt;' || chr(10) || chr(10) || '## Architecture' || chr(10) || chr(10) || chr(10)
  || '## Design Decisions' || chr(10) || p_size || chr(10) AS document FROM part""")
def doc_render_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("overview"), F.concat(F.lit("<"), "p_brand", F.lit(">")).alias("concepts"), F.col("p_size").alias("design_decisions")))
    return table(spark, sf_dir, "part").select("p_partkey", render_variant(F.lit("explanation"), jsons.parsed(answer)).alias("document"))


@query(f"""
SELECT p_partkey, category, CASE k WHEN 3 THEN p_partkey || '/x.md' ELSE 'part_' || p_partkey || '.md' END AS file,
  CASE WHEN k = 0 THEN '# Part ' || p_partkey || chr(10) || chr(10) || '## Description' || chr(10) || {_sql_escape("p_brand")} || chr(10) || chr(10) || '## Usage' || chr(10) || chr(10) || chr(10)
    || '## API' || chr(10) || chr(10) || chr(10) || '## Examples' || chr(10) || chr(10) END AS document,
  CASE k WHEN 1 THEN 'answer is not JSON: sorry' WHEN 2 THEN 'unknown category: poem' WHEN 3 THEN 'topic is no file name: ' || p_partkey || '/x' END AS problem
FROM (SELECT *, p_partkey % 4 AS k, CASE WHEN p_partkey % 4 = 2 THEN 'poem' ELSE 'reference' END AS category FROM part)""")
def doc_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to documents: good ones, an answer that is no JSON, a category and a topic that are refused."""
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    topic = F.when(kind == 3, F.concat(key, F.lit("/x"))).otherwise(F.concat(F.lit("Part "), key))
    asked = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(kind == 2, "poem").otherwise("reference").alias("category"), topic.alias("topic"), docgen.repository_context(F.col("p_brand")).alias("context")
    )
    found = lambda pattern: F.regexp_extract("request", pattern, 1)
    answer = F.to_json(F.struct(found('about "([^"]*)"').alias("title"), found("Repository at ([^\n]*)\n").alias("description")))
    responder = agent.Template(F.when(found('about "Part ([0-9]+)"').try_cast("long") % 4 == 1, "```\nsorry\n```").otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```"))))
    return docgen.generate(asked, responder).select(F.col("id").alias("p_partkey"), "category", "file", "document", F.col("error.message").alias("problem"))


@query("""
SELECT 'docs/reference/' || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '_' END || p_partkey || '.md' AS path, 'ü ' || p_name || chr(13) || chr(10) AS content,
  CAST(strlen('ü ' || p_name) + 2 AS BIGINT) AS length FROM part""")
def doc_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one file each, and read again as a tree, with names that Spark's own sources leave out."""
    files.register(spark)
    folder = _folder(spark, "documents")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("_"), F.col("p_partkey").cast("string"), F.lit(".md"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("docs/reference/"), name).alias("path"), F.concat(F.lit("ü "), "p_name", F.lit("\r\n")).alias("content"))
    documents.dealt(rows).write.format("documents").mode("append").save(folder)
    return spark.read.format("tree").load(folder).select("path", utf8_strict(F.col("content")).alias("content"), "length")


@query("""
SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN '' WHEN 2 THEN 'src/deep/' ELSE 'docs/' END || 'f' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.py' ELSE '.txt' END AS path
FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 4 = 2) AND p_partkey % 4 <> 3""")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files: one folder is left out by a rule, and in another *.py by its own ignore file."""
    files.register(spark)
    folder = _folder(spark, "tree")
    kind = F.col("p_partkey") % 4
    place = F.concat(F.when(kind == 0, "src/").when(kind == 1, "").when(kind == 2, "src/deep/").otherwise("docs/"), F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".py").otherwise(".txt"))
    rows = table(spark, sf_dir, "part").select(place.alias("path"), F.lit("x").alias("content"))
    rules = spark.createDataFrame([("src/deep/.gitignore", "*.py\n.gitignore\n")], "path string, content string")
    documents.dealt(rows.unionByName(rules)).write.format("documents").mode("append").save(folder)
    return spark.read.format("tree").option("ignore", "/docs/").option("content", "false").load(folder).select("path")


# -- texts ------------------------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(65533) END AS lossy, CASE WHEN doc_id % 2 = 0 THEN text END AS strict FROM documents""")
def utf8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of texts, every other one with a byte that is no UTF-8 at its end."""
    data = F.encode("text", "UTF-8")
    data = F.when(F.col("doc_id") % 2 == 0, data).otherwise(F.concat(data, F.unhex(F.lit("FF"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("b"))
    return rows.select("doc_id", utf8_lossy("b").alias("lossy"), utf8_strict(F.col("b")).alias("strict"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'md' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'gz' END AS ext,
  CASE p_partkey % 4 WHEN 0 THEN 'n' || p_partkey || '.md' WHEN 1 THEN 'n' || p_partkey || '.md' WHEN 2 THEN '.n' || p_partkey || '.md' ELSE 'n' || p_partkey || '.tar.md' END AS file, 'Repository at ' || p_brand AS context
FROM part""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("p_partkey") % 4, F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    name = F.when(kind == 0, F.concat(key, F.lit(".md"))).when(kind == 1, key).when(kind == 2, F.concat(F.lit("."), key)).otherwise(F.concat(key, F.lit(".tar.gz")))
    return table(spark, sf_dir, "part").select("p_partkey", extension(F.concat(F.lit("a.b/"), name)).alias("ext"), with_extension(name, "md").alias("file"), docgen.repository_context(F.col("p_brand")).alias("context"))


@query("""
SELECT conv_id, n, CASE WHEN n >= 5 THEN 5 ELSE n END AS calls, n > 5 AS over FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)""")
def call_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation, counted up to the most rounds of a run."""
    return conversation.call_counts(log_of(spark, sf_dir), agent.MOST_ROUNDS)
