"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import errors
from .functions import jsons
from .functions.render import HOW_TO_STEPS, TUTORIAL_STEPS, render, render_variant
from .functions.text import document_path, first_block, safe_name, topic_file, trim_space, unfence
from .model import CATEGORIES
from .operators import conversation, docgen, tools
from .plans import waves
from .streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BUDGET = 256


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


# -- conversations ------------------------------------------------------------


@query("SELECT conv_id, CAST(coalesce(sum(strlen(text)), 0) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conv_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.token_totals(log_of(spark, sf_dir))


@query(f"""
SELECT conv_id, turn, role, text AS content FROM (
  SELECT *, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix
  FROM conversations) WHERE suffix // 4 <= {BUDGET}""")
def conv_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.compact(log_of(spark, sf_dir), BUDGET)


@query(f"SELECT conv_id, coalesce(sum(strlen(text)), 0) // 4 > {BUDGET} AS compacted FROM conversations GROUP BY conv_id")
def conv_compaction_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.compaction_flags(log_of(spark, sf_dir), BUDGET)


@query("SELECT conv_id, turn, lower(role) AS role, text AS content FROM conversations")
def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.wire_messages(log_of(spark, sf_dir))


@query("""
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_answers,
       max(turn) AS last_turn, string_agg(role, ' ' ORDER BY turn) AS roles
FROM conversations GROUP BY conv_id""")
def conv_log_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]), " ")
    return log_of(spark, sf_dir).groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "assistant").alias("n_answers"), F.max("turn").alias("last_turn"), roles.alias("roles")
    )


# -- plans: an order is a plan, a line number a step that needs the one before ---


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = waves.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    n = F.col("l_linenumber")
    deps = F.when(n > 1, F.array((n - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_orderkey").alias("plan"), order.alias("ord"), n.cast("string").alias("id"), deps.alias("deps"))


_WAVES = """
WITH ids AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber AS n FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY n) AS r FROM ids),
done AS (SELECT plan, CAST(n AS VARCHAR) AS id, CAST(n - 1 AS BIGINT) AS wave FROM ranked WHERE n = r)
"""


@query(_WAVES + "SELECT plan, id, wave FROM done")
def plan_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.waves(_steps(spark, sf_dir), checkpoint=_cut(spark))


@query(_WAVES + """
SELECT s.plan, s.n_steps, coalesce(d.n_done, 0) AS n_done, coalesce(d.n_done, 0) <> s.n_steps AS deadlocked
FROM (SELECT l_orderkey AS plan, count(*) AS n_steps FROM lineitem GROUP BY 1) s
LEFT JOIN (SELECT plan, count(DISTINCT id) AS n_done FROM done GROUP BY 1) d ON s.plan = d.plan""")
def plan_deadlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.stalled(waves.schedule(_steps(spark, sf_dir), checkpoint=_cut(spark)))


@query("SELECT l_orderkey AS plan, CAST(l_linenumber AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def plan_validate_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.duplicate_ids(_steps(spark, sf_dir))


@query("""
SELECT DISTINCT l.l_orderkey AS plan, CAST(l.l_linenumber AS VARCHAR) AS id, CAST(l.l_linenumber - 1 AS VARCHAR) AS dep
FROM lineitem l WHERE l.l_linenumber > 1 AND NOT EXISTS (
  SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber - 1)""")
def plan_validate_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.unknown_dependencies(_steps(spark, sf_dir))


def _cut(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """checkpoint() into the shared folder that the session names, or a temporary one where it names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            import tempfile

            folder = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df: df.checkpoint()


# -- tools: an event is a registration, or a call with its props as arguments -----


@query("""
SELECT event_type AS name, arg_max(value, ts_id) AS value, arg_max(user_id, ts_id) AS user_id, max(event_id) AS event_id
FROM (SELECT *, event_id AS ts_id FROM events) GROUP BY event_type""")
def tool_registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "user_id", "event_id")
    return tools.last_registered(events, order=("event_id",)).select("name", "value", "user_id", "event_id")


_TOOLS = [("click", "Count a click"), ("purchase", "Book a purchase"), ("view", "Count a view")]


@query("""
SELECT event_id, event_type AS name, description, CASE WHEN description IS NULL THEN 'Tool not found: ' || event_type END AS problem
FROM events LEFT JOIN (VALUES """ + ", ".join(f"('{n}', '{d}')" for n, d in _TOOLS) + """) t(tool, description) ON event_type = tool""")
def tool_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"))
    known = spark.createDataFrame(_TOOLS, "name string, description string")
    return tools.dispatch(calls, known).select("event_id", "name", "description", F.col("error.message").alias("problem"))


@query("""
SELECT event_id, json_valid(props) AS valid, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       json_type(props, '$.k') = 'VARCHAR' AS k_is_text
FROM events""")
def tool_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = jsons.parsed(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", v.isNotNull().alias("valid"), F.try_variant_get(v, "$.k", "bigint").alias("k"), (jsons.kind(v, "$.k") == "STRING").alias("k_is_text")
    )


# -- texts ------------------------------------------------------------------------


@query("SELECT event_id, trim(props) AS clean, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit(" \u2003```json\n"), "props", F.lit("\n```\n\u00a0"))
    clean = unfence(fenced)
    return table(spark, sf_dir, "events").select("event_id", clean.alias("clean"), F.try_variant_get(jsons.parsed(clean), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'yaml' END AS format, props || chr(10) AS body FROM events""")
def fenced_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.when(F.col("event_id") % 2 == 0, "json").otherwise("yaml")
    md = F.concat(F.lit("# Plan\n\ntext\n  ```"), info, F.lit("\n"), "props", F.lit("\n```\nmore\n```\nsecond\n```\n"))
    block = first_block(md)
    return table(spark, sf_dir, "events").select("event_id", block["format"].alias("format"), block["body"].alias("body"))


_DIRECTORIES = ", ".join(f"('{c}', '{d}')" for c, d in CATEGORIES.items())


@query(f"""
SELECT p_partkey, category, 'out/' || dir || '/' || lower(replace(p_name, ' ', '_')) || '.md' AS path
FROM part, (VALUES {_DIRECTORIES}) c(category, dir)""")
def doc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return parts.select("p_partkey", "category", document_path(F.lit("out"), F.col("category"), topic_file(F.col("p_name"))).alias("path"))


@query("""
SELECT doc_id, 'Write a reference document about "' || source || '".' || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10)
  || 'Answer with one JSON object of this shape and nothing around it:' || chr(10) || '""" + docgen.SHAPES["reference"] + """' || chr(10) || chr(10)
  || 'Write clearly and briefly, in the depth that the kind of document calls for, with code where it helps.' AS prompt
FROM documents""")
def doc_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", docgen.prompt(F.lit("reference"), F.col("source"), F.col("text")).alias("prompt"))


def _sql_escape(x: str) -> str:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), ("`", "&#x60;"), ("=", "&#x3D;")):
        x = f"replace({x}, '{plain}', '{escaped}')"
    return x


@query(f"""
SELECT o_orderkey, '# How to pay order ' || o_orderkey || chr(10) || chr(10) || '## Problem' || chr(10) || {_sql_escape("o_orderpriority")} || chr(10) || chr(10)
  || '## Solution' || chr(10) || {_sql_escape("o_orderstatus")} || chr(10) || chr(10) || '## Steps' || chr(10) || coalesce(steps, '') || chr(10) || '## Discussion' || chr(10) || chr(10) AS document
FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg('1. part ' || l_partkey || chr(10), '' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def doc_render_howto(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: F.concat(F.lit("part "), s["l_partkey"].cast("string")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(steps.cast(HOW_TO_STEPS).alias("steps"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    fields = {"title": F.concat(F.lit("pay order "), F.col("o_orderkey").cast("string")), "problem": F.col("o_orderpriority"), "solution": F.col("o_orderstatus"), "steps": F.col("steps")}
    return orders.select("o_orderkey", render("how-to", fields).alias("document"))


@query(f"""
SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || chr(10) || '## Introduction' || chr(10) || {_sql_escape("o_orderpriority")} || chr(10) || chr(10)
  || '## Prerequisites' || chr(10) || chr(10) || chr(10) || '## Step-by-Step Guide' || chr(10) || coalesce(steps, '') || chr(10) || '## Conclusion' || chr(10) || {_sql_escape("o_orderstatus")} || chr(10) AS document
FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(chr(10) || '### Step ' || l_linenumber || ': part ' || l_partkey || chr(10) || 'flag &lt;' || l_returnflag || '&gt;' || chr(10), '' ORDER BY l_linenumber, l_partkey, l_returnflag) AS steps
  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def doc_render_tutorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    steps = F.transform(
        ordered,
        lambda s: F.struct(s["l_linenumber"].alias("number"), F.concat(F.lit("part "), s["l_partkey"].cast("string")).alias("title"), F.concat(F.lit("flag <"), s["l_returnflag"], F.lit(">")).alias("content")),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(steps.cast(TUTORIAL_STEPS).alias("steps"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    fields = {"title": F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "introduction": F.col("o_orderpriority"), "steps": F.col("steps"), "conclusion": F.col("o_orderstatus")}
    return orders.select("o_orderkey", render("tutorial", fields).alias("document"))


@query(f"""
SELECT p_partkey, '# ' || {_sql_escape("p_name")} || chr(10) || chr(10) || '## Description' || chr(10) || {_sql_escape("p_type")} || chr(10) || chr(10)
  || '## Usage' || chr(10) || chr(10) || chr(10) || '## API' || chr(10) || p_size || chr(10) || chr(10) || '## Examples' || chr(10) || chr(10) AS document FROM part""")
def doc_render_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer in JSON, parsed and rendered."""
    answer = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_size").alias("api")))
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", render_variant(F.lit("reference"), jsons.parsed(answer)).alias("document"))


@query("""
SELECT p_partkey, 'out/docs/reference/' || lower(replace(p_name, ' ', '_')) || '.md' AS path,
  CASE WHEN count(*) OVER (PARTITION BY lower(replace(p_name, ' ', '_'))) > 1 THEN 'several'
       WHEN p_partkey % 3 = 0 THEN 'exists' ELSE 'written' END AS verdict
FROM part""")
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part's document is there already; names that several parts share collide."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("reference").alias("category"), topic_file(F.col("p_name")).alias("file"))
    alone = parts.withColumn("n", F.count("*").over(Window.partitionBy("file")))
    existing = alone.filter("n = 1 and p_partkey % 3 = 0").select(document_path(F.lit("out"), F.col("category"), F.col("file")).alias("path"))
    write, refused = docgen.guard(parts, existing, "out")
    why = F.when(F.col("error.message").startswith("several"), "several").otherwise("exists")
    return write.select("p_partkey", "path", F.lit("written").alias("verdict")).unionByName(refused.select("p_partkey", "path", why.alias("verdict")))


# -- chunks -------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS content,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS object_content, event_id % 2 = 1 AS object_error
FROM events""")
def chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four kinds (whole, end mark, no role, no choice); objects that are whole or lack a role."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit('data: {"choices":[{"delta":{"role":"assistant","content":"'), "event_type", F.lit('"}}]}')))
        .when(kind == 1, "data: [DONE]")
        .when(kind == 2, F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit('"}}]}')))
        .otherwise('data: {"choices":[]}')
    )
    whole = F.concat(F.lit('{"message":{"content":"'), "event_type", F.lit('"'), F.when(F.col("event_id") % 2 == 0, ',"role":"assistant"').otherwise(""), F.lit("}}"))
    chunk = chunks.object_chunk(whole)
    return e.select("event_id", chunks.event_chunk(line).alias("content"), chunk["content"].alias("object_content"), chunk["error"].isNotNull().alias("object_error"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Configuration error: Validation error: ' WHEN 1 THEN 'Provider error: API error: ' ELSE 'IO error: ' END || event_type AS text FROM events""")
def error_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("config.validation"), F.lit("provider.api"), F.lit("io")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", errors.error_text(kind, F.col("event_type")).alias("text"))


@query("""
SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '.md' AS file, p_partkey % 2 = 0 AS safe, p_name AS trimmed FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("../"), "p_name"))
    padded = F.concat(F.lit("\u3000\t"), "p_name", F.lit(" \u0085\n"))
    return table(spark, sf_dir, "part").select("p_partkey", topic_file(F.col("p_name")).alias("file"), safe_name(name).alias("safe"), trim_space(padded).alias("trimmed"))
