"""Queries of executions: plans that run, graphs of any shape, streams with state, sinks in both modes, tools with effects.

Importing this module adds them to ``queries.QUERIES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dataflows import _folder, _log
from .functions.text import utf8_strict
from .model import TOOL_CALLS
from .operators import agent, conversation, tools
from .plans import parse, run, waves
from .queries import BUDGET, _cut, log_of, query, table
from .sources import documents, files
from .streaming import recorded, state

# -- plans ------------------------------------------------------------------------------

#: An order's lines in this order are the steps of a plan.
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")

_STEPS_SQL = f"""
lines AS (
  SELECT l_orderkey AS plan, CAST(l_quantity AS INT) AS q, l_returnflag AS flag, p_name || chr(9) || '"' || p_brand || '"' || chr(10) || p_type AS prompt,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS t, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey),
-- the waves of a plan's steps so far, null for one that never runs
waved(plan, t, ws) AS (
  SELECT plan, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) FROM lines WHERE t = 0
  UNION ALL
  SELECT w.plan, l.t, list_append(ws, CASE WHEN q % 13 = 0 OR (l.t > 0 AND q % 3 <> 0 AND ws[l.t] IS NULL) OR (l.t > 1 AND q % 2 = 0 AND ws[l.t - 1] IS NULL) THEN NULL
    ELSE greatest(CASE WHEN l.t > 0 AND q % 3 <> 0 THEN ws[l.t] + 1 ELSE 0 END, CASE WHEN l.t > 1 AND q % 2 = 0 THEN ws[l.t - 1] + 1 ELSE 0 END) END)
  FROM waved w JOIN lines l ON l.plan = w.plan AND l.t = w.t + 1),
steps AS (SELECT l.*, w.ws[l.t + 1] AS wave FROM lines l JOIN waved w ON w.plan = l.plan AND w.t = l.n - 1),
placed AS (SELECT *, CASE WHEN wave IS NOT NULL THEN row_number() OVER (PARTITION BY plan, wave IS NULL ORDER BY wave, t DESC) END AS place FROM steps)
"""


def _order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans whose later lines stand first, with up to two dependencies a step, some of which are cycles of one."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    in_order = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    lines = lines.withColumn("t", F.row_number().over(in_order) - 1).withColumn("q", F.col("l_quantity").cast("int"))
    name = lambda t: F.concat(F.lit("s"), t.cast("string"))
    t, q = F.col("t"), F.col("q")
    deps = F.array_compact(F.array(F.when((t > 0) & (q % 3 != 0), name(t - 1)), F.when((t > 1) & (q % 2 == 0), name(t - 2)), F.when(q % 13 == 0, name(t))))
    prompt = F.concat("p_name", F.lit('\t"'), "p_brand", F.lit('"\n'), "p_type")
    kind = F.when(F.col("l_returnflag") == "N", "agent_task").when(F.col("l_returnflag") == "A", "analyze_code").otherwise("execute_command")
    action = F.struct(kind.alias("type"), F.struct(F.when(F.col("l_returnflag") == "N", prompt).alias("prompt")).alias("params"))
    return lines.select(F.col("l_orderkey").alias("plan"), (-t).alias("ord"), name(t).alias("id"), action.alias("action"), deps.alias("deps"))


@query(f"""
WITH RECURSIVE {_STEPS_SQL},
tasks AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY place) AS k FROM placed WHERE flag = 'N' AND place IS NOT NULL),
-- a plan's conversation: what was said so far, and whether the last request was answered
said(plan, k, items, answer, good) AS (
  SELECT plan, CAST(0 AS BIGINT), '', '', true FROM tasks WHERE k = 1
  UNION ALL
  SELECT plan, k, asked || ',{{"role":"assistant","content":"' || md5('[' || asked || ']') || '"}}', md5('[' || asked || ']'), md5('[' || asked || ']')[1] <> '0'
  FROM (SELECT s.plan, t.k, CASE WHEN s.items = '' THEN '' ELSE s.items || ',' END || '{{"role":"user","content":' || to_json(t.prompt) || '}}' AS asked
    FROM said s JOIN tasks t ON t.plan = s.plan AND t.k = s.k + 1 WHERE s.good)),
results AS (SELECT t.plan, t.place, t.t, s.answer, s.good FROM said s JOIN tasks t ON t.plan = s.plan AND t.k = s.k),
stops AS (SELECT plan, place AS stop, 's' || t AS id FROM results WHERE NOT good),
ran AS (
  SELECT p.plan, 's' || p.t AS id, p.place, CASE WHEN p.place IS NULL OR p.place > stop THEN 'skipped' WHEN p.place = stop THEN 'failed' ELSE 'done' END AS state,
    CASE WHEN r.good THEN r.answer END AS output, s.id AS failed
  FROM placed p LEFT JOIN results r ON r.plan = p.plan AND r.place = p.place LEFT JOIN stops s ON s.plan = p.plan)
SELECT plan, id, place, state, output, n_done, CASE WHEN failed IS NOT NULL THEN 'step ' || failed || ': no answer' WHEN n_done < n THEN '{run.DEADLOCK}' END AS problem
FROM (SELECT *, count(*) OVER (PARTITION BY plan) AS n, count(*) FILTER (state = 'done') OVER (PARTITION BY plan) AS n_done FROM ran)""")
def plan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that run: an answer is the hash of all that was said in its plan, and some requests have none."""
    _cut(spark)
    responder = agent.Template(F.md5(F.col("request").cast("binary")), answers=~F.md5(F.col("request").cast("binary")).startswith("0"))
    ran, plans, _ = run.run_plans(_order_steps(spark, sf_dir), responder, tools.Registry())
    done = ran.select("plan", "id", "place", "state", "output")
    return done.join(plans.select("plan", "n_done", F.col("error.message").alias("problem")), "plan")


_GRAPH_SQL = """
WITH RECURSIVE rows AS (
  SELECT event_type || '-' || user_id % 3 AS plan, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS k, user_id, event_id, user_id % 3 = 1 AND event_id % 701 = 0 AS flagged FROM events),
marked AS (SELECT *, lag(flagged, 1, false) OVER (PARTITION BY plan ORDER BY k) AS after, count(*) OVER (PARTITION BY plan) AS n FROM rows),
waved(plan, k, ws) AS (
  SELECT plan, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM marked WHERE k = 1
  UNION ALL
  SELECT w.plan, m.k, list_append(ws, CASE WHEN flagged OR len(list_filter(wanted, lambda x: ws[x] IS NULL)) > 0 THEN NULL ELSE coalesce(list_max(list_transform(wanted, lambda x: ws[x] + 1)), 0) END)
  FROM waved w JOIN (
    SELECT *, list_filter(CASE WHEN user_id % 3 = 0 OR after THEN [k - 1] ELSE [k - 1 - user_id % 7, k - 1 - event_id % 3, k - 1 - event_id % 50] END, lambda x: x > 0) AS wanted FROM marked) m ON m.plan = w.plan AND m.k = w.k + 1),
whole AS (SELECT plan, ws FROM waved JOIN (SELECT plan, max(n) AS n FROM marked GROUP BY 1) USING (plan) WHERE k = n)
"""


@query(_GRAPH_SQL + """
SELECT m.plan, m.event_id, ws[k] AS wave, count(ws[k]) OVER (PARTITION BY m.plan) < count(*) OVER (PARTITION BY m.plan) AS deadlocked FROM marked m JOIN whole USING (plan)""")
def plan_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of thousands of steps: chains of all of them, fan-in and diamonds, and cycles that block what waits for them."""
    in_order = Window.partitionBy("plan").orderBy("event_id")
    name = F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "events").select(name.alias("plan"), "event_id", "user_id").withColumn("k", F.row_number().over(in_order).cast("long"))
    flagged = (F.col("user_id") % 3 == 1) & (F.col("event_id") % 701 == 0)
    rows = rows.withColumn("flagged", flagged).withColumn("after", F.lag("flagged", 1, False).over(in_order))
    k = F.col("k")
    wanted = F.when((F.col("user_id") % 3 == 0) | F.col("after"), F.array(k - 1)).otherwise(F.array(k - 1 - F.col("user_id") % 7, k - 1 - F.col("event_id") % 3, k - 1 - F.col("event_id") % 50))
    # a flagged step waits for the next one, which waits for it
    wanted = F.when(F.col("flagged"), F.array(k + 1, k)).otherwise(F.filter(wanted, lambda x: x > 0))
    steps = rows.select("plan", F.col("event_id").alias("ord"), k.cast("string").alias("id"), F.transform(wanted, lambda x: x.cast("string")).alias("deps"))
    scheduled = waves.schedule(steps, checkpoint=_cut(spark))
    return scheduled.join(waves.stalled(scheduled), "plan").select("plan", F.col("ord").alias("event_id"), "wave", "deadlocked")


@query("""
SELECT p_partkey, 'part ' || p_partkey AS name, 1 + p_size % 3 AS n_steps FROM part""")
def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan files of three formats, written as documents and read again."""
    files.register(spark)
    folder = _folder(spark, "plans")
    key = F.col("p_partkey").cast("string")
    step = lambda n: F.struct(n.cast("string").alias("id"), F.col("p_name").alias("description"), F.struct(F.lit("scan_repository").alias("type")).alias("action"))
    plan = F.to_json(F.struct(F.concat(F.lit("part "), key).alias("name"), F.col("p_type").alias("description"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), step).alias("steps")))
    # JSON is YAML, too
    content = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("# Plan\n\n```json\n"), plan, F.lit("\n```\n"))).otherwise(plan)
    ext = F.element_at(F.array(F.lit(".json"), F.lit(""), F.lit(".md")), (F.col("p_partkey") % 3 + 1).cast("int"))
    documents.dealt(table(spark, sf_dir, "part").select(F.concat(F.lit("plan"), key, ext).alias("path"), content.alias("content"))).write.format("documents").mode("append").save(folder)
    plans = parse.parse_plans(parse.read_plans(spark, folder))
    number = F.regexp_extract("path", r"plan([0-9]+)(?:\.[a-z]+)?\z", 1).cast("long")
    return plans.select(number.alias("p_partkey"), F.col("plan.name").alias("name"), F.size("plan.steps").cast("long").alias("n_steps"))


# -- streams ----------------------------------------------------------------------------


def _in_parts(spark: SparkSession, rows: DataFrame, folder: str, schema_of: DataFrame, run_up_to, parts: int = 4) -> None:
    """Let the rows arrive by turn in four parts; the query is stopped after the second and started again."""
    part = F.least(F.lit(parts - 1), F.floor(F.col("turn") / 2))
    for k in range(parts):
        rows.filter(part == k).write.mode("append").parquet(folder)
        if k == parts // 2 - 1 or k == parts - 1:
            run_up_to().awaitTermination()


def _arriving(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", int(spark.conf.get("spark.sql.shuffle.partitions"))).parquet(folder)


@query(f"""
WITH kept AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT *, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM conversations) WHERE suffix // 4 <= {BUDGET}),
counts AS (SELECT conv_id, count(*) AS n_seen, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)
SELECT c.conv_id, n_seen, least(n, 2) AS calls, n > 2 AS over, turn, role, text AS content FROM counts c LEFT JOIN kept k ON k.conv_id = c.conv_id""")
def conv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation logs within a budget, kept as a stream's state over several batches and a restart."""
    folder, out, progress = (_folder(spark, name) for name in ("messages", "logs", "progress"))
    rows = log_of(spark, sf_dir).select("conv_id", "turn", "role", "content")
    _in_parts(spark, rows, folder, rows, lambda: state.start(state.conversation_logs(_arriving(spark, folder, rows), most=BUDGET, most_calls=2), out, progress))
    logs = state.latest(spark.read.parquet(out))
    return logs.select("conv_id", "n_seen", "calls", "over", F.explode_outer("log").alias("m")).select("conv_id", "n_seen", "calls", "over", "m.turn", "m.role", "m.content")


@query("""
SELECT conv_id, turn, prompt FROM (
  SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10)) AS prompt, max(CASE WHEN strlen(text) % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS gone FROM conversations)
WHERE gone = 0 AND prompt <> ''""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of sessions as a stream over several batches and a restart: nothing comes behind an exit word."""
    folder, out, progress = (_folder(spark, name) for name in ("lines", "prompts", "progress"))
    word = F.element_at(F.array(F.lit(" exit"), F.lit("QUIT\n"), F.lit("\tExit ")), (F.col("conv_id") % 3 + 1).cast("int"))
    text = F.when(F.octet_length("text") % 9 == 0, word).otherwise(F.concat(F.lit(" \t"), "text", F.lit("\n")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    _in_parts(spark, rows, folder, rows, lambda: state.start(state.session_prompts(_arriving(spark, folder, rows)), out, progress))
    return spark.read.schema("conv_id long, turn long, prompt string").parquet(out)


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS event_content, CASE WHEN event_id % 5 = 1 THEN props END AS object_content, event_id % 5 <> 1 AS object_error FROM events""")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded chunks of bytes as a stream, started again midway: events, objects, halves of objects, two events at once, bytes that are no text."""
    files.register(spark)
    folder, out, progress = (_folder(spark, name) for name in ("recordings", "chunks", "progress"))
    kind = F.col("event_id") % 5
    event = F.concat(F.lit('data: {"choices":[{"delta":{"role":"assistant","content":"'), "event_type", F.lit('"}}]}\n\n'))
    whole = F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("props").alias("content")).alias("message")))
    text = F.when(kind == 0, event).when(kind == 1, whole).when(kind == 2, F.substring(whole, 1, 20)).otherwise(F.concat(event, event))
    data = F.when(kind == 3, F.unhex(F.lit("64617461FF"))).otherwise(text.cast("binary"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("response"), F.regexp_replace(F.base64(data), r"\s", "").alias("chunk")))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    n = F.floor(F.col("event_id") / 1000)  # a file for a thousand chunks
    lines = rows.groupBy(n.cast("long").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n").alias("content"))
    recordings = lines.select("n", F.concat(F.lit("r"), F.lpad(F.col("n").cast("string"), 12, "0")).alias("path"), "content")
    half = recordings.agg(F.max("n")).head()[0] // 2
    for some in (F.col("n") <= half, F.col("n") > half):
        recordings.filter(some).select("path", "content").write.format("documents").mode("append").save(folder)
        arrived = spark.readStream.format("chunks").load(folder)
        objects = recorded.objects(arrived).select("response", "content", F.col("error").isNotNull().alias("error"), F.lit("object").alias("form"))
        events = recorded.events(arrived).select("response", "content", F.lit(False).alias("error"), F.lit("event").alias("form"))
        for stream, name in ((objects, "objects"), (events, "events")):
            state.start(stream, f"{out}/{name}", f"{progress}/{name}").awaitTermination()
    read = spark.read.schema("response string, content string, error boolean, form string")
    objects, events = (read.parquet(f"{out}/{name}") for name in ("objects", "events"))
    both = objects.select("response", F.col("content").alias("object_content"), F.col("error").alias("object_error")).join(events.select("response", F.col("content").alias("event_content")), "response")
    return both.select(F.col("response").cast("long").alias("event_id"), "event_content", "object_content", "object_error")


# -- conversations and tools ------------------------------------------------------------


@query("""
WITH calls AS (SELECT conv_id, turn, unnest([0, 1]) AS ord, 'c' || strlen(text) % (2 + unnest([0, 1])) AS id FROM conversations WHERE role = 'assistant'),
results AS (SELECT conv_id, turn, CASE WHEN strlen(text) % 7 <> 0 THEN 'c' || strlen(text) % 4 END AS id, text FROM conversations WHERE role = 'user'),
events AS (SELECT conv_id, id, turn, ord, 1 AS up, NULL AS text FROM calls UNION ALL SELECT conv_id, id, turn, -1, -1, text FROM results WHERE id IS NOT NULL),
summed AS (SELECT *, sum(up) OVER w AS level, count(*) FILTER (up = 1) OVER w AS n_calls, count(*) FILTER (up = -1) OVER w AS n_results FROM events WINDOW w AS (PARTITION BY conv_id, id ORDER BY turn, ord)),
low AS (SELECT *, least(0, min(level) OVER (PARTITION BY conv_id, id ORDER BY turn, ord)) AS low FROM summed),
placed AS (SELECT *, low < lag(low, 1, 0) OVER (PARTITION BY conv_id, id ORDER BY turn, ord) AS lost FROM low),
given AS (SELECT conv_id, id, turn, text, n_results + low AS n FROM placed WHERE up = -1 AND NOT lost)
SELECT c.conv_id, c.id AS call_id, c.turn AS call_turn, c.ord, g.turn AS result_turn, g.text AS output, CASE WHEN g.n IS NULL THEN 'open' ELSE 'answered' END AS state
FROM (SELECT * FROM placed WHERE up = 1) c LEFT JOIN given g ON g.conv_id = c.conv_id AND g.id = c.id AND g.n = c.n_calls
UNION ALL SELECT conv_id, id, NULL, NULL, turn, text, 'orphan' FROM placed WHERE up = -1 AND lost
UNION ALL SELECT conv_id, NULL, NULL, NULL, turn, text, 'orphan' FROM results WHERE id IS NULL""")
def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with two calls each and results between them, with ids that repeat, lack a partner or are missing."""
    n = F.octet_length("text")
    ident = lambda of: F.concat(F.lit("c"), (n % of).cast("string"))
    call = lambda of: F.struct(ident(of).alias("id"), F.struct(F.lit("measure").alias("name"), F.lit("{}").alias("arguments")).alias("function"))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    log = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", role.alias("role"), F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.array(call(2), call(3))).cast(TOOL_CALLS).alias("tool_calls"),
        F.when((F.col("role") == "user") & (n % 7 != 0), ident(4)).alias("tool_call_id"),
    )
    return conversation.match_results(log).drop("name", "arguments")


@query("""
WITH last AS (SELECT conv_id, arg_max(text, turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN strlen(text) % 3 <> 0 THEN 'heard: ' || text END AS answer, CASE WHEN strlen(text) % 3 = 0 THEN 'no answer' END AS problem, n + CASE WHEN strlen(text) % 3 <> 0 THEN 1 ELSE 0 END AS n_messages FROM last""")
def agent_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations answered from recordings by the hash of all that was said; a third have none."""
    _cut(spark)
    log = _log(spark, sf_dir)
    asked = agent.requests(log).join(log.groupBy("conv_id").agg(F.max_by("content", "turn").alias("text")), "conv_id").filter(F.octet_length("text") % 3 != 0)
    recordings = asked.select(agent.request_key(F.col("request")).alias("request_sha"), F.concat(F.lit("heard: "), "text").alias("content"), F.lit(None).cast(TOOL_CALLS).alias("tool_calls"))
    grown, outcomes = agent.run(log, agent.Recorded(recordings), tools.Registry())
    n = grown.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return outcomes.select("conv_id", "answer", F.col("error.message").alias("problem")).join(n, "conv_id")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || 'é' WHEN 3 THEN '' ELSE '' END AS output,
  CASE p_partkey % 4 WHEN 1 THEN 'File not found: none/' || p_partkey END AS failure, CASE p_partkey % 4 WHEN 2 THEN 'Missing path parameter' WHEN 3 THEN 'Missing content parameter' END AS problem FROM part""")
def tool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by calls, under a ledger that is asked twice, and read by others: good ones, none, and two that are refused."""
    _cut(spark)
    files.register(spark)
    folder = _folder(spark, "effects").removeprefix("file://")
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    registry = tools.file_tools()
    parts = table(spark, sf_dir, "part")
    spark.range(1).select(F.lit("x").alias("path"), F.lit("").alias("content")).write.format("documents").mode("append").save(folder)
    path = F.concat(F.lit(f"{folder}/"), key)
    written = F.to_json(F.struct(path.alias("path"), F.concat("p_name", F.lit("\né")).alias("content")))
    write = parts.filter(kind == 0).select(key.alias("id"), F.lit("write_file").alias("name"), written.alias("arguments"))
    for _ in range(2):
        registry.execute(write, ledger=f"{folder}/.ledger").checkpoint()
    where = F.when(kind == 1, F.concat(F.lit("none/"), key)).otherwise(path)
    calls = parts.select(
        "p_partkey", F.when(kind == 3, "write_file").otherwise("read_file").alias("name"), F.when(kind == 2, F.lit('{"path": 5}')).otherwise(F.to_json(F.struct(where.alias("path")))).alias("arguments")
    )
    done = registry.execute(calls).checkpoint()
    return done.select("p_partkey", F.coalesce("result.output", F.lit("")).alias("output"), F.col("result.error").alias("failure"), F.col("error.message").alias("problem"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'measure' WHEN 1 THEN 'nope' ELSE 'measure' END AS name, CASE p_partkey % 3 WHEN 0 THEN CAST(len(p_name) AS VARCHAR) WHEN 2 THEN NULL END AS output,
  CASE p_partkey % 3 WHEN 1 THEN 'Tool not found: nope' WHEN 2 THEN 'Missing text parameter' END AS problem FROM part""")
def tool_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools called from SQL, over a table of calls with columns of its own."""
    registry = tools.Registry()
    measure = lambda a: (str(len(a["text"])), None)
    registry.register(tools.Tool("measure", "Count code points", tools._schema(text="Any text"), tools._each(measure), ("text",), effect=measure))
    tools.register_sql(spark, registry)
    kind = F.col("p_partkey") % 3
    calls = table(spark, sf_dir, "part").select("p_partkey", F.when(kind == 1, "nope").otherwise("measure").alias("name"), F.when(kind == 2, "{}").otherwise(F.to_json(F.struct(F.col("p_name").alias("text")))).alias("arguments"))
    return spark.sql("SELECT p_partkey, name, output, problem FROM call_tools(TABLE({calls}))", calls=calls)


@query("""
SELECT CASE p_partkey % 5 WHEN 0 THEN 'a/' WHEN 1 THEN 'a/b/' WHEN 2 THEN 'a/b/c/' ELSE '' END || 'p' || p_partkey || '.md' AS path,
  CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name || chr(10) END AS content FROM part""")
def doc_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended, and then a third of them and some new ones written over them."""
    files.register(spark)
    folder = _folder(spark, "documents")
    kind = F.col("p_partkey") % 5
    path = F.concat(F.when(kind == 0, "a/").when(kind == 1, "a/b/").when(kind == 2, "a/b/c/").otherwise(""), F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".md"))
    parts = table(spark, sf_dir, "part")
    # parts that six divides are written by the second write alone
    documents.dealt(parts.filter("p_partkey % 6 <> 0").select(path.alias("path"), F.concat("p_name", F.lit("\n")).alias("content"))).write.format("documents").mode("append").save(folder)
    documents.dealt(parts.filter("p_partkey % 3 = 0").select(path.alias("path"), F.concat(F.lit("new "), "p_name").alias("content"))).write.format("documents").mode("overwrite").save(folder)
    return spark.read.format("tree").option("partitions", "8").load(folder).select("path", utf8_strict(F.col("content")).alias("content"))
