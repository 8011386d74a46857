"""Agents as rounds over many conversations at once.

A round asks a responder for the next message of every open conversation, executes the
tool calls of the answers, and adds what was said to the log.  A conversation closes with
an answer without calls; one that still calls after ``MOST_ROUNDS`` rounds fails.  The
model is a ``Responder``, a function of DataFrames; two deterministic ones stand in for a
live model.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors
from ..config import Config
from ..errors import DocloomError
from ..functions.text import trim_space
from ..model import ERROR, MESSAGE, MOST_ROUNDS, TOOL_CALLS
from . import conversation
from .tools import Registry, result_message


class Responder(Protocol):
    def complete(self, requests: DataFrame) -> DataFrame:
        """(conv_id, content, tool_calls) for requests (conv_id, request), request being the
        conversation as JSON; conversations without an answer are left out."""


class Recorded:
    """Answers looked up by the hash of the request: recordings(request_sha, content, tool_calls).

    Of several recordings of one request the one with the least text answers.
    """

    def __init__(self, recordings: DataFrame):
        one = F.min_by(F.struct("content", "tool_calls"), F.coalesce("content", F.lit("")))
        self._recordings = recordings.groupBy("request_sha").agg(one.alias("_r")).select("request_sha", "_r.*")

    def complete(self, requests: DataFrame) -> DataFrame:
        keyed = requests.withColumn("request_sha", request_key(F.col("request")))
        return keyed.join(self._recordings, "request_sha").select("conv_id", "content", F.col("tool_calls").cast(TOOL_CALLS).alias("tool_calls"))


class Template:
    """Answers that are an expression of the request; where ``answers`` is false there is none."""

    def __init__(self, content: Column, tool_calls: Column | None = None, answers: Column | None = None):
        self._content = content
        self._calls = F.lit(None) if tool_calls is None else tool_calls
        self._answers = answers

    def complete(self, requests: DataFrame) -> DataFrame:
        asked = requests if self._answers is None else requests.filter(self._answers)
        return asked.select("conv_id", self._content.alias("content"), self._calls.cast(TOOL_CALLS).alias("tool_calls"))


#: Each kind of responder: the model where none is set, whether tools are called, whether answers come in chunks.
RESPONDERS = {"recorded": ("recordings", True, False), "template": ("expression", True, False)}


def responder(settings: Config, *, recordings: DataFrame | None = None, content: Column | None = None, tool_calls: Column | None = None) -> Responder:
    """The responder that the settings name; an unknown one is an error."""
    if settings.responder == "recorded" and recordings is not None:
        return Recorded(recordings)
    if settings.responder == "template" and content is not None:
        return Template(content, tool_calls)
    why = "nothing to answer from for " if settings.responder in RESPONDERS else "Unknown provider: "
    raise DocloomError("provider.auth", why + settings.responder)


def responders(spark: SparkSession) -> DataFrame:
    """(name, model, tools, streaming) of every kind."""
    return spark.createDataFrame([(k, *v) for k, v in RESPONDERS.items()], "name string, model string, tools boolean, streaming boolean")


def chosen(asked: DataFrame) -> DataFrame:
    """asked(responder, model, ...) with the kind's model where none is given, its abilities, and an error for an unknown kind."""
    known = responders(asked.sparkSession).select(F.col("name").alias("responder"), F.col("model").alias("_model"), "tools", "streaming")
    found = asked.join(F.broadcast(known), "responder", "left")  # a row for each kind
    problem = F.when(F.col("_model").isNull(), errors.error("provider.auth", F.concat(F.lit("Unknown provider: "), F.coalesce("responder", F.lit("")))))
    return found.withColumn("model", F.coalesce("model", "_model")).withColumn("error", problem).drop("_model")


def request_key(request: Column) -> Column:
    return F.sha2(request.cast("binary"), 256)


def requests(log: DataFrame, *, system_prompt: str | None = None) -> DataFrame:
    """(conv_id, request): each conversation's wire messages in order as one JSON array."""
    wire = conversation.wire_messages(log)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return wire.groupBy("conv_id").agg(ordered.alias("_m")).select("conv_id", F.to_json(_plain("_m", system_prompt)).alias("request"))


def _plain(column: str, system_prompt: str | None) -> Column:
    plain = F.transform(F.col(column), lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content")))
    if system_prompt is None:
        return plain
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))), plain)


def has_calls(calls: Column) -> Column:
    """A null list and an empty one both end the conversation."""
    return F.coalesce(F.size(calls), F.lit(0)) > 0


def _problem(kind: str, message: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message"))


def _messages(df: DataFrame, message: Column) -> DataFrame:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    return df.select("conv_id", "turn", message.alias("_m")).select("conv_id", "turn", *[F.col(f"_m.{n}").alias(n) for n in names])


#: What an open conversation has said so far, in the order of its requests.
SAID = "array<struct<turn:bigint,role:string,content:string>>"


def _grown(*messages: Column) -> Column:
    """``messages`` with more behind them."""
    return F.concat("messages", F.array(*messages).cast(SAID))


def _one(turn: Column, role: Column, content: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), role.alias("role"), content.alias("content"))


def rounds(
    log: DataFrame, responder: Responder, registry: Registry, *, most_rounds: int = MOST_ROUNDS, compact_to: int | None = None, system_prompt: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(said, outcomes): the messages that were added and (conv_id, answer, error, last) of each conversation, last being its last turn."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.lower("role").alias("_r"), "content", "role")))
    talks = log.groupBy("conv_id").agg(F.max("turn").cast("long").alias("last"), F.transform(ordered, lambda m: _one(m["turn"], m["role"], m["content"])).alias("messages"))
    said, ended = continued(talks.checkpoint(), responder, registry, most_rounds=most_rounds, compact_to=compact_to, system_prompt=system_prompt)
    return said, ended.select("conv_id", "answer", "error", "last")


def continued(
    talks: DataFrame, responder: Responder, registry: Registry, *, most_rounds: int = MOST_ROUNDS, compact_to: int | None = None, system_prompt: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(said, ended) of ``talks(conv_id, last, messages, ...)``, a row for each conversation with all that it said.

    said   the messages that were added
    ended  the rows of ``talks`` with ``answer`` and ``error``; ``last`` is the last turn, and
           ``messages`` holds all that was said where there is no error

    An unknown tool or bad arguments end a conversation with an error; a tool that fails
    does not.  A conversation is a row that grows, so that a round moves those that are
    open once and gathers none of them anew.
    """
    none, no_error = F.lit(None).cast("string"), F.lit(None).cast(ERROR)
    more = [c for c in talks.columns if c not in ("last", "messages")]
    still: DataFrame | None = talks
    said: list[DataFrame] = []
    ended: list[DataFrame] = []
    for _ in range(most_rounds):
        if compact_to is None:
            asking = still.select("conv_id", F.to_json(_plain("messages", system_prompt)).alias("request"))
        else:
            asking = requests(conversation.compact(still.select("conv_id", F.inline("messages")), compact_to), system_prompt=system_prompt)
        found = responder.complete(asking).select("conv_id", "content", "tool_calls", F.lit(True).alias("_answered"))
        answers = still.join(found, "conv_id", "left").checkpoint()
        calling = not answers.filter(has_calls(F.col("tool_calls"))).isEmpty()
        answer = F.struct(F.lit("assistant").alias("role"), F.col("content"), none.alias("name"), F.col("tool_calls"), none.alias("tool_call_id"))
        said.append(_messages(answers.filter("_answered").withColumn("turn", F.col("last") + 1), answer))
        spoken = _grown(_one(F.col("last") + 1, F.lit("assistant"), F.col("content")))
        over = answers.filter(~has_calls(F.col("tool_calls")))
        turn = F.col("last") + F.col("_answered").isNotNull().cast("long")
        messages = F.when(F.col("_answered"), spoken).otherwise(F.col("messages"))
        problem = F.when(F.col("_answered").isNull(), _problem("provider.api", "no answer"))
        ended.append(over.select(*more, turn.alias("last"), messages.alias("messages"), F.col("content").alias("answer"), problem.alias("error")))
        if not calling:
            still = None
            break
        called = answers.filter(has_calls(F.col("tool_calls")))
        asked = called.select("conv_id", "last", F.size("tool_calls").alias("_n"), F.posexplode("tool_calls").alias("ord", "call"))
        asked = asked.select("conv_id", "last", "_n", "ord", F.col("call.id").alias("id"), F.col("call.function.name").alias("name"), F.col("call.function.arguments").alias("arguments"))
        calls = registry.execute(asked).checkpoint()
        failed = calls.groupBy("conv_id", "last", "_n").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))).alias("_f"))
        # results of the calls before the first that is in error
        good = calls.join(failed.select("conv_id", F.col("_f.ord").alias("_at")), "conv_id").filter("result is not null and (_at is null or ord < _at)")
        results = _messages(good.withColumn("turn", (F.col("last") + 2 + F.col("ord")).cast("long")), result_message(F.col("id"), F.col("name"), F.col("result")))
        said.append(results)
        told = results.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).cast(SAID).alias("_told"))
        after = called.select(*more, "last", spoken.alias("messages")).join(failed.drop("last"), "conv_id").join(told, "conv_id", "left")
        ended.append(after.filter("_f is not null").select(*more, (F.col("last") + 1 + F.col("_f.ord")).cast("long").alias("last"), "messages", none.alias("answer"), F.col("_f.error").alias("error")))
        messages = F.concat("messages", F.coalesce("_told", F.array().cast(SAID)))
        still = after.filter("_f is null").select(*more, (F.col("last") + 1 + F.col("_n")).cast("long").alias("last"), messages.alias("messages")).checkpoint()
    if still is not None:
        ended.append(still.select(*more, "last", "messages", none.alias("answer"), _problem("workflow.execution", f"no answer after {most_rounds} rounds").alias("error")))
    return reduce(DataFrame.unionByName, said), reduce(DataFrame.unionByName, [df.withColumn("error", F.coalesce("error", no_error)) for df in ended])


def run(log: DataFrame, responder: Responder, registry: Registry, *, most_rounds: int = MOST_ROUNDS, compact_to: int | None = None, system_prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, outcomes): the grown log and (conv_id, answer, error) of each conversation.  The log is not rolled back."""
    said, outcomes = rounds(log, responder, registry, most_rounds=most_rounds, compact_to=compact_to, system_prompt=system_prompt)
    return log.unionByName(said), outcomes.drop("last")


def prompts(lines: DataFrame, text: str = "text") -> DataFrame:
    """The prompts of an interactive session: trimmed, not empty, up to the first exit word of each."""
    t = trim_space(F.col(text))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.max(F.lower(t).isin("exit", "quit").cast("int")).over(before)
    return lines.withColumn("prompt", t).withColumn("_left", left).filter("_left = 0 and prompt <> ''").select("conv_id", "turn", "prompt")
