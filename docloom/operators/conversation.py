"""Conversation logs: token totals, compaction, wire form, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from ..model import CONTEXT_TOKENS, MESSAGE, TOOL_CALLS


def message(role: str, content: Column) -> Column:
    """A message struct with its other fields null."""
    return F.struct(
        F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast(TOOL_CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"),
    )


def token_totals(log: DataFrame, content: str = "content") -> DataFrame:
    """(conv_id, tokens): the estimate is rounded down once, after the sum."""
    return log.groupBy("conv_id").agg(estimated_tokens(F.coalesce(F.sum(F.octet_length(content)), F.lit(0))).cast("long").alias("tokens"))


def compact(log: DataFrame, most: int = CONTEXT_TOKENS, content: str = "content") -> DataFrame:
    """The log without the oldest messages of conversations over ``most`` tokens.

    Dropping from the front until the rest fits keeps the rows whose suffix sum,
    taken from the newest row backwards, fits: sums only grow towards the front.
    A newest message that alone is over the budget leaves nothing.
    """
    # messages with one turn go by role and text, so that the same ones are dropped each time
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc("turn"), *[F.desc(c) for c in ("role", content) if c in log.columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = log.withColumn("_suffix", F.sum(F.coalesce(F.octet_length(content), F.lit(0))).over(newest_first))
    return summed.filter(estimated_tokens(F.col("_suffix")) <= most).drop("_suffix")


def compaction_flags(log: DataFrame, most: int = CONTEXT_TOKENS, content: str = "content") -> DataFrame:
    """(conv_id, compacted): whether the conversation was over budget."""
    return token_totals(log, content).select("conv_id", (F.col("tokens") > most).alias("compacted"))


def wire_messages(log: DataFrame, content: str = "content") -> DataFrame:
    """What is sent: lower-case role and content, without names and tool calls."""
    return log.select("conv_id", "turn", F.lower("role").alias("role"), F.col(content).alias("content"))


def wire_json(log: DataFrame) -> DataFrame:
    """Each message as JSON; null fields are left out, but for tool_call_id, which is written as null."""
    fields = F.to_json(F.struct("role", "content", "name", "tool_calls"))
    tail = F.when(F.col("tool_call_id").isNull(), F.lit(',"tool_call_id":null}')).otherwise(F.concat(F.lit(',"tool_call_id":'), F.to_json(F.struct(F.col("tool_call_id").alias("x"))).substr(F.lit(6), F.lit(1 << 30))))
    return log.select("conv_id", "turn", F.concat(F.regexp_replace(fields, r"\}\z", ""), tail).alias("json"))


def append(log: DataFrame, more: DataFrame) -> DataFrame:
    """The log with ``more(conv_id, message struct, ord)`` behind each conversation's last turn."""
    last = log.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("ord"))
    numbered = more.join(last, "conv_id", "left").withColumn("turn", (F.coalesce("_last", F.lit(-1)) + rank).cast("long"))
    return log.unionByName(numbered.select("conv_id", "turn", *[F.col(f"message.{f.split()[0]}").alias(f.split()[0]) for f in MESSAGE.split(", ")]))


def cleared(log: DataFrame, conversations: DataFrame) -> DataFrame:
    """The log without the given conversations."""
    return log.join(conversations, "conv_id", "left_anti")


def call_counts(log: DataFrame, most: int) -> DataFrame:
    """(conv_id, n, calls, over): answers of a conversation, counted up to ``most``, and whether there were more."""
    answers = log.filter(F.lower("role") == "assistant").groupBy("conv_id").agg(F.count("*").alias("n"))
    return answers.select("conv_id", "n", F.least("n", F.lit(most).cast("long")).alias("calls"), (F.col("n") > most).alias("over"))


def match_results(log: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_turn, ord, name, arguments, result_turn, output, state) of all tool calls and results.

    A result belongs to the earliest call before it with its ``tool_call_id`` that has none
    yet, since ids may repeat in a conversation.  A call without a result is ``open``, a
    result without a call an ``orphan``, any other pair ``answered``; a null id matches
    nothing.  One shuffle by conversation and id: running counts number the calls and
    those results that find one, and equal numbers meet.
    """
    calls = log.select("conv_id", "turn", F.posexplode("tool_calls").alias("ord", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", "ord", F.struct("turn", "ord", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")).alias("call"))
    results = log.filter(F.lower("role") == "tool").select("conv_id", F.col("tool_call_id").alias("call_id"), "turn", F.lit(-1).alias("ord"), F.struct("turn", F.col("content").alias("output")).alias("result"))
    events = calls.unionByName(results, allowMissingColumns=True)
    known = events.filter("call_id is not null")
    so_far = Window.partitionBy("conv_id", "call_id").orderBy("turn", "ord", "result.output").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_call = F.col("call").isNotNull()
    counted = known.withColumn("_calls", F.count("call").over(so_far)).withColumn("_results", F.count("result").over(so_far))
    # results without a call so far: how deep the balance of calls and results has ever been below zero
    counted = counted.withColumn("_lost", F.greatest(F.lit(0), F.max(F.col("_results") - F.col("_calls")).over(so_far)))
    earlier = F.coalesce(F.lag("_lost").over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "ord", "result.output")), F.lit(0))
    orphan = ~is_call & (F.col("_lost") > earlier)
    numbered = counted.withColumn("_n", F.when(is_call, F.col("_calls")).when(orphan, -F.col("_lost")).otherwise(F.col("_results") - F.col("_lost")))
    pairs = numbered.groupBy("conv_id", "call_id", "_n").agg(F.max("call").alias("call"), F.max("result").alias("result")).drop("_n")
    pairs = pairs.unionByName(events.filter("call_id is null").select("conv_id", "call_id", "call", "result"))
    state = F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "open").otherwise("answered")
    return pairs.select("conv_id", "call_id", F.col("call.turn").alias("call_turn"), "call.ord", "call.name", "call.arguments", F.col("result.turn").alias("result_turn"), "result.output", state.alias("state"))
