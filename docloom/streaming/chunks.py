"""Answers that arrive in chunks, as stateless maps over batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions import jsons

DATA, END = "data: ", "[DONE]"


def object_chunk(chunk: Column) -> Column:
    """STRUCT<content, error> of a chunk that is one JSON object with message.role and message.content."""
    v = jsons.parsed(chunk)
    content = jsons.text_at(v, "$.message.content")
    good = content.isNotNull() & jsons.text_at(v, "$.message.role").isNotNull()
    return F.struct(F.when(good, content).alias("content"), F.when(~F.coalesce(good, F.lit(False)), errors.error("provider.serialization", F.concat(F.lit("bad chunk: "), F.coalesce(chunk, F.lit(""))))).alias("error"))


def event_chunk(line: Column) -> Column:
    """The text of a server-sent event line; '' for the end mark and for whatever is no valid event.

    A delta counts only with both role and content.
    """
    v = jsons.parsed(F.when(line.startswith(DATA) & ~line.startswith(DATA + END), F.substring(line, len(DATA) + 1, 1 << 30)))
    role, content = jsons.text_at(v, "$.choices[0].delta.role"), jsons.text_at(v, "$.choices[0].delta.content")
    return F.coalesce(F.when(role.isNotNull(), content), F.lit(""))


def completion(body: Column) -> Column:
    """The message text of a whole answer in either form: message, or the first of choices."""
    v = jsons.parsed(body)
    return F.coalesce(jsons.text_at(v, "$.message.content"), jsons.text_at(v, "$.choices[0].message.content"))


def completions(answers: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """The answers with ``content`` and ``error``: a bad status, or a body without a message."""
    ok = F.col(status).between(200, 299)
    content = completion(F.col(body))
    problem = F.when(~F.coalesce(ok, F.lit(False)), errors.error("provider.api", F.concat(F.lit("status "), F.coalesce(F.col(status).cast("string"), F.lit("unknown"))))).when(content.isNull(), errors.error("provider.serialization", "no message in the answer"))
    return answers.withColumn("content", F.when(ok, content)).withColumn("error", problem)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (content) from text files of event lines."""
    return spark.readStream.text(path).select(event_chunk(F.col("value")).alias("content"))


def object_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (content, error) from text files of one JSON object a line."""
    return spark.readStream.text(path).select(object_chunk(F.col("value")).alias("c")).select("c.*")


def prompt_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of prompts: trimmed lines that are neither empty nor an exit word."""
    from ..functions.text import trim_space

    t = trim_space(F.col("value"))
    return spark.readStream.text(path).select(t.alias("prompt")).filter((F.col("prompt") != "") & ~F.lower("prompt").isin("exit", "quit"))
