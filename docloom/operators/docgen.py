"""Documents: prompts, answers to Markdown, guarded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import jsons
from ..functions.render import SECTIONS, render_variant
from ..functions.text import category, document_path, safe_name, topic_file, unfence
from .agent import Responder, request_key

#: The JSON that an answer has, by category: its fields, a list's as an example.
SHAPES = {
    name: '{"title": "text"' + "".join(f', "{f}": ' + (('[{"number": 1, "title": "text", "content": "text"}]' if name == "tutorial" else '["text"]') if f == "steps" else '"text"') for _, f in sections) + "}"
    for name, sections in SECTIONS.items()
}


def shape(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])[c]


def prompt(category_name: Column, topic: Column, context: Column) -> Column:
    """What a model is asked for a document."""
    return F.concat(
        F.lit("Write a "), category_name, F.lit(' document about "'), topic, F.lit('".\n\nContext:\n'), context,
        F.lit("\n\nAnswer with one JSON object of this shape and nothing around it:\n"), shape(category_name),
        F.lit("\n\nWrite clearly and briefly, in the depth that the kind of document calls for, with code where it helps."),
    )


def repository_context(path: Column) -> Column:
    return F.concat(F.lit("Repository at "), path)


def requests(asked: DataFrame) -> DataFrame:
    """asked(category, topic, context) with its normalised category, prompt, file and error."""
    out = asked.withColumn("category", F.coalesce(category(F.col("category")), "category"))
    out = out.withColumn("file", topic_file(F.col("topic")))
    bad = F.coalesce(
        F.when(category(F.col("category")).isNull(), F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("")))),
        F.when(~safe_name(F.col("file")), F.concat(F.lit("topic is no file name: "), F.coalesce("topic", F.lit("")))),
    )
    out = out.withColumn("error", F.when(bad.isNotNull(), errors.error("docgen.generation", bad)))
    return out.withColumn("prompt", F.when(F.col("error").isNull(), prompt(F.col("category"), F.col("topic"), F.col("context"))))


def documents(answers: DataFrame) -> DataFrame:
    """answers(category, answer, ...) with ``document`` and ``error``: unfenced, parsed, rendered."""
    clean = unfence(F.col("answer"))
    parsed = answers.withColumn("_v", jsons.parsed(clean))
    failed = F.when(F.col("_v").isNull(), errors.error("docgen.generation", F.concat(F.lit("answer is not JSON: "), F.coalesce(clean, F.lit("")))))
    before = F.col("error") if "error" in answers.columns else F.lit(None).cast("struct<kind:string,message:string>")
    return parsed.withColumn("error", F.coalesce(before, failed)).withColumn("document", F.when(F.col("error").isNull(), render_variant(F.col("category"), F.col("_v")))).drop("_v")


def generate(asked: DataFrame, responder: Responder) -> DataFrame:
    """asked(id, category, topic, context) with prompt, file, answer, document and error.

    A prompt is sent once, with its hash as conv_id, and all requests with that prompt get
    its answer; ids may be null or repeat.
    """
    wanted = requests(asked).withColumn("_key", request_key(F.col("prompt")))
    sent = wanted.filter("error is null").select(F.col("_key").alias("conv_id"), F.col("prompt").alias("request")).dropDuplicates(["conv_id"])
    answered = responder.complete(sent).select(F.col("conv_id").alias("_key"), F.col("content").alias("answer"))
    return documents(wanted.join(answered, "_key", "left").drop("_key"))


def guard(documents: DataFrame, existing: DataFrame, directory: str, *, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to write, refused) of documents(category, file, ...), given existing(path).

    A document is refused where its path exists already, or where several rows
    would write it; ``overwrite`` lifts the first.
    """
    placed = documents.withColumn("path", document_path(F.lit(directory), F.col("category"), F.col("file")))
    several = placed.groupBy("path").agg(F.count("*").alias("_n")).filter("_n > 1").select("path", F.lit("several documents for ").alias("_why"))
    taken = existing.select("path").distinct().withColumn("_why", F.lit("File already exists: "))
    reasons = several if overwrite else several.unionByName(taken).groupBy("path").agg(F.min("_why").alias("_why"))
    marked = placed.join(reasons, "path", "left")
    refused = marked.filter("_why is not null").withColumn("error", errors.error("docgen.io", F.concat("_why", "path"))).drop("_why")
    return marked.filter("_why is null").drop("_why"), refused
