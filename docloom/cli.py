"""Command line: ``python -m docloom.cli run|validate|generate|converse|tree ...``.

``run`` runs step plans, each in a conversation of its own, and prints what became of each
step; ``execute_command`` is never executed.  Without ``--answers`` it prints the order of
the steps only.  ``generate`` writes documents and ``converse`` answers conversations.  All
answers are recorded ones.
"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .model import LOG, TOOL_CALLS
from .operators import agent, docgen, tools
from .plans import parse, run, waves
from .sources import files

log = logging.getLogger("docloom")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docloom", description="Documentation dataflow on Spark")
    parser.add_argument("--log", default="INFO")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        command = commands.add_parser(name)
        command.add_argument("plans", help="path or glob of plan files")
        if name == "run":
            command.add_argument("--answers", help="JSON lines of request_sha, content, tool_calls")
    generate = commands.add_parser("generate")
    generate.add_argument("requests", help="JSON lines of id, category, topic, context")
    generate.add_argument("answers", help="JSON lines of request_sha, content")
    generate.add_argument("--output", default=None)
    generate.add_argument("--overwrite", action="store_true")
    converse = commands.add_parser("converse")
    converse.add_argument("log", help="JSON lines of conv_id, turn, role, content")
    converse.add_argument("answers", help="JSON lines of request_sha, content, tool_calls")
    tree = commands.add_parser("tree")
    tree.add_argument("root")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=options.log.upper(), format="%(levelname)s %(filename)s:%(lineno)d %(message)s")
    settings = config.load()
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    files.register(spark)
    if options.command in ("run", "validate"):
        from .queries import _cut

        plans = parse.parse_plans(parse.read_plans(spark, options.plans))
        plans.filter("error is not null").select("path", "error.message").show(truncate=False)
        steps = parse.steps(plans)
        if options.command == "validate":
            waves.validate(steps).show(truncate=False)
        elif options.answers is None:
            scheduled = waves.schedule(steps, checkpoint=_cut(spark))
            scheduled.filter("wave is not null").select("plan", "wave", "ord", "id").orderBy("plan", "wave", "ord").show(1000, truncate=False)
            waves.stalled(scheduled).filter("deadlocked").show(truncate=False)
        else:
            _cut(spark)
            answers = spark.read.schema(f"request_sha string, content string, tool_calls {TOOL_CALLS}").json(options.answers)
            responder = agent.responder(settings, recordings=answers)
            ran, ended, _ = run.run_plans(steps, responder, tools.file_tools(), most_rounds=settings.max_rounds, compact_to=settings.context_tokens)
            ran.select("plan", "place", "id", "state", "output").orderBy("plan", F.col("place").asc_nulls_last()).show(1000, truncate=False)
            ended.filter("error is not null").select("plan", "n_steps", "n_done", "error.message").show(1000, truncate=False)
    elif options.command == "generate":
        asked = spark.read.schema("id long, category string, topic string, context string").json(options.requests)
        answers = spark.read.schema("request_sha string, content string").json(options.answers)
        made = docgen.generate(asked, agent.responder(settings, recordings=answers.withColumn("tool_calls", F.lit(None))))
        output = options.output or settings.output
        os.makedirs(output, exist_ok=True)
        existing = spark.read.format("tree").option("content", "false").option("gitignore", "false").load(output)
        existing = existing.select(F.concat(F.lit(f"{output}/"), "path").alias("path"))
        write, refused = docgen.guard(made.filter("error is null"), existing, output, overwrite=options.overwrite)
        relative = F.substring("path", len(output) + 2, 1 << 30)
        write.select(relative.alias("path"), F.col("document").alias("content")).write.format("documents").mode("overwrite" if options.overwrite else "append").save(output)
        made.filter("error is not null").select("id", "error.message").show(truncate=False)
        refused.select("id", "error.message").show(truncate=False)
    elif options.command == "converse":
        from .queries import _cut

        _cut(spark)
        log_rows = spark.read.schema(LOG).json(options.log)
        answers = spark.read.schema(f"request_sha string, content string, tool_calls {TOOL_CALLS}").json(options.answers)
        responder = agent.responder(settings, recordings=answers)
        _, outcomes = agent.run(log_rows, responder, tools.file_tools(), most_rounds=settings.max_rounds, compact_to=settings.context_tokens)
        outcomes.select("conv_id", "answer", "error.message").show(1000, truncate=False)
    else:
        spark.read.format("tree").option("ignore", "\n".join(settings.ignore)).option("content", "false").load(options.root).orderBy("path").show(1000, truncate=False)
    log.info("%s done", options.command)


if __name__ == "__main__":
    main()
