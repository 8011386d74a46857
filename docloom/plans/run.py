"""Execution of plans: all plans at once, each one's steps in its own order.

Steps run by wave and, within one, in the order of the plan.  A plan has one conversation:
the prompt of each ``agent_task`` is a user's message behind all that was said before, and
the step is done when the responder answers.  The other actions only take their turn in
the order; commands are never executed.  The first step that fails ends its plan: what it
has said stays, later steps do not run, and other plans go on.  A plan whose steps are
all done but for such as can never run ends with an error, too.

A round runs the next agent task of every plan that is still going, so there are as many
rounds as the plan with the most of them has, however many plans there are.

Cases with a defined result
  null plan         left out
  no steps          the plan is not among the results
  repeated id       those that are ready first run; the plan ends with an error
  null prompt       an empty message
  empty table       empty results
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..model import ERROR, LOG, MOST_ROUNDS
from ..operators import agent, conversation
from ..operators.agent import Responder
from ..operators.tools import Registry
from . import waves

#: Said of a plan that stops short without a failure.
DEADLOCK = "steps are left that wait for each other, for themselves or for unknown steps"


def run_plans(
    steps: DataFrame, responder: Responder, registry: Registry, *, most_rounds: int = MOST_ROUNDS, compact_to: int | None = None, system_prompt: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ran, plans, log) of ``steps(plan, ord, id, action struct<type, params>, deps)``.

    ran    (plan, wave, ord, id, place, state, output, error): ``place`` is the step's place in
           the execution, ``state`` is done, failed, or skipped behind a failure; steps that
           can never run are skipped with a null place
    plans  (plan, n_steps, n_done, error): the failed step's error, or that of a deadlock
    log    the conversations, with the plan as conv_id
    """
    steps = steps.filter("plan is not null").select("plan", "ord", "id", "deps", F.col("action.type").alias("_action"), F.col("action.params.prompt").alias("_prompt"))
    scheduled = waves.schedule(steps, carried=("_action", "_prompt"))
    # all of a plan by one shuffle; steps that never run come last
    in_order = Window.partitionBy("plan").orderBy(F.col("wave").isNull(), "wave", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    task = (F.col("_action") == "agent_task") & F.col("wave").isNotNull()
    placed = scheduled.withColumn("place", F.when(F.col("wave").isNotNull(), F.count(F.lit(1)).over(in_order)))
    placed = placed.withColumn("_task", F.when(task, F.count_if(task).over(in_order)))
    prompt = F.when(task, F.coalesce("_prompt", F.lit("")))
    placed = placed.select("plan", "wave", "ord", "id", "place", "_task", prompt.alias("_prompt")).checkpoint()
    wanted = F.array_sort(F.collect_list(F.struct("_task", "place", F.col("_prompt").alias("prompt"))))
    # a row for each conversation: what it said, the tasks to come, and which messages are the answers to those before
    talks = placed.filter("_task is not null").groupBy(F.col("plan").alias("conv_id")).agg(wanted.alias("_tasks"))
    talks = talks.withColumns({"last": F.lit(-1).cast("long"), "messages": F.array().cast(agent.SAID), "_answers": F.array().cast("array<int>")}).checkpoint()
    most = talks.agg(F.max(F.size("_tasks"))).head()[0] or 0

    parts: list[DataFrame] = []  # what each round adds to the log
    results: list[DataFrame] = []
    for _ in range(most):
        next_ = F.col("_tasks")[0]
        turn = F.col("last") + 1
        said_now = F.array(F.struct(turn.alias("turn"), F.lit("user").alias("role"), next_["prompt"].alias("content"))).cast(agent.SAID)
        later = F.slice("_tasks", F.lit(2), F.size("_tasks"))
        asked = talks.select("conv_id", turn.alias("last"), F.concat("messages", said_now).alias("messages"), next_["place"].alias("_place"), later.alias("_tasks"), "_answers")
        parts.append(agent._messages(asked.withColumn("turn", F.col("last")), conversation.message("user", F.element_at("messages", -1)["content"])))
        said, ended = agent.continued(asked, responder, registry, most_rounds=most_rounds, compact_to=compact_to, system_prompt=system_prompt)
        parts.append(said)
        answered = F.concat("_answers", F.array(F.size("messages")))
        ended = ended.withColumn("_answers", F.when(F.col("error").isNull(), answered).otherwise(F.col("_answers")))
        goes_on = F.col("error").isNull() & (F.size("_tasks") > 0)
        outputs = F.transform("_answers", lambda at: F.col("messages")[at - 1]["content"])
        stop = F.when(F.col("error").isNotNull(), F.col("_place"))
        results.append(ended.filter(~goes_on).select(F.col("conv_id").alias("plan"), outputs.alias("_outputs"), stop.alias("_stop"), F.col("error").alias("_error")))
        talks = ended.filter(goes_on)

    if results:
        ran = placed.join(reduce(DataFrame.unionByName, results), "plan", "left")
    else:
        ran = placed.withColumns({"_outputs": F.lit(None).cast("array<string>"), "_stop": F.lit(None).cast("long"), "_error": F.lit(None).cast(ERROR)})
    state = F.when(F.col("place").isNull() | (F.col("place") > F.col("_stop")), "skipped").when(F.col("place") == F.col("_stop"), "failed").otherwise("done")
    output, error = F.get("_outputs", (F.col("_task") - 1).cast("int")), F.when(F.col("place") == F.col("_stop"), F.col("_error"))
    ran = ran.select("plan", "wave", "ord", "id", "place", state.alias("state"), output.alias("output"), error.alias("error"))
    counted = ran.groupBy("plan").agg(
        F.count("*").alias("n_steps"), F.size(F.collect_set(F.when(F.col("state") == "done", F.col("id")))).cast("long").alias("n_done"),
        F.max(F.when(F.col("state") == "failed", F.struct("id", "error"))).alias("_failed"),
    )
    failure = errors.error("workflow.execution", F.concat(F.lit("step "), F.coalesce("_failed.id", F.lit("")), F.lit(": "), F.col("_failed.error.message")))
    left = F.when(F.col("n_done") < F.col("n_steps"), errors.error("workflow.execution", F.lit(DEADLOCK)))
    plans = counted.select("plan", "n_steps", "n_done", F.when(F.col("_failed").isNotNull(), failure).otherwise(left).alias("error"))
    if parts:
        return ran, plans, reduce(DataFrame.unionByName, parts)
    kind = steps.schema["plan"].dataType.simpleString()
    return ran, plans, steps.sparkSession.createDataFrame([], LOG.replace("conv_id long", f"conv_id {kind}"))
