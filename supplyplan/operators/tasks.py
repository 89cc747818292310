"""Task ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.calendar import stamp_text, timestamp_literal
from supplyplan.functions.text import join_text, normalized
from supplyplan.plans.ledger import aligned, next_id, numbered
from supplyplan.plans.skew import lookup_join
from supplyplan.sources.ledgers import StoredLedger


def created_tasks(tasks: DataFrame, actions: DataFrame, as_of: date | datetime,
                  ids: Callable[[int], int] | None = None) -> DataFrame:
    """New tasks of a batch, with the `ord` of the action that made them; `ids` reserves their ids (`IdBlocks`)."""
    first = ids or next_id(tasks, "task_request_id")
    made = numbered(normalized(actions).where("action = 'CREATE'"), "ord", first, "task_request_id")
    now = timestamp_literal(as_of)
    message = join_text(f"<U>{stamp_text(as_of)} [", F.col("p_from"), "]</U><BR/>", F.col("message"), "<BR/>")
    return made.select(
        "ord", "task_request_id", F.col("task_request_id").alias("task_approval_id"), "planner",
        F.col("p_from").alias("task_from"), "supplier", F.col("p_to").alias("task_to"), "product",
        F.col("forecast_date").cast("string").alias("forecast_date"),
        F.col("variance").cast("string").alias("variances"), F.col("status").alias("task_status"),
        F.col("subject").alias("task_subject"), message.alias("task_message"),
        F.col("login_value").alias("created_by"), now.alias("creation_date"),
        F.col("login_value").alias("updated_by"), now.alias("updation_date"))


def apply_task_actions(tasks: DataFrame, actions: DataFrame, as_of: date | datetime) -> DataFrame:
    """The task table after a batch of actions, taken in `ord` order.

    A text that is no number in request_id fails that action alone; see `task_action_status`. CREATE adds a task, UPDATE sets the status and appends a stamped message (signed by
    the sender for planners, by the receiver for manufacturers; other roles append
    nothing), other actions and unknown task ids do nothing. An update of a task created
    in the same batch counts if it comes later.

    Actions: ord, action, request_id, login_type, login_value, planner, p_from, supplier,
    p_to, product, forecast_date, variance, status, subject, message. All messages of one
    task end in one text, so its updates are gathered per task by nature of the result.
    """
    created = created_tasks(tasks, actions, as_of)
    return _updated(tasks.unionByName(aligned(created, tasks)), created, actions, as_of)


def store_task_actions(ledger: StoredLedger, actions: DataFrame, as_of: date | datetime,
                       ids: Callable[[int], int] | None = None) -> int:
    """`apply_task_actions` on a stored ledger, as one version: only files with an updated task are rewritten."""
    tasks = ledger.read()
    created = created_tasks(tasks, actions, as_of, ids)
    asked = actions.where("action = 'UPDATE'").select(F.col("request_id").try_cast("long").alias("request_id"))
    return ledger.change(asked.where("request_id IS NOT NULL"), lambda rows: _updated(rows, created, actions, as_of),
                         _updated(aligned(created, tasks), created, actions, as_of))


def _updated(before: DataFrame, created: DataFrame, actions: DataFrame, as_of: date | datetime) -> DataFrame:
    """Rows of the ledger after the updates of a batch; `created` tells when the batch's own tasks came to be."""
    born = created.select(F.col("task_request_id").alias("request_id"), F.col("ord").alias("born"))
    updates = normalized(actions.withColumn("request_id", F.col("request_id").try_cast("long"))).where(
        "action = 'UPDATE' AND request_id IS NOT NULL")
    updates = lookup_join(updates, born, ["request_id"], "left", left_spread=F.col("ord")).where(
        F.col("born").isNull() | (F.col("ord") > F.col("born")))
    sign = (F.when(F.col("login_type") == "PLNR", F.struct(F.col("p_from").alias("who")))
            .when(F.col("login_type") == "CM", F.struct(F.col("p_to").alias("who"))))
    addition = F.when(sign.isNotNull(), join_text(
        f"<BR/><U>{stamp_text(as_of)} [", sign["who"], "]</U><BR/>", F.col("message"), "<BR/>"))
    folded = updates.withColumn("addition", addition).groupBy(F.col("request_id").alias("task_request_id")).agg(
        F.expr("listagg(addition, '') WITHIN GROUP (ORDER BY ord)").alias("added"),
        F.max_by(F.struct("status", "login_value"), "ord").alias("last"))
    after = lookup_join(before, folded, ["task_request_id"], "left")
    touched = F.col("last").isNotNull()
    return after.withColumns({
        "task_status": F.when(touched, F.col("last.status")).otherwise(F.col("task_status")),
        "task_message": F.when(touched, join_text(F.col("task_message"), F.col("added")))
        .otherwise(F.col("task_message")),
        "updated_by": F.when(touched, F.col("last.login_value")).otherwise(F.col("updated_by")),
        "updation_date": F.when(touched, timestamp_literal(as_of)).otherwise(F.col("updation_date")),
    }).select(*before.columns)


def task_action_status(tasks: DataFrame, actions: DataFrame, as_of: date | datetime) -> DataFrame:
    """ord and status of every action: CREATED, UPDATED, BAD_ID, UNKNOWN_TASK (also a task that a later action of the
    batch makes) or IGNORED."""
    asked = normalized(actions.select("ord", "action", F.col("request_id").cast("string").alias("asked")))
    asked = asked.withColumn("request_id", F.col("asked").try_cast("long"))
    known = tasks.select(F.col("task_request_id").alias("request_id"), F.lit(None).cast("long").alias("born")).unionByName(
        created_tasks(tasks, actions, as_of).select(F.col("task_request_id").alias("request_id"),
                                                    F.col("ord").cast("long").alias("born"))).where("request_id IS NOT NULL")
    first = known.groupBy("request_id").agg(F.min(F.coalesce("born", F.lit(-(1 << 63)))).alias("from"))
    met = lookup_join(asked, first, ["request_id"], "left", left_spread=F.col("ord"))
    update = F.col("action") == "UPDATE"
    return met.select("ord", F.when(F.col("action") == "CREATE", "CREATED")
                      .when(update & F.col("asked").isNotNull() & F.col("request_id").isNull(), "BAD_ID")
                      .when(update & F.col("asked").isNotNull() & (F.col("ord") > F.col("from")), "UPDATED")
                      .when(update & F.col("asked").isNotNull(), "UNKNOWN_TASK").otherwise("IGNORED").alias("status"))
