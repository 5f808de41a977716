"""Why a task runs, or that it is skipped: one DataFrame plan over task inputs and outputs, the world and the records.

task: task_id. task_io: task_id, side, pos, kind, id. state: kind, id, stamp. record: task_id, side, ref_key, stamp
(a task whose last success is recorded has at least a row with side 'ok'; rows of bad shape are no record).
Reasons, the first that holds: no-store, no-inputs, input-unstamped, no-record, input-ids-changed, input-changed, then of the first output
by position that isn't as recorded: output-unstamped, output-ids-changed, output-missing, output-changed; then
output-ids-changed if more outputs were recorded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ref_key

REASONS = (
    "no-store", "no-inputs", "input-unstamped", "no-record", "input-ids-changed", "input-changed",
    "output-unstamped", "output-ids-changed", "output-missing", "output-changed",
)


def good_records(record: DataFrame) -> DataFrame:
    """Records whose rows all have a key and a known side; a task with any other row has none."""
    bad = record.where("task_id is null or side is null or side not in ('ok', 'in', 'out') or (side <> 'ok' and ref_key is null)")
    return record.join(bad.select("task_id").distinct(), "task_id", "left_anti").where("task_id is not null")


def decide(task: DataFrame, task_io: DataFrame, state: DataFrame, record: DataFrame | None) -> DataFrame:
    """task_id, reason, reason_id; reason NULL: skip."""
    if record is None:
        return task.select("task_id", F.lit("no-store").alias("reason"), F.lit(None).cast("string").alias("reason_id"))
    rec = good_records(record)
    # an input or output declared twice counts once, at its first place
    io = task_io.groupBy("task_id", "side", "kind", "id").agg(F.min("pos").alias("pos")).withColumn("ref_key", ref_key(F.col("kind"), F.col("id")))
    io = io.join(state, ["kind", "id"], "left")
    known = rec.where("side <> 'ok'").select("task_id", "side", "ref_key", F.col("stamp").alias("recorded"), F.lit(True).alias("has"))
    io = io.join(known, ["task_id", "side", "ref_key"], "left")
    is_in, is_out, prefix = F.col("side") == "in", F.col("side") == "out", F.col("kind") == "prefix"
    first = lambda cond, what="id": F.min_by(F.when(cond, F.col(what)), F.when(cond, F.col("pos")))
    changed = F.col("has") & ~F.col("stamp").eqNullSafe(F.col("recorded"))
    # a prefix without a stamp never enters a record, so as an input it doesn't count among the recorded keys
    fault = (
        F.when(prefix & F.col("stamp").isNull(), F.struct(F.lit("output-unstamped").alias("reason"), F.col("id").alias("reason_id")))
        .when(F.col("has").isNull(), F.struct(F.lit("output-ids-changed").alias("reason"), F.lit(None).cast("string").alias("reason_id")))
        .when(F.col("stamp").isNull(), F.struct(F.lit("output-missing").alias("reason"), F.col("id").alias("reason_id")))
        .when(~F.col("stamp").eqNullSafe(F.col("recorded")), F.struct(F.lit("output-changed").alias("reason"), F.col("id").alias("reason_id")))
    )
    io = io.withColumn("fault", F.when(is_out, fault))
    seen = io.groupBy("task_id").agg(
        F.sum(is_in.cast("int")).alias("n_in"),
        F.sum(is_out.cast("int")).alias("n_out"),
        first(is_in & prefix & F.col("stamp").isNull()).alias("unstamped"),
        F.max(is_in & F.col("has").isNull()).alias("new_in"),
        first(is_in & changed).alias("changed_in"),
        first(F.col("fault").isNotNull(), "fault").alias("fault"),
    )
    count = lambda side: F.sum((F.col("side") == side).cast("int"))
    recorded = rec.groupBy("task_id").agg(count("in").alias("rec_in"), count("out").alias("rec_out"))
    t = task.select("task_id").join(seen, "task_id", "left").join(recorded, "task_id", "left")
    why = lambda reason, id=None: F.struct(F.lit(reason).alias("reason"), (F.lit(None).cast("string") if id is None else F.col(id)).alias("reason_id"))
    decision = (
        F.when(F.coalesce("n_in", F.lit(0)) == 0, why("no-inputs"))
        .when(F.col("unstamped").isNotNull(), why("input-unstamped", "unstamped"))
        .when(F.col("rec_in").isNull(), why("no-record"))
        .when(F.col("new_in") | (F.col("rec_in") != F.col("n_in")), why("input-ids-changed"))
        .when(F.col("changed_in").isNotNull(), why("input-changed", "changed_in"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("rec_out") > F.coalesce("n_out", F.lit(0)), why("output-ids-changed"))
    )
    return t.withColumn("d", decision).select("task_id", F.col("d.reason").alias("reason"), F.col("d.reason_id").alias("reason_id"))


def snapshot(task_io: DataFrame, state: DataFrame) -> DataFrame:
    """Record rows of the tasks in task_io as the world is now: task_id, side, ref_key, stamp. Prefixes without a stamp are left out."""
    io = task_io.select("task_id", "side", "kind", "id").distinct().join(state, ["kind", "id"], "left").where("kind = 'artifact' or stamp is not null")
    rows = io.select("task_id", "side", ref_key(F.col("kind"), F.col("id")).alias("ref_key"), "stamp")
    ok = task_io.select("task_id").distinct().select("task_id", F.lit("ok").alias("side"), F.lit("").alias("ref_key"), F.lit(None).cast("string").alias("stamp"))
    return rows.union(ok)


def outcomes(task: DataFrame, edges: DataFrame, decisions: DataFrame, fails: DataFrame) -> DataFrame:
    """task_id, type (executed, skipped, failed), reason, level. fails: task_id of tasks whose body would fail if it ran."""
    from ..operators.graph import cut, settle

    decisions = cut(decisions)  # read three times below
    runs = decisions.where("reason is not null").select("task_id")
    bad = fails.join(runs, "task_id", "left_semi").select("task_id", F.lit(True).alias("bad"))
    nodes = task.select("task_id").join(bad, "task_id", "left").select(F.col("task_id").alias("id"), F.coalesce("bad", F.lit(False)).alias("fails"))
    s = settle(nodes, edges)
    out = s.join(decisions, s["id"] == decisions["task_id"], "left")
    kind = F.when(F.col("state") != "ok", "failed").when(F.col("reason").isNull(), "skipped").otherwise("executed")
    why = F.when(F.col("state") == "failed", "error").when(F.col("state") != "ok", F.col("state")).otherwise(F.col("reason"))
    return out.select(F.col("id").alias("task_id"), kind.alias("type"), why.alias("reason"), "level")
