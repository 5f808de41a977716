"""Which task writes what another task reads: edges (consumer, producer) from task_io rows.

task_io: task_id, side ('in' or 'out'), pos, kind ('artifact' or 'prefix'), id.

A prefix covers the ids that start with it. startswith() as a join condition is a nested loop, so ids are expanded to those
of their beginnings that have the length of some prefix, and joined by hash. The list of lengths has at most as
many entries as the longest id has characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beginnings(ids: DataFrame, id: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """ids with a column `start` for every beginning that is as long as some prefix."""
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length(prefix))).alias("lengths"))
    cut = F.filter("lengths", lambda n: n <= F.length(id))
    return ids.crossJoin(F.broadcast(lengths)).select(*ids.columns, F.explode(F.transform(cut, lambda n: F.substring(F.col(id), F.lit(1), n))).alias("start"))


def _side(io: DataFrame, side: str, kind: str, name: str) -> DataFrame:
    return io.where((F.col("side") == side) & (F.col("kind") == kind)).select(F.col("task_id").alias(name), F.col("id").alias(f"{name}_ref"))


def exact_edges(io: DataFrame) -> DataFrame:
    a, b = _side(io, "in", "artifact", "consumer"), _side(io, "out", "artifact", "producer")
    return a.join(b, a["consumer_ref"] == b["producer_ref"]).select("consumer", "producer")


def prefix_output_edges(io: DataFrame) -> DataFrame:
    """An artifact is read below a prefix that is written."""
    a, b = _side(io, "in", "artifact", "consumer"), _side(io, "out", "prefix", "producer")
    return beginnings(a, "consumer_ref", b, "producer_ref").join(b, F.col("start") == b["producer_ref"]).select("consumer", "producer")


def prefix_input_edges(io: DataFrame) -> DataFrame:
    """A prefix is read and an artifact below it is written."""
    a, b = _side(io, "in", "prefix", "consumer"), _side(io, "out", "artifact", "producer")
    return beginnings(b, "producer_ref", a, "consumer_ref").join(a, F.col("start") == a["consumer_ref"]).select("consumer", "producer")


def overlap_edges(io: DataFrame) -> DataFrame:
    """Two prefixes of which one starts with the other."""
    a, b = _side(io, "in", "prefix", "consumer"), _side(io, "out", "prefix", "producer")
    down = beginnings(a, "consumer_ref", b, "producer_ref").join(b, F.col("start") == b["producer_ref"]).select("consumer", "producer")
    up = beginnings(b, "producer_ref", a, "consumer_ref").join(a, F.col("start") == a["consumer_ref"]).select("consumer", "producer")
    return down.union(up).distinct()


def custom_edges(inputs: DataFrame, outputs: DataFrame, covers: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """inputs have `consumer`, outputs `producer`; a user's predicate decides, so every pair of its join keys is tried."""
    return inputs.join(outputs, covers(inputs, outputs)).select("consumer", "producer")


def edges(io: DataFrame) -> DataFrame:
    """All dependencies; a task never waits for itself."""
    every = exact_edges(io).union(prefix_output_edges(io)).union(prefix_input_edges(io)).union(overlap_edges(io))
    return every.where("consumer <> producer").distinct()


def orphans(found: DataFrame, io: DataFrame) -> DataFrame:
    """Rows of found (id) that no task declares, neither as an artifact nor by a prefix."""
    outs = io.where("side = 'out'")
    exact = outs.where("kind = 'artifact'").select("id").distinct()
    prefix = outs.where("kind = 'prefix'").select(F.col("id").alias("prefix")).distinct()
    rest = found.join(exact, "id", "left_anti")
    covered = beginnings(rest.select("id"), "id", prefix, "prefix").join(prefix, F.col("start") == F.col("prefix"), "left_semi").select("id").distinct()
    return rest.join(covered, "id", "left_anti")


def uncovered_reports(reports: DataFrame, io: DataFrame) -> DataFrame:
    """Rows of reports (task_id, id) that the task's own outputs don't cover."""
    outs = io.where("side = 'out'").select("task_id", "kind", F.col("id").alias("out"))
    ok = reports.join(outs, "task_id").where(((F.col("kind") == "artifact") & (F.col("out") == F.col("id"))) | ((F.col("kind") == "prefix") & F.col("id").startswith(F.col("out"))))
    return reports.join(ok.select("task_id", "id").distinct(), ["task_id", "id"], "left_anti")
