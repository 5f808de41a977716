"""Aggregates, set differences and ordered operators over keyed rows and their changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_lists(files: DataFrame, keys: list[str], id: str = "id", stamp: str = "stamp") -> DataFrame:
    """One row per key with the files in order of their ids. A list that would be empty has no row."""
    entry = F.struct(F.col(id).cast("string").alias("id"), F.col(stamp).cast("string").alias("stamp"))
    return files.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("data"), F.lit(True).alias("is_list"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by order; a map-side aggregate, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def existence(events: DataFrame, keys: list[str]) -> DataFrame:
    """events: keys, seq, kind (scan, produced, deleted, promised, withdrawn), task. Final state per key:
    on_disk, promised, matched. On disk goes by the last of scan, produced and deleted; promised, if some task's last word is promised."""
    disk = F.col("kind").isin("scan", "produced", "deleted")
    on_disk = events.where(disk).groupBy(*keys).agg((F.max_by("kind", "seq") != "deleted").alias("on_disk"))
    word = events.where(~disk).groupBy(*keys, "task").agg(F.max_by("kind", "seq").alias("w"))
    promised = word.groupBy(*keys).agg(F.max(F.col("w") == "promised").alias("promised"))
    both = on_disk.join(promised, keys, "full_outer")
    both = both.select(*keys, F.coalesce("on_disk", F.lit(False)).alias("on_disk"), F.coalesce("promised", F.lit(False)).alias("promised"))
    return both.withColumn("matched", F.col("on_disk") | F.col("promised"))


def existence_transitions(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, op: found or gone where the matched state of a key flips."""
    own = Window.partitionBy(*keys).orderBy("seq")
    disk = F.when(F.col("kind").isin("scan", "produced"), True).when(F.col("kind") == "deleted", False)
    # the number of promising tasks changes only where a task's word changes
    by_task = Window.partitionBy(*keys, "task").orderBy("seq")
    word = F.when(F.col("kind") == "promised", 1).when(F.col("kind") == "withdrawn", 0)
    e = events.withColumn("word", word)
    e = e.withColumn("before", F.coalesce(F.last("word", True).over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("step", F.coalesce(F.col("word") - F.col("before"), F.lit(0)))
    e = e.withColumn("on_disk", F.coalesce(F.last(disk, True).over(own), F.lit(False))).withColumn("n", F.sum("step").over(own))
    e = e.withColumn("matched", F.col("on_disk") | (F.col("n") > 0))
    e = e.withColumn("was", F.coalesce(F.lag("matched").over(own), F.lit(False)))
    return e.where("matched <> was").select(*keys, "seq", F.when(F.col("matched"), "found").otherwise("gone").alias("op"))


def changed_rows(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's row before them."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value))).where("_first or not _same").drop("_first", "_same")


def first_place(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row with `place`: a row that replaces another of its key keeps the first one's place."""
    return rows.withColumn("place", F.min(order).over(Window.partitionBy(*keys)))


def previous(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "previous") -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def first_and_last(rows: DataFrame, keys: list[str], order: str, value: str, first: int, last: int) -> DataFrame:
    """Each row with `members`: the key's first rows and the last ones before it, each once, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    entry = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    head = F.collect_list(F.when(F.col("_n") <= first, entry)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tail = F.collect_list(entry).over(w.rowsBetween(-last, -1))
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.array_sort(F.array_distinct(F.concat(head, tail))))
    return out.withColumn("members", F.transform("_all", lambda x: x["v"])).drop("_n", "_all")


def outputs_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase, event: withdrawn ones (phase 0) come before promised ones (phase 1)."""
    gone = old.join(new, keys, "left_anti").select(*keys, F.lit(0).alias("phase"), F.lit("withdrawn").alias("event"))
    come = new.join(old, keys, "left_anti").select(*keys, F.lit(1).alias("phase"), F.lit("promised").alias("event"))
    return gone.union(come)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def same_ids(a: Column, b: Column) -> Column:
    """Equal sets of ids, in any order, NULL as the empty one."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, empty))) == F.array_sort(F.array_distinct(F.coalesce(b, empty)))


def same_lists(a: Column, b: Column) -> Column:
    """Equal lists in equal order; NULL equals NULL."""
    return a.eqNullSafe(b)


def lost(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the old rows that the new ones lack: tasks that leave a group, outputs that nobody makes any more."""
    return old.join(new, keys, "left_anti").select(*keys)


def live_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The number of different keys, as `live`. A key with a NULL in it isn't one."""
    return rows.agg(F.count_distinct(*keys).alias("live"))


def unreported(outputs: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Declared outputs of tasks that succeeded without saying so: they count as produced."""
    return outputs.join(reported, keys, "left_anti")


def outcome_buckets(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("type").agg(F.count("*").alias("n"))


def success(outcomes: DataFrame, errors: int = 0) -> DataFrame:
    return outcomes.agg((F.coalesce(F.bool_and(F.col("type") != "failed"), F.lit(True)) & F.lit(errors == 0)).alias("success"))
