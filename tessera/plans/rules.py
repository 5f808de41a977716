"""Rules as DataFrame plans: tasks from joined sets, and rules that feed themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import task_id
from ..functions.pattern import KeyPattern
from ..operators.graph import cut
from ..operators.join import Relation, RuleError, joined_sets, union_vars


class SendLimitError(RuntimeError):
    """A rule goes on feeding itself."""


def check_templates(relations: list[Relation], outputs: dict[str, KeyPattern]) -> None:
    known = set(union_vars(relations))
    for name, p in outputs.items():
        unknown = [v for v in p.var_names if v not in known]
        if unknown:
            raise RuleError(f"output '{name}' has variables {unknown} that no relation has")


def one_task_io(name: str, relations: list[Relation], outputs: dict[str, KeyPattern], required: list[str] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """task_io rows of one task per joined set: inputs are the data of the relations in order, lists laid flat;
    outputs the templates. A set that lacks a template's variable gives no task. `prefixes` names outputs that are prefixes."""
    check_templates(relations, outputs)
    sets = joined_sets(relations, required)
    names = union_vars(relations)
    data = [r.data for r in relations if r.data in sets.columns]
    empty = F.array().cast("array<struct<id:string,stamp:string>>")
    flat = F.concat(*(F.coalesce(F.col(c), empty) for c in data)) if data else empty
    rendered = {k: p.render({v: F.col(v) for v in p.var_names}) for k, p in outputs.items()}
    sets = sets.select(task_id(name, [F.col(n) for n in names]).alias("task_id"), flat.alias("ins"), *(c.alias(f"out_{k}") for k, c in rendered.items()))
    for k in outputs:
        sets = sets.where(F.col(f"out_{k}").isNotNull())
    entry = lambda side, pos, kind, id: F.struct(F.lit(side).alias("side"), pos.cast("int").alias("pos"), kind.alias("kind"), id.alias("id"))
    ins = F.transform("ins", lambda x, i: entry("in", i, F.lit("artifact"), x["id"]))
    outs = [F.array(entry("out", F.lit(i), F.lit("prefix" if k in prefixes else "artifact"), F.col(f"out_{k}"))) for i, k in enumerate(outputs)]
    return sets.select("task_id", F.explode(F.concat(ins, *outs)).alias("e")).select("task_id", "e.*")


def task_id_clashes(tasks: DataFrame) -> DataFrame:
    """tasks (task_id, group_key): ids given by more than one group, or twice by one; such a step is refused as a whole."""
    return tasks.groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("groups")).where("n > 1")


def loop_rows(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], limit: int = 10_000) -> DataFrame:
    """All rows that a rule derives from start, itself included: semi-naive rounds over the new rows until there are
    none. More than `limit` rounds are an error. Lineage is cut each round."""
    every = new = cut(start.dropDuplicates(keys))
    for _ in range(limit):
        new = cut(step(new).dropDuplicates(keys).join(every, keys, "left_anti"))
        if new.isEmpty():
            return every
        every = cut(every.unionByName(new))
    raise SendLimitError(f"the rule was still giving rows after {limit} rounds")
