"""Changelogs of artifacts as streams: the existence state machine and step-wise refresh of joined sets.

Events: seq, kind (scan, promised, produced, deleted, withdrawn), path, task. One micro-batch is one step: all of its changes apply
at once, retractions before assertions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import latest
from ..operators.graph import cut
from ..operators.join import Relation, diff_sets, joined_sets, touched_sets, union_vars
from ..plans.state import upsert

EVENTS = "seq long, kind string, path string, task string"


class Existence(StatefulProcessor):
    """Per path: on disk or not, and the tasks that promise it. Emits (path, seq, op) when its being matched flips."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.disk = handle.getValueState("disk", "on boolean")
        self.tasks = handle.getMapState("tasks", "task string", "on boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        on = bool(self.disk.get()[0]) if self.disk.exists() else False
        promised = {k[0] for k, v in self.tasks.iterator() if v[0]}
        out = []
        for seq, kind, task in zip(pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["task"].tolist(), strict=True):
            was = on or bool(promised)
            if kind in ("scan", "produced"):
                on = True
            elif kind == "deleted":
                on = False
            elif kind == "promised":
                promised.add(task)
                self.tasks.updateValue((task,), (True,))
            elif kind == "withdrawn" and task in promised:
                promised.discard(task)
                self.tasks.removeKey((task,))
            if (on or bool(promised)) != was:
                out.append((key[0], seq, "gone" if was else "found"))
        self.disk.update((on,))
        if out:
            yield pd.DataFrame(out, columns=["path", "seq", "op"])

    def close(self) -> None:
        pass


def existence_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of operators.changes.existence_transitions. Needs the RocksDB state store provider."""
    return events.groupBy("path").transformWithStateInPandas(Existence(), "path string, seq long, op string", "Append", "None")


class Refresh:
    """Keeps joined sets up to date from changelogs of their relations.

    step() takes the changes of one micro-batch (relation name -> rows with seq, op, variables, data), applies the last one
    per key and returns the sets that were added, removed or changed. Only sets that the changed keys touch are derived, once from the
    tables before the step and once from those after it. A change that leaves a row with the same ids
    is no change. Rows wait in the tables without limit, so there is no watermark."""

    def __init__(self, relations: list[Relation], required: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> None:
        self.relations = {r.name: r for r in relations}
        self.order = [r.name for r in relations]
        self.required, self.keep = required, keep

    @property
    def sets(self) -> DataFrame:
        """All sets as they are now; a plan, not kept."""
        return joined_sets([self.relations[n] for n in self.order], self.required)

    def step(self, changes: dict[str, DataFrame]) -> DataFrame:
        old = [self.relations[n] for n in self.order]
        changed = {}
        for name, rows in changes.items():
            r = self.relations[name]
            last = self.keep(latest(rows, list(r.vars), "seq") if r.vars else rows.orderBy(F.desc("seq")).limit(1))
            changed[name] = last.select(*r.vars)
            table = upsert(r.df, last, list(r.vars)) if r.vars else last.where("op = 'found'").select(*r.df.columns)
            self.relations[name] = Relation(name, self.keep(table), r.vars)
        new = [self.relations[n] for n in self.order]
        names = union_vars(new)
        was, now = (touched_sets(x, changed, self.required) for x in (old, new))
        ids = lambda df: df.select(*names, *(F.transform(c, lambda x: x["id"]).alias(c) for c in df.columns if c not in names))
        data = [c for c in now.columns if c not in names]
        out = self.keep(diff_sets(ids(was), ids(now), names, data).where("change <> 'same'"))
        # retractions first
        return out.withColumn("phase", F.when(F.col("change") == "removed", 0).otherwise(1))


def refresh_query(stream: DataFrame, refresh: Refresh, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs refresh on a stream of changes with a column `relation`; each micro-batch is one step."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            changes = {}
            for name, r in refresh.relations.items():
                own = df.where(F.col("relation") == name)
                if not own.isEmpty():
                    changes[name] = own.select("seq", "op", *r.df.columns)
            sink(refresh.step(changes), number)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
