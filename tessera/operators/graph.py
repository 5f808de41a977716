"""Graph operators on edge lists: connected components, levels, reachability and what is stuck on cycles."""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which a whole graph goes to one task; larger graphs are dealt out by component.
ONE_TASK_EDGES = 2_000_000
#: Different edges up to which components are found in one task; larger graphs take rounds of joins.
ONE_TASK_COMPONENTS = 500_000
#: Rounds in which a larger component is peeled; what is left then is walked in one task, however large, since a graph that deep is a chain.
PEEL_ROUNDS = 200


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the session's setting; a folder of its own only in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at the checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def _jump(hook: DataFrame, moved: bool = False) -> DataFrame:
    up = hook.select(F.col("node").alias("to"), F.col("to").alias("to2"))
    flag = [(F.col("to2") < F.col("to")).alias("moved")] if moved else []
    return hook.join(up, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), *flag)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, comp) of all edges (a, b) that come."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(list(map(root, nodes)), kind)], ["node", "comp"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) to rows (node, comp): comp is the smallest node of the component. Nodes of one type.

    A graph of few different edges (counted) goes to one task; of others, each round hooks every node to its smallest neighbour, follows the pointers to the roots by doubling, and
    replaces the ends of edges by their roots; the edges of a hub collapse by a map-side distinct."""
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = live.schema["a"].dataType.simpleString()
    if is_small(live, ONE_TASK_COMPONENTS):
        return cut(live.repartition(1).mapInArrow(_union, f"node {kind}, comp {kind}"))
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        for _ in range(rounds):
            # two jumps a job: pointers of up to four steps end at their roots
            hook = cut(_jump(_jump(hook)))
            if _jump(hook, moved=True).where("moved").isEmpty():
                break
        maps.append(hook)
        a = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        live = cut(live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError("components: no fixpoint within the bound on rounds")
    if not maps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, comp {kind}")
    out = maps[-1]
    for m in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("to"), F.col("to").alias("top"))
        out = m.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
    return cut(out.select("node", F.col("to").alias("comp")))


def _settle(nodes: list, edges: list[tuple], failed: set, base: dict | None = None, below_failed: tuple = ()) -> list[tuple]:
    """(node, level, state) of one part of a graph. edges: (consumer, producer).

    Levels count from 0, or from `base`; state is ok, failed (in `failed` and able to run), dependency (below a failed one, as those
    in `below_failed` are from the start) or deadlock."""
    below = defaultdict(list)
    waits = dict.fromkeys(nodes, 0)
    for c, p in edges:
        below[p].append(c)
        waits[c] += 1
    level = dict.fromkeys(nodes, 0) | (base or {})
    ready = deque(n for n in nodes if not waits[n])
    order = []
    while ready:
        n = ready.popleft()
        order.append(n)
        for c in below[n]:
            level[c] = max(level[c], level[n] + 1)
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    done = set(order)
    state: dict = dict.fromkeys(below_failed, "dependency")
    spoiled = deque(n for n in below_failed if n not in done)
    for n in order:
        # in topological order, so a failed producer is known before its readers
        if state.get(n) != "dependency" and n in failed:
            state[n] = "failed"
        if n in state:
            for c in below[n]:
                if c not in state:
                    state[c] = "dependency"
                    if c not in done:
                        spoiled.append(c)
    while spoiled:  # failures reach tasks on cycles, too, and take precedence
        for c in below[spoiled.popleft()]:
            if state.get(c) != "dependency":
                state[c] = "dependency"
                spoiled.append(c)
    return [(n, level[n] if n in done else None, state.get(n, "ok" if n in done else "deadlock")) for n in nodes]


def _peel(live: DataFrame, e: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Settles nodes that wait for nothing, round by round, until the edges are few or PEEL_ROUNDS are over.

    live: id, fails, base, bad (below a failed one). Returns parts (id, level, state), and the nodes and edges that are left. If only what hangs on
    cycles is left, failures are spread over it by rounds and no node is."""
    out: list[DataFrame] = []
    for _ in range(PEEL_ROUNDS):
        if is_small(e, ONE_TASK_EDGES):
            return out, live, e
        state = F.when(F.col("bad"), "dependency").when(F.col("fails"), "failed").otherwise("ok")
        ready = cut(live.join(e.select(F.col("consumer").alias("id")).distinct(), "id", "left_anti").select("id", F.col("base").alias("level"), state.alias("state")))
        if ready.isEmpty():
            break
        out.append(ready)
        if len(out) == 16:  # plans of many parts are slow
            out = [cut(_all(out))]
        by = ready.withColumnRenamed("id", "producer")
        told = e.join(by, "producer").groupBy(F.col("consumer").alias("id")).agg((F.max("level") + 1).alias("l"), F.max(F.col("state") != "ok").alias("b"))
        live = live.join(ready.select("id"), "id", "left_anti").join(told, "id", "left")
        live = cut(live.select("id", "fails", F.greatest("base", F.coalesce("l", F.lit(0))).alias("base"), (F.col("bad") | F.coalesce("b", F.lit(False))).alias("bad")))
        e = cut(e.join(by.select("producer"), "producer", "left_anti"))
    else:
        return out, live, e
    bad = new = cut(live.where("bad").select("id"))
    while not new.isEmpty():
        new = cut(e.join(new.withColumnRenamed("id", "producer"), "producer").select(F.col("consumer").alias("id")).distinct().join(bad, "id", "left_anti"))
        bad = cut(bad.union(new))
    hit = live.join(bad.withColumn("hit", F.lit(True)), "id", "left")
    stuck = hit.select("id", F.lit(None).cast("long").alias("level"), F.when(F.col("hit"), "dependency").otherwise("deadlock").alias("state"))
    return [*out, stuck], live.limit(0), e.limit(0)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, fails boolean), edges (consumer, producer) to rows (id, level, state).

    A graph of few edges (counted) goes to one call, and so does each component of a larger graph, without a
    driver loop however deep it is. A component that is larger itself is peeled by joins until few edges are left.
    Self-loops don't count; edges to unknown nodes don't, either."""
    nodes = cut(nodes.select("id", "fails"))
    e = edges.where("consumer <> producer").distinct()
    known = nodes.select(F.col("id").alias("producer"))
    e = e.join(known, "producer", "left_semi").join(known.withColumnRenamed("producer", "consumer"), "consumer", "left_semi")
    e = cut(e)
    kind = nodes.schema["id"].dataType.simpleString()
    start = (F.lit(0).cast("long").alias("base"), F.lit(False).alias("bad"))
    peeled: list[DataFrame] = []
    if is_small(e, ONE_TASK_EDGES):
        on_edge = e.select(F.col("consumer").alias("id")).union(e.select("producer")).distinct()
        group = on_edge.withColumn("part", F.lit("all"))
        own = nodes.join(group, "id").select("part", "id", "fails", *start)
        e = e.withColumn("part", F.lit("all"))
    else:
        comp = components(e.select(F.col("consumer").alias("a"), F.col("producer").alias("b")))
        group = comp.select(F.col("node").alias("id"), F.col("comp").cast("string").alias("part"))
        own = nodes.join(group, "id").select("part", "id", "fails", *start)
        e = cut(e.join(comp.select(F.col("node").alias("consumer"), F.col("comp").cast("string").alias("part")), "consumer"))
        # at most one in ONE_TASK_EDGES edges
        large = cut(e.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK_EDGES).select("part"))
        if not large.isEmpty():
            peeled, rest, left = _peel(cut(own.join(large, "part", "left_semi").drop("part")), cut(e.join(large, "part", "left_semi").select("consumer", "producer")))
            own = own.join(large, "part", "left_anti").unionByName(rest.withColumn("part", F.lit("peeled ")))
            e = e.join(large, "part", "left_anti").select("part", "consumer", "producer").unionByName(left.withColumn("part", F.lit("peeled ")).select("part", "consumer", "producer"))
    n = own.select("part", "id", F.lit(None).cast(kind).alias("producer"), "fails", "base", "bad")
    rows = n.unionByName(e.select("part", F.col("consumer").alias("id"), "producer", F.lit(False).alias("fails"), *start))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["producer"].isna()]
        links = pdf[~pdf["producer"].isna()]
        ids = own["id"].tolist()
        producers = links["producer"].astype(own["id"].dtype).tolist()
        failed, bad = (set(own.loc[own[c].astype(bool), "id"].tolist()) for c in ("fails", "bad"))
        got = _settle(ids, list(zip(links["id"].tolist(), producers, strict=True)), failed, dict(zip(ids, own["base"].tolist(), strict=True)), tuple(bad))
        out = pd.DataFrame(got, columns=["id", "level", "state"])
        out["level"] = out["level"].astype("Int64")
        return out

    linked = rows.groupBy("part").applyInPandas(run, f"id {kind}, level long, state string")
    # tasks without edges need no call
    alone = nodes.join(group.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("level"), F.when(F.col("fails"), "failed").otherwise("ok").alias("state"))
    return _all([linked, *peeled, alone])
