"""Joins, deltas, dependencies, graphs, the skip rule and changelogs against plain loops."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, deps, graph
from tessera.operators.join import Relation, RuleError, delta_sets, diff_sets, joined_sets, set_counts, touched_sets, union_vars
from tessera.plans import catalogue, skip
from tessera.plans.rules import SendLimitError, loop_rows, one_task_io, task_id_clashes
from tessera.plans.state import MemoryStore, SnapshotStore, StoreError, upsert


def rel(spark, name, vars, rows):
    schema = ", ".join(f"{v} string" for v in vars) or "_ string"
    df = spark.createDataFrame(rows if vars else [("",)] * len(rows), schema)
    ids = F.concat_ws("/", F.lit(name), *vars) if vars else F.lit(name)
    return Relation(name, df.select(*vars, F.array(F.struct(ids.alias("id"), F.lit(None).cast("string").alias("stamp"))).alias("data")), tuple(vars))


def brute(relations, required=None):
    """Dict rows by nested loops; None for what is unbound."""
    need = [r for r in relations if required is None or r[0] in required]
    rest = [r for r in relations if r not in need]
    sets = [{}]
    for name, vars, rows in need:
        sets = [s | dict(zip(vars, row, strict=True)) | {name: True} for s in sets for row in rows if all(s.get(v, x) == x for v, x in zip(vars, row, strict=True))]
    bound = {v for r in need for v in r[1]}
    for name, vars, rows in rest:
        out = []
        for s in sets:
            hits = [row for row in rows if all(v not in bound or s.get(v) == x for v, x in zip(vars, row, strict=True))]
            out += [s | dict(zip(vars, row, strict=True)) | {name: True} for row in hits] or [s]
        sets = out
        bound |= set(vars)
    names = list(dict.fromkeys(v for r in relations for v in r[1]))
    return sorted((tuple(s.get(v) for v in names) + tuple(r[0] in s for r in relations) for s in sets), key=repr)


def run(spark, relations, required=None):
    df = joined_sets([rel(spark, *r) for r in relations], required)
    names = list(dict.fromkeys(v for r in relations for v in r[1]))
    return sorted((tuple(r[v] for v in names) + tuple(r[f"{n}_data"] is not None for n, _, _ in relations) for r in df.collect()), key=repr)


CROP = ("crop", ("farm", "plot"), [("n", "1"), ("n", "2"), ("n", "3"), ("s", "1"), ("w", "9")])
PLOTS = ("crop", ("plot",), [("1",), ("2",), ("3",)])
CASES = {
    "shared variable": ([CROP, ("soil", ("farm",), [("n",), ("s",), ("e",)])], None, 4),
    "nothing fits": ([("crop", ("farm",), [("w",)]), ("soil", ("farm",), [("e",), ("s",)])], None, 0),
    "three relations": ([CROP, ("soil", ("farm",), [("n",), ("s",)]), ("harvest", ("farm", "plot"), [("n", "2"), ("s", "1"), ("s", "5"), ("w", "9")])], None, 2),
    "product": ([("tool", ("t",), [("hoe",), ("rake",), ("saw",)]), ("year", ("y",), [("1",), ("2",)])], None, 6),
    "keys through a third": ([("soil", ("farm",), [("n",), ("s",)]), ("seed", ("plot",), [("1",), ("2",)]), ("crop", ("farm", "plot"), [("n", "1"), ("s", "2"), ("s", "3")])], None, 2),
    "chain": ([("river", ("x",), [("1",), ("2",)]), ("reach", ("x", "y"), [("1", "p"), ("2", "p"), ("2", "q"), ("3", "p")]), ("gauge", ("y",), [("p",)])], None, 2),
    "no variables": ([CROP, ("law", (), [()])], None, 5),
    "no variables, no row": ([CROP, ("law", (), [])], None, 0),
    "fan-out": ([CROP, ("note", ("farm", "plot", "who"), [("n", "1", "k"), ("n", "1", "l"), ("n", "1", "m"), ("s", "1", "k"), ("s", "2", "k")])], ["crop"], 7),
    "independent": ([PLOTS, ("note", ("plot", "who"), [("1", "k"), ("1", "l"), ("1", "m")]), ("photo", ("plot", "no"), [("1", "x"), ("1", "y"), ("3", "z")])], ["crop"], 8),
    "null in ON": ([PLOTS, ("owner", ("plot", "name"), [("2", "ida")]), ("phone", ("name",), [("ida",), ("ole",)])], ["crop"], 3),
    "on true": ([PLOTS, ("tag", ("t",), [("x",), ("y",)])], ["crop"], 6),
    "on true, none": ([PLOTS, ("tag", ("t",), [])], ["crop"], 3),
    "required later": ([("note", ("plot", "who"), [("1", "k"), ("2", "l"), ("4", "k")]), PLOTS], ["crop"], 3),
    "order 1": ([PLOTS, ("note", ("plot", "who"), [("1", "k"), ("2", "k")]), ("price", ("plot", "who"), [("1", "m"), ("3", "m")])], ["crop"], 3),
    "order 2": ([PLOTS, ("price", ("plot", "who"), [("1", "m"), ("3", "m")]), ("note", ("plot", "who"), [("1", "k"), ("2", "k")])], ["crop"], 3),
}


@pytest.mark.parametrize("name", list(CASES))
def test_joins(spark, name):
    relations, required, n = CASES[name]
    got = run(spark, relations, required)
    assert got == brute(relations, required) and len(got) == n


def test_joins_random(spark):
    rng = random.Random(1)
    for _ in range(8):
        relations = []
        for i in range(rng.randint(2, 4)):
            vars = tuple(rng.sample("abc", rng.randint(0, 2)))
            relations.append((f"r{i}", vars, sorted({tuple(rng.choice("xyz") for _ in vars) for _ in range(rng.randint(0, 4))})))
        required = rng.choice([None, ["r0"], ["r1"]])
        assert run(spark, relations, required) == brute(relations, required), (relations, required)


@pytest.mark.parametrize("seed", range(6))
def test_set_counts_random(spark, seed):
    """What grouping the derived sets counts; rows may repeat and have NULLs, relations may be empty or have no variables."""
    rng = random.Random(seed)
    for _ in range(4):
        relations = []
        for i in range(rng.randint(1, 4)):
            vars = tuple(rng.sample("abcd", rng.choice([0, 1, 2, 2, 3])))
            relations.append(rel(spark, f"r{i}", vars, [tuple(rng.choice(["x", "y", None]) for _ in vars) for _ in range(rng.choice([0, 2, 3, 5]))]))
        required = rng.choice([None, ["r0"], [relations[-1].name]])
        names = union_vars(relations)
        by = rng.sample(names, rng.randint(0, min(2, len(names))))
        got = set_counts(relations, by, required)
        want = joined_sets(relations, required).groupBy(*by).agg(F.count("*").alias("n_sets"))
        assert got.schema == want.schema
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), ([(r.name, r.vars, r.df.collect()) for r in relations], required, by)
    with pytest.raises(RuleError):
        set_counts(relations, ["nope"])


def test_sets_are_counted_underived(spark, tmp_path):
    """The query over 10^12 sets of one customer and 10^6 of another: they can't be derived within the minute after which its jobs are stopped."""
    n = 1_000_000
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "1L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "7 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sparkContext.setJobGroup("underived", "set counts", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("underived"))
    stop.start()
    try:
        got = catalogue.QUERIES["join_left_product"](spark, str(tmp_path)).collect()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.c: r.n_sets for r in got} == {"1": n * n, "2": n, "3": 1}


def test_delta_equals_recompute(spark):
    rng = random.Random(2)
    before = [("page", ("l", "s"), [(a, b) for a in "xyz" for b in "12"]), ("tpl", ("l",), [("x",), ("y",)]), ("rev", ("s", "by"), [("1", "ann")])]
    for name, vars in (("page", ("l", "s")), ("tpl", ("l",)), ("rev", ("s", "by"))):
        after = [(n, v, [row for row in rows if n != name or rng.random() < 0.6] + ([("x", "9")] if n == name == "page" else [("1", "bob")] if n == name == "rev" else [("z",)] if n == name else [])) for n, v, rows in before]
        a, b = ([rel(spark, *r) for r in x] for x in (before, after))
        names = union_vars(a)
        changed = sorted(set(dict((r[0], r) for r in before)[name][2]) ^ set(dict((r[0], r) for r in after)[name][2]))
        keys = {name: spark.createDataFrame(changed, ", ".join(f"{v} string" for v in vars))}
        required = ["page", "tpl"]
        touched = {tuple(r) for x in (a, b) for r in delta_sets(x, keys, required).select(*names).collect()}
        old, new = (joined_sets(x, required).select(*names) for x in (a, b))
        diff = {tuple(r) for r in old.exceptAll(new).union(new.exceptAll(old)).collect()}
        assert diff <= touched


@pytest.mark.parametrize("seed", range(4))
def test_touched_sets_hold_the_difference(spark, seed):
    """Old and new touched sets differ by just what old and new sets differ by, whichever relations changed."""
    rng = random.Random(seed)
    shape = [("field", ("f", "row")), ("crop", ("f",)), ("note", ("row", "who")), ("phone", ("who",)), ("sign", ())]
    draw = lambda v: sorted({tuple(rng.choice("pqr") for _ in v) for _ in range(rng.randint(1, 5))})
    before = [(n, v, draw(v)) for n, v in shape]
    moved = rng.sample([n for n, _ in shape[:4]], 2) + (["sign"] if seed == 3 else [])
    after = [(n, v, (draw(v) if v else []) if n in moved else rows) for n, v, rows in before]
    a, b = ([rel(spark, *r) for r in x] for x in (before, after))
    keys = {}
    for (n, v, old), (_, _, new) in zip(before, after, strict=True):
        if n in moved:
            keys[n] = spark.createDataFrame(sorted(set(old) ^ set(new)), ", ".join(f"{x} string" for x in v)) if v else spark.range(1).select()
    names, required = union_vars(a), ["field", "crop"]
    rows = lambda df: {tuple(r) for r in df.select(*names).collect()}
    whole = [rows(joined_sets(x, required)) for x in (a, b)]
    part = [rows(touched_sets(x, keys, required)) for x in (a, b)]
    assert part[0] <= whole[0] and part[1] <= whole[1]
    assert whole[0] - whole[1] == part[0] - part[1] and whole[1] - whole[0] == part[1] - part[0]


def test_nothing_changed_touches_nothing(spark):
    a = rel(spark, "a", ("x",), [("1",)])
    assert touched_sets([a], {}).count() == 0 and delta_sets([a], {}).columns == ["x"]


def test_relation_checks(spark):
    a = rel(spark, "a", ("x",), [("1",)])
    with pytest.raises(RuleError):
        Relation("b", a.df, ("x", "y"))
    with pytest.raises(RuleError):
        Relation("b", a.df.withColumn("z", F.lit(1)), ("x",))
    for bad in ([], [a, a]):
        with pytest.raises(RuleError):
            joined_sets(bad)
    for required in ([], ["nope"]):
        with pytest.raises(RuleError):
            joined_sets([a], required)


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "k string, v string")
    got = {tuple(r) for r in diff_sets(old, new, ["k"], ["v"]).collect()}
    assert got == {('["a"]', "removed"), ('["b"]', "same"), ('["c"]', "changed"), ('["d"]', "added")}


def io(spark, rows):
    return spark.createDataFrame(rows, "task_id string, side string, pos int, kind string, id string")


def test_edges_random(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = list({(f"t{i}", rng.choice(["in", "out"]), 0, rng.choice(["artifact", "prefix"]), "".join(rng.choice("ab/") for _ in range(rng.randint(1, 5)))) for i in range(20) for _ in range(3)})
        want = set()
        for c, cs, _, ck, ci in rows:
            for p, ps, _, pk, pi in rows:
                if cs == "in" and ps == "out" and c != p:
                    hit = ci == pi if ck == pk == "artifact" else ci.startswith(pi) if ck == "artifact" else pi.startswith(ci) if pk == "artifact" else ci.startswith(pi) or pi.startswith(ci)
                    if hit:
                        want.add((c, p))
        df = deps.edges(io(spark, rows))
        assert {tuple(r) for r in df.collect()} == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_orphans(spark):
    t = io(spark, [("a", "out", 0, "artifact", "x/1"), ("b", "out", 0, "prefix", "y/")])
    found = spark.createDataFrame([("x/1",), ("x/2",), ("y/3",), ("z",)], "id string")
    assert sorted(r.id for r in deps.orphans(found, t).collect()) == ["x/2", "z"]


def states(nodes, edges, fails):
    producers = {n: {p for c, p in edges if c == n and p != n} for n in nodes}
    state, level = {}, {}
    while True:
        new = [n for n in nodes if n not in state and all(p in state for p in producers[n]) and not any(state[p] != "ok" for p in producers[n])]
        bad = [n for n in nodes if n not in state and any(state.get(p) in ("failed", "dependency") for p in producers[n])]
        if not new and not bad:
            break
        for n in bad:
            state[n] = "dependency"
        for n in new:
            if n not in state:
                state[n] = "failed" if n in fails else "ok"
    return {n: state.get(n, "deadlock") for n in nodes}


@pytest.mark.parametrize(("limit", "rounds"), [(graph.ONE_TASK_EDGES, 0), (0, 200), (4, 200), (0, 1)])
def test_settle_random(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", limit)
    monkeypatch.setattr(graph, "PEEL_ROUNDS", rounds)
    rng = random.Random(4)
    for size, links in ((12, 14), (40, 50)) if limit else ((12, 14),):
        nodes = list(range(size))
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(links)]
        fails = {n for n in nodes if rng.random() < 0.15}
        got = graph.settle(spark.createDataFrame([(n, n in fails) for n in nodes], "id long, fails boolean"), spark.createDataFrame(edges, "consumer long, producer long")).collect()
        assert {r.id: r.state for r in got} == states(nodes, edges, fails)


@pytest.mark.parametrize(("limit", "rounds"), [(10, 200), (10, 2), (0, 200)])
def test_peeled_levels(spark, monkeypatch, limit, rounds):
    """A large component, with a cycle in the second graph, gets the levels and states of one walk."""
    rng = random.Random(limit + rounds)
    for ring in ([], [(30, 31), (31, 32), (32, 30), (33, 32), (30, 5)]):
        nodes = list(range(36))
        edges = sorted({(c, rng.randrange(c)) for c in range(1, 30) for _ in range(2)} | set(ring))
        fails = {7, 11}
        want = {n: (level, state) for n, level, state in graph._settle(nodes, edges, fails)}
        monkeypatch.setattr(graph, "ONE_TASK_EDGES", limit)
        monkeypatch.setattr(graph, "PEEL_ROUNDS", rounds)
        got = graph.settle(spark.createDataFrame([(n, n in fails) for n in nodes], "id long, fails boolean"), spark.createDataFrame(edges, "consumer long, producer long")).collect()
        assert {r.id: (r.level, r.state) for r in got} == want and len(got) == 36


def test_settle_deep_chain(spark):
    n = spark.range(32_000).select("id", F.lit(False).alias("fails"))
    e = spark.range(1, 32_000).select(F.col("id").alias("consumer"), (F.col("id") - 1).alias("producer"))
    assert graph.settle(n, e).agg(F.max("level")).first()[0] == 31_999


@pytest.mark.parametrize("in_one_task", [0, 500_000])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(graph, "ONE_TASK_COMPONENTS", in_one_task)
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def decide(spark, ins, outs, state, record):
    rows = [("t", "in", i, k, x) for i, (k, x) in enumerate(ins)] + [("t", "out", i, k, x) for i, (k, x) in enumerate(outs)]
    s = spark.createDataFrame([(*k.split(" ", 1), v) for k, v in state.items()], "kind string, id string, stamp string")
    r = None if record is None else spark.createDataFrame([("t", side, k, v) for side, k, v in record], "task_id string, side string, ref_key string, stamp string")
    got = skip.decide(spark.createDataFrame([("t",)], "task_id string"), io(spark, rows), s, r).first()
    return got.reason, got.reason_id


A, P = ("artifact", "a"), ("prefix", "p/")
OUT, OUTP = ("artifact", "o"), ("prefix", "q/")
WORLD = {"artifact a": "1", "prefix p/": "2", "artifact o": "3", "prefix q/": "4"}
GOOD = [("ok", "", None), ("in", "artifact a", "1"), ("in", "prefix p/", "2"), ("out", "artifact o", "3"), ("out", "prefix q/", "4")]


@pytest.mark.parametrize(
    "ins,outs,world,record,want",
    [
        ([A, P], [OUT, OUTP], {}, GOOD, (None, None)),
        ([A, P], [OUT, OUTP], {}, None, ("no-store", None)),
        ([], [OUT], {}, GOOD, ("no-inputs", None)),
        ([A, P], [OUT], {"prefix p/": None}, GOOD, ("input-unstamped", "p/")),
        ([A, P], [OUT, OUTP], {}, [], ("no-record", None)),
        ([A, P], [OUT, OUTP], {}, [*GOOD, ("weird", "x", "1")], ("no-record", None)),
        ([A], [OUT, OUTP], {}, GOOD, ("input-ids-changed", None)),
        ([A, P, ("artifact", "b")], [OUT, OUTP], {}, GOOD, ("input-ids-changed", None)),
        ([A, A, P], [OUT, OUTP], {}, GOOD, (None, None)),
        ([P, A], [OUT, OUTP], {"artifact a": "9", "prefix p/": "9"}, GOOD, ("input-changed", "p/")),
        ([A, P], [OUT, OUTP], {"artifact a": None}, GOOD, ("input-changed", "a")),
        ([A, P], [OUT, OUTP], {"artifact a": "9", "artifact o": "9"}, GOOD, ("input-changed", "a")),
        ([A, P], [OUT, OUTP], {"artifact o": None}, GOOD, ("output-missing", "o")),
        ([A, P], [OUT, OUTP], {"artifact o": "9"}, GOOD, ("output-changed", "o")),
        ([A, P], [OUTP, OUT], {"prefix q/": None, "artifact o": "9"}, GOOD, ("output-unstamped", "q/")),
        ([A, P], [OUT, OUTP, ("artifact", "n")], {}, GOOD, ("output-ids-changed", None)),
        ([A, P], [OUT], {}, GOOD, ("output-ids-changed", None)),
        ([("prefix", "a")], [], {"prefix a": "1"}, [("ok", "", None), ("in", "artifact a", "1")], ("input-ids-changed", None)),
        ([("artifact", "gone")], [], {}, [("ok", "", None), ("in", "artifact gone", None)], (None, None)),
    ],
)
def test_reasons(spark, ins, outs, world, record, want):
    assert decide(spark, ins, outs, WORLD | world, record) == want


def test_snapshot_then_skip(spark):
    rows = io(spark, [("t", "in", 0, "artifact", "a"), ("t", "in", 1, "prefix", "nostamp"), ("t", "out", 0, "artifact", "o")])
    state = spark.createDataFrame([("artifact", "a", "1"), ("artifact", "o", "2")], "kind string, id string, stamp string")
    got = {(r.side, r.ref_key, r.stamp) for r in skip.snapshot(rows, state).collect()}
    assert got == {("ok", "", None), ("in", "artifact a", "1"), ("out", "artifact o", "2")}


def test_one_task_rule_and_clash(spark):
    a = rel(spark, "A", ("a", "lang"), [("en", "x")])
    p = rel(spark, "P", ("lang",), [("x",), ("en",)])
    b = rel(spark, "B", ("lang", "b"), [("en", "x")])
    tasks = one_task_io("page", [a, p, b], {}, ["P"])
    # (NULL, en, x) and (en, x, NULL) give one id: reported, not merged
    clash = task_id_clashes(tasks.where("pos = 0").select("task_id", F.monotonically_increasing_id().alias("group_key"))).collect()
    assert [r.task_id for r in clash] == ["page:en/x"]


def test_loop_limit(spark):
    start = spark.createDataFrame([(0,)], "id long")
    with pytest.raises(SendLimitError):
        loop_rows(start, lambda r: r.select((F.col("id") + 1).alias("id")), ["id"], 3)


def test_changelog_random(spark):
    rng = random.Random(5)
    events = [(i, rng.choice(["scan", "promised", "produced", "deleted", "withdrawn"]), rng.choice("abc"), rng.choice("tu")) for i in range(80)]
    disk, prom, want = {}, {}, []
    for seq, kind, path, task in events:
        was = disk.get(path, False) or bool(prom.get(path))
        if kind in ("scan", "produced", "deleted"):
            disk[path] = kind != "deleted"
        else:
            (prom.setdefault(path, set()).add if kind == "promised" else prom.setdefault(path, set()).discard)(task)
        now = disk.get(path, False) or bool(prom.get(path))
        if now != was:
            want.append((path, seq, "found" if now else "gone"))
    df = spark.createDataFrame(events, "seq long, kind string, path string, task string")
    assert sorted(tuple(r) for r in changes.existence_transitions(df, ["path"]).collect()) == sorted(want)
    assert {r.path: r.matched for r in changes.existence(df, ["path"]).collect()} == {p: disk.get(p, False) or bool(prom.get(p)) for p in "abc"}


def test_upsert(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long")
    c = spark.createDataFrame([("a", 2, 1, "found"), ("a", 3, 2, "found"), ("b", 0, 3, "gone"), ("c", 1, 1, "gone"), ("d", 4, 1, "found")], "k string, v long, seq long, op string")
    assert sorted(tuple(r) for r in upsert(t, c, ["k"]).collect()) == [("a", 3), ("d", 4)]


@pytest.mark.parametrize("kind", ["memory", "snapshot"])
def test_stores(spark, tmp_path, kind):
    store = MemoryStore(spark) if kind == "memory" else SnapshotStore(spark, str(tmp_path / "s"))
    schema = "task_id string, side string, ref_key string, stamp string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted(tuple(r) for r in store.read().collect())
    assert read() == []
    store.set(rows(("a", "ok", "", "1"), ("b", "ok", "", "1")))
    store.set(rows(("b", "ok", "", "2"), ("b", "in", "artifact x", "3")))
    assert read() == [("a", "ok", "", "1"), ("b", "in", "artifact x", "3"), ("b", "ok", "", "2")]
    store.delete(["a", "nope"])
    assert {r[0] for r in read()} == {"b"}
    store.clear()
    assert read() == []


def test_snapshot_store_survives_and_complains(spark, tmp_path):
    folder = tmp_path / "s"
    store = SnapshotStore(spark, str(folder))
    store.set(spark.createDataFrame([("a", "ok", "", "1")], "task_id string, side string, ref_key string, stamp string"))
    # a writer that died before CURRENT was replaced leaves the last version
    spark.range(3).write.parquet(str(folder / "v=2"))
    assert SnapshotStore(spark, str(folder)).read().count() == 1
    (folder / ".CURRENT.crc").unlink(missing_ok=True)
    (folder / "CURRENT").write_text("2\n")
    with pytest.raises(StoreError):
        store.read()
    (folder / "CURRENT").write_text("x\n")
    with pytest.raises(StoreError):
        store.read()
