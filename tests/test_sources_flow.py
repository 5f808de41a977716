"""Listing, relations, the flow engine and streams."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions.pattern import FilePattern, KeyPattern
from tessera.operators.join import Relation
from tessera.plans.flow import Artifact, Flow, FlowError, Prefix, Rule, Task, ids_relation
from tessera.plans.rules import SendLimitError
from tessera.plans.state import MemoryStore
from tessera.sources import relation as R
from tessera.sources.listing import stamp_of
from tessera.streaming.events import EVENTS, Refresh, existence_stream, refresh_query


@pytest.fixture
def tree(tmp_path):
    for name in ("atlas/en/a.svg", "atlas/en/coast/b.svg", "atlas/en/coast/inner/c.svg", "atlas/fr/cover.svg", "atlas/legend.txt", "atlas/en/about.txt", "atlas/en/.hidden.svg", "atlas/en/_u.svg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    os.symlink(tmp_path / "atlas", tmp_path / "atlas/en/loop")
    os.symlink(tmp_path / "missing", tmp_path / "atlas/broken")
    return str(tmp_path)


def test_listing(spark, tree):
    got = {r.relative: r for r in R.listing(spark, tree, stamp="hash").collect()}
    assert {k for k in got if "loop" not in k} == {"atlas/en/a.svg", "atlas/en/coast/b.svg", "atlas/en/coast/inner/c.svg", "atlas/fr/cover.svg", "atlas/legend.txt", "atlas/en/about.txt", "atlas/en/.hidden.svg", "atlas/en/_u.svg"}
    assert got["atlas/legend.txt"].stamp == hashlib.sha256(b"atlas/legend.txt").hexdigest()
    st = os.stat(f"{tree}/atlas/legend.txt")
    times = {r.relative: r.stamp for r in R.listing(spark, tree, stamp="time").collect()}
    assert times["atlas/legend.txt"] == f"{st.st_mtime_ns}:{st.st_size}" == stamp_of(f"{tree}/atlas/legend.txt", "time")
    assert R.listing(spark, f"{tree}/nothing").count() == 0
    assert stamp_of(f"{tree}/nothing", "hash") is None
    with pytest.raises(ValueError):
        stamp_of(f"{tree}/atlas", "hash")
    with pytest.raises(ValueError):
        stamp_of(f"{tree}/atlas/legend.txt", "other")


def test_file_relations(spark, tree):
    f = R.file_relation(spark, "pages", FilePattern("atlas/<lang>/<slug>.svg", tree))
    assert sorted((r.lang, r.slug) for r in f.df.collect()) == [("en", ".hidden"), ("en", "_u"), ("en", "a"), ("fr", "cover")]
    g = R.group_relation(spark, "all", FilePattern("atlas/<lang>/coast/**/*.svg", tree))
    rows = g.df.collect()
    assert [r.lang for r in rows] == ["en"]
    assert [x.id for x in rows[0].data] == [f"file:{tree}/atlas/en/coast/b.svg", f"file:{tree}/atlas/en/coast/inner/c.svg"]


def test_pruned_walk(spark, tree, monkeypatch):
    from tessera.sources import listing

    listed = []
    names = os.listdir
    monkeypatch.setattr(listing.os, "listdir", lambda p: listed.append(os.path.relpath(p, tree)) or names(p))
    found = lambda shape: [os.path.relpath(p, tree) for p in listing.walk_shape(tree, shape)]
    assert found(["atlas", None, "coast", None]) == ["atlas/en/coast/b.svg"] and set(listed) == {"atlas", "atlas/en/coast"}
    assert found(["atlas", "fr", "cover.svg"]) == ["atlas/fr/cover.svg"] and found(["none", None]) == [] == found([])
    assert found(["atlas", None, "coast", []]) == ["atlas/en/coast/b.svg", "atlas/en/coast/inner/c.svg"]
    monkeypatch.undo()
    for pattern, want in (("atlas/<l>/coast/<s>.svg", ["b"]), ("atlas/en/<s>.txt", ["about"]), ("atlas/<s>.txt", ["legend"]), ("<s>/legend.txt", ["atlas"]), ("<s>/<t>.txt", ["atlas"])):
        assert sorted(r.s for r in R.file_relation(spark, "f", FilePattern(pattern, tree)).df.collect()) == want, pattern
    assert R.file_relation(spark, "f", FilePattern("atlas/legend.txt", tree)).df.count() == 1
    assert R.file_relation(spark, "f", FilePattern("atlas/none.txt", tree)).df.count() == 0


def test_file_artifacts(tmp_path, monkeypatch):
    from tessera.plans.flow import file_artifact
    from tessera.sources import listing

    p = tmp_path / "a"
    p.write_bytes(b"1")
    reads = []
    real = listing.hash_file
    monkeypatch.setattr(listing, "hash_file", lambda x: reads.append(x) or real(x))
    fresh = file_artifact(str(p), listing.StampCache())
    assert fresh.stamp() == fresh.stamp() == hashlib.sha256(b"1").hexdigest() and fresh.read() == b"1"
    assert len(reads) == 2  # it was changed just now, so its hash isn't kept
    kept = file_artifact(str(p), listing.StampCache(racy_ns=0))
    assert kept.stamp() == kept.stamp() and len(reads) == 3
    p.write_bytes(b"22")
    assert kept.stamp() == hashlib.sha256(b"22").hexdigest() and len(reads) == 4
    assert file_artifact(str(tmp_path / "b"), listing.StampCache()).stamp() is None


def test_objects(spark):
    s3 = R.MemoryObjects()
    s3.put("b", "pages/a.md", b"1")
    s3.put("b", "pages/b.md", b"2")
    s3.put("b", "pagesx/z.md", b"3")
    stamp = lambda: R.prefix_stamp(R.checked_objects(s3.list(spark, "b")), "pages").first().stamp
    one = stamp()
    s3.put("b", "pagesx/z.md", b"4")
    assert stamp() == one == R.prefix_stamp(s3.list(spark, "b"), "pages/").first().stamp
    s3.put("b", "pages/a.md", b"5")
    assert stamp() != one
    assert R.prefix_stamp(s3.list(spark, "b"), "none").first().stamp == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="lacks its key"):
        R.checked_objects(spark.createDataFrame([("a", None)], "key string, etag string")).collect()
    r = R.key_relation("objects", s3.list(spark, "b"), "key", KeyPattern("pages/<slug>.md"), F.col("etag"))
    assert sorted(x.slug for x in r.df.collect()) == ["a", "b"]
    assert s3.head("b", "none") is None and s3.get("b", "pages/b.md") == b"2"


def test_other_relations(spark):
    c = R.constant_relation(spark, "code", "v", "7")
    assert c.df.first().data[0].stamp == "7"
    e = spark.createDataFrame([(1, "found", "a"), (2, "gone", "a"), (3, "found", "b")], "seq long, op string, k string").withColumn("data", F.array(F.struct(F.col("k").alias("id"), F.lit("").alias("stamp"))))
    assert [r.k for r in R.changelog_relation("x", e, ["k"]).df.collect()] == ["b"]
    d = spark.createDataFrame([("d", '{"a": 1, "b": "x"}')], "id string, doc string")
    assert sorted(r.id for r in R.json_keys(d, F.col("id"), F.col("doc")).collect()) == ["d#a", "d#b"]


class World:
    def __init__(self, **values):
        self.values = dict(values)
        self.ran = []

    def art(self, id):
        return Artifact(id, lambda: self.values.get(id))

    def pre(self, id):
        return Prefix(id, lambda: ";".join(f"{k}={v}" for k, v in sorted(self.values.items()) if k.startswith(id)))

    def task(self, id, ins=(), outs=(), fail=False, reports=()):
        def run(ctx):
            self.ran.append(id)
            if fail:
                raise ValueError("no")
            for o in outs:
                if not o.endswith("/"):
                    self.values[o] = f"{id}({','.join(str(self.values.get(i)) for i in ins)})"
            for r in reports:
                self.values[r] = id
                ctx.produced(r)

        ref = lambda x: self.pre(x) if x.endswith("/") else self.art(x)
        return Task(id, tuple(map(ref, ins)), tuple(map(ref, outs)), run)


def test_order_and_skip(spark):
    w, store = World(a="1"), MemoryStore(spark)

    def build():
        f = Flow(spark, store)
        f.add(w.task("second", ["mid"], ["end"]))
        f.add(w.task("first", ["a"], ["mid"]))
        w.ran.clear()
        return f.run()

    r = build()
    assert w.ran == ["first", "second"] and r.success and {o.reason for o in r.outcomes} == {"no-record"}
    assert build().ids("skipped") == ["second", "first"] and w.ran == []
    w.values["a"] = "2"
    r = build()
    assert w.ran == ["first", "second"] and {(o.reason, o.reason_id) for o in r.outcomes} == {("input-changed", "a"), ("input-changed", "mid")}
    del w.values["end"]
    assert [(o.reason, o.reason_id) for o in build().outcomes if o.type == "executed"] == [("output-missing", "end")]


def test_prefix_dependencies(spark):
    w = World()
    f = Flow(spark)
    f.add(w.task("reader", ["dir/"], ["r"]))
    f.add(w.task("child", ["dir/x/1"], ["c"]))
    f.add(w.task("writer", [], ["dir/x/"], reports=["dir/x/1"]))
    f.add(w.task("exact", [], ["dir/y"]))
    f.run()
    assert set(w.ran[:2]) == {"writer", "exact"} and set(w.ran[2:]) == {"reader", "child"}


def test_failures_and_deadlock(spark):
    w = World()
    f = Flow(spark)
    for t in (w.task("bad", [], ["x"], fail=True), w.task("below", ["x"], ["y"]), w.task("lower", ["y"], ["z"]), w.task("ok", [], ["k"]), w.task("p", ["q1"], ["p1"]), w.task("q", ["p1"], ["q1"]), w.task("self", ["s"], ["s"]), w.task("after", ["p1"], ["aa"])):
        f.add(t)
    r = f.run()
    assert {o.task_id: (o.type, o.reason) for o in r.outcomes if o.type == "failed"} == {
        "bad": ("failed", "error"), "below": ("failed", "dependency"), "lower": ("failed", "dependency"),
        "p": ("failed", "deadlock"), "q": ("failed", "deadlock"), "after": ("failed", "deadlock"),
    }
    assert not r.success and set(r.ids("executed")) == {"ok", "self"}


def test_changes_refused_and_replaced(spark):
    w, heard = World(), []
    f = Flow(spark)
    f.subscribe(lambda kind, id, task: heard.append((kind, id)))
    f.add(w.task("a", [], ["x"]))
    with pytest.raises(FlowError):
        f.add(w.task("b", [], ["x"]))
    with pytest.raises(FlowError):
        f.set_groups({"g": [w.task("c"), w.task("c")]})
    assert set(f.tasks) == {"a"}
    f.add(w.task("a", [], ["y"]))
    assert heard == [("promised", "x"), ("withdrawn", "x"), ("promised", "y")]
    f.remove("a")
    assert f.tasks == {} and heard[-1] == ("withdrawn", "y")
    assert [(o.task_id, o.reason) for o in f.run().outcomes] == [("a", "replaced"), ("a", "removed")]
    with pytest.raises(FlowError):
        Flow(spark, send_limit=0)


def test_report_guard_and_listener(spark):
    w = World()
    f = Flow(spark)
    f.add(w.task("a", [], ["dir/"], reports=["other/1"]))
    assert f.run().outcomes[0].type == "failed"

    async def listener(*_):
        pass

    f = Flow(spark)
    f.subscribe(listener)
    with pytest.raises(FlowError):
        f.add(w.task("a", [], ["x"]))


def test_rule_and_discovery(spark):
    """A task writes files; a rule makes a task for each in the same run, and a rule of groups one for all."""
    w = World()
    f = Flow(spark, MemoryStore(spark), stamp=lambda id: w.values.get(id))
    made = []

    def page(ctx, values, data):
        made.append((values["slug"], [x["id"] for x in data["text"]]))
        w.values[f"svg/{values['slug']}"] = "done"

    f.each(Rule({"text": ids_relation(spark, "text", KeyPattern("text/<slug>"))}, "page", page, outputs={"svg": KeyPattern("svg/<slug>")}))
    f.add(w.task("split", [], ["text/"], reports=["text/1", "text/2"]))
    r = f.run()
    assert sorted(made) == [("1", ["text/1"]), ("2", ["text/2"])]
    assert set(r.ids("executed")) == {"split", "page:1", "page:2"}
    with pytest.raises(FlowError):
        f.each(Rule({"text": lambda _: None}, "x", page))


def test_rule_fed_by_itself(spark):
    w = World()
    f = Flow(spark, send_limit=50)

    def step(values, data, outs):
        n = int(values["n"])
        if n < 4:
            yield w.task(f"step{n}", [f"n/{n}"], [f"n/{n + 1}"])

    f.each(Rule({"n": ids_relation(spark, "n", KeyPattern("n/<n>"))}, tasks=step))
    f.add(w.task("seed", [], ["n/1"]))
    assert f.run().ids("executed") == ["seed", "step1", "step2", "step3"]

    g = Flow(spark, send_limit=6)
    g.each(Rule({"n": ids_relation(spark, "n", KeyPattern("n/<n>"))}, tasks=lambda v, d, o: [w.task(f"s{v['n']}", [f"n/{v['n']}"], [f"n/{int(v['n']) + 1}"])]))
    g.add(w.task("seed", [], ["n/1"]))
    with pytest.raises(SendLimitError):
        g.run()
    with pytest.raises(SendLimitError):
        g.run()


def test_changes_from_bodies(spark):
    """Bodies replace, remove and add tasks while others run or wait."""
    ran, heard = [], []
    f = Flow(spark, MemoryStore(spark), stamp=lambda _: "s")
    f.subscribe(lambda kind, id, task: heard.append((kind, id, task)))
    art = lambda id: Artifact(id, lambda: "s")

    def note(name):
        return lambda ctx: ran.append(name)

    def swap(ctx):
        f.add(Task("swapped", (), (art("y"),), note("new")))
        assert ctx.signal.wait(5) and ctx.cancelled  # it replaces itself, too
        ran.append("old")

    def both(ctx):
        f.add(Task("swapped", (), (art("x"),), note("first")))
        swap(ctx)

    f.add(Task("swapped", (), (art("x"),), both))
    f.add(Task("gone", (), (art("z"),), lambda ctx: (f.remove("gone"), ran.append("gone"))))
    # "reader" waits for "first"; that adds a producer of what the reader reads
    f.add(Task("first", (), (art("a"),), lambda ctx: f.add(Task("late", (art("a"),), (art("dir/1"),), note("late")))))
    f.add(Task("reader", (art("a"), Prefix("dir/", lambda: "s")), (art("b"),), note("reader")))
    r = f.run()
    assert ran.index("late") < ran.index("reader")
    assert ran.index("old") < ran.index("new") and "first" not in ran
    kinds = {(o.task_id, o.type, o.reason) for o in r.outcomes}
    assert ("gone", "cancelled", "removed") in kinds and ("swapped", "cancelled", "replaced") in kinds
    assert [o.type for o in r.outcomes if o.task_id == "swapped" and o.type != "cancelled"] == ["executed"]
    assert heard[-1][0] != "withdrawn" and "z" not in f.on_disk and ("produced", "z", "gone") not in heard
    assert {x.task_id for x in f.store.read().collect()} == {"swapped", "first", "late", "reader"}


def test_events_in_order_and_limit(spark):
    f, first, second = Flow(spark, send_limit=5), [], []

    def chain(kind, id, task):
        first.append((kind, id))
        if kind == "promised" and id == "a":
            f.add(Task("next", (), (Artifact("b"),)))

    f.subscribe(chain)
    f.subscribe(lambda kind, id, task: second.append((kind, id)))
    f.add(Task("one", (), (Artifact("a"),)))
    assert first == second == [("promised", "a"), ("promised", "b")]
    # a declaration of many outputs is no endless chain
    f.set_groups({"many": [Task(f"t{i}", (), (Artifact(f"o{i}"),)) for i in range(50)]})
    assert f.run().success and len(second) == 2 + 50 + 52

    g = Flow(spark, send_limit=5)
    g.subscribe(lambda kind, id, task: g.add(Task(id + "x", (), (Artifact(id + "x"),))))
    with pytest.raises(SendLimitError):
        g.add(Task("a", (), (Artifact("a"),)))


def test_records_survive_an_error(spark):
    store = MemoryStore(spark)
    f = Flow(spark, store)
    f.add(Task("a", (Artifact("i", lambda: "1"),), (Artifact("o", lambda: "2"),)))

    def listener(kind, id, task):
        if kind == "produced":
            raise ValueError("listener")

    f.subscribe(listener)
    with pytest.raises(ValueError):
        f.run()
    assert {x.task_id for x in store.read().collect()} == {"a"}


def test_many_tasks_are_quick(spark):
    import time

    f = Flow(spark)
    began = time.time()
    f.set_groups({"all": [Task(f"t{i}", (Artifact(f"a{i - 1}"),), (Artifact(f"a{i}"),)) for i in range(5000)]})
    assert len(f.run().ids("executed")) == 5000
    assert time.time() - began < 20


def test_existence_stream(spark, tmp_path):
    events = [(1, "scan", "old", None), (2, "promised", "new", "write"), (3, "produced", "new", "write"), (4, "withdrawn", "new", "write"), (5, "deleted", "new", "write"), (6, "promised", "old", "re"), (7, "withdrawn", "old", "re")]
    src = tmp_path / "in"
    for i, part in enumerate((events[:3], events[3:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(str(src))
    q = existence_stream(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 10).json(str(src))).writeStream.format("memory").queryName("exist").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.seq, r.path, r.op) for r in spark.table("exist").collect()) == [(1, "old", "found"), (2, "new", "found"), (5, "new", "gone")]


def data_of(df, name, vars):
    return df.withColumn("data", F.array(F.struct(F.concat_ws("/", F.lit(name), *vars).alias("id"), F.lit(None).cast("string").alias("stamp"))))


def test_refresh_steps(spark, tmp_path):
    page = data_of(spark.createDataFrame([("en", "a"), ("fr", "a")], "l string, s string"), "page", ["l", "s"])
    review = data_of(spark.createDataFrame([], "s string, by string"), "review", ["s", "by"])
    r = Refresh([Relation("page", page, ("l", "s")), Relation("review", review, ("s", "by"))], ["page"])
    assert r.sets.count() == 2
    ch = lambda rows, schema, name, vars: data_of(spark.createDataFrame(rows, f"seq long, op string, {schema}"), name, vars)
    out = r.step({"review": ch([(1, "found", "a", "ann"), (2, "found", "a", "bob")], "s string, by string", "review", ["s", "by"])})
    assert sorted(x.change for x in out.collect()) == ["added"] * 4 + ["removed"] * 2 and r.sets.count() == 4
    # delivered again: nothing changes
    assert r.step({"review": ch([(3, "found", "a", "ann")], "s string, by string", "review", ["s", "by"])}).count() == 0
    # the last review goes: the set without one comes back
    r.step({"review": ch([(4, "gone", "a", "ann"), (5, "gone", "a", "bob"), (6, "gone", "a", "cy")], "s string, by string", "review", ["s", "by"])})
    assert sorted((x.l, x.s, x.by) for x in r.sets.collect()) == [("en", "a", None), ("fr", "a", None)]
    # as a stream
    schema = "relation string, seq long, op string, l string, s string, data array<struct<id:string,stamp:string>>"
    spark.createDataFrame([("page", 7, "gone", "fr", "a", []), ("page", 8, "found", "de", "b", [("page/de/b", None)])], schema).write.parquet(str(tmp_path / "in"))
    single = Refresh([Relation("page", page, ("l", "s"))])
    seen = []
    refresh_query(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), single, lambda df, n: seen.extend((x.set_key, x.change, x.phase) for x in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == [('["de","b"]', "added", 1), ('["fr","a"]', "removed", 0)]
