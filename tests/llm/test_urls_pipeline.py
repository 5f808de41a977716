"""The URL filter against a loop, and the pipeline against a brute-force version of its stages."""

import datetime
import re
from collections import defaultdict

from test_documents_ops import brute_jaccard, check_packing, table
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, pii, quality, urls
from tessera.llm.common import components, prepare

D = datetime.date


def verdict(url, fetched, entries):
    m = re.match(r"[A-Za-z]+://([^/?#:]+)(?::\d+)?([^?#]*)", url or "")
    asks = set()
    if m:
        host, labels = m[1].lower(), m[1].lower().split(".")
        parts = [p for p in m[2].split("/") if p]
        asks = {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", host + "/" + "/".join(parts[: i + 1])) for i in range(len(parts))}
    last = {}
    for name, kind, value, day, action in sorted(e for e in entries if None not in e):
        if (kind, value) in asks and fetched and day <= fetched:
            last[name, kind, value] = action
    active = {k: a for k, a in last.items() if a != "remove"}
    return len(active), ",".join(sorted({k[0] for k in active})), "block" in active.values() and "allow" not in active.values()


def test_urls(spark, monkeypatch):
    entries = [
        ("ads", "host", "a.example.com", D(2024, 1, 5), "block"), ("ads", "host", "a.example.com", D(2024, 2, 1), "remove"), ("ads", "host", "a.example.com", D(2024, 3, 1), "block"),
        ("ok", "domain", "example.com", D(2024, 3, 10), "allow"), ("ok", "domain", "example.com", D(2024, 3, 20), "remove"), ("ok", "domain", "example.com", D(2024, 3, 20), "allow"),
        ("x", "prefix", "b.org/en", D(2024, 1, 1), "block"), (None, "host", "b.org", D(2024, 1, 1), "block"), ("x", "host", None, D(2024, 1, 1), "block"),
    ]
    days = [D(2024, 1, 4), D(2024, 1, 5), D(2024, 1, 31), D(2024, 2, 1), D(2024, 3, 1), D(2024, 3, 10), D(2024, 3, 20), D(2024, 5, 1), None]
    hosts = ["https://A.example.com/en/x?q", "http://b.org/en/y", "http://b.org", "nonsense", None, "https://a.example.com:8080/en"]
    caps = [(i, u, d) for i, (u, d) in enumerate((u, d) for u in hosts for d in days)]
    caps.append(caps[0])
    c = spark.createDataFrame(caps, "page_id long, url string, fetched date").selectExpr("*", "1 as uid", "'x' as list")
    e = spark.createDataFrame(entries, "list string, kind string, value string, listed_on date, action string")
    want = sorted((i, d, *verdict(u, d, entries)) for i, u, d in caps if d) + [(i, d, *verdict(u, d, entries)) for i, u, d in caps if not d]
    for few in (urls.FEW, 0):  # broadcast, then salted shuffle
        monkeypatch.setattr(urls, "FEW", few)
        got = [tuple(r) for r in urls.temporal_filter(c, e).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert urls.temporal_filter(c.limit(0), e).collect() == []
    assert all(r.n_active == 0 for r in urls.temporal_filter(c, e.limit(0)).collect())


def test_components(spark):
    import random

    rng = random.Random(9)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 40)] + [(i + 100, 140) for i in range(40)]):
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        prepare(spark)
        got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root}


def test_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    r = quality.reader()
    docs = [d for d in docs if quality.measure(d[1], d[2], r, quality.BANDS)[6]]
    groups = defaultdict(list)
    for d in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1])].append(d)
    docs = [min(g, key=lambda d: (-len(d[1]), d[0])) for g in groups.values()]
    _, comp = brute_jaccard(docs, 5, 80)
    docs = [(i, pii.mask(t), g) for i, t, g in docs if comp[i] == i]
    used, bound = check_packing(corpus_pipeline.run(spark, sf).collect(), docs, Tokenizer.from_file(packing.DEFAULT_VOCABULARY))
    assert used <= bound + max(1, bound // 50)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    awkward = table(spark, [(1, None, None), (2, "", "en"), (3, "a b", None)], extra=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        stage(spark, awkward, sf).collect()
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_dedup_stages_drop_rows(spark, sf):
    """Ids that repeat, are null, or stand for a dropped and a kept text."""
    w = [f"w{i}" for i in range(40)]
    a, near_a, b, c = " ".join(w), " ".join([*w[:-1], "zz"]), "another text altogether " + " ".join(w[::-1]), "short one"
    rows = [(1, a, "en"), (1, a, "en"), (None, b, "en"), (None, b, "en"), (2, a, "en"), (2, c, "en"), (2, c + " ", "en"), (None, near_a, "en"), (1, near_a, "en")]
    docs = table(spark, rows, extra=False).repartition(3)
    left = corpus_pipeline.exact(spark, docs, sf)
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(1, a), (None, b), (2, c + " "), (1, near_a)], key=repr)
    last = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, left, sf).collect()), key=repr)
    assert len(last) == 3 and (None, b) in last and (2, c + " ") in last and (last[0] in ((1, a), (1, near_a)))
    # rows of one id with different texts aren't near copies, repeated rows are, and null ids stay behind others
    docs = table(spark, [(5, a, "en"), (5, b, "en"), (5, b, "en"), (None, near_a, "en"), (None, c, "en"), (None, c, "en")], extra=False)
    last = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, sf).collect()), key=repr)
    assert last == sorted([(5, a), (5, b), (None, c)], key=repr)
