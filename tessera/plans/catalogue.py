"""A query per operator over the driver's tables, each with the SQL that says the same.

Earlier snapshots, records and failures are simulated by arithmetic on ids, so that every branch has rows; all
rows of the tables take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.pattern import FilePattern, KeyPattern
from ..operators import changes, deps, graph
from ..operators.join import Relation, delta_sets, diff_sets, joined_sets, set_counts, touched_sets
from ..sources.relation import changelog_relation, json_keys, key_relation, prefix_stamp, table_relation
from ..streaming.events import Refresh
from . import skip
from .rules import loop_rows, one_task_io
from .state import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s(name: str) -> Column:
    return F.col(name).cast("string")


def dockey() -> Column:
    return F.concat(F.lit("content/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), s("doc_id"), F.lit(".md"))


def urlkey() -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/$", "")


URLKEY = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '')"


# ---- patterns ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang AS l, source AS s, CAST(doc_id AS VARCHAR) AS d FROM documents")
def pattern_match(spark, d):
    p = KeyPattern("content/<l>/<s>/<d>.md")
    return p.scan(read(spark, d, "documents").select("doc_id", dockey().alias("key")), "key").drop("key")


@query(f"WITH k AS (SELECT page_id, {URLKEY} AS k FROM pages) SELECT page_id, split_part(k, '/', 1) AS host, split_part(k, '/', 2) AS lang, split_part(k, '/', 3) AS slug FROM k WHERE length(k) - length(replace(k, '/', '')) = 2")
def pattern_url(spark, d):
    return KeyPattern("<host>/<lang>/<slug>").scan(read(spark, d, "pages").select("page_id", urlkey().alias("key")), "key").drop("key")


@query("SELECT doc_id, lang AS l, CAST(doc_id AS VARCHAR) AS n FROM documents WHERE lang = CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END")
def pattern_repeat_var(spark, d):
    other = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("en")
    key = F.concat(F.col("lang"), F.lit("/"), s("doc_id"), F.lit("."), other, F.lit(".md"))
    return KeyPattern("<l>/<n>.<l>.md").scan(read(spark, d, "documents").select("doc_id", key.alias("key")), "key").drop("key")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang || '/' || doc_id END AS below, '/site/' || lang || '/' || doc_id || '.html' AS page FROM documents")
def path_relative_and_output(spark, d):
    """Paths below a root, and an output rendered there; every third path lies in a folder whose name only starts like the root's."""
    p = FilePattern("<lang>/<doc>.html", "/site", allow_globs=False)
    path = F.concat(F.when(F.col("doc_id") % 3 > 0, "/site/").otherwise("/sites/"), F.col("lang"), F.lit("/"), s("doc_id"))
    return read(spark, d, "documents").select("doc_id", p.relative(path).alias("below"), p.render({"lang": F.col("lang"), "doc": s("doc_id")}).alias("page"))


@query("SELECT doc_id, 'lang' AS k, sha256(lang) AS stamp FROM documents UNION ALL SELECT doc_id, 'source', sha256(source) FROM documents")
def json_stamp_map(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", "source")).alias("j"))
    return docs.select("doc_id", F.explode(keys.json_key_stamps(F.col("j"))).alias("k", "stamp"))


@query(f"WITH k AS (SELECT page_id, string_split({URLKEY}, '/') AS k FROM pages) SELECT page_id, k[3] AS slug FROM k WHERE len(k) = 3 AND ends_with(k[1], '.example.com')")
def pattern_glob(spark, d):
    return KeyPattern("*.example.com/*/<slug>").scan(read(spark, d, "pages").select("page_id", urlkey().alias("key")), "key").drop("key")


@query(f"WITH k AS (SELECT page_id, string_split({URLKEY} || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/a' ELSE '/a/b' END, '/') AS k FROM pages) SELECT page_id, k[1] AS host, k[-1] AS slug FROM k WHERE len(k) >= 2")
def pattern_globstar(spark, d):
    more = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "/a").otherwise("/a/b")
    return KeyPattern("<host>/**/<slug>").scan(read(spark, d, "pages").select("page_id", F.concat(urlkey(), more).alias("key")), "key").drop("key")


@query("SELECT p_partkey, p_size || '.' || (p_partkey % 7) AS major, CAST(p_partkey % 3 AS VARCHAR) AS minor FROM part")
def pattern_greedy_split(spark, d):
    key = F.concat(F.lit("rel/v"), s("p_size"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"), F.lit(".json"))
    return KeyPattern("rel/v<major>.<minor>.json").scan(read(spark, d, "part").select("p_partkey", key.alias("key")), "key").drop("key")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^[^/]*a[^/]*e[^/]*i[^/]*$')")
def pattern_many_globs(spark, d):
    return read(spark, d, "part").where(KeyPattern("*a*e*i*").matches(F.regexp_replace(F.lower("p_name"), "/", " "))).select("p_partkey")


@query("SELECT doc_id, 'site/' || lang || '/' || source || '/' || doc_id || '.html' AS path FROM documents")
def render_template(spark, d):
    return read(spark, d, "documents").select("doc_id", KeyPattern("site/<l>/<s>/<n>.html").render({"l": F.col("lang"), "s": F.col("source"), "n": s("doc_id")}).alias("path"))


@query("SELECT doc_id, 'content/' || lang || '/' AS lead, 'content/' AS static_lead FROM documents")
def bound_prefix(spark, d):
    p = KeyPattern("content/<l>/<s>/*.md")
    return read(spark, d, "documents").select("doc_id", p.bound_prefix({"l": F.col("lang")}).alias("lead"), F.lit(p.static_prefix()).alias("static_lead"))


@query("SELECT d.doc_id, 'q/' || quality || '/' || d.doc_id AS path FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def template_drop_null(spark, d):
    sets = joined_sets([_docs(spark, d), _labels(spark, d)], ["docs"])
    path = KeyPattern("q/<quality>/<doc>").render({"quality": F.col("quality"), "doc": F.col("doc")})
    return sets.select(F.col("doc").cast("long").alias("doc_id"), path.alias("path")).where("path is not null")


@query("SELECT doc_id, CAST(to_json([lang, source, NULL]) AS VARCHAR) AS row_key FROM documents")
def row_key_json(spark, d):
    return read(spark, d, "documents").select("doc_id", keys.row_key(F.col("lang"), F.col("source"), F.lit(None)).alias("row_key"))


@query("SELECT d.doc_id, 'doc:' || concat_ws('/', d.doc_id, lang, quality) AS task_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def task_id_concat(spark, d):
    sets = joined_sets([_docs(spark, d), _labels(spark, d)], ["docs"])
    return sets.select(F.col("doc").cast("long").alias("doc_id"), keys.task_id("doc", [F.col("doc"), F.col("lang"), F.col("quality")]).alias("task_id"))


@query("SELECT d.doc_id, concat_ws(' ', 'rule 2', 'lang=' || lang, 'quality=' || quality) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def set_labels(spark, d):
    sets = joined_sets([_docs(spark, d), _labels(spark, d)], ["docs"])
    return sets.select(F.col("doc").cast("long").alias("doc_id"), keys.set_label(2, ["lang", "quality"]).alias("label"))


@query("SELECT 'doc:' || p.lang || '/' AS prefix, count(*) AS n FROM (SELECT DISTINCT lang FROM documents) p JOIN documents d ON starts_with('doc:' || d.lang || '/' || d.doc_id, 'doc:' || p.lang || '/') GROUP BY 1")
def covers_pred(spark, d):
    docs = read(spark, d, "documents")
    ids = docs.select(F.concat(F.lit("doc:"), F.col("lang"), F.lit("/"), s("doc_id")).alias("id"))
    prefixes = docs.select(F.concat(F.lit("doc:"), F.col("lang"), F.lit("/")).alias("prefix")).distinct()
    return deps.beginnings(ids, "id", prefixes, "prefix").join(prefixes, F.col("start") == F.col("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT 'doc:' || lang || '/' AS a FROM documents), b AS (SELECT DISTINCT 'doc:' || lang || '/' || source || '/' AS b FROM documents) SELECT a, b FROM a, b WHERE starts_with(a, b) OR starts_with(b, a)")
def overlaps_pred(spark, d):
    docs = read(spark, d, "documents")
    a = docs.select(F.concat(F.lit("doc:"), F.col("lang"), F.lit("/")).alias("a")).distinct()
    b = docs.select(F.concat(F.lit("doc:"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/")).alias("b")).distinct()
    return deps.custom_edges(a.withColumnRenamed("a", "consumer"), b.withColumnRenamed("b", "producer"), lambda x, y: keys.overlaps(x["consumer"], y["producer"])).select(F.col("consumer").alias("a"), F.col("producer").alias("b"))


@query("SELECT event_id FROM events WHERE user_id % 2 = 1")
def report_guard(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("user:"), s("user_id")).alias("task_id"), F.concat(F.lit("u"), s("user_id"), F.lit("/"), s("event_id")).alias("id"), "user_id")
    io = e.select("task_id", "user_id").distinct().select("task_id", F.lit("out").alias("side"), F.lit(0).alias("pos"), F.lit("prefix").alias("kind"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), s("user_id"), F.lit("/"))).otherwise("none/").alias("id"))
    return deps.uncovered_reports(e, io).select("event_id")


# ---- relations and joins ------------------------------------------------------------------------------------------


def _docs(spark, d) -> Relation:
    return Relation("docs", read(spark, d, "documents").select(s("doc_id").alias("doc"), "lang"), ("doc", "lang"))


def _labels(spark, d) -> Relation:
    return Relation("labels", read(spark, d, "labels").select(s("doc_id").alias("doc"), s("quality").alias("quality")), ("doc", "quality"))


def _info(spark) -> Relation:
    return Relation("info", spark.createDataFrame([("0", "low"), ("1", "high")], "quality string, word string"), ("quality", "word"))


def _nation(spark, d) -> Relation:
    return Relation("nation", read(spark, d, "nation").select(s("n_nationkey").alias("n"), s("n_regionkey").alias("r")), ("n", "r"))


def _region(spark, d) -> Relation:
    return Relation("region", read(spark, d, "region").select(s("r_regionkey").alias("r")), ("r",))


def _customer(spark, d) -> Relation:
    return Relation("customer", read(spark, d, "customer").select(s("c_nationkey").alias("n"), s("c_custkey").alias("c")), ("n", "c"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c, CAST(n_regionkey AS VARCHAR) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey")
def join_natural(spark, d):
    return joined_sets([_customer(spark, d), _nation(spark, d)])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r, CAST(c_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def join_nway_connected(spark, d):
    return joined_sets([_region(spark, d), _customer(spark, d), _nation(spark, d)])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r, lang FROM region, (SELECT DISTINCT lang FROM documents)")
def join_cross(spark, d):
    return joined_sets([_region(spark, d), Relation("langs", read(spark, d, "documents").select("lang").distinct(), ("lang",))])


def _newest(spark, d) -> Relation:
    e = read(spark, d, "events").agg(F.max("event_id").alias("e"))
    return Relation("newest", e.select(F.array(F.struct(s("e").alias("id"), F.lit(None).cast("string").alias("stamp"))).alias("data")), ())


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r, (SELECT CAST(max(event_id) AS VARCHAR) FROM events) AS id FROM region")
def join_zero_var(spark, d):
    return joined_sets([_region(spark, d), _newest(spark, d)]).select("r", F.col("newest_data")[0]["id"].alias("id"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r FROM region WHERE false")
def join_zero_var_empty(spark, d):
    r = _newest(spark, d)
    return joined_sets([_region(spark, d), Relation("newest", r.df.where("false"), ())]).select("r")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc, lang, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_left_optional(spark, d):
    return joined_sets([_docs(spark, d), _labels(spark, d)], ["docs"])


@query("SELECT CAST(c_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left_fanout(spark, d):
    o = read(spark, d, "orders").select(s("o_custkey").alias("c"), s("o_orderkey").alias("o"))
    return joined_sets([_customer(spark, d), Relation("orders", o, ("c", "o"))], ["customer"])


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc, lang, CAST(quality AS VARCHAR) AS quality, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS word FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_left_chain(spark, d):
    return joined_sets([_docs(spark, d), _labels(spark, d), _info(spark)], ["docs"])


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc, lang, i.quality, i.word FROM documents d CROSS JOIN (VALUES ('0', 'low'), ('1', 'high')) i(quality, word) LEFT JOIN labels l ON l.doc_id = d.doc_id AND CAST(l.quality AS VARCHAR) = i.quality")
def join_left_chain_swapped(spark, d):
    return joined_sets([_docs(spark, d), _info(spark), _labels(spark, d)], ["docs"])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS n FROM region LEFT JOIN nation ON true")
def join_left_true(spark, d):
    n = read(spark, d, "nation").select(s("n_nationkey").alias("n"))
    return joined_sets([_region(spark, d), Relation("nations", n, ("n",))], ["region"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c, count(*) AS n_sets FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1")
def join_left_product(spark, d):
    o = Relation("orders", read(spark, d, "orders").select(s("o_custkey").alias("c"), s("o_orderkey").alias("o")), ("c", "o"))
    p = Relation("supplier", read(spark, d, "supplier").select(s("s_nationkey").alias("n"), s("s_suppkey").alias("p")), ("n", "p"))
    return set_counts([_customer(spark, d), o, p], ["c"], ["customer"])


@query("SELECT CAST(c_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c, CAST(n_regionkey AS VARCHAR) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 = 0")
def join_delta(spark, d):
    changed = read(spark, d, "nation").where("n_nationkey % 5 = 0").select(s("n_nationkey").alias("n"), s("n_regionkey").alias("r"))
    return delta_sets([_customer(spark, d), _nation(spark, d)], {"nation": changed})


@query(
    "WITH q AS (SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(quality AS VARCHAR) AS quality FROM labels) "
    "SELECT CAST(to_json([CAST(d.doc_id AS VARCHAR), lang, q.quality]) AS VARCHAR) AS set_key, 'removed' AS change, 0 AS phase FROM documents d JOIN q ON q.doc = CAST(d.doc_id AS VARCHAR) "
    "UNION ALL SELECT CAST(to_json([CAST(d.doc_id AS VARCHAR), lang, NULL]) AS VARCHAR), 'added', 1 FROM documents d JOIN q ON q.doc = CAST(d.doc_id AS VARCHAR)"
)
def refresh_retraction(spark, d):
    """All labels go in one step: each set with one is withdrawn, and the set without one comes back."""
    gone = _labels(spark, d).df.withColumns({"seq": F.lit(1).cast("long"), "op": F.lit("gone")})
    return Refresh([_docs(spark, d), _labels(spark, d)], ["docs"]).step({"labels": gone})


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc, lang, CAST(l.quality AS VARCHAR) AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1")
def join_touched_optional(spark, d):
    """The sets that the changed labels, those of toxic documents, are part of."""
    changed = read(spark, d, "labels").where("toxic = 1").select(s("doc_id").alias("doc"), s("quality").alias("quality"))
    return touched_sets([_docs(spark, d), _labels(spark, d)], {"labels": changed}, ["docs"])


@query("SELECT CAST(a.doc_id AS VARCHAR) AS doc, q.quality AS quality, count(w.word) AS n FROM documents a LEFT JOIN (SELECT doc_id, CAST(quality AS VARCHAR) AS quality FROM labels) q USING (doc_id) LEFT JOIN (VALUES ('0', 'low'), ('1', 'high'), (NULL, 'none')) w(quality, word) ON w.quality = q.quality GROUP BY ALL")
def join_left_null_key(spark, d):
    """A NULL on either side equals nothing."""
    words = Relation("words", spark.createDataFrame([("0", "low"), ("1", "high"), (None, "none")], "quality string, word string"), ("quality", "word"))
    return joined_sets([_docs(spark, d), _labels(spark, d), words], ["docs"]).groupBy("doc", "quality").agg(F.count("word").alias("n"))


@query("SELECT count(DISTINCT c_nationkey) AS live FROM customer")
def live_keys(spark, d):
    return changes.live_keys(_customer(spark, d).df, ["n"])


# ---- dependencies ---------------------------------------------------------------------------------------------------


def io_row(task: Column, side: str, pos: int, kind: str, id: Column) -> Column:
    return F.struct(task.alias("task_id"), F.lit(side).alias("side"), F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), id.alias("id"))


def io_rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.filter(F.array(*rows), lambda r: r["id"].isNotNull())).alias("r")).select("r.*").distinct()


def _path(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _heap_io(spark, d) -> DataFrame:
    i = F.col("doc_id")
    parent = F.when(i > 0, F.concat(F.lit("doc:"), F.floor(i / 2).cast("string")))
    return io_rows(read(spark, d, "documents").select("doc_id"), io_row(s("doc_id"), "out", 0, "artifact", _path("doc:", s("doc_id"))), io_row(s("doc_id"), "in", 0, "artifact", parent))


def _tree_io(spark, d) -> tuple[DataFrame, Column, Column]:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return docs, _path("doc:", F.col("lang"), "/", F.col("source"), "/", s("doc_id")), _path("doc:", F.col("lang"), "/", F.col("source"), "/")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS consumer, CAST(p.doc_id AS VARCHAR) AS producer FROM documents d JOIN documents p ON p.doc_id = d.doc_id // 2 WHERE d.doc_id > 0")
def deps_exact(spark, d):
    return deps.edges(_heap_io(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS consumer, 'src:' || lang || '/' || source AS producer FROM documents")
def deps_prefix_out(spark, d):
    docs, id, prefix = _tree_io(spark, d)
    return deps.prefix_output_edges(io_rows(docs, io_row(s("doc_id"), "in", 0, "artifact", id), io_row(_path("src:", F.col("lang"), "/", F.col("source")), "out", 0, "prefix", prefix)))


@query("SELECT 'lang:' || lang AS consumer, CAST(doc_id AS VARCHAR) AS producer FROM documents")
def deps_prefix_in(spark, d):
    docs, id, _ = _tree_io(spark, d)
    return deps.prefix_input_edges(io_rows(docs, io_row(s("doc_id"), "out", 0, "artifact", id), io_row(_path("lang:", F.col("lang")), "in", 0, "prefix", _path("doc:", F.col("lang"), "/"))))


@query("SELECT DISTINCT 'lang:' || lang AS consumer, 'src:' || lang || '/' || source AS producer FROM documents UNION SELECT 'part:' || lang || '/' || source || doc_id % 3, 'src:' || lang || '/' || source FROM documents")
def deps_overlap(spark, d):
    docs, _, prefix = _tree_io(spark, d)
    third = (F.col("doc_id") % 3).cast("string")
    src = _path("src:", F.col("lang"), "/", F.col("source"))
    rows = (io_row(src, "out", 0, "prefix", prefix), io_row(_path("lang:", F.col("lang")), "in", 0, "prefix", _path("doc:", F.col("lang"), "/")), io_row(_path("part:", F.col("lang"), "/", F.col("source"), third), "in", 0, "prefix", _path(prefix, third)))
    return deps.overlap_edges(io_rows(docs, *rows))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS consumer, 'range:' || k AS producer FROM documents d JOIN (SELECT DISTINCT doc_id // 100 AS k FROM documents) ON d.doc_id BETWEEN 100 * k AND 100 * k + 99")
def deps_custom(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    ranges = docs.select(F.floor(F.col("doc_id") / 100).alias("k")).distinct().select("k", _path("range:", s("k")).alias("producer"))
    return deps.custom_edges(docs.withColumn("consumer", s("doc_id")), ranges, lambda a, b: a["doc_id"].between(b["k"] * 100, b["k"] * 100 + 99))


@query(f"WITH k AS (SELECT DISTINCT {URLKEY} AS id FROM pages) SELECT id FROM k WHERE split_part(id, '/', 2) <> 'en'")
def orphan_outputs(spark, d):
    found = read(spark, d, "pages").select(urlkey().alias("id")).distinct()
    host = F.split("id", "/")[0]
    return deps.orphans(found, io_rows(found, io_row(_path("site:", host), "out", 0, "prefix", _path(host, "/en/"))))


@query("SELECT CAST(doc_id AS VARCHAR) AS consumer, 'shelf' AS producer FROM documents")
def deps_no_self(spark, d):
    """A task that reads what it makes itself doesn't wait for itself."""
    own = _path("doc:", s("doc_id"))
    shelf = _path("shelf:", F.col("lang"))
    rows = (io_row(s("doc_id"), "out", 0, "artifact", own), io_row(s("doc_id"), "in", 0, "artifact", own), io_row(s("doc_id"), "in", 1, "artifact", shelf), io_row(F.lit("shelf"), "out", 0, "prefix", F.lit("shelf:")))
    return deps.edges(io_rows(read(spark, d, "documents").select("doc_id", "lang"), *rows))


@query("SELECT CAST(p.doc_id AS VARCHAR) AS consumer, count(*) AS n FROM documents d JOIN documents p ON p.doc_id > 0 AND d.doc_id = p.doc_id // 2 GROUP BY 1")
def producer_count(spark, d):
    return deps.edges(_heap_io(spark, d)).groupBy("consumer").agg(F.count("*").alias("n"))


# ---- aggregates, sets, order -----------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM documents GROUP BY ALL")
def group_sorted_list(spark, d):
    g = changes.group_lists(read(spark, d, "documents").select("lang", "source", s("doc_id").alias("id"), F.lit(None).cast("string").alias("stamp")), ["lang", "source"])
    return g.select("lang", "source", F.size("data").cast("long").alias("n"), F.concat_ws("|", F.col("data.id")).alias("ids"))


@query("SELECT lang, sha256(string_agg(doc_id || '=' || sha256(text), chr(10) ORDER BY doc_id || '=' || sha256(text))) AS stamp FROM documents GROUP BY lang")
def digest_stamp(spark, d):
    line = F.concat_ws("=", s("doc_id"), keys.file_stamp(F.col("text").cast("binary")))
    return read(spark, d, "documents").groupBy("lang").agg(keys.digest(line).alias("stamp"))


SET_WORDS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query(f"WITH x AS (SELECT lang, source, sha256(doc_id || '=' || sha256(text)) AS h FROM documents) SELECT lang, source, sha256(count(*) || ':' || {SET_WORDS}) AS stamp FROM x GROUP BY ALL")
def digest_of_bag(spark, d):
    line = F.concat_ws("=", s("doc_id"), keys.file_stamp(F.col("text").cast("binary")))
    return read(spark, d, "documents").groupBy("lang", "source").agg(keys.set_digest(line).alias("stamp"))


@query(f"WITH k AS (SELECT {URLKEY} AS k, sha256(html) AS e FROM pages) SELECT sha256(coalesce(string_agg(substr(k, 18) || '=' || e, chr(10) ORDER BY substr(k, 18) || '=' || e), '')) AS stamp FROM k WHERE starts_with(k, 'www.example.com/')")
def object_prefix_stamp(spark, d):
    return prefix_stamp(read(spark, d, "pages").select(urlkey().alias("key"), F.sha2("html", 256).alias("etag")), "www.example.com")


@query("SELECT o_orderkey, epoch_us(o_orderdate) || ':' || o_custkey AS stamp FROM orders")
def time_stamp(spark, d):
    return read(spark, d, "orders").select("o_orderkey", keys.time_stamp(F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_custkey")).alias("stamp"))


@query("SELECT event_id || '#' || k AS id, sha256(json_extract_string(props, '$.' || k)) AS stamp FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_key_stamps(spark, d):
    return json_keys(read(spark, d, "events"), s("event_id"), F.col("props"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return changes.latest(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def _file_events(spark, d) -> DataFrame:
    """Views are scans, purchases produced, errors deleted, clicks promised and sign-ups withdrawn."""
    kind = F.when(F.col("event_type") == "view", "scan").when(F.col("event_type") == "purchase", "produced").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "promised").otherwise("withdrawn")
    return read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).alias("task"))


FILE_EVENTS = "e AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'scan' WHEN 'purchase' THEN 'produced' WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'promised' ELSE 'withdrawn' END AS kind, event_id % 3 AS task FROM events)"


@query(
    f"WITH {FILE_EVENTS}, a AS (SELECT user_id, arg_max(kind, seq) <> 'deleted' AS x FROM e WHERE kind IN ('scan', 'produced', 'deleted') GROUP BY 1), "
    "t AS (SELECT user_id, task, arg_max(kind, seq) = 'promised' AS p FROM e WHERE kind IN ('promised', 'withdrawn') GROUP BY 1, 2), p AS (SELECT user_id, bool_or(p) AS p FROM t GROUP BY 1) "
    "SELECT u.user_id, coalesce(x, false) AS on_disk, coalesce(p, false) AS promised, coalesce(x, false) OR coalesce(p, false) AS matched FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id) LEFT JOIN p USING (user_id)"
)
def existence_state(spark, d):
    return changes.existence(_file_events(spark, d), ["user_id"])


@query(
    f"WITH {FILE_EVENTS}, x AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('scan', 'produced') THEN true WHEN kind = 'deleted' THEN false END IGNORE NULLS) OVER w, false) AS disk, "
    "coalesce(last_value(CASE WHEN task = 0 AND kind = 'promised' THEN true WHEN task = 0 AND kind = 'withdrawn' THEN false END IGNORE NULLS) OVER w, false) AS p0, "
    "coalesce(last_value(CASE WHEN task = 1 AND kind = 'promised' THEN true WHEN task = 1 AND kind = 'withdrawn' THEN false END IGNORE NULLS) OVER w, false) AS p1, "
    "coalesce(last_value(CASE WHEN task = 2 AND kind = 'promised' THEN true WHEN task = 2 AND kind = 'withdrawn' THEN false END IGNORE NULLS) OVER w, false) AS p2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)), "
    "m AS (SELECT user_id, seq, disk OR p0 OR p1 OR p2 AS m FROM x), l AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY seq), false) AS was FROM m) "
    "SELECT user_id, seq, CASE WHEN m THEN 'found' ELSE 'gone' END AS op FROM l WHERE m <> was"
)
def existence_transitions(spark, d):
    return changes.existence_transitions(_file_events(spark, d), ["user_id"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def noop_suppress(spark, d):
    return changes.changed_rows(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT CAST(ts AS DATE) AS step, user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2")
def step_last_wins(spark, d):
    return changes.latest(read(spark, d, "events").select(F.to_date("ts").alias("step"), "user_id", "event_id", "event_type"), ["step", "user_id"], "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 <> 0")
def keyed_upsert_delete(spark, d):
    """Every fifth key goes; every seventh, also of those that went, is found again with another value."""
    table = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    gone = table.where("c_custkey % 5 = 0").withColumns({"seq": F.lit(1).cast("long"), "op": F.lit("gone")})
    found = table.where("c_custkey % 7 = 0").select("c_custkey", (F.col("n") + 1).alias("n"), F.lit(2).cast("long").alias("seq"), F.lit("found").alias("op"))
    return upsert(table, gone.unionByName(found), ["c_custkey"])


@query("SELECT CAST(user_id AS VARCHAR) AS u, 'event:' || max(event_id) AS id FROM events GROUP BY user_id HAVING max(event_id) % 3 <> 0")
def changelog_match(spark, d):
    entry = F.array(F.struct(_path("event:", s("event_id")).alias("id"), F.lit(None).cast("string").alias("stamp")))
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "gone").otherwise("found").alias("op"), s("user_id").alias("u"), entry.alias("data"))
    return changelog_relation("events", log, ["u"]).df.select("u", F.col("data")[0]["id"].alias("id"))


@query("SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS place FROM events")
def stable_order(spark, d):
    return changes.first_place(read(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id")


@query("SELECT conv_id, turn, lag('t' || conv_id || '/' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def lag_dependency(spark, d):
    return changes.previous(read(spark, d, "conversations").select("conv_id", "turn", _path("t", s("conv_id"), "/", s("turn")).alias("out")), ["conv_id"], "turn", "out").drop("out")


@query(
    "WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) "
    "SELECT a.conv_id, a.turn, coalesce(string_agg(CAST(b.turn AS VARCHAR), ',' ORDER BY b.turn), '') AS members FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.n < a.n AND (b.n <= 2 OR b.n >= a.n - 2) GROUP BY 1, 2"
)
def first_plus_last_k(spark, d):
    return changes.first_and_last(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn", 2, 2).select("conv_id", "turn", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1, 2")
def last_report(spark, d):
    events = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.col("event_type").alias("kind"))
    return changes.latest(events, ["user_id", "day"], "event_id").drop("event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_task_ids(spark, d):
    return changes.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'out:' || o_custkey || '/' || o_orderpriority AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_outputs(spark, d):
    return changes.duplicates(read(spark, d, "orders").select(_path("out:", s("o_custkey"), "/", F.col("o_orderpriority")).alias("id")), ["id"])


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """An earlier list of outputs without every seventh document and with others since gone, and the list of now."""
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    out = _path("out:", s("doc_id"))
    old = docs.select("source", F.when(F.col("doc_id") % 7 == 0, _path("old:", s("doc_id"))).otherwise(out).alias("ref_key"), (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).alias("stamp"))
    return old, docs.select("source", out.alias("ref_key"), F.col("n_chars").alias("stamp"))


SNAPSHOTS = "o AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'old:' ELSE 'out:' END || doc_id AS ref_key, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS stamp FROM documents), n AS (SELECT source, 'out:' || doc_id AS ref_key, n_chars AS stamp FROM documents)"


@query(f"WITH {SNAPSHOTS} SELECT ref_key, CAST(0 AS INTEGER) AS phase, 'withdrawn' AS event FROM o WHERE ref_key NOT IN (SELECT ref_key FROM n) UNION ALL SELECT ref_key, 1, 'promised' FROM n WHERE ref_key NOT IN (SELECT ref_key FROM o)")
def outputs_diff(spark, d):
    old, new = _snapshots(spark, d)
    return changes.outputs_diff(old, new, ["ref_key"])


@query(f"WITH {SNAPSHOTS} SELECT source, ref_key FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = o.source AND n.ref_key = o.ref_key)")
def group_drop(spark, d):
    old, new = _snapshots(spark, d)
    return changes.lost(old, new, ["source", "ref_key"])


@query(f"WITH {SNAPSHOTS} SELECT CAST(to_json([coalesce(o.ref_key, n.ref_key)]) AS VARCHAR) AS set_key, CASE WHEN o.ref_key IS NULL THEN 'added' WHEN n.ref_key IS NULL THEN 'removed' WHEN o.stamp = n.stamp THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.ref_key = n.ref_key")
def joined_set_diff(spark, d):
    old, new = _snapshots(spark, d)
    return diff_sets(old, new, ["ref_key"], ["stamp"])


@query(f"WITH {SNAPSHOTS}, a AS (SELECT source, list_sort(list(ref_key)) AS k FROM o GROUP BY 1), b AS (SELECT source, list_sort(list(ref_key)) AS k FROM n GROUP BY 1) SELECT source, a.k = b.k AS same FROM a JOIN b USING (source)")
def ids_equal(spark, d):
    old, new = (x.groupBy("source").agg(F.collect_list("ref_key").alias(n)) for x, n in zip(_snapshots(spark, d), "ab", strict=True))
    return old.join(new, "source").select("source", changes.same_ids(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH {SNAPSHOTS}, a AS (SELECT source, string_agg(CAST(stamp AS VARCHAR), ',' ORDER BY ref_key) AS k FROM o GROUP BY 1), b AS (SELECT source, string_agg(CAST(stamp AS VARCHAR), ',' ORDER BY ref_key) AS k FROM n GROUP BY 1) SELECT source, a.k = b.k AS same FROM a JOIN b USING (source)")
def list_equal(spark, d):
    ordered = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("ref_key", "stamp"))), lambda x: x["stamp"]).alias(n)
    old, new = (x.groupBy("source").agg(ordered(n)) for x, n in zip(_snapshots(spark, d), "ab", strict=True))
    return old.join(new, "source").select("source", changes.same_lists(F.col("a"), F.col("b")).alias("same"))


# ---- graphs, the skip rule, outcomes ---------------------------------------------------------------------------------


def _heap(spark, d, ring: int = 0) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    e = docs.where("id > 0").select(F.col("id").alias("consumer"), F.floor(F.col("id") / 2).alias("producer"))
    if ring:
        r = spark.range(1, ring + 1).select((-F.col("id")).alias("id"))
        e = e.union(r.select(F.col("id").alias("consumer"), (-(-F.col("id") % ring) - 1).alias("producer"))).union(spark.range(1).select(F.lit(5).cast("long"), F.lit(-1).cast("long")))
        docs = docs.union(r)
    return docs, e


@query("WITH RECURSIVE h AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS level UNION ALL SELECT d.doc_id, h.level + 1 FROM h JOIN documents d ON d.doc_id > 0 AND d.doc_id // 2 = h.id) SELECT id, level FROM h")
def topo_levels(spark, d):
    n, e = _heap(spark, d)
    return graph.settle(n.withColumn("fails", F.lit(False)), e).select("id", "level")


HIT = "WITH RECURSIVE t AS (SELECT d.doc_id AS id, coalesce(toxic, 0) = 1 AS bad FROM documents d LEFT JOIN labels l USING (doc_id)), h AS (SELECT id, bad, false AS below FROM t WHERE id = 0 UNION ALL SELECT t.id, t.bad, h.below OR h.bad FROM h JOIN t ON t.id > 0 AND t.id // 2 = h.id)"


@query(HIT + " SELECT id, CASE WHEN below THEN 'dependency' WHEN bad THEN 'failed' ELSE 'ok' END AS state FROM h")
def failure_propagation(spark, d):
    n, e = _heap(spark, d)
    toxic = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("t"))
    return graph.settle(n.join(toxic, "id", "left").select("id", F.coalesce("t", F.lit(False)).alias("fails")), e).select("id", "state")


@query("WITH RECURSIVE h AS (SELECT CAST(5 AS BIGINT) AS id UNION ALL SELECT d.doc_id FROM h JOIN documents d ON d.doc_id > 0 AND d.doc_id // 2 = h.id) SELECT id FROM h UNION ALL SELECT -CAST(range AS BIGINT) FROM range(1, 11)")
def deadlock_nodes(spark, d):
    n, e = _heap(spark, d, 10)
    return graph.settle(n.withColumn("fails", F.lit(False)), e).where("state = 'deadlock'").select("id")


def _world(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """task, task_io, state and record, so that every reason occurs."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    i, n = F.col("doc_id"), s("n_chars")
    task = docs.select(s("doc_id").alias("task_id"))
    src, lib, out, out2 = _path("src:", s("doc_id")), _path("lib:", F.col("lang"), "/"), _path("out:", s("doc_id")), _path("out2:", s("doc_id"))
    when = lambda c, x: F.when(c, x)
    io = io_rows(
        docs,
        io_row(s("doc_id"), "in", 0, "artifact", when(i % 31 != 0, src)), io_row(s("doc_id"), "in", 1, "prefix", when((i % 31 != 0) & (i % 3 == 0), lib)),
        io_row(s("doc_id"), "out", 0, "artifact", out), io_row(s("doc_id"), "out", 1, "prefix", when(i % 4 == 0, F.concat(out2, F.lit("/")))),
    )
    entry = lambda kind, id, stamp: F.struct(F.lit(kind).alias("kind"), id.alias("id"), stamp.cast("string").alias("stamp"))
    state = docs.select(
        F.explode(F.array(entry("artifact", src, when(i % 29 != 0, n)), entry("prefix", lib, when(F.col("lang") != "de", F.length("lang"))), entry("artifact", out, when(i % 23 != 0, n)), entry("prefix", F.concat(out2, F.lit("/")), when(i % 8 == 0, n)))).alias("e")
    ).select("e.*").distinct()
    rec = lambda side, key, stamp, cond: F.when((i % 7 != 0) & cond, F.struct(s("doc_id").alias("task_id"), F.lit(side).alias("side"), key.alias("ref_key"), stamp.cast("string").alias("stamp")))
    yes, none = F.lit(True), F.lit(None)
    record = docs.select(
        F.explode(
            F.array_compact(
                F.array(
                    rec("ok", F.lit(""), none, yes),
                    rec("in", F.concat(F.lit("artifact "), F.when(i % 19 == 0, F.lit("x:")).otherwise(""), src), when(i % 29 != 0, F.when(i % 11 == 0, F.lit("was")).otherwise(n)), i % 31 != 0),
                    rec("in", F.concat(F.lit("prefix "), lib), F.length("lang"), (i % 31 != 0) & (i % 3 == 0)),
                    rec("out", F.concat(F.lit("artifact "), out), F.when(i % 13 == 0, F.lit("was")).otherwise(n), yes),
                    rec("out", F.concat(F.lit("prefix "), out2, F.lit("/")), n, (i % 4 == 0) & (i % 16 != 0)),
                    rec("out", F.concat(F.lit("artifact extra:"), s("doc_id")), n, i % 17 == 0),
                )
            )
        ).alias("r")
    ).select("r.*")
    return task, io, state, record


REASON = """
SELECT doc_id, CASE
  WHEN doc_id % 31 = 0 THEN 'no-inputs'
  WHEN doc_id % 3 = 0 AND lang = 'de' THEN 'input-unstamped'
  WHEN doc_id % 7 = 0 THEN 'no-record'
  WHEN doc_id % 19 = 0 THEN 'input-ids-changed'
  WHEN doc_id % 29 <> 0 AND doc_id % 11 = 0 THEN 'input-changed'
  WHEN doc_id % 23 = 0 THEN 'output-missing'
  WHEN doc_id % 13 = 0 THEN 'output-changed'
  WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'output-unstamped'
  WHEN doc_id % 16 = 0 THEN 'output-ids-changed'
  WHEN doc_id % 17 = 0 THEN 'output-ids-changed' END AS reason, lang
FROM documents"""


@query(
    f"SELECT CAST(doc_id AS VARCHAR) AS task_id, reason, CASE reason WHEN 'input-unstamped' THEN 'lib:' || lang || '/' WHEN 'input-changed' THEN 'src:' || doc_id WHEN 'output-missing' THEN 'out:' || doc_id WHEN 'output-changed' THEN 'out:' || doc_id WHEN 'output-unstamped' THEN 'out2:' || doc_id || '/' END AS reason_id FROM ({REASON})"
)
def skip_reasons(spark, d):
    return skip.decide(*_world(spark, d))


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS task_id, 'ok' AS side, '' AS ref_key, CAST(NULL AS VARCHAR) AS stamp FROM documents "
    "UNION ALL SELECT doc_id, 'in', 'artifact src:' || doc_id, CASE WHEN doc_id % 29 <> 0 THEN CAST(n_chars AS VARCHAR) END FROM documents WHERE doc_id % 31 <> 0 "
    "UNION ALL SELECT doc_id, 'in', 'prefix lib:' || lang || '/', CAST(length(lang) AS VARCHAR) FROM documents WHERE doc_id % 31 <> 0 AND doc_id % 3 = 0 AND lang <> 'de' "
    "UNION ALL SELECT doc_id, 'out', 'artifact out:' || doc_id, CASE WHEN doc_id % 23 <> 0 THEN CAST(n_chars AS VARCHAR) END FROM documents "
    "UNION ALL SELECT doc_id, 'out', 'prefix out2:' || doc_id || '/', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 8 = 0"
)
def record_rows(spark, d):
    """What is recorded when every task succeeds with the world as it is."""
    _, io, state, _ = _world(spark, d)
    return skip.snapshot(io, state)


@query("SELECT CAST(doc_id AS VARCHAR) AS task_id, 'no-store' AS reason, CAST(NULL AS VARCHAR) AS reason_id FROM documents")
def skip_no_store(spark, d):
    task, io, state, _ = _world(spark, d)
    return skip.decide(task, io, state, None)


OUTCOMES = (
    f"WITH RECURSIVE r AS ({REASON}), t AS (SELECT r.doc_id AS id, reason, coalesce(toxic, 0) = 1 AND reason IS NOT NULL AS bad FROM r LEFT JOIN labels l USING (doc_id)), "
    "h AS (SELECT id, reason, bad, false AS below, CAST(0 AS BIGINT) AS level FROM t WHERE id = 0 UNION ALL SELECT t.id, t.reason, t.bad, h.below OR h.bad, h.level + 1 FROM h JOIN t ON t.id > 0 AND t.id // 2 = h.id), "
    "o AS (SELECT CAST(id AS VARCHAR) AS task_id, CASE WHEN below OR bad THEN 'failed' WHEN reason IS NULL THEN 'skipped' ELSE 'executed' END AS type, CASE WHEN below THEN 'dependency' WHEN bad THEN 'error' ELSE reason END AS reason, level FROM h)"
)


@query(OUTCOMES + " SELECT * FROM o")
def outcomes(spark, d):
    task, io, state, record = _world(spark, d)
    n, e = _heap(spark, d)
    fails = read(spark, d, "labels").where("toxic = 1").select(s("doc_id").alias("task_id"))
    return skip.outcomes(task, e.select(s("consumer").alias("consumer"), s("producer").alias("producer")), skip.decide(task, io, state, record), fails)


@query(OUTCOMES + " SELECT type, count(*) AS n FROM o GROUP BY type")
def outcome_buckets(spark, d):
    return changes.outcome_buckets(outcomes(spark, d))


@query(OUTCOMES + " SELECT bool_and(type <> 'failed') AS success FROM o")
def success_flag(spark, d):
    return changes.success(outcomes(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS task_id, 'out:' || doc_id AS id FROM documents WHERE doc_id % 2 = 1")
def auto_produced(spark, d):
    """Even documents report their outputs themselves; the others' follow from success."""
    _, io, _, _ = _world(spark, d)
    reported = read(spark, d, "documents").where("doc_id % 2 = 0").select(s("doc_id").alias("task_id"), _path("out:", s("doc_id")).alias("id"))
    return io.where("side = 'out' and kind = 'artifact'").select("task_id", "id").transform(changes.unreported, reported, ["task_id", "id"])


@query(
    "SELECT 'build:' || concat_ws('/', d.doc_id, lang, quality) AS task_id, 'in' AS side, CAST(0 AS INTEGER) AS pos, 'artifact' AS kind, 'text:' || d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id "
    "UNION ALL SELECT 'build:' || concat_ws('/', d.doc_id, lang, quality), 'in', 1, 'artifact', 'label:' || d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id "
    "UNION ALL SELECT 'build:' || concat_ws('/', d.doc_id, lang, quality), 'out', 0, 'artifact', 'site/' || lang || '/' || d.doc_id || '.html' FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def one_task_rule(spark, d):
    docs = table_relation("docs", read(spark, d, "documents").withColumnRenamed("doc_id", "doc"), ["doc", "lang"], _path("text:", s("doc")))
    labels = table_relation("labels", read(spark, d, "labels").withColumnRenamed("doc_id", "doc"), ["doc", "quality"], _path("label:", s("doc")))
    return one_task_io("build", [docs, labels], {"page": KeyPattern("site/<lang>/<doc>.html")}, ["docs"])


@query("SELECT lang AS l, string_agg(k, '|' ORDER BY k) AS ids FROM (SELECT lang, 'content/' || lang || '/' || source || '/' || doc_id || '.md' AS k FROM documents) GROUP BY lang")
def group_rule(spark, d):
    r = key_relation("group", read(spark, d, "documents").select(dockey().alias("key")), "key", KeyPattern("content/<l>/**/*.md"), group=True)
    return r.df.select("l", F.concat_ws("|", F.col("data.id")).alias("ids"))


@query("SELECT r_regionkey * 100 + n AS id FROM region, range(0, 8) t(n)")
def loop_fixpoint(spark, d):
    """Each region's chain grows by one row a round until its eighth."""
    start = read(spark, d, "region").select((F.col("r_regionkey") * 100).cast("long").alias("id"))
    return loop_rows(start, lambda rows: rows.where("id % 100 < 7").select((F.col("id") + 1).alias("id")), ["id"], 20)
