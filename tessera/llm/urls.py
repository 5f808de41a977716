"""Temporal list join: URL captures against dated list entries, with DataFrame operations only.

The entries of one list for one value, in order of their dates, become validity intervals: each holds until the next one for the
same value. A capture asks for its host, every parent domain and every path prefix; an as-of join
finds the one interval of each list and value that was valid at fetch time. A capture is blocked if an active entry
blocks it and none allows it.

The intervals are broadcast only if they are few (counted first). Otherwise both sides are shuffled by value and a salt,
which spreads a host with a third of all captures over SALTS tasks.

Defined results: several entries of a value on one date count as the last by action name ("remove" after
"block" after "allow"). A null or unreadable URL asks for nothing; a null fetch time meets no interval. Repeated
captures are judged each on their own. Entries with a null list, kind, value, date or action are void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, is_small, prepare

#: Intervals that are broadcast at most, and tasks that share a value beyond.
FEW, SALTS = 200_000, 16


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def asked(url: Column) -> Column:
    """Array of (kind, value) that a URL asks for."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value"))
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host != "", F.concat(own, domains, prefixes)).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, kind, value, listed_on, action. Adds until (null: still valid); removals only end others."""
    e = entries.where("list is not null and kind is not null and value is not null and listed_on is not null and action is not null")
    e = e.groupBy("list", "kind", "value", "listed_on").agg(F.max("action").alias("action"))
    until = F.lead("listed_on").over(Window.partitionBy("list", "kind", "value").orderBy("listed_on"))
    return e.withColumn("until", until).where("action <> 'remove'")


def temporal_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched. Returns page_id, fetched, n_active, lists, blocked."""
    prepare(captures.sparkSession)
    c = cut(captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("uid")))
    spans = cut(intervals(entries))
    keys = c.select("uid", "fetched", F.explode(asked(F.col("url"))).alias("k")).select("uid", "fetched", "k.kind", "k.value")
    if is_small(spans, FEW):
        on = ["kind", "value"]
        right = F.broadcast(spans)
    else:
        on = ["kind", "value", "salt"]
        keys = keys.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
        right = spans.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)]))).hint("shuffle_hash")
    active = keys.join(right, on).where("listed_on <= fetched and (until is null or fetched < until)")
    found = active.groupBy("uid").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max((F.col("action") == "block").cast("int")).alias("block"), F.max((F.col("action") == "allow").cast("int")).alias("allow")
    )
    return c.join(found, "uid", "left").select(
        "page_id", "fetched", F.coalesce("n", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce((F.col("block") == 1) & (F.col("allow") == 0), F.lit(False)).alias("blocked")
    )


def day(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `pages` as captures: it has no fetch times, so they follow from the ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", day("2024-01-01", (F.col("page_id") * 37) % 365).alias("fetched"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dated lists made by rule from the hosts, domains and first folders of `pages`."""
    url = F.col("url")
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(host_of(url).alias("host"), F.element_at(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), 1).alias("folder")).where("host <> ''").distinct()
    row = lambda name, kind, value, day_, action: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), day_.alias("listed_on"), F.lit(action).alias("action"))
    n = F.length("host")
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    prefix = F.concat_ws("/", "host", "folder")
    made = F.array(
        F.when(n % 4 < 3, row("ads", "host", F.col("host"), day("2024-01-01", n * 11 % 300), "block")),
        F.when(n % 2 == 0, row("ads", "host", F.col("host"), day("2024-01-01", n * 11 % 300 + 60), "remove")),
        F.when(F.size(F.split("host", r"\.")) > 1, row("trust", "domain", domain, day("2024-08-01", F.length(domain) * 5 % 100), "allow")),
        F.when(F.size(F.split("host", r"\.")) > 1, row("trust", "domain", domain, day("2024-10-15", F.length(domain) * 3 % 50), "remove")),
        F.when(F.col("folder").isNotNull() & (F.length(prefix) % 3 < 2), row("abuse", "prefix", prefix, day("2024-02-01", F.length(prefix) * 7 % 200), "block")),
    )
    return hosts.select(F.explode(F.array_compact(made)).alias("e")).select("e.*").distinct()


OP7_SQL = r"""
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages
), h AS (
  SELECT DISTINCT host, parts[1] AS folder, string_split(host, '.') AS labels, length(host) AS n FROM c WHERE host <> ''
), d AS (SELECT *, array_to_string(labels[-2:], '.') AS domain, concat_ws('/', host, folder) AS prefix FROM h),
e AS (
  SELECT 'ads' AS list, 'host' AS kind, host AS value, DATE '2024-01-01' + CAST(n * 11 % 300 AS INTEGER) AS listed_on, 'block' AS action FROM d WHERE n % 4 < 3
  UNION SELECT 'ads', 'host', host, DATE '2024-01-01' + CAST(n * 11 % 300 + 60 AS INTEGER), 'remove' FROM d WHERE n % 2 = 0
  UNION SELECT 'trust', 'domain', domain, DATE '2024-08-01' + CAST(length(domain) * 5 % 100 AS INTEGER), 'allow' FROM d WHERE len(labels) > 1
  UNION SELECT 'trust', 'domain', domain, DATE '2024-10-15' + CAST(length(domain) * 3 % 50 AS INTEGER), 'remove' FROM d WHERE len(labels) > 1
  UNION SELECT 'abuse', 'prefix', prefix, DATE '2024-02-01' + CAST(length(prefix) * 7 % 200 AS INTEGER), 'block' FROM d WHERE folder IS NOT NULL AND length(prefix) % 3 < 2
), o AS (SELECT list, kind, value, listed_on, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(listed_on) OVER (PARTITION BY list, kind, value ORDER BY listed_on) AS until FROM o),
k AS (
  SELECT page_id, fetched, 'host' AS kind, host AS value FROM c WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 'domain', unnest([array_to_string(string_split(host, '.')[x:], '.') FOR x IN range(1, len(string_split(host, '.')) + 1)]) FROM c WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 'prefix', unnest([host || '/' || array_to_string(parts[:x], '/') FOR x IN range(1, len(parts) + 1)]) FROM c WHERE host <> ''
), a AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(action = 'block') AS b, bool_or(action = 'allow') AS w
  FROM k JOIN i USING (kind, value) WHERE action <> 'remove' AND listed_on <= fetched AND (until IS NULL OR fetched < until) GROUP BY page_id
)
SELECT c.page_id, c.fetched, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(b AND NOT w, false) AS blocked FROM c LEFT JOIN a USING (page_id)
"""
