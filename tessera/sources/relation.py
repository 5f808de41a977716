"""Relations from files, object listings, tables, JSON documents and changelogs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import digest
from ..functions.pattern import FilePattern, KeyPattern
from ..operators.changes import group_lists, latest
from ..operators.join import Relation
from .listing import ListingSource


def listing(spark: SparkSession, root: str, start: str = "", stamp: str = "none", shape: list | None = None) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").option("path", root).option("start", start).option("stamp", stamp).option("shape", json.dumps(shape or [[]])).load()


def _below_start(pattern: KeyPattern) -> list:
    """The shape of a pattern's parts behind its literal start."""
    shape = [[] if x.folders else x.literal for x in pattern.segments]
    while len(shape) > 1 and isinstance(shape[0], str):
        shape.pop(0)
    return shape


def _files(spark: SparkSession, p: FilePattern, stamp: str) -> DataFrame:
    """Files that fit. Literal parts, also behind variables, are joined and not listed."""
    start = p.key.static_prefix()
    if all(x.literal is not None for x in p.key.segments):
        start = "/".join(x.literal for x in p.key.segments[:-1])
    return p.key.scan(listing(spark, p.root, start, stamp, _below_start(p.key)), "relative")


def _entry(id: Column, stamp: Column) -> Column:
    return F.array(F.struct(id.cast("string").alias("id"), stamp.cast("string").alias("stamp"))).alias("data")


def file_relation(spark: SparkSession, name: str, pattern: FilePattern, stamp: str = "hash") -> Relation:
    """A row per file that fits."""
    p = pattern.for_files()
    rows = _files(spark, p, stamp)
    return Relation(name, rows.select(*p.var_names, _entry(F.concat(F.lit("file:"), F.col("path")), F.col("stamp"))), tuple(p.var_names))


def group_relation(spark: SparkSession, name: str, pattern: FilePattern, stamp: str = "hash") -> Relation:
    """A row per binding of the variables, with the list of files in order of their paths."""
    p = pattern.for_groups()
    files = _files(spark, p, stamp).withColumn("id", F.concat(F.lit("file:"), F.col("path")))
    return Relation(name, group_lists(files, p.var_names), tuple(p.var_names))


def key_relation(name: str, df: DataFrame, key: str, pattern: KeyPattern, stamp: Column | None = None, group: bool = False) -> Relation:
    """Rows of any table whose key column fits the pattern, such as an object listing."""
    rows = pattern.scan(df, key).withColumn("id", F.col(key)).withColumn("stamp", (F.lit(None) if stamp is None else stamp).cast("string"))
    v = tuple(pattern.var_names)
    if group:
        return Relation(name, group_lists(rows, list(v)), v)
    return Relation(name, rows.select(*v, _entry(F.col("id"), F.col("stamp"))), v)


def table_relation(name: str, df: DataFrame, variables: list[str], id: Column, stamp: Column | None = None) -> Relation:
    """A row per row of a table: variables are cast to strings."""
    rows = df.select(*(F.col(v).cast("string").alias(v) for v in variables), _entry(id, F.lit(None) if stamp is None else stamp))
    return Relation(name, rows, tuple(variables))


def changelog_relation(name: str, events: DataFrame, variables: list[str]) -> Relation:
    """The current rows of a changelog (seq, op, variables, data): the last event per key, unless it says gone."""
    rows = latest(events, variables, "seq").where("op = 'found'")
    return Relation(name, rows.select(*variables, "data"), tuple(variables))


def constant_relation(spark: SparkSession, name: str, id: str, value: str) -> Relation:
    """One row without variables whose stamp is its value, such as the version of some code."""
    return Relation(name, spark.range(1).select(_entry(F.lit(id), F.lit(value))), ())


def json_keys(df: DataFrame, id: Column, document: Column) -> DataFrame:
    """id `<document id>#<key>` and stamp of each key of JSON objects."""
    kv = F.explode(F.from_json(document, "map<string,string>"))
    return df.select(id.alias("_d"), kv.alias("k", "v")).select(F.concat_ws("#", "_d", "k").alias("id"), F.sha2("v", 256).alias("stamp"))


def checked_objects(listed: DataFrame) -> DataFrame:
    """key, etag of an object listing; a row without either is an error."""
    bad = F.col("key").isNull() | F.col("etag").isNull()
    return listed.select(F.when(bad, F.raise_error(F.lit("object listing: a row lacks its key or etag")).cast("string")).otherwise(F.col("key")).alias("key"), "etag")


def prefix_stamp(listed: DataFrame, prefix: str, key: str = "key", stamp: str = "etag") -> DataFrame:
    """One row, `stamp`: the digest of `<key>=<stamp>` of all below the prefix ('/' added), in order. No objects have a stamp, too."""
    start = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    return listed.where(F.col(key).startswith(start)).agg(digest(F.concat_ws("=", F.substring(F.col(key), len(start) + 1, 1 << 30), F.col(stamp))).alias("stamp"))


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """key, size, last_modified and etag (from size and time) of a folder in any store Spark can read, without reading bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    etag = F.concat_ws("-", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), etag.alias("etag"))


class MemoryObjects:
    """An object store in memory, for tests: etag is the content's hash, times strictly increase."""

    def __init__(self) -> None:
        self.objects: dict[tuple[str, str], tuple[bytes, str, int]] = {}
        self.clock = 0

    def put(self, bucket: str, key: str, body: bytes) -> str:
        import hashlib

        self.clock += 1
        etag = hashlib.sha256(body).hexdigest()
        self.objects[bucket, key] = (body, etag, self.clock)
        return etag

    def get(self, bucket: str, key: str) -> bytes | None:
        return self.objects.get((bucket, key), (None,))[0]

    def head(self, bucket: str, key: str) -> str | None:
        o = self.objects.get((bucket, key))
        return o[1] if o else None

    def delete(self, bucket: str, key: str) -> None:
        self.objects.pop((bucket, key), None)

    def list(self, spark: SparkSession, bucket: str, prefix: str = "") -> DataFrame:
        rows = sorted((k, len(b), e, t) for (n, k), (b, e, t) in self.objects.items() if n == bucket and k.startswith(prefix))
        return spark.createDataFrame(rows, "key string, size long, etag string, last_modified long")
