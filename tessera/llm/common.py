"""Helpers shared by the training-data operators.

Conventions of every operator here:

* a null text counts as the empty text unless the docstring says otherwise;
* columns are read by name, so extra columns, also with clashing names, don't matter;
* rows are never dropped, sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoints, components, cut
from ..operators.graph import is_small as _is_small

#: Largest id list, in rows, that is sent to every executor; longer ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows of one Arrow batch: bounds a Python worker's memory when texts are very long.
BATCH_ROWS = 512
#: Entries of a worker's word or chunk cache; when full it is emptied, which only costs time.
CACHE_ENTRIES = 700_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that bound a Python worker's memory, and a checkpoint folder where none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoints(spark)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; batches are kept small."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return _is_small(df, rows)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key isn't in ids (one column named key). The list is broadcast only if it is
    short (counted first); else both sides are shuffled."""
    ids = ids.select(F.col(key).alias("_drop")).where(F.col("_drop").isNotNull())
    ids = F.broadcast(ids) if is_small(ids) else ids.hint("shuffle_hash")
    return docs.join(ids, docs[key] == ids["_drop"], "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is in ids; as without_ids."""
    ids = ids.select(F.col(key).alias("_keep"))
    ids = F.broadcast(ids) if is_small(ids) else ids.hint("shuffle_hash")
    return docs.join(ids, docs[key] == ids["_keep"], "left_semi")


__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "CACHE_ENTRIES", "components", "cut", "documents", "is_small", "map_arrow", "only_ids", "prepare", "text_or_empty", "without_ids"]
