"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Documents are aggregated by length with map-side sums, so the rows after the aggregate are as many as there are different lengths. Suffix
sums run in two levels, within blocks of lengths and over the totals of blocks, so no task gets all lengths.

Defined results: null and empty texts have length 0. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .packing import DEFAULT_VOCABULARY, word_encoder

#: Lengths per block.
WIDTH = 256


def encoded_lengths(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """length: ids of each row's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = word_encoder(path)
        return pa.RecordBatch.from_arrays([pa.array([len(ids) // 4 for ids in enc.encode_all([t or "" for t in batch.column("text").to_pylist()])], pa.int64())], ["length"])

    return map_arrow(docs.select("text"), run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: n_docs, n_tokens; docs_at_least and tokens_at_least (suffix sums); docs_up_to, tokens_up_to; and
    truncated_total, the tokens that are left when every document is cut to this length, with lost_tokens.

    A row also answers for what lies between the length before and its own. limit_from is the least such limit, and cut to any limit
    from there to length, the documents have tokens_below + limit * docs_at_least tokens. The quantile of a share above share_below, up to share_up_to, is length."""
    h = lengths.groupBy("length").agg(F.count("*").alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / WIDTH))
    # else every use would encode all texts again
    h = cut(h)
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"), F.max("length").alias("top"))
    in_order = Window.orderBy("block")
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"),
        *(F.sum(c).over(both).alias(f"{c}_all") for c in "dt"),
        F.lag("top", 1, -1).over(in_order).alias("top_before"),
    )
    down = Window.partitionBy("block").orderBy(F.col("length").desc())
    own = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.join(totals, "block").withColumns(
        {
            "docs_at_least": F.col("d_above") + F.sum("n_docs").over(own),
            "tokens_at_least": F.col("t_above") + F.sum("n_tokens").over(own),
            "limit_from": F.coalesce(F.lead("length").over(down), F.col("top_before")) + 1,
        }
    )
    out = out.withColumns(
        {
            "docs_up_to": F.col("d_all") - F.col("docs_at_least") + F.col("n_docs"),
            "tokens_up_to": F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens"),
            "tokens_below": F.col("t_all") - F.col("tokens_at_least"),
        }
    )
    out = out.withColumns(
        {
            "truncated_total": F.col("tokens_below") + F.col("length") * F.col("docs_at_least"),
            "share_below": (F.col("docs_up_to") - F.col("n_docs")) / F.col("d_all"),
            "share_up_to": F.col("docs_up_to") / F.col("d_all"),
        }
    )
    return out.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "docs_up_to", "tokens_up_to", "truncated_total",
        (F.col("t_all") - F.col("truncated_total")).alias("lost_tokens"), "limit_from", "tokens_below", "share_below", "share_up_to",
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of the documents doesn't exceed. Each share is answered by one row."""
    least = F.col("docs_up_to") == F.col("n_docs")
    mine = lambda s: (s <= F.col("share_up_to")) & ((s > F.col("share_below")) | least)
    return hist.select(F.explode(F.filter(F.array(*(F.lit(float(s)) for s in shares)), mine)).alias("share"), "length") if shares else _none(hist, "share double, length long")


def truncated_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total: for limits from 0 on, also those that no document has as its length. Each is answered by one row."""
    last = F.col("docs_at_least") == F.col("n_docs")
    mine = lambda x: (x >= F.col("limit_from")) & ((x <= F.col("length")) | last)
    total = F.col("tokens_below") + F.least(F.col("limit"), F.col("length")) * F.col("docs_at_least")
    if not limits:
        return _none(hist, "limit long, truncated_total long")
    return hist.select("*", F.explode(F.filter(F.array(*(F.lit(int(x)).cast("long") for x in limits)), mine)).alias("limit")).select("limit", total.alias("truncated_total"))


def _none(hist: DataFrame, schema: str) -> DataFrame:
    return hist.sparkSession.createDataFrame([], schema)
