"""Exact deduplication by a tree merge of sorted digest runs, with DataFrame operations only.

Every row gets a digest of its normalised text. A *run* holds, for one slice of the rows, each digest
once: with its best row and the number of rows. Runs meet in binomial rounds, as in a butterfly: after
round r a run is known by r*b bits of its origin less and r*b leading bits of the digest more, so that 2^b runs are
merged into each new one (multiway), the work of a round is spread over all runs, and after the last round one
run holds all that is known of its range of digests. A merge retains the best row and adds the counts;
it merges entries only if the whole digest, the normalised length and a second, independent hash agree. A run is the rows of one
(node, origin): Spark sorts them by digest within a task and merges neighbours in a sort aggregate, so several tasks may
share a run; as a digest goes to one of them, the result is that of one merge.

The answer goes back down the same tree: an entry that won tells its 2^b sources. A group of equal texts
therefore never meets in one task; a task sees it once per run it merges.

Defined results: a null text equals the empty text. Null ids sort last. Rows with the same text, length
and id tie: exactly one of them stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: log2 of the number of runs merged into one in a round, and rounds: 2^(3*2) = 64 runs.
RADIX_BITS, ROUNDS = 3, 2
#: Deleted before texts are compared: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"

KEY = ["digest", "norm_len", "check"]


def digests(docs: DataFrame, bits: int = RADIX_BITS * ROUNDS, row: str | None = None) -> DataFrame:
    """uid, doc_id, run, digest (binary), norm_len, check, best: struct that is smallest for the row to keep.
    row: column with a unique number of each row, if there is one."""
    norm = F.translate(text_or_empty(), WHITE, "")
    # translate() drops the characters that have no counterpart
    uid = F.col(row) if row else F.monotonically_increasing_id()
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).alias("n"), norm.alias("norm"), uid.alias("uid"))
    return df.select(
        "uid",
        "doc_id",
        F.pmod(F.xxhash64("uid"), F.lit(1 << bits)).cast("int").alias("run"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.length("norm").alias("norm_len"),
        F.xxhash64("norm").alias("check"),
        F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")).alias("best"),
    )


def _lead(bits: int):
    """The leading bits of the digest."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - bits)


def classes(rows: DataFrame, radix_bits: int = RADIX_BITS, rounds: int = ROUNDS) -> DataFrame:
    """rows: as from digests(), already cut. Returns uid, doc_id, digest, keep_id, keep_uid, group_size."""
    total = radix_bits * rounds
    levels = [rows.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))]
    for r in range(1, rounds + 1):
        # origin bits leave at the low end, digest bits enter at the high end
        node = F.shiftleft(_lead(r * radix_bits), total).bitwiseOR(F.shiftright(F.col("run").bitwiseAND((1 << total) - 1), r * radix_bits))
        below = levels[-1].withColumn("node", node) if r == 1 else levels[-1].withColumn(
            "node", F.shiftleft(_lead(r * radix_bits), total).bitwiseOR(F.shiftright(F.col("origin"), radix_bits))
        )
        origin = F.shiftright(F.col("run"), radix_bits) if r == 1 else F.shiftright(F.col("origin"), radix_bits)
        merged = below.withColumn("up", origin).groupBy("node", F.col("up").alias("origin"), *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(cut(merged.withColumnRenamed("node", "run")))
    top = levels[-1].select("run", "origin", *KEY, F.struct("best", "n").alias("won"))
    for r in range(rounds, 0, -1):
        low = levels[r - 1]
        up = F.shiftright(F.col("run" if r == 1 else "origin"), radix_bits)
        low = low.select(*[c for c in ("run", "origin") if c in low.columns], *KEY, up.alias("up"))
        top = low.join(top.drop("run").withColumnRenamed("origin", "up"), ["up", *KEY]).drop("up")
    won = top.select("run", *KEY, "won")
    return rows.join(won, ["run", *KEY]).select(
        "uid", "doc_id", "digest", F.col("won.best.id").alias("keep_id"), F.col("won.best.uid").alias("keep_uid"), F.col("won.n").alias("group_size")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(cut(digests(docs))).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def dropped_rows(docs: DataFrame, row: str) -> DataFrame:
    """The numbers (column row: unique, not null, the same on every read) of the rows that don't stay."""
    return cut(classes(cut(digests(docs, row=row)))).where("uid <> keep_uid").select(F.col("uid").alias(row))
