"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte is removed if it lies in a string of LENGTH bytes that also starts anywhere else. The positions that such strings can start at are sorted as
suffixes (to LENGTH bytes) so that equal ones are neighbours:

1. Texts that occur more than once are known to be removed whole; one of them goes on as a source for the others.
2. In every LENGTH-byte window the k-gram with the least hash is its *anchor*: equal windows have equal anchors. Windows in a row
   with one anchor make a stretch. Only stretches whose anchor occurs twice or more can hold a repeat; anchors are counted with
   map-side sums, and a Bloom filter of fixed greatest size keeps the others from being sent (false hits only cost time).
3. Stretches are dealt out by anchor, so equal windows meet. An anchor with very many stretches is dealt out further by the bytes that all windows of
   a quarter of the stretch hold. Equal stretches of one task are sent once.
4. A task sorts its windows in two stages. Suffixes smaller than their successors are sorted directly; the others are induced: bucket by
   bucket of the first byte, from small to large, in the order of their successors. Then the common prefixes of neighbours are
   computed; LENGTH bytes or more mark both.
5. Marked windows go back to their documents, overlapping ones are joined, and the rest of the bytes is kept.

Defined results: null text is the empty text; texts shorter than LENGTH keep all. Rows are judged by their texts, so repeated rows are
repeats of each other, and rows that share an id, or have none, are documents of their own. Ties don't arise: every repeat is marked. An
empty table gives no rows. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, only_ids, prepare, text_or_empty, without_ids

LENGTH = 200
GRAM = 32
#: Anchors that occur so often are dealt out further.
HOT = 2_000
PARTS_OF_HOT = 4
#: Windows that a task sorts at once.
BLOCK = 150_000
#: Windows of a text whose anchors are sought at once.
SLICE = 1 << 18
#: Stretches that are held, and rows that are sent, at once: a worker's memory doesn't grow with the texts of a batch.
HELD = 20_000
#: Greatest number of bits of a Bloom filter: 64 MB.
MOST_BITS = 1 << 29

_rng = np.random.default_rng(20_240_501)
_TABLE = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29, _S27 = np.uint64(32), np.uint64(29), np.uint64(27)
_WORDS = _rng.integers(1, 1 << 63, LENGTH // 8, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S32)


def words_of(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _places(data: bytes) -> np.ndarray:
    """The anchor's place of each window."""
    x = _TABLE[np.frombuffer(data, np.uint8)]
    p, n = np.uint32(0x9E3779B1), 1
    while n < GRAM:
        x = x[:-n] * p + x[n:]
        p, n = p * p, 2 * n
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x2C1B3C6D)
    key = (x ^ (x >> np.uint32(12))).astype(np.uint64) << _S32 | np.arange(len(x), dtype=np.uint64)
    width, n = LENGTH - GRAM + 1, 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < width:
        key = np.minimum(key[: len(key) - (width - n)], key[width - n :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place, anchor's hash) of each stretch; data has LENGTH bytes at least."""
    windows = len(data) - LENGTH + 1
    firsts, places = [], []
    for at in range(0, windows, SLICE):
        place = _places(data[at : at + SLICE + LENGTH - 1])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        firsts.append(first + at)
        places.append(place[first] + at)
    first, place = np.concatenate(firsts), np.concatenate(places)
    new = np.r_[True, place[1:] != place[:-1]]  # a stretch may go on in the next slice
    first, place = first[new], place[new]
    count = np.diff(np.r_[first, windows])
    w = words_of(data)
    h = np.zeros(len(place), np.uint64)
    for k in range(0, GRAM, 8):
        h = mix(h * _M1 + w[place + k])
    return first, count, place, h


def _key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _anchors(docs: DataFrame) -> DataFrame:
    """anchor, n: counted within a batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        with np.errstate(over="ignore"):
            for t in batch.column("text").to_pylist():
                data = (t or "").encode("utf-8", "replace")
                if len(data) >= LENGTH:
                    found.append(stretches(data)[3])
        anchor, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return map_arrow(docs.select("text"), run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def bloom(rows: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the column anchor, as 64-bit words. It is put together on the executors; its size is bounded."""
    bits = 1 << 16
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    place = F.explode(F.array(F.col("anchor").bitwiseAND(bits - 1), F.shiftrightunsigned("anchor", 29).bitwiseAND(bits - 1))).alias("p")
    words = rows.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint64)


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(h), bool)
    for p in (h & mask, (h >> _S29) & mask):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


PLACES = "grp long, stretch binary, copies long, n int, data binary, key binary, starts array<int>"


def _send(docs: DataFrame, repeated, hot) -> DataFrame:
    """Of every stretch that may hold a repeat: its bytes (once per task; key null), and where it is (key, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, many = repeated.value, hot.value
        sent: dict[bytes, int] = {}

        def parts_of(data: bytes) -> Iterator[tuple[int, int, int]]:
            first, count, place, h = stretches(data)
            hits = np.flatnonzero(in_bloom(want, h))
            for i in range(0, len(hits), HELD):
                some = hits[i : i + HELD]
                often = in_bloom(many, h[some]) if many is not None else np.zeros(len(some), bool)
                for a, n, q, g, split in zip(first[some].tolist(), count[some].tolist(), place[some].tolist(), h[some].view(np.int64).tolist(), often.tolist(), strict=True):
                    if not split:
                        yield a, n, g
                        continue
                    # quarters by the distance to the anchor; all windows of a quarter hold its core
                    width = -(-(LENGTH - GRAM + 1) // PARTS_OF_HOT)
                    for k in range(PARTS_OF_HOT):
                        lo, hi = max(a, q - (k + 1) * width + 1), min(a + n - 1, q - k * width)
                        if lo <= hi:
                            core = data[q - k * width : q - (k + 1) * width + 1 + LENGTH]
                            yield lo, hi - lo + 1, int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True) ^ k

        def with_bytes(copies: dict[bytes, list]) -> Iterator[tuple]:
            for mark, (g, c, n, piece) in copies.items():
                # sent once with its bytes; a second row, without them, only says that there are more
                again = sent.get(mark, 0)
                if again < 2:
                    sent[mark] = again + 1
                    if len(sent) > 300_000:
                        sent.clear()
                    yield g, mark, c, n, None if again else piece, None, None
            copies.clear()

        def where(own: dict[bytes, list], key: bytes, copies: dict[bytes, list]) -> Iterator[tuple]:
            for mark, (g, n, starts, piece) in own.items():
                if mark in copies:
                    copies[mark][1] += len(starts)
                else:
                    copies[mark] = [g, len(starts), n, piece]
                yield g, mark, None, n, None, key, starts
            own.clear()
            if len(copies) >= HELD:
                yield from with_bytes(copies)

        def rows() -> Iterator[tuple]:
            copies: dict[bytes, list] = {}
            for batch in batches:
                for t in batch.column("text"):
                    data = (t.as_py() or "").encode("utf-8", "replace")
                    if len(data) < LENGTH:
                        continue
                    key = None
                    own: dict[bytes, list] = {}
                    held = 0
                    for a, n, g in parts_of(data):
                        key = key or _key(data)
                        piece = data[a : a + n - 1 + LENGTH]
                        mark = hashlib.blake2b(piece, digest_size=16).digest()
                        if mark in own:
                            own[mark][2].append(a)
                        else:
                            own[mark] = [g, n, [a], piece]
                        held += 1
                        if held >= HELD:
                            yield from where(own, key, copies)
                            held = 0
                    yield from where(own, key, copies)
                yield from with_bytes(copies)

        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
        with np.errstate(over="ignore"):
            for some in itertools.batched(rows(), HELD):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["grp", "stretch", "copies", "n", "data", "key", "starts"])

    return docs.select("text").mapInArrow(run, PLACES)


def two_stage(buffer: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorts the windows first[i].. first[i]+count[i]-1 of the buffer, and the auxiliary positions that inducing needs; returns all in order.

    Each stretch is followed by LENGTH - 1 bytes of its own; the buffer by 2 * LENGTH zeros."""
    b = np.frombuffer(buffer, np.uint8)
    size = len(b)
    # where the run of equal bytes at each position ends, and whether a smaller byte follows
    change = np.flatnonzero(b[1:] != b[:-1])
    run_end = np.full(size, size - 1, np.int64)
    at = np.searchsorted(change, np.arange(size - 1))
    inside = at < len(change)
    run_end[:-1][inside] = change[at[inside]]
    follows = b[np.minimum(run_end + 1, size - 1)]
    late = b > follows  # larger than its successor: to be induced
    late[run_end - np.arange(size) >= LENGTH - 1] = False  # one byte throughout: sorted directly
    windows = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    # the successors of the last windows, up to one that is sorted directly
    extra, cur = [], first + count - 1
    for _ in range(LENGTH):
        cur = cur[late[cur]] + 1
        if not len(cur):
            break
        extra.append(cur)
    items = np.concatenate([windows, *extra])
    is_late = late[items]
    direct, induced = items[~is_late], items[is_late]
    rank = np.full(size, -1, np.int64)
    # stage 1: equal windows are sorted as one
    w = words_of(buffer)
    h = np.zeros(len(direct), np.uint64)
    for k in range(LENGTH // 8):
        h = h * _M1 + mix(w[direct + 8 * k] * _WORDS[k])
    _, some, which = np.unique(h, return_index=True, return_inverse=True)
    texts = np.lib.stride_tricks.as_strided(b, (size - LENGTH, LENGTH), (1, 1))[direct[some]]
    by = np.empty(len(some), np.int64)
    by[np.argsort(np.ascontiguousarray(texts).view(f"S{LENGTH}").ravel(), kind="stable")] = np.arange(len(some))
    direct = direct[np.argsort(by[which], kind="stable")]
    # stage 2: bucket scans
    d_cut = np.searchsorted(b[direct], np.arange(257))
    length = run_end[induced] - induced
    o = np.lexsort((length, b[induced]))
    induced, length = induced[o], length[o]
    out: list[np.ndarray] = []
    done = 0

    def give(x: np.ndarray) -> None:
        nonlocal done
        rank[x] = np.arange(done, done + len(x))
        done += len(x)
        out.append(x)

    i_cut = np.searchsorted(b[induced], np.arange(257))
    for c in range(256):
        lo, hi = i_cut[c], i_cut[c + 1]
        if lo < hi:
            # shorter runs of the byte are smaller, and each run's successor is in the run before
            for a, z in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.r_[lo, lo + 1 + np.flatnonzero(length[lo + 1 : hi] != length[lo : hi - 1]), hi]), strict=True):
                own = induced[a:z]
                give(own[np.argsort(rank[own + 1], kind="stable")])
        if d_cut[c] < d_cut[c + 1]:
            give(direct[d_cut[c] : d_cut[c + 1]])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated_windows(pieces: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """Of stretches (bytes, windows, copies), which windows occur twice or more."""
    buffer = b"".join(p[0] for p in pieces) + bytes(2 * LENGTH)
    first = np.r_[0, np.cumsum([len(p[0]) for p in pieces])[:-1]].astype(np.int64)
    count = np.array([p[1] for p in pieces], np.int64)
    order = two_stage(buffer, first, count)
    window = np.zeros(len(buffer), bool)
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        window[a : a + n] = True
    order = order[window[order]]
    w = words_of(buffer)
    x, y = order[:-1], order[1:]
    equal = np.flatnonzero(w[x] == w[y])
    for k in range(8, LENGTH, 8):
        equal = equal[w[x[equal] + k] == w[y[equal] + k]]
    twice = np.zeros(len(buffer), bool)
    twice[x[equal]] = True
    twice[y[equal]] = True
    return [np.ones(n, bool) if copies > 1 else twice[a : a + n] for a, n, (_, _, copies) in zip(first.tolist(), count.tolist(), pieces, strict=True)]


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grp and stretch; gives (stretch, runs: first and last+1 window of each run)."""
    held: dict[bytes, list] = {}
    windows, group = 0, None

    def flush() -> pa.RecordBatch:
        marks = list(held)
        with np.errstate(over="ignore"):
            found = repeated_windows([(held[m][2], held[m][1], held[m][0]) for m in marks])
        runs = []
        for mask in found:
            edge = np.diff(np.r_[0, mask.view(np.int8), 0])
            runs.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist())
        keep = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([marks[i] for i in keep], pa.binary()), pa.array([runs[i] for i in keep], pa.list_(pa.int32()))], ["stretch", "runs"])

    for batch in batches:
        for grp, mark, copies, n, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "stretch", "copies", "n", "data")), strict=True):
            if grp != group:
                group = grp
                if windows >= BLOCK:
                    yield flush()
                    held, windows = {}, 0
            if mark in held:
                held[mark][0] += copies
                held[mark][2] = held[mark][2] or data
            else:
                held[mark] = [copies, n, data]
                windows += n
    if held:
        yield flush()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, removed when the session's JVM ends."""
    spark = df.sparkSession
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def _forget(df: DataFrame) -> None:
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed_spans(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """texts: different texts. Returns key (of the text) and spans: [start, end, start, end, ...], sorted and apart."""
    counted = cut(_anchors(texts).where("n > 1"))
    many = counted.where(F.col("n") >= HOT)
    n_many = many.count()
    repeated = spark.sparkContext.broadcast(bloom(counted, counted.count()))
    hot = spark.sparkContext.broadcast(bloom(many, n_many) if n_many else None)
    sent = stored(_send(texts, repeated, hot))
    data = sent.where("key is null").select("grp", "stretch", "copies", "n", "data")
    runs = data.repartition("grp").sortWithinPartitions("grp", "stretch").mapInArrow(_sort_blocks, "stretch binary, runs array<int>")
    runs = cut(runs)
    # a run of windows w0..w1-1 at start s covers the bytes s+w0 .. s+w1-1+LENGTH
    at = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r, i: s + r + F.when(i % 2 == 1, LENGTH - 1).otherwise(0))))
    places = sent.where("key is not null").select("stretch", "key", "starts").join(runs, "stretch").select("key", at.alias("spans"))
    spans = places.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for flat in batch.column("spans").to_pylist():
            x = np.array(flat, np.int64).reshape(-1, 2)
            x = x[np.argsort(x[:, 0], kind="stable")]
            end = np.maximum.accumulate(x[:, 1])
            new = np.flatnonzero(np.r_[True, x[1:, 0] > end[:-1]])
            last = np.r_[new[1:] - 1, len(x) - 1]
            out.append(np.stack([x[new, 0], end[last]], 1).ravel().tolist())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "spans"])

    out = cut(map_arrow(spans, run, "key binary, spans array<int>"))
    _forget(sent)
    return out


EMPTY = hashlib.sha256(b"").hexdigest()


def kept_bytes(data: bytes, spans: list[int]) -> bytes:
    cuts = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    raw = text_or_empty().cast("binary")
    rows = cut(docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("sha")))
    long_rows = rows.where(F.col("n_bytes") >= LENGTH)
    copies = cut(long_rows.groupBy("sha").agg(F.min("doc_id").alias("one"), F.count("*").alias("rows")).where("rows > 1"))
    # one row of the copies goes on; rows are told by id and text, as one id may stand for several texts
    named = docs.withColumn("sha", F.unhex(F.sha2(raw, 256)))
    dropped = long_rows.join(copies, "sha").where("doc_id <> one").select(F.struct("doc_id", "sha").alias("row")).distinct()
    spans = removed_spans(without_ids(named.withColumn("row", F.struct("doc_id", "sha")), cut(dropped), "row"), spark)
    key = F.substring("sha", 1, 16)
    # only the texts that lose a part are moved to their spans, at any size; copies lose all
    parts = cut(spans.join(copies.select(key.alias("key")), "key", "left_anti"))
    keyed = named.where(F.octet_length(text_or_empty()) >= LENGTH).select("text", key.alias("key"))
    texts = only_ids(keyed, parts.select("key"), "key").join(parts, "key").select("text", "key", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, key, flat in zip(*(batch.column(c).to_pylist() for c in ("text", "key", "spans")), strict=True):
            data = (t or "").encode("utf-8", "replace")
            rows.append((key, sum(flat[1::2]) - sum(flat[::2]), len(flat) // 2, hashlib.sha256(kept_bytes(data, flat)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "n_removed", "n_spans", "kept"])

    changed = map_arrow(texts, run, "key binary, n_removed long, n_spans long, kept string")
    whole = copies.select("sha", F.lit(True).alias("whole"))
    out = rows.withColumn("key", key).join(whole, "sha", "left").join(changed, "key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
