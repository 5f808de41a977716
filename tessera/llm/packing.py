"""Packing documents into sequences of bounded length.

Documents are encoded, closed with an end id and, only if longer than a sequence, cut into pieces. The plan is made
on the histogram of piece lengths, which has at most `capacity` entries however many documents there are:

1. the configuration linear program (how often to use each *pattern*, a multiset of lengths that fits into one
   sequence, so that every length is covered as often as it occurs, with the fewest sequences) is solved
   by multiplicative weights; a knapsack dynamic program prices the best pattern for the weights, and of the same
   prices every length gets its own best pattern, of which those near the best are used, too. Prices give a dual
   bound; rounds go on until the demand is covered by a solution whose value is within GAP of the bound;
2. uses are rounded to whole numbers, and what is left uncovered is packed best fit, longest first, still on the
   histogram: sequences with equal contents are one entry with a count.

The n-th piece of a length then takes the n-th place for that length in the plan. Numbers within a length
come from counts per (length, salt), so a length that holds a third of all pieces is still numbered by many tasks.

Defined results: a null text is the empty text and encodes to the end id alone. Repeated rows are packed
each on their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END_ID = 1
#: The program is solved when its value is at most this share above the dual bound.
GAP = 0.01
#: Rounds of the second pass, at most, and the rate at which prices fall with coverage.
ROUNDS, STEP = 400, 0.1
#: A pattern is used in a round if its value is so near the best.
NEAR_BEST = 0.98
#: Share of the tokens that the first pass leaves to best fit, where few lengths with pieces left make rounds short.
REST = 0.1
#: Chunks that a worker keeps; when there are so many they are forgotten, which only costs time.
WORDS = 300_000
#: Pieces numbered by one task.
NUMBERED = 200_000


class _Known(dict):
    """Chunk to ids (little-endian unsigned 32-bit); a chunk that isn't there is encoded when it is asked for."""

    #: Chunks of these alone (printable ASCII without capitals, and letters that are normal forms in lower case) are split here: what the
    #: tokenizer's normaliser does leaves them as they are. Others go through the library whole.
    SIMPLE = re.compile("[\x21-\x40\x5b-\x7eß-öø-ÿ]+")
    #: The split of the tokenizer's file, for such chunks.
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str) -> None:
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # how the byte-level step writes each letter of SIMPLE
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = str.maketrans({chr(c): step.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))})

    def __missing__(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if plain and chunk.isalpha() and chunk.islower():
            ids = array("I", [t.id for t in self.tokenize(chunk)]).tobytes()
        elif self.SIMPLE.fullmatch(chunk) and "<|" not in chunk:
            parts = self.SPLIT.findall(chunk)
            if len(parts) > 1:
                ids = b"".join([self[x] for x in parts])
            else:
                ids = array("I", [t.id for t in self.tokenize(chunk if plain else chunk.translate(self.spelt))]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) < 64 and len(self) < WORDS:
            self[chunk] = ids
        return ids


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so what stands between
    spaces is encoded once and kept."""

    #: A line end is white space like a space.
    LINES = bytes.maketrans(b"\n", b" ")
    #: ASCII capitals may be lowered before the tokenizer does it, if no combining mark that could join one follows (those
    #: begin with the bytes CC and CD) and no special token is made by it.
    FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")

    def __init__(self, path: str) -> None:
        self.known = _Known(path)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        data = text.encode("utf-8", "replace")
        fold = b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data
        known = self.known
        if len(known) >= WORDS:
            known.clear()
            known[""] = b""
        return b"".join(map(known.__getitem__, data.translate(self.FOLD if fold else self.LINES).decode().split(" ")))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.encode, texts)


@lru_cache(2)
def word_encoder(path: str = DEFAULT_VOCABULARY) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = word_encoder(path)
        rows: list[list] = [[], [], [], [], []]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts), strict=True):
            ids += end
            for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[a : a + 4 * capacity]
                for col, v in zip(rows, (doc, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the greatest value and the length to take first (0: none, as for one less): unbounded knapsack."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    some = np.flatnonzero(value > 0)
    few = len(some) < capacity // 8
    worth, cuts = value[some], np.searchsorted(some, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        # value[l] + best[c - l] for l = 1..c, or for those that are worth anything
        n = cuts[c]
        if not n:
            continue
        of = worth[:n] + best[c - some[:n]] if few else value[1 : c + 1] + best[c - 1 :: -1]
        k = int(of.argmax())
        if of[k] > best[c - 1]:
            best[c], take[c] = of[k], some[k] if few else k + 1
        else:
            best[c] = best[c - 1]
    return best, take


def _taken(take: list[int], last: list[int], c: int) -> list[int]:
    """The lengths taken for capacity c; last[c]: the greatest capacity up to c at which one is taken."""
    out = []
    while c := last[c]:
        out.append(take[c])
        c -= take[c]
    return out


def _traceable(take: np.ndarray) -> tuple[list[int], list[int]]:
    return take.tolist(), np.maximum.accumulate(np.where(take > 0, np.arange(len(take)), 0)).tolist()


def price(value: np.ndarray, capacity: int) -> list[int]:
    """The pattern (lengths, longest first) of greatest value that fits. value[l] is that of length l."""
    return sorted(_taken(*_traceable(_priced(value, capacity)[1]), capacity), reverse=True)


@dataclass
class Program:
    """A fractional solution of the configuration program, and the value of the best dual solution found."""

    patterns: list[tuple[list[int], float]]
    value: float
    bound: float

    @property
    def gap(self) -> float:
        """How far the value may be above the optimum, as a share of it."""
        return self.value / self.bound - 1 if self.bound else 0.0


def configuration_lp(demand: dict[int, int], capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> Program:
    """How often to use each pattern so that every length is covered, with the fewest sequences, by multiplicative weights.

    Of any prices (value d * w of the demand, V of the best pattern), d * w / V bounds the program from below: prices over V are a dual
    solution. Prices start at size / capacity. In a first pass a length whose demand is met leaves the program; the last REST of
    the tokens is left to best fit, and the value is that of the rounded solution. If value and bound don't meet, a second pass lets demands be covered over and over, and a length's
    price falls exponentially with the times it was covered, until they do or its rounds end; the mean covers all once the
    least covered length is."""
    lengths = np.array(sorted(x for x, n in demand.items() if n), np.int64)
    if not len(lengths):
        return Program([], 0.0, 0.0)
    d = np.zeros(capacity + 1)
    d[lengths] = [demand[int(x)] for x in lengths]
    bound = 0.0

    def respond(weight: np.ndarray, room: np.ndarray) -> Iterator[tuple[Counter, float]]:
        """Patterns near the best at these prices, each length's own, and how often each is used; takes that from room."""
        nonlocal bound
        best, take = _priced(weight, capacity)
        bound = max(bound, float(d[lengths] @ np.maximum(weight[lengths], 0)) / best[capacity])
        own = lengths[weight[lengths] > 0]
        of = weight[own] + best[capacity - own]
        order = np.argsort(-of, kind="stable")
        tables = _traceable(take)
        for length in own[order[of[order] >= NEAR_BEST * of.max()]].tolist():
            if room[length] > 1e-9:
                times = Counter(_taken(*tables, capacity - length))
                times[length] += 1
                # as much of the pattern as the scarcest of its lengths allows
                use = min(room[x] / k for x, k in times.items())
                if use > 1e-9:
                    for x, k in times.items():
                        room[x] -= use * k
                    yield times, float(use)

    price_of = np.arange(capacity + 1) / capacity
    left, rest = d.copy(), REST * capacity * float(price_of @ d)
    uses: dict[tuple[int, ...], float] = {}

    def note(times: Counter, use: float) -> None:
        key = tuple(sorted(times.elements(), reverse=True))
        uses[key] = uses.get(key, 0.0) + use

    while capacity * float(price_of @ left) > rest:
        for times, use in respond(np.where(left > 1e-9, price_of * np.exp(-STEP * (1 - left / np.maximum(d, 1))), -1.0), left):
            note(times, use)
    met = [(list(p), x) for p, x in uses.items()]
    # a packing of all is a solution, too
    out = Program(met, float(sum(n for _, n in rounded(met, demand, capacity))), bound)

    covered = np.zeros(capacity + 1)
    uses = {}
    for _ in range(rounds):
        if out.gap <= gap:
            break
        room = d.copy()
        for times, use in respond(np.where(d > 0, price_of * np.exp(-STEP * (covered - covered[lengths].min())), -1.0), room):
            note(times, use)
        covered[lengths] += 1 - room[lengths] / d[lengths]
        out.bound, least, total = bound, covered[lengths].min(), sum(uses.values())
        if least > 0 and total / least < out.value:
            out = Program([(list(p), x / least) for p, x in uses.items()], total / least, bound)
    out.bound = bound
    return out


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Longest first into the fullest sequence with room, on counts: (pattern, times)."""
    open_at: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room -> (times, pattern)
    rooms: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(room: int, times: int, pattern: tuple[int, ...]) -> None:
        if room == 0:
            done.append((list(pattern), times))
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((times, pattern))

    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, full, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                break
            room = rooms[i]
            times, pattern = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(i)
            each = min(room // length, max(1, n // times))
            use = min(times, n // each)
            put(room - each * length, use, pattern + (length,) * each)
            if use < times:
                put(room, times - use, pattern)
            n -= use * each
    done += [(list(p), t) for room in rooms for t, p in open_at[room]]
    return done


def rounded(program: list[tuple[list[int], float]], demand: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with how many sequences use each; together they hold exactly the demand. Whole uses come first; then, if that
    takes fewer sequences, one more of the patterns with the largest fractions; what is left is packed best fit."""
    left = dict(demand)
    whole: dict[tuple[int, ...], int] = {}

    def use(pattern: list[int], n: int) -> None:
        times = Counter(pattern)
        n = min(n, *(left[x] // k for x, k in times.items()))
        if n > 0:
            whole[tuple(pattern)] = whole.get(tuple(pattern), 0) + n
            for x, k in times.items():
                left[x] -= n * k

    def filled() -> list[tuple[list[int], int]]:
        return [(list(p), n) for p, n in whole.items()] + best_fit(left, capacity)

    for pattern, x in sorted(program, key=lambda p: -p[1]):
        use(pattern, int(x + 1e-9))
    down = filled()
    for pattern, x in sorted(program, key=lambda p: int(p[1] + 1e-9) - p[1]):
        if x % 1 > 1e-9:
            use(pattern, 1)
    return min(filled(), down, key=lambda p: sum(n for _, n in p))


def plan(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP) -> list[tuple[list[int], int]]:
    """Patterns with how many sequences use each; together they hold exactly the demand."""
    demand = {x: n for x, n in demand.items() if n}
    packed = rounded(configuration_lp(demand, capacity, rounds, gap).patterns, demand, capacity)
    # rounding may lose a few sequences against best fit alone where hardly any pieces share a length
    return min(packed, best_fit(demand, capacity), key=lambda p: sum(n for _, n in p))


def lower_bound(demand: dict[int, int], capacity: int = CAPACITY) -> int:
    return -(-sum(x * n for x, n in demand.items()) // capacity)


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The n-th place of each length, as runs: key = length << 40 | first number, sequence, offset."""
    runs: list[tuple[int, int, int, int]] = []
    base = 0
    seen: dict[int, int] = {}
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            first = seen.get(length, 0)
            runs.append((length << 40 | first, base, offset, n))
            seen[length] = first + n
            offset += length
        base += n
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 4)
    return {"key": a[:, 0].copy(), "sequence": a[:, 1].copy(), "offset": a[:, 2].copy()}


def number(rows: DataFrame, salts: int) -> DataFrame:
    """rows with `nth`, counting the rows of each length from 0."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("uid")
    return rows.withColumn("k", F.row_number().over(within) - 1).join(counts, ["length", "salt"]).withColumn("nth", F.col("before") + F.col("k")).drop("salt", "k", "before")


def pack(docs: DataFrame, path: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()))
    # at most `capacity` rows come to the driver, whatever the input
    demand = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}
    table = places(plan(demand, capacity, rounds, gap))
    total = sum(demand.values())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        want = col("length").astype(np.int64) << 40 | col("nth").astype(np.int64)
        i = np.searchsorted(table["key"], want, side="right") - 1
        sequence = table["sequence"][i] + (want - table["key"][i])
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(table["offset"][i], pa.int64())], [*names, "sequence_id", "offset"])

    numbered = number(rows, max(16, -(-total // NUMBERED)))
    return map_arrow(numbered, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
