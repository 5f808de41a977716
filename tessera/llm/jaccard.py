"""Jaccard self-join of word n-gram sets with prefix trees.

A document's set holds its distinct word n-grams as 64-bit numbers. Two documents link if
100 * |intersection| >= similarity * |union|. No link between different texts is lost:

1. Documents with the same set are one class, named by a 128-bit digest of the set.
2. The global order of n-grams is by frequency over all documents, then by number. Frequencies are counted in two shuffles
   without a broadcast: a task deals the n-grams of many documents out to parts of the number line, as sorted arrays; a part counts
   and answers which of them occur twice or more. An n-gram that is frequent within a task is sent once, with its count. Only
   shared n-grams can be in an intersection, so sets go on without those that occur once.
3. Of linked sets, the rarest n-gram that both hold is among the size - need + 1 rarest of each, the *prefix*. Sets whose prefix
   holds no shared n-gram are done. The others are candidates; each n-gram of a prefix joins its sets to the first of them (equal ones of
   a task are joined before the shuffle), and the components of these edges meet.
4. A component is a block, or several if it is large (then every two blocks meet, each in a task of its own). A task stores one block's
   sets, in the global order from the frequent end, in a prefix tree and sends all sets of the other through it: sets share the
   overlap of a common path, and a subtree is left as soon as the lengths that remain can't give the overlap needed.
   Links are exact counts; links that span are sent on, the others are only counted.
5. The components of the links, with the classes, give component_id.

Defined results: null and empty texts and those of white space have an empty set and are linked with nothing. A text of
fewer words than n has one n-gram, all of its words. Each row is a document of its own, also where rows share a doc_id: rows of one id
with different sets are linked only if their sets are. component_id is the smallest doc_id of the rows that can be reached; a row
without a doc_id gets that, too, or null if there is none. Ties and repeated rows are equal sets. An empty table gives no rows.

docs must give the same rows in the same order if read again (a table or a checkpoint does), as tasks may be run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_arrow

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))
#: N-grams that a task deals out at once, and documents at most (their numbers are sent in 16 bits).
FLUSH, FLUSH_DOCS = 1_500_000, 60_000
#: An n-gram of so many documents of a flush is sent once with its count.
FREQUENT = 32
ONCE = 0xFFFF
#: N-grams of a part of the number line; parts are at most 2^16, so that a flush has many for each.
PART, MOST_PART_BITS = 400_000, 16
#: Bits of an n-gram's number within its part.
WITHIN = 40
#: Documents and set elements in two blocks that meet.
BLOCK_DOCS, BLOCK_ELEMENTS = 1_000, 2_000_000
#: Cells of the membership table of a task.
CELLS = 48_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def word_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted set of n-gram numbers of each text."""
    words: list[bytes] = []
    ends = []
    for t in texts:
        if t:
            words += t.encode("utf-8", "replace").translate(LOWER).split()
        ends.append(len(words))
    if not words:
        return [np.empty(0, np.uint64)] * len(texts)
    array = np.empty(len(words), object)
    array[:] = words
    h = pd.util.hash_array(array, categorize=False)

    def grams(of: np.ndarray, k: int) -> np.ndarray:
        m = len(of) - k + 1
        acc = of[:m] + np.uint64(k * int(_C) % 2**64)
        for j in range(1, k):
            acc = mix(acc) + of[j : j + m]
        return mix(acc)

    # windows over all words at once; those across texts are left out below
    every = grams(h, n) if len(h) >= n else np.empty(0, np.uint64)
    out, begin = [], 0
    for end in ends:
        k = end - begin
        if k == 0:
            out.append(np.empty(0, np.uint64))
        elif k < n:
            out.append(grams(h[begin:end], k))
        else:
            out.append(np.unique(every[begin : end - n + 1]))
        begin = end
    return out


def need(a, b, similarity: int):
    """Least intersection of linked sets of these sizes."""
    return -(-similarity * (a + b) // (100 + similarity))


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def set_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and digest of the set (null if empty), one row per row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = word_sets(batch.column("text").to_pylist(), n)
        digest = [set_digest(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n_shingles", "digest"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_shingles long, digest binary")


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers, all first bytes before all second ones: the high ones of sorted numbers compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


#: One row per flush and part: its n-grams (planes of WITHIN bits), their documents (16 bits each, ONCE for a frequent one)
#: and the counts of the frequent ones. One row more per flush: its set digests and sizes, and the documents of its frequent n-grams.
DEALT = "part int, flush long, grams binary, docs binary, times binary, nodes binary, sizes binary"


def deal(docs: DataFrame, n: int, bits: int) -> DataFrame:
    shift = np.uint64(64 - WITHIN - bits)
    low = np.uint64((1 << WITHIN) - 1)

    def flush(number: int, nodes: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple]:
        size = np.array([len(s) for s in sets], np.int64)
        gram = np.concatenate(sets) >> shift
        o = np.argsort(gram, kind="stable")
        gram, doc = gram[o], np.repeat(np.arange(len(sets)), size)[o].astype(np.uint16)
        first = _runs(gram)
        count = np.diff(np.r_[first, len(gram)])
        often = count >= FREQUENT
        of_often = np.repeat(often, count)
        yield number % (1 << bits), number, planes(gram[first[often]], 8), doc[of_often].tobytes(), count[often].astype("<u4").tobytes(), b"".join(nodes), size.astype("<u4").tobytes()
        sent = ~of_often
        sent[first[often]] = True
        doc[first[often]] = ONCE
        gram, doc, times = gram[sent], doc[sent], count[often].astype("<u4")
        frequent = np.r_[0, np.cumsum(doc == ONCE)]
        cuts = np.searchsorted(gram, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(WITHIN))
        for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a < b:
                yield part, number, planes(gram[a:b] & low, WITHIN // 8), doc[a:b].tobytes(), times[frequent[a] : frequent[b]].tobytes(), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[bytes, np.ndarray] = {}
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(flush(number, list(held), list(held.values())))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            for k in range(0, len(rows), 256):
                cols = zip(*rows[k : k + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "flush", "grams", "docs", "times", "nodes", "sizes"])

        for batch in batches:
            for s in word_sets(batch.column("text").to_pylist(), n):
                if len(s) and (node := set_digest(s)) not in held:
                    held[node] = s
                    total += len(s)
                if total >= FLUSH or len(held) >= FLUSH_DOCS:
                    yield from out()
                    held, total, number = {}, 0, number + 1
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, DEALT)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows that agree in the first column, from rows sorted by it."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


#: Answers: the n-grams of a flush that are shared, with their documents and frequencies; the flush's own row goes along.
SHARED = "flush long, part int, grams binary, docs binary, often binary, times binary, nodes binary, sizes binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
    names = ["flush", "part", "grams", "docs", "often", "times", "nodes", "sizes"]
    for rows in _groups(batches, ("part", "flush", "grams", "docs", "times", "nodes", "sizes")):
        own = [r for r in rows if r[5] is None]
        out = [(r[1], r[0], r[2], r[3], None, r[4], r[5], r[6]) for r in rows if r[5] is not None]
        if own:
            gram = np.concatenate([unplanes(r[2], WITHIN // 8) for r in own])
            doc = np.concatenate([np.frombuffer(r[3], np.uint16) for r in own])
            weight = np.ones(len(gram), np.int64)
            weight[doc == ONCE] = np.concatenate([np.frombuffer(r[4], "<u4") for r in own])
            o = np.argsort(gram, kind="stable")
            first = _runs(gram[o])
            often = np.empty(len(gram), np.int64)
            often[o] = np.repeat(np.add.reduceat(weight[o], first), np.diff(np.r_[first, len(gram)]))
            cuts = np.cumsum([0, *(len(r[3]) // 2 for r in own)])
            for r, a, b in zip(own, cuts[:-1], cuts[1:], strict=True):
                keep = a + np.flatnonzero(often[a:b] > 1)
                if len(keep):
                    out.append((r[1], r[0], planes(gram[keep], WITHIN // 8), doc[keep].tobytes(), planes(often[keep], 5), None, None, None))
        for k in range(0, len(out), 256):
            cols = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


#: A prefix n-gram with a set that has it (hub: the two sets were joined within the flush); or (sig null) a candidate's size and elements.
CANDIDATES = "sig long, node binary, hub binary, m long, elements binary"


def _candidates(similarity: int):
    def of_flush(rows: list[tuple]) -> pa.RecordBatch | None:
        (own,) = [r for r in rows if r[6] is not None]
        rows = [r for r in rows if r[6] is None]
        if not rows:
            return None
        nodes = [own[6][k : k + 16] for k in range(0, len(own[6]), 16)]
        size = np.frombuffer(own[7], "<u4").astype(np.int64)
        gram = np.concatenate([unplanes(r[2], WITHIN // 8) | np.uint64(r[1] << WITHIN) for r in rows])
        doc = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows]).astype(np.int64)
        often = np.concatenate([unplanes(r[4], 5) for r in rows])
        # frequent n-grams: their documents are in the flush's own row
        known = unplanes(own[2], 8)
        times = np.frombuffer(own[5], "<u4").astype(np.int64)
        once = doc == ONCE
        order = np.argsort(gram[once])
        back = np.searchsorted(gram[once][order], known)
        doc = np.r_[doc[~once], np.frombuffer(own[3], np.uint16).astype(np.int64)]
        often_of_known = often[once][order][back] if len(known) else np.empty(0, np.uint64)
        often = np.r_[often[~once], np.repeat(often_of_known, times)]
        gram = np.r_[gram[~once], np.repeat(known, times)]
        # the global order: the most frequent first; the number of an element holds its place in it
        level = np.uint64(255) - np.minimum(8 * np.log2(often), 255).astype(np.uint64)
        key = level << np.uint64(56) | gram
        shared = np.bincount(doc, minlength=len(nodes))
        wanted = shared + 1 - -(-similarity * size // 100)
        mine = wanted[doc] > 0
        key, doc = key[mine], doc[mine]
        o = np.lexsort((key, doc))
        key, doc = key[o], doc[o]
        first = _runs(doc)
        if not len(first):
            return None
        last = np.r_[first[1:], len(doc)]
        which = doc[first]
        elements = [key[a:b].astype("<u8").tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        # the prefix is at the rare end
        prefix = np.arange(len(key)) >= np.repeat(last - wanted[which], last - first)
        sig, of = key[prefix], doc[prefix]
        o = np.argsort(sig, kind="stable")
        sig, of = sig[o], of[o]
        start = _runs(sig)
        hub = np.repeat(of[start], np.diff(np.r_[start, len(sig)]))
        pairs = np.unique(np.stack([of, hub], 1)[of != hub], axis=0)
        key_of = mix(mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64))
        sigs = [*sig[start].view(np.int64).tolist(), *key_of.view(np.int64).tolist(), *[None] * len(which)]
        named = [nodes[i] for i in [*of[start].tolist(), *pairs[:, 0].tolist(), *which.tolist()]]
        hubs = [*[None] * len(start), *(nodes[i] for i in pairs[:, 1].tolist()), *[None] * len(which)]
        none = [None] * (len(start) + len(pairs))
        return pa.RecordBatch.from_arrays(
            [pa.array(sigs, pa.int64()), pa.array(named, pa.binary()), pa.array(hubs, pa.binary()), pa.array([*none, *size[which].tolist()], pa.int64()), pa.array([*none, *elements], pa.binary())],
            ["sig", "node", "hub", "m", "elements"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("flush", "part", "grams", "docs", "often", "times", "nodes", "sizes")):
            out = of_flush(rows)
            if out is not None:
                yield out

    return run


def _join_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from rows sorted by sig: each set to the first of its n-gram. Holds one batch."""
    last = first = None
    for batch in batches:
        found = set()
        for sig, node, hub in zip(*(batch.column(c).to_pylist() for c in ("sig", "node", "hub")), strict=True):
            if hub is not None:
                found.add((node, hub))
            elif sig != last:
                last, first = sig, node
            elif node != first:
                found.add((node, first))
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


class PrefixTree:
    """Rising lists of numbers 0..; equal beginnings are stored once. sizes: of the whole sets, of which the lists are parts."""

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray) -> None:
        self.order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">u4").tobytes())
        self.lists = [lists[i] for i in self.order]
        self.length = np.array([len(s) for s in self.lists], np.int64)
        self.size = sizes[self.order]
        self.shared = np.zeros(len(lists) + 1, np.int64)
        for k in range(1, len(lists)):
            a, b = self.lists[k - 1], self.lists[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = differ[0] if len(differ) else m

    def join(self, member: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each stored set (by its number before sorting) the probes linked with it.

        member[e, p]: whether probe p holds e; lengths and sizes: of the probes' lists and whole sets."""
        todo = [(0, len(self.lists), 0, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while todo:
            lo, hi, depth, probes, overlap = todo.pop()
            inner = self.shared[lo + 1 : hi]
            end = int(inner.min()) if len(inner) else int(self.length[lo])
            if end > depth:
                path = self.lists[lo][depth:end]
                overlap = overlap + (member[path] if len(probes) == member.shape[1] else member[np.ix_(path, probes)]).sum(axis=0)
            # what remains of the longest list below, or of the probe, can't give the overlap needed by the smallest set below
            reach = overlap + np.minimum(self.length[lo:hi].max() - end, lengths[probes] - overlap)
            ok = reach >= need(self.size[lo:hi].min(), sizes[probes], similarity)
            if not ok.all():
                probes, overlap = probes[ok], overlap[ok]
            if not len(probes):
                continue
            k = lo
            while k < hi and self.length[k] == end:  # lists that end at this node come first
                hit = overlap >= need(self.size[k], sizes[probes], similarity)
                if hit.any():
                    yield self.order[k], probes[hit]
                k += 1
            if k < hi:
                cuts = [k, *(k + 1 + np.flatnonzero(self.shared[k + 1 : hi] == end)), hi]
                todo += [(int(x), int(y), end, probes, overlap) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


Row = tuple[bytes, int, int, np.ndarray]


def join_blocks(stored: list[Row], probes: list[Row] | None, similarity: int) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Rows (node, copies, size, elements). Links that span the components found, and each node's number of linked rows.
    probes None: the stored sets among themselves."""
    own = probes is None
    probes = stored if own else probes
    values, inverse = np.unique(np.concatenate([r[3] for r in stored]), return_inverse=True)
    cuts = np.cumsum([len(r[3]) for r in stored])[:-1]
    tree = PrefixTree(np.split(inverse, cuts), np.array([r[2] for r in stored], np.int64))
    parent = {r[0]: r[0] for r in [*stored, *probes]}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[bytes, bytes]] = []
    degree: dict[bytes, int] = {}
    step = max(1, CELLS // max(1, len(values)))
    for begin in range(0, len(probes), step):
        part = probes[begin : begin + step]
        copies = np.array([r[1] for r in part], np.int64)
        member = np.zeros((len(values), len(part)), bool)
        for p, r in enumerate(part):
            at = np.searchsorted(values, r[3])
            at[at == len(values)] = 0
            member[at[values[at] == r[3]], p] = True
        lengths, sizes = (np.array(x, np.int64) for x in ([len(r[3]) for r in part], [r[2] for r in part]))
        of_probe = np.zeros(len(part), np.int64)
        for k, hits in tree.join(member, lengths, sizes, similarity):
            x, more = stored[k][:2]
            if own:
                hits = hits[hits != k - begin]
            degree[x] = degree.get(x, 0) + int(copies[hits].sum())
            of_probe[hits] += more
            for p in hits.tolist():
                a, b = root(x), root(part[p][0])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, part[p][0]))
        if not own:
            for p in np.flatnonzero(of_probe).tolist():
                degree[part[p][0]] = degree.get(part[p][0], 0) + int(of_probe[p])
    return links, degree


def _join_rows(similarity: int):
    def out(rows: list[tuple]) -> pa.RecordBatch | None:
        (i, j) = rows[0][0][1:]
        # equal sets of several flushes are neighbours
        rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][1] != r[1]]
        sets = [(r[1], r[2], r[3], np.frombuffer(r[4], "<u8")) for r in rows]
        if i == j:
            links, degree = join_blocks(sets, None, similarity) if len(sets) > 1 else ([], {})
        else:
            here = [s for s, r in zip(sets, rows, strict=True) if r[5] == i]
            there = [s for s, r in zip(sets, rows, strict=True) if r[5] != i]
            links, degree = join_blocks(here, there, similarity) if here and there else ([], {})
        a = [x for x, _ in links] + list(degree)
        b = [y for _, y in links] + [None] * len(degree)
        n = [0] * len(links) + list(degree.values())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            meeting = zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True)
            for row in zip(meeting, *(batch.column(c).to_pylist() for c in ("node", "copies", "m", "elements", "block")), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield out(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield out(rows)

    return run


def links(docs: DataFrame, classes: DataFrame, n: int, similarity: int) -> DataFrame:
    """classes: digest, m, copies. Rows (a, b, n): links that span the components (n is 0), and (b null) the linked rows of a class."""
    total = classes.agg(F.sum("m")).first()[0] or 0
    bits = min(MOST_PART_BITS, max(4, (total // PART).bit_length()))
    dealt = deal(docs, n, bits).repartition(F.col("part")).sortWithinPartitions("part", "flush")
    shared = dealt.mapInArrow(_count, SHARED).repartition(F.col("flush")).sortWithinPartitions("flush")
    found = cut(shared.mapInArrow(_candidates(similarity), CANDIDATES))
    prefixes = found.where("sig is not null").select("sig", "node", "hub").repartition("sig").sortWithinPartitions("sig", "node")
    near = cut(components(prefixes.mapInArrow(_join_prefixes, "a binary, b binary")).join(classes.withColumnRenamed("digest", "node"), "node"))
    size = near.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("m").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") * 2 / BLOCK_DOCS), F.ceil(F.col("total") * 2 / BLOCK_ELEMENTS)).cast("int")
    blocks = F.when((F.col("docs") <= BLOCK_DOCS) & (F.col("total") <= BLOCK_ELEMENTS), F.lit(1)).otherwise(blocks)
    placed = near.join(size.select("comp", blocks.alias("blocks")), "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = (
        found.where("sig is null")
        .select("node", "elements")
        .join(placed, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "m", "elements", "block")
    )
    return cut(met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").mapInArrow(_join_rows(similarity), "a binary, b binary, n long"))


def jaccard_join(docs: DataFrame, n: int = 3, similarity: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: rows linked with this one, equal sets included."""
    rows = cut(set_classes(docs, n))
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("m"), F.count("*").alias("copies")))
    found = links(docs, classes.select("digest", "m", "copies"), n, similarity)
    comp = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("digest"), "comp")
    named = classes.join(comp, "digest")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    component = named.select("digest", "comp").join(least, "comp").drop("comp")
    degree = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("degree"))
    known = classes.join(component, "digest", "left").join(degree, "digest", "left").select(
        "digest", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")
    )
    return rows.join(known, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_copies(docs: DataFrame, row: str, n: int = 5, similarity: int = 80) -> DataFrame:
    """The numbers (column row: unique, not null, the same on every read) of the rows that don't stay: all but the one of
    the smallest id in each component. Null ids sort last; rows of one id tie, and the smallest number stays. Rows are
    joined by number, so rows that share an id, or have none, are compared like any others."""
    near = jaccard_join(docs.select(F.col(row).alias("doc_id"), "text"), n, similarity)
    comp = near.select(F.col("doc_id").alias("_number"), F.col("component_id").alias("_comp"))
    own = docs.select(F.col(row).alias("_number"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"))
    members = cut(comp.join(own, "_number"))
    stays = members.groupBy("_comp").agg(F.count("*").alias("n"), F.min(F.struct("no_id", "id", "_number")).alias("best")).where("n > 1")
    return members.join(stays, "_comp").where("_number <> best._number").select(F.col("_number").alias(row))
