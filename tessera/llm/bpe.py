"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece of text the BPE encoding ends in exactly one token. That *last token* is found from the
tokens that are suffixes of the prefix: exactly one of them is compatible with the last token of the prefix
before it (two tokens are compatible if BPE, run on their joined bytes, would give these two again). The table of last
tokens gives the encoding by walking back. It also allows exact appends (go on from the last state) and
exact re-encoding near an edit: the table is recomputed from the edit on until, for as many prefixes as the longest
token has bytes, it agrees with the old one.

Encoding a text splits it by the public pattern and encodes each piece on its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, map_arrow

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Tables of beginnings that an encoder keeps.
PREFIX_ENTRIES = 150_000


class PrefixBpe:
    """Encoder and decoder of one rank file's vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.prefixes: dict[bytes, tuple[tuple[int, ...], bytes]] = {}
        #: tokens that BPE itself can make; others stand only for a whole piece
        self.reachable: dict[bytes, int] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.left[r] = self.right[r] = r
                self.reachable[b] = r
                continue
            for i in range(1, len(b)):
                x, y = self.reachable.get(b[:i]), self.reachable.get(b[i:])
                if x is not None and y is not None and x < r and y < r and self.compatible(x, y):
                    self.left[r], self.right[r] = x, y
                    self.pairs[x, y] = r
                    self.reachable[b] = r
                    break
        self.memo.clear()
        # tokens by their bytes from last to first, for finding all suffixes of a prefix
        self.root: dict = {}
        for b, r in self.reachable.items():
            node = self.root
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[-1] = r

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of both tokens gives just these two.

        Undoes the merges on both sides of the border, latest first; if at any time the two tokens at the
        border could have merged earlier than one of the merges undone, BPE would have merged them."""
        left, right, pairs = self.left, self.right, self.pairs
        bound = 1 << 60  # the merge undone last on either side
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < bound:
                return False
            a_whole, b_whole = right[a] == a, left[b] == b
            if a_whole and b_whole:
                return True
            # of equal merges the left one is done first, so the right one is undone first
            if not a_whole and (b_whole or a > b):
                bound, a = a, right[a]
            else:
                bound, b = b + 1, left[b]

    def extend(self, piece: bytes, last: list[int], size: list[int], begin: int, stop_at: tuple[list[int], int] | None = None) -> int:
        """Fills last and size for the prefixes of piece that end after begin; returns where it stopped.

        stop_at: (old last tokens, shift): stop once `longest` prefixes in a row agree with the old ones."""
        memo, root, token = self.memo, self.root, self.token
        agree = 0
        for end in range(begin, len(piece)):
            node, i = root, end
            found = None
            while i >= 0 and (node := node.get(piece[i])) is not None:
                r = node.get(-1)
                if r is not None:
                    if i == 0:
                        found = r  # covers the whole prefix; BPE makes it, so it is the one
                    else:
                        p = last[i - 1]
                        ok = memo.get(key := p << 20 | r)
                        if ok is None:
                            if len(memo) >= CACHE_ENTRIES:
                                memo.clear()
                            ok = memo[key] = self.compatible(p, r)
                        if ok:
                            found = r
                            break
                i -= 1
            if found is None:
                raise ValueError("the vocabulary lacks a byte")
            if len(last) > end:
                last[end], size[end] = found, len(token[found])
            else:
                last.append(found)
                size.append(len(token[found]))
            if stop_at:
                j = end - stop_at[1]
                agree = agree + 1 if 0 <= j < len(stop_at[0]) and stop_at[0][j] == found else 0
                if agree >= self.longest:
                    return end + 1
        return len(piece)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # pieces that begin alike share the table of that beginning
        known = self.prefixes
        n, k = len(piece), 0
        last: list[int] = []
        size: list[int] = []
        if n <= 24:
            for k in range(n - 2, 3, -1):
                if (state := known.get(piece[:k])) is not None:
                    last, size = list(state[0]), list(state[1])
                    break
            else:
                k = 0
        self.extend(piece, last, size, k)
        if 6 <= n <= 24:
            cut = n - 2 if n < 10 else n * 2 // 3
            if cut > k:
                if len(known) >= PREFIX_ENTRIES:
                    known.clear()
                known[piece[:cut]] = (tuple(last[:cut]), bytes(size[:cut]))
        return walk_back(last, size)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def walk_back(last: list[int], size: list[int]) -> list[int]:
    out, end = [], len(last)
    while end:
        out.append(last[end - 1])
        end -= size[end - 1]
    out.reverse()
    return out


class PrefixTable:
    """The last tokens of one piece, kept for appends and edits. (No pattern: one piece.)"""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b"") -> None:
        self.bpe, self.piece = bpe, b""
        self.last: list[int] = []
        self.size: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        begin, self.piece = len(self.piece), self.piece + more
        self.bpe.extend(self.piece, self.last, self.size, begin)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; returns how many prefixes were computed anew."""
        piece = self.piece[:start] + new + self.piece[end:]
        shift = len(new) - (end - start)
        old_last, old_size = self.last, self.size
        last, size = old_last[:start], old_size[:start]
        # agreement counts only beyond the edit
        at = self.bpe.extend(piece[: start + len(new)], last, size, start)
        at = self.bpe.extend(piece, last, size, at, (_Masked(old_last, end), shift))
        self.last, self.size = last[:at] + old_last[at - shift :], size[:at] + old_size[at - shift :]
        self.piece = piece
        return at - start

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.piece)
        return [whole] if whole is not None else walk_back(self.last, self.size)


class _Masked:
    """Old last tokens, of which those before `begin` agree with nothing."""

    def __init__(self, last: list[int], begin: int) -> None:
        self.last, self.begin = last, begin

    def __len__(self) -> int:
        return len(self.last)

    def __getitem__(self, i: int) -> int:
        return self.last[i] if i >= self.begin else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder:
    """Encodes whole texts: cuts them before single spaces, where the pattern always cuts, and keeps what it found."""

    #: A space followed by something else than white space starts a piece, whatever stands before it.
    CUT = re.compile(r" (?=\S)")
    ODD = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str) -> None:
        self.bpe = PrefixBpe(read_ranks(path))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        #: what a single space and this text encode to
        self.chunks: dict[str, bytes] = {}
        size = max(self.bpe.token) + 1
        self.table = [self.bpe.token.get(i, b"") for i in range(size)]

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(key) < 64:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.chunks.clear()
            self.chunks[key] = ids
        return ids

    def chunk(self, text: str) -> bytes:
        out, known = [], self.chunks
        for piece in self.pattern.findall(text):
            spaced = piece[0] == " "
            ids = known.get(piece[1:]) if spaced else None
            if ids is None:
                ids = np.array(self.bpe.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
                if spaced:
                    self._keep(piece[1:], ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.ODD.search(text):
            parts = self.CUT.split(text)
        else:
            parts = text.split(" ")
        known = self.chunks
        out = [self.chunk(parts[0])]
        try:
            out += map(known.__getitem__, parts[1:])
            return b"".join(out)
        except KeyError:
            del out[1:]
        for p in parts[1:]:
            ids = known.get(p)
            out.append(self._keep(p, self.chunk(" " + p)) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str = DEFAULT_RANKS) -> TextEncoder:
    return TextEncoder(path)


def bpe_digests(docs: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text. A null or empty text has no tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        n, a, b = [], [], []
        for t in batch.column("text").to_pylist():
            ids = enc.encode(t or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id and ids, an array of int."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype("<i4") for t in batch.column("text").to_pylist()]
        offsets = pa.array([0, *accumulate(map(len, ids))], pa.int32())
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids array<int>")
