"""Secret scanning with a worklist that unwraps nested encodings.

A text is scanned for the base kinds. Then every encoded stretch in it (percent escapes, Unicode and
character escapes, base64, and zlib, gzip or raw deflate data inside base64) is decoded into a new layer, whose every
character knows the stretch of the source it came from. Bytes that aren't UTF-8 are read as Latin-1, a character each; layers in which nothing
can be found or decoded are left out. Layers go through a worklist until nothing new comes, however deep they are
nested; a layer whose text was seen before at its place isn't visited again (cycle detection). Each decoding step makes a
layer shorter than the stretch it came from, except for decompression. That is streamed, all members of it: a
decompressed text is read in segments, cut where nothing that is looked for can cross, and the worklist is
a stack of unfinished readings, so that one segment of each depth is held at a time. Spans found in a layer are mapped back to the source and
added unless one span of the same kind already covers them whole; base spans always stay, also those that are a fragment of an added one.
What comes out of compressed data has the whole stretch of that data as its place.

Defined results: null text is the empty text and has no spans. Positions are code points, end exclusive. Every row is judged on its own,
so repeated rows get equal results. Spans that start together are in the order of their kinds, then of their ends. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
#: Bytes decompressed at once, and characters from which a segment is cut off.
CHUNK, SEGMENT = 1 << 18, 1 << 20
#: Where a segment may end: a line end that folded base64 can't cross, and a space that no assignment can.
LINE_END = re.compile(r"(?<![A-Za-z0-9+/=])(?:[A-Za-z0-9+/]{0,39}={0,2})\r?\n|[.,!?)]\x20")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 text may be folded into lines, the last of any length; then what decodes together is joined before decoding.
FOLDED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:\r?\n[A-Za-z0-9+/]{40,}+)*(?:\r?\n[A-Za-z0-9+/]+)?={0,2}")


#: For quick tests: every keyword holds one of these; hex digits, and base64 characters, to 0.
_STEMS = ("passw", "secret", "token", "api")
_HEX_BYTES = bytes(48 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_BASE64_BYTES = bytes(48 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in that order."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] if any(k in low for k in _STEMS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of hex digits is matched whole, so short runs can be skipped by the pattern itself
    if b"0" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    out.sort()
    return out


class Same:
    """A list that holds one value at every place."""

    def __init__(self, value: int) -> None:
        self.value = value

    def __getitem__(self, i: int) -> int:
        return self.value


class Layer:
    """A decoded text; at[i]..to[i] is the source stretch of its i-th character."""

    def __init__(self, text: str, at: list[int] | Same, to: list[int] | Same) -> None:
        self.text, self.at, self.to = text, at, to


def _stretch(layer: Layer | None, a: int, b: int) -> tuple[int, int]:
    return (a, b) if layer is None else (layer.at[a], layer.to[b - 1])


def _unescape(layer: Layer | None, text: str, a: int, b: int, rx: re.Pattern[str], value) -> Layer | None:
    out: list[str] = []
    at: list[int] = []
    to: list[int] = []

    def plain(i: int, j: int) -> None:
        for k in range(i, j):
            s, e = _stretch(layer, k, k + 1)
            out.append(text[k])
            at.append(s)
            to.append(e)

    pos, did = a, False
    for m in rx.finditer(text, a, b):
        got = value(m)
        if got is None:
            continue
        did = True
        plain(pos, m.start())
        for ch, i, j in got:
            s, e = _stretch(layer, i, j)
            out.append(ch)
            at.append(s)
            to.append(e)
        pos = m.end()
    if not did:
        return None
    plain(pos, b)
    return Layer("".join(out), at, to)


def _percent(m: re.Match[str]):
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        chars = raw.decode()
    except UnicodeDecodeError:
        chars = raw.decode("latin-1")
        return [(c, m.start() + 3 * i, m.start() + 3 * i + 3) for i, c in enumerate(chars)]
    out, k = [], m.start()
    for c in chars:
        n = 3 * len(c.encode())
        out.append((c, k, k + n))
        k += n
    return out


def _escape(m: re.Match[str]):
    out = []
    for x in ONE_ESCAPE.finditer(m[0]):
        code = int(x[4]) if x[4] else int(next(g for g in (x[1], x[2], x[3], x[5]) if g), 16)
        if code > 0x10FFFF:
            return None
        ch = chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd"
        out.append((ch, m.start() + x.start(), m.start() + x.end()))
    return out


#: What the bytes of a layer must hold so that something can be found or decoded in it.
_WORTH = re.compile(rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{16}|%[0-9a-f]{2}|\\[ux]|&#|[a-z0-9+/_-]{16}", re.I)


def _bits(data: bytes) -> int:
    """zlib's window bits for data that starts like a gzip or zlib member; else 0."""
    if data[:2] == b"\x1f\x8b":
        return 31
    # the header of RFC 1950: method 8, a window of at most 32 kB, no preset dictionary, a multiple of 31
    return 15 if len(data) > 1 and data[0] & 0x8F == 8 and not data[1] & 32 and int.from_bytes(data[:2]) % 31 == 0 else 0


def _inflate_raw(data: bytes) -> Iterator[bytes]:
    """What deflate data without a header holds, in chunks. Raises zlib.error unless it ends with the data."""
    d, rest = zlib.decompressobj(-15), data
    while not d.eof:
        out = d.decompress(rest, CHUNK)
        rest = d.unconsumed_tail
        if out:
            yield out
        elif not rest:
            raise zlib.error("cut off")
    if d.unused_data:
        raise zlib.error("ends before the data")


def _inflate(chunks: Iterable[bytes], left: list[int] | None = None) -> Iterator[bytes]:
    """What all members hold that follow one another, in chunks. Raises zlib.error if the first is broken; what follows the
    last is ignored, and its length appended to left."""
    d, first, rest = None, True, b""
    total = end = 0  # bytes so far, and where the last whole member ended
    for chunk in chunks:
        rest += chunk
        total += len(chunk)
        full = False
        while rest or full:
            if d is None:
                after = rest if first else rest.lstrip(b"\0")  # members may be padded
                if len(after) < 2:
                    break
                if not (bits := _bits(after)):
                    if left is not None:
                        left.append(total - end)
                    return
                d, rest = zlib.decompressobj(bits), after
            try:
                out = d.decompress(rest, CHUNK)
            except zlib.error:
                if first:
                    raise
                if left is not None:
                    left.append(total - end)
                return
            if out:
                yield out
            if d.eof:
                d, first, rest, full = None, False, d.unused_data, False
                end = total - len(rest)
            else:
                full, rest = len(out) == CHUNK, d.unconsumed_tail


def _check(chunks: Iterable[bytes]) -> tuple[bytes, bytes, str] | None:
    """Of a stream: its first bytes, its digest, and its encoding; None if it is empty or broken."""
    h, head = hashlib.blake2b(digest_size=16), b""
    dec = codecs.getincrementaldecoder("utf-8")()
    encoding = "utf-8"
    try:
        for chunk in chunks:
            h.update(chunk)
            if len(head) < 2:
                head = (head + chunk)[:2]
            if encoding == "utf-8":
                try:
                    dec.decode(chunk)
                except UnicodeDecodeError:
                    encoding = "latin-1"
    except zlib.error:
        return None
    if encoding == "utf-8" and dec.getstate()[0]:
        encoding = "latin-1"
    return (head, h.digest(), encoding) if head else None


def _segments(chunks: Iterable[bytes], encoding: str) -> Iterator[str]:
    """A stream of text in segments."""
    dec = codecs.getincrementaldecoder(encoding)()
    parts: list[str] = []
    size, enough = 0, SEGMENT
    for chunk in chunks:
        parts.append(dec.decode(chunk))
        size += len(parts[-1])
        if size >= enough:
            text = "".join(parts)
            end = 0
            for m in LINE_END.finditer(text):
                end = m.end()
            if end:
                yield text[:end]
            parts = [text[end:]]
            size = len(text) - end
            # without a place to cut, look again when there is twice as much
            enough = max(SEGMENT, 2 * size)
    if text := "".join(parts):
        yield text


def _decompressed(chunks: Callable[[], Iterable[bytes]], s: int, e: int) -> Iterator[Layer]:
    """Layers of a decompressed stream, also if that is compressed again; the source stretch is s..e, as there are no finer positions."""
    seen: set[bytes] = set()
    while (got := _check(chunks())) and got[1] not in seen:
        head, digest, encoding = got
        seen.add(digest)
        yield from (Layer(x, Same(s), Same(e)) for x in _segments(chunks(), encoding))
        if not _bits(head):
            return
        chunks = lambda below=chunks: _inflate(below())


def _n_printable(s: str) -> int:
    return len(s) if s.isprintable() else sum(c.isprintable() or c in "\t\r\n" for c in s)


def _base64(layer: Layer | None, text: str, a: int, b: int, members: bool = True) -> Iterator[Layer]:
    """Layers of the base64 text a..b, which may be folded into lines; without those of zlib or gzip members if it is known where they end."""
    raw = text[a:b]
    places: list[int] | range = range(a, b)
    if "\n" in raw or "\r" in raw:
        places = [i for i in places if text[i] not in "\r\n"]
        raw = re.sub(r"[\r\n]", "", raw)
    raw = raw.rstrip("=").replace("-", "+").replace("_", "/")
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    try:
        data = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    if members and _bits(data):
        yield from _decompressed(lambda: _inflate([data]), *_stretch(layer, a, b))
    try:
        got: str | None = data.decode()
    except UnicodeDecodeError:
        got = None
        yield from _decompressed(lambda: _inflate_raw(data), *_stretch(layer, a, b))
    if not _WORTH.search(data):
        return
    at, to, k = [], [], 0
    for c in data.decode("latin-1") if got is None else got:
        n = 1 if got is None else len(c.encode())
        # a byte is in two characters of base64, a character of text in those of all its bytes
        x, y = _stretch(layer, places[k * 4 // 3], places[-(-(k + n) * 4 // 3) - 1] + 1)
        at.append(x)
        to.append(y)
        k += n
    yield Layer(data.decode("latin-1") if got is None else got, at, to)


def _lines_decoded(text: str, lines: list[tuple[int, int]], i: int) -> Iterator[tuple[int, bytes]]:
    """Number of each line from i on, and what it adds to the data of the joined lines."""
    carry = ""
    for k in range(i, len(lines)):
        raw = carry + text[lines[k][0] : lines[k][1]].rstrip("=")
        cut = len(raw) // 4 * 4
        carry = raw[cut:]
        if k == len(lines) - 1 and len(carry) > 1:
            raw, cut = raw + "=" * (4 - len(carry)), cut + 4
        yield k, binascii.a2b_base64(raw[:cut])


def _last_line(text: str, lines: list[tuple[int, int]], i: int) -> int:
    """The last of the lines that decode to one text, or to compressed data, together with line i; i if none does."""
    if i == len(lines) - 1:
        return i
    if _bits(binascii.a2b_base64(text[lines[i][0] : lines[i][0] + 4])):
        left: list[int] = []
        n = [0]

        def chunks() -> Iterator[bytes]:
            for _, data in _lines_decoded(text, lines, i):
                n[0] += len(data)
                yield data

        try:
            for _ in _inflate(chunks(), left):
                pass
        except zlib.error:
            pass
        else:
            used, k = -(-(n[0] - sum(left)) * 4 // 3), i
            while k + 1 < len(lines) and used > lines[k][1] - lines[k][0]:
                used -= lines[k][1] - lines[k][0]
                k += 1
            return k
    dec = codecs.getincrementaldecoder("utf-8")()
    good = total = 0
    best = i
    for k, data in _lines_decoded(text, lines, i):
        try:
            got = dec.decode(data)
        except UnicodeDecodeError:
            break
        total += len(got)
        good += _n_printable(got)
        if good >= 0.95 * total and not dec.getstate()[0]:
            best = k
        elif good < 0.5 * total:  # such as long runs of zeros in binary data
            break
    return best


def _unfolded(layer: Layer | None, text: str, a: int, b: int, done: list[tuple[int, int]]) -> Iterator[Layer]:
    """Layers of the longest runs of lines in a..b that decode together; their stretches are appended to done. Lines of one
    length that don't decode to text are tried as one block of bytes, and stay to be decoded alone."""
    lines = [m.span() for m in re.compile(r"[^\r\n]+").finditer(text, a, b)]
    i = block = 0
    while i < len(lines):
        j = _last_line(text, lines, i)
        if j > i:
            yield from _base64(layer, text, lines[i][0], lines[j][1])
            done.append((lines[i][0], lines[j][1]))
        elif i >= block:
            n, block = lines[i][1] - lines[i][0], i + 1
            while n % 4 == 0 and block < len(lines) and lines[block][1] - lines[block][0] == n:
                block += 1
            if block > i + 1:
                yield from _base64(layer, text, lines[i][0], lines[block - 1][1], False)
            if n % 4 == 0 and block < len(lines) and lines[block][1] - lines[block][0] < n:
                # the remainder of the block, or a word that follows it
                block += 1
                yield from _base64(layer, text, lines[i][0], lines[block - 1][1], False)
        i = j + 1


def _decoded(layer: Layer | None, text: str) -> Iterator[Layer]:
    for here, rx, value in (("%" in text, PERCENT, _percent), ("\\" in text or "&#" in text, ESCAPE, _escape)):
        # whole lines, so that a secret may be escaped in part
        for m in re.finditer(r"[^\n]+", text) if here else ():
            if rx.search(text, m.start(), m.end()) and (got := _unescape(layer, text, m.start(), m.end(), rx, value)):
                yield got
    folded: list[tuple[int, int]] = []
    for m in FOLDED.finditer(text) if "\n" in text else ():
        yield from _unfolded(layer, text, m.start(), m.end(), folded)
    for m in BASE64.finditer(text) if b"0" * 16 in text.encode("utf-8", "surrogatepass").translate(_BASE64_BYTES) else ():
        k = bisect_left(folded, (m.start() + 1,))
        if not (k and m.start() < folded[k - 1][1]):
            yield from _base64(layer, text, m.start(), m.end())


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that decoding adds), each (start, kind number, end)."""
    base = base_spans(text)
    seen: set[bytes] = set()
    extra: set[tuple[int, int, int]] = set()
    work = [_decoded(None, text)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(f"{layer.at[0]}:{layer.to[-1]}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        extra.update((layer.at[s], k, layer.to[e - 1]) for s, k, e in base_spans(layer.text))
        work.append(_decoded(layer, layer.text))
    if not extra:
        return base, []
    own = [[(s, e) for s, k, e in base if k == kind] for kind in range(3)]
    reach = [0, 0, 0]  # how far the added spans of a kind go
    added = []
    for s, k, e in sorted(extra, key=lambda x: (x[0], x[1], -x[2])):
        # base spans of a kind don't overlap, so only the last that starts by then can cover it
        i = bisect_left(own[k], (s + 1,))
        if e > reach[k] and not (i and own[k][i - 1][1] >= e):
            reach[k] = e
            added.append((s, k, e))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], []]
        shas, spans, n_added = [], [], []
        for t in batch.column("text").to_pylist():
            base, added = scan(t or "")
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(base + added)))
            n_added.append(len(added))
        cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(n_added, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
