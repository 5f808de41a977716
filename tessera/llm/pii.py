"""Personal data with offset-preserving deobfuscation.

The base kinds are found in the text as it stands. A transducer then rewrites the text: homoglyphs
to their ASCII look-alikes, full-width forms to ASCII, spelled digits ("zero seven nine") to digits, and
disguised separators ("name [at] host (dot) org", "name at host dot org") to '@' and '.', each wherever it stands. It keeps
for every character it writes the stretch of the source it stands for. Whether something is an identifier is decided by the
patterns on the rewritten text; only an address that hangs on a bare word "at" or "dot" must also end in what can be a
top-level domain, and isn't part of a web address. Identifiers detected in the rewritten text are mapped back
to source stretches. A mapped span is added unless one base span of its kind covers it whole; base spans that are only a
fragment of it stay beside it, and masking takes the union.

All scans are linear: an e-mail is looked for around each '@', digits in maximal runs.

Defined results: null text is the empty text, without spans. Positions are code points, end exclusive. Every row is judged on its own,
so repeated rows get equal results. Spans that start together are in the order of their ends. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic, Greek and other letters drawn like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρνıℓ@﹫․。．‐‑‒–−",
        "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXoapvil@@...-----",
        strict=True,
    )
)
# Spelled digits in the languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: Words that follow "dot" or a full stop in prose, and are no top-level domains.
PROSE = frozenset("and or but the then than that this these those there with from for which who was were are will when while where because after before dash und oder aber der die das les des una los las".split())

_FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_ONE_TO_ONE = HOMOGLYPHS | _FULL_WIDTH
_GLYPH = re.compile("[" + re.escape("".join(c for c in _ONE_TO_ONE if c != "@")) + "]")
_TABLE = str.maketrans({k: v for k, v in _ONE_TO_ONE.items() if k != v})
#: For quick tests on bytes: every digit to 0.
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_DIGIT_WORD = re.compile("(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?!\w)")
_GAP = re.compile(r"[\x20,-]{1,2}")
_PLUS = re.compile(r"plus\x20+")
_BRACKET_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|@|arroba|chez|ät)\x20?[\])}>]\x20?")
_BRACKET_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|punto|punkt|point|\.)\x20?[\])}>]\x20?")
_TRIGGER = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.|arroba|chez|ät|punto|punkt|point)\x20?[\])}>]")
_TOP_LEVEL = re.compile(r"[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def identifiers(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, as in KINDS."""
    if "@" not in text and b"0" not in text.encode("utf-8", "surrogatepass").translate(_ZEROS):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and _luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


class Rewritten:
    """A rewritten text with its edits: (start, end here, start, end in the source, whether it was a bare word)."""

    def __init__(self, text: str, edits: list[tuple[int, int, int, int, bool]]) -> None:
        self.text, self.edits, self.starts = text, edits, [e[0] for e in edits]

    def stretch(self, i: int) -> tuple[int, int]:
        """The source stretch of the i-th character."""
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        _, end, a, b, _ = self.edits[k]
        return (a, b) if i < end else (b + i - end, b + i - end + 1)

    def bare(self, s: int, e: int) -> bool:
        """Whether a bare "at" or "dot" was rewritten in s..e."""
        k = bisect_right(self.starts, s - 1)
        while k < len(self.edits) and self.starts[k] < e:
            if self.edits[k][4]:
                return True
            k += 1
        return False


def _lower(text: str) -> str:
    """In lower case, as long as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bare_words(low: str, word: str, char: str) -> list[tuple[int, int, str, bool]]:
    """Edits for a separator's name between white space, where what stands on both sides can belong to it."""
    out, i = [], low.find(f" {word} ")
    while i >= 0:
        a, b = i, i + len(word) + 2
        while a and low[a - 1] == " ":
            a -= 1
        while b < len(low) and low[b] == " ":
            b += 1
        if a and b < len(low) and (low[a - 1] in LOCAL or _in_word(low[a - 1])) and (low[b] == "-" or _in_word(low[b])):
            out.append((a, b, char, True))
        i = low.find(f" {word} ", b - 1)
    return out


def _digit_words(low: str) -> list[tuple[int, int, str, bool]]:
    out: list[tuple[int, int, str, bool]] = []
    last = -1  # end of the digit before
    for m in _DIGIT_WORD.finditer(low):
        a, b = m.span()
        if a and _in_word(low[a - 1]):
            continue
        if 0 < a - last <= 2 and last >= 0 and _GAP.fullmatch(low, last, a):
            out.append((last, a, "", False))
        else:
            # next to numerals, what separates them becomes one space, which the patterns allow
            k = a
            while k and a - k < 2 and low[k - 1] in " ,-":
                k -= 1
            if k < a and k and "0" <= low[k - 1] <= "9" and low[k:a] not in (" ", "-"):
                out.append((k, a, " ", False))
        out.append((a, b, DIGITS[m[0]], False))
        last = b
        if (g := _GAP.match(low, b)) and "0" <= low[g.end() : g.end() + 1] <= "9" and g[0] not in (" ", "-"):
            out.append((b, g.end(), " ", False))
    return out


def normalise(text: str) -> Rewritten | None:
    """The rewritten text; None if nothing was rewritten."""
    glyphs = not text.isascii() and bool(_GLYPH.search(text))
    flat = text.translate(_TABLE) if glyphs else text  # as long as the source
    low = _lower(flat)
    edits = _digit_words(low)
    starts = {e[0] for e in edits}
    if "plus " in low:
        for m in _PLUS.finditer(low):
            a, b = m.span()
            if not (a and _in_word(low[a - 1])) and (b in starts or "0" <= low[b : b + 1] <= "9"):
                edits.append((a, b, "+", False))
    if any(c in low for c in "[({<") and _TRIGGER.search(low):
        for rx, c in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
            edits += [(*m.span(), c, False) for m in rx.finditer(low)]
    edits += _bare_words(low, "at", "@") + _bare_words(low, "dot", ".")
    if not edits and not glyphs:
        return None
    edits.sort()
    out: list[str] = []
    done: list[tuple[int, int, int, int, bool]] = []
    pos = n = 0
    for a, b, c, bare in edits:
        if a < pos:
            continue
        out += (flat[pos:a], c)
        n += a - pos
        done.append((n, n + len(c), a, b, bare))
        n += len(c)
        pos = b
    out.append(flat[pos:])
    return Rewritten("".join(out), done)


def _address_end(got: Rewritten, s: int, at: int, e: int) -> int:
    """Where the address s..e ends; 0 if it is none."""
    if not got.bare(s, e):
        return e
    text = got.text
    while True:
        dot = text.rfind(".", at, e)
        if dot < 0:
            return 0
        label = text[dot + 1 : e]
        if _TOP_LEVEL.fullmatch(label) and label.lower() not in PROSE:
            break
        e = dot
    web = got.bare(at, at + 1) and (text[at + 1 : at + 5].lower() == "www." or text[e : e + 1] == "/")
    return 0 if web else e


def addresses(got: Rewritten) -> list[tuple[int, int]]:
    """E-mails of a rewritten text. Unlike in emails(), a bare "at" may be prose beside another '@' ("write at
    j.d@host.org", "j at host.org at noon"): of two that overlap, one whose '@' isn't bare wins, and two bare ones both count."""
    text = got.text
    out: list[tuple[int, int, bool]] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in LOCAL:
            start -= 1
        bare = got.bare(at, at + 1)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            if out and start < out[-1][1]:
                if out[-1][2] and not bare and _address_end(got, start, at, m.end()):
                    out.pop()
                elif not out[-1][2]:
                    start = at if bare else out[-1][1]
            if start < at and (end := _address_end(got, start, at, m.end())):
                out.append((start, end, bare))
        at = text.find("@", at + 1)
    return [(s, e) for s, e, _ in out]


def find(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base spans, added spans), by kind."""
    base = identifiers(text)
    added: list[list[tuple[int, int]]] = [[], [], [], []]
    if got := normalise(text):
        starts = [[x for x, _ in own] for own in base]
        for k, spans in enumerate(identifiers(got.text)):
            for s, e in spans if k else addresses(got) if "@" in got.text else ():
                a, b = got.stretch(s)[0], got.stretch(e - 1)[1]
                # base spans of a kind don't overlap, so only the last that starts by then can cover it
                i = bisect_right(starts[k], a) - 1
                if i < 0 or b > base[k][i][1]:
                    added[k].append((a, b))
    return base, added


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, own in enumerate(spans) for s, e in own)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        shas, spans, extra = [], [], []
        for t in batch.column("text").to_pylist():
            base, added = find(t or "")
            for k in range(4):
                counts[k].append(len(base[k]))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined([sorted(base[k] + added[k]) for k in range(4)]))
            extra.append(sum(map(len, added)))
        cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str) -> str:
    """The text with each span replaced by its kind, as in <email>; overlapping spans become one, named by the first."""
    base, added = find(text)
    spans = sorted((s, e, k) for k in range(4) for s, e in base[k] + added[k])
    out, pos, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < e:
            i += 1
            e = max(e, spans[i][1])
        out += [text[pos:s], f"<{KINDS[k]}>"]
        pos = e
        i += 1
    return "".join(out) + text[pos:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars, if there, counted anew. A null text stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index("text")
        new = pa.array([None if t is None else mask(t) for t in batch.column(i).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([new if j == i else batch.column(j) for j in range(batch.num_columns)], schema=batch.schema)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length(text_or_empty()).cast("long")) if "n_chars" in docs.columns else out
