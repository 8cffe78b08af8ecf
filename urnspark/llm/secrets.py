"""Secret scans through nested encodings (operator 3)."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import read, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,8}\})+")
#: In form bodies a blank is a plus; only runs without a blank that have an escape too are taken for such.
_RUN = re.compile(r"\S+")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs of base64 that are wrapped: every line but the last has 16 characters at least.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]+={0,2}")
_GAP = re.compile(r"\s+")
#: Bytes as text with escapes: of URLs, and of literals.
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!$&-;=?-Z_a-z~])+")
_RAW_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv\\'\"]|[\x20-\x5b\x5d-\x7e])+")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|.")
_RAW_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\.|.")
_LETTER = dict(zip("abfnrtv", b"\a\b\f\n\r\t\v"))
#: Where a gzip, bzip2, xz or zlib stream may begin.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
#: Characters that the layers of one document may come to; a document beyond it says so.
MOST = 1 << 26


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of each match, leftmost and non-overlapping per kind, less those that are too short."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text and where its characters came from in the text below: runs that are copied, and runs that are not.

    at: where each run begins; src, end: its span below; plain: whether it is a copy.
    """

    def __init__(self, below: Layer | None = None):
        self.below, self.parts, self.size = below, [], 0
        self.at: list[int] = []
        self.runs: list[tuple[int, int, bool]] = []

    def add(self, text: str, src: int, end: int, plain: bool) -> None:
        if text:
            self.parts.append(text)
            self.at.append(self.size)
            self.runs.append((src, end, plain))
            self.size += len(text)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that holds what the layer's span was decoded from."""
        if self.below is None:
            return start, end
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        s = self.runs[a][0] + (start - self.at[a]) if self.runs[a][2] else self.runs[a][0]
        e = self.runs[b][0] + (end - self.at[b]) if self.runs[b][2] else self.runs[b][1]
        return self.below.span(s, e)


def _unescape(run: str) -> list[tuple[str, int]]:
    """Characters of a run of escapes and the length of each one's escape; a surrogate pair is one character."""
    out, i = [], 0
    while i < len(run):
        if run[i + 1] == "x":
            out.append((chr(int(run[i + 2 : i + 4], 16)), 4))
            i += 4
            continue
        if run[i + 1] == "U" or run[i + 2] == "{":
            n = 10 if run[i + 1] == "U" else run.index("}", i) + 1 - i
            c = int(run[i : i + n].strip("\\uU{}"), 16)
            out.append((chr(c) if c < 0xD800 or 0xE000 <= c < 0x110000 else "�", n))
            i += n
            continue
        c, n = int(run[i + 2 : i + 6], 16), 6
        if 0xD800 <= c < 0xDC00 and run[i + 6 : i + 8] == "\\u" and 0xDC00 <= (d := int(run[i + 8 : i + 12], 16)) < 0xE000:
            c, n = 0x10000 + ((c - 0xD800) << 10) + d - 0xDC00, 12
        out.append((chr(c) if not 0xD800 <= c < 0xE000 else "�", n))
        i += n
    return out


def _percent(run: str) -> list[tuple[str, int]]:
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    raw = text.encode("utf-8")
    if len(raw) * 3 != len(run):  # not UTF-8: byte for byte
        return [(chr(b), 3) for b in bytes.fromhex(run.replace("%", ""))]
    return [(c, 3 * len(c.encode("utf-8"))) for c in text]


def _form(text: str, layer: Layer) -> Layer | None:
    """The text with its form-encoded runs decoded."""
    out, last = Layer(layer), 0
    for m in _RUN.finditer(text):
        run = m.group()
        if "+" in run and _PERCENT.search(run):
            for e in _FORM.finditer(run):
                src = m.start() + e.start()
                out.add(text[last:src], last, src, True)
                for c, n in [(" ", 1)] if e.group() == "+" else _percent(e.group()):
                    out.add(c, src, src + n, False)
                    src += n
                last = src
    if not last:
        return None
    out.add(text[last:], last, len(text), True)
    return out


def _rewritten(text: str, layer: Layer, pattern: re.Pattern, chars) -> Layer | None:
    out, last = Layer(layer), 0
    for m in pattern.finditer(text):
        out.add(text[last : m.start()], last, m.start(), True)
        src = m.start()
        for c, n in chars(m.group()):
            out.add(c, src, src + n, False)
            src += n
        last = m.end()
    if not last:
        return None
    out.add(text[last:], last, len(text), True)
    return out


def _opener(raw: bytes):
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return zlib.decompressobj(wbits=47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\x00" else None


def _unpack(raw: bytes | memoryview, room: int) -> tuple[bytes, int, bool]:
    """The members that raw begins with, decompressed; the bytes they take; whether there was more than room."""
    out, at, raw = [], 0, memoryview(raw)
    while (d := _opener(bytes(raw[at : at + 8]))) is not None:
        # Ever larger pieces, so that what a member leaves unused is never copied at length.
        end, step, got, part = at, 1 << 10, 0, []
        try:
            while end < len(raw) and not d.eof and got <= room:
                data = d.decompress(raw[end : end + step], room + 1 - got)
                end, step, got = min(len(raw), end + step), min(2 * step, 1 << 20), got + len(data)
                part.append(data)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        out.append(b"".join(part)[:room])
        if got > room:
            return b"".join(out), len(raw), True
        room -= got
        at = end - len(d.unused_data)
        if not d.eof:
            break
        while at < len(raw) and raw[at] == 0:  # padding between members
            at += 1
    return b"".join(out), at, False


def _payloads(raw: bytes, room: int) -> tuple[list[tuple[bytes, int, int]], bool]:
    """raw and all that is compressed in it, however deep, with the bytes of raw that each comes from; whether room ran out."""
    out, seen, cut = [(raw, 0, len(raw))], {hashlib.sha256(raw).digest()}, False
    for now, start, end in out:  # grows
        at = 0
        for m in [0, *(m.start() for m in _MAGIC.finditer(now))]:
            if m < at:
                continue
            data, used, more = _unpack(memoryview(now)[m:], room)
            cut |= more
            if data:
                at = m + used
                if (key := hashlib.sha256(data).digest()) not in seen:
                    seen.add(key)
                    room -= len(data)
                    out.append((data, m, at) if now is raw else (data, start, end))
    return out, cut


def _telling(text: str) -> bool:
    """Whether a text is readable, or holds a find or an encoded run; what isn't can't lead to a find."""
    if len(text) < 6:
        return False
    if all(c.isprintable() or c in "\t\n\r" for c in text):
        return True
    return bool(_BASE64.search(text) or _PERCENT.search(text) or _ESCAPE.search(text) or base_spans(text))


def _texts(raw: bytes, room: int, packed: bool = False) -> tuple[list[tuple[str, int, int]], bool]:
    """What raw and the compressed data in it (packed: the latter alone) say, bytes that aren't UTF-8 replaced."""
    found, cut = _payloads(raw, room)
    return [(t, s, e) for x, s, e in found[packed:] if _telling(t := x.decode("utf-8", "replace"))], cut


def _from_base64(run: str, room: int) -> tuple[list[tuple[str, int]], bool]:
    """Texts of a run and the character each starts at; a prefix may shift the run, so all four alignments are tried."""
    body, out, cut = run.rstrip("=").replace("-", "+").replace("_", "/"), [], False
    for k in range(4):
        part = body[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        texts, more = _texts(base64.b64decode(part + "=" * (-len(part) % 4)), room)
        out += [(t, k + s // 3 * 4) for t, s, _ in texts]
        cut |= more
    return out, cut


def _from_bytes(run: str, byte: re.Pattern, room: int) -> tuple[list[tuple[str, int, int]], bool]:
    """Texts of compressed data that is written with escapes, and the characters each comes from."""
    raw, at = bytearray(), []
    for m in byte.finditer(run):
        at.append(m.start())
        c = m.group()
        raw.append(int(m[1], 16) if m[1] else ord(c) if len(c) == 1 else _LETTER.get(c[1], ord(c[1])))
    at.append(len(run))
    out, cut = [], False
    for data in {bytes(raw), bytes(raw).replace(b"+", b" ") if byte is _URL_BYTE else bytes(raw)}:
        texts, more = _texts(data, room, packed=True)
        out += [(t, at[s], at[e]) for t, s, e in texts]
        cut |= more
    return out, cut


def _skipped(run: str, n: int) -> int:
    """Where the character after n that aren't blank is."""
    return [i for i, c in enumerate(run) if not c.isspace()][n]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """Base spans, all spans, layers unwrapped, and whether MOST stopped it; spans are (start, kind, end), sorted.

    A worklist starts at the text. Of each layer, URL escapes (also with pluses for blanks), Unicode escapes, base64 runs (wrapped ones joined, at all
    four alignments) and all compressed members in them or in escaped bytes make further layers, which are scanned and decoded in turn until none is new. A layer whose text was
    seen before in this document isn't entered again, so cycles end. Finds map to the span that they were decoded from.
    """
    base = sorted(base_spans(text))
    found, seen, work, total, full = set(base), {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}, [(text, Layer())], 0, False
    n = 0
    while work:
        now, layer = work.pop()
        made = []
        if "%" in now:
            made.append(_rewritten(now, layer, _PERCENT, _percent))
            if "+" in now:
                made.append(_form(now, layer))
        if "\\" in now:
            made.append(_rewritten(now, layer, _ESCAPE, _unescape))
        texts = []
        for m in [*_BASE64.finditer(now), *_WRAPPED.finditer(now)]:
            some, cut = _from_base64(run := _GAP.sub("", m.group()), MOST - total)
            full |= cut
            texts += [(t, m.start() + (s if len(run) == m.end() - m.start() else _skipped(m.group(), s)), m.end()) for t, s in some]
        for mark, runs, byte in (("%", _URL_BYTES, _URL_BYTE), ("\\x", _RAW_BYTES, _RAW_BYTE)):
            for m in runs.finditer(now) if mark in now else ():
                if mark in m.group():
                    some, cut = _from_bytes(m.group(), byte, MOST - total)
                    full |= cut
                    texts += [(t, m.start() + s, m.start() + e) for t, s, e in some]
        for t, s, e in texts:
            one = Layer(layer)
            one.add(t, s, e, False)
            made.append(one)
        for one in filter(None, made):
            t = "".join(one.parts)
            key = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
            if key in seen or not t:
                continue
            if total + len(t) > MOST:
                full = True
                continue
            seen.add(key)
            n, total = n + 1, total + len(t)
            for s, k, e in base_spans(t):
                a, b = one.span(s, e)
                found.add((a, k, b))
            one.parts = []
            work.append((t, one))
    return base, sorted(found), n, full


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for d, t in zip(x["id"], x["text"], strict=True):
            base, spans, layers, full = scan(t)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            out.append((d, *n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), layers, full))
        yield pd.DataFrame(out, columns=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "cut_short"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: id, base counts by kind, base_sha256, spans, n_layers, cut_short.

    Spans are kind:start:end in code points of the whole text, by start, then kind. Null and empty texts have none.
    Rows that repeat an id are scanned each.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(_scan, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, cut_short boolean")
    return out.withColumnRenamed("id", id_col)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE_SQL = {}
