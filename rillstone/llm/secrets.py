"""Secret scans with a recursive decoding worklist.

The text is the first layer. Each layer is scanned, and its encoded stretches (URL escapes,
Unicode and hex escapes, character references, base64 and base64url, also wrapped over lines or glued to other characters, and gzip or zlib data inside
base64, however deep) are decoded into new layers, alone and among their surroundings, until none is left. A layer whose text and places were seen before is not decoded
again, so cycles end; a text that stands twice is reported at both places. A layer keeps segments that map its characters to those of the
whole text, made once from those of the layer around it, so a deep layer costs no more than a shallow one: the work on a text is linear in the sum of its
layers. A find in a deep layer is reported at its span of the text.

Content that inflates to more than WINDOW bytes is streamed and worked in windows of that size that overlap by OVERLAP characters, so memory has
a bound and nothing is left out but what a single find of more than OVERLAP characters or an encoded stretch across windows would add.

Defined results: null and empty texts have no finds; very long texts are scanned whole; base64 runs are tried from LEAST_BLOB characters on, the
length of the shortest assignment; data that is not text is no layer, but text among other bytes is; ties, one span found in several layers, are one find;
rows that repeat are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.entities import html5
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: The kinds in order, their patterns and the least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Runs of characters of URLs are taken first, escapes looked for inside: linear in the text, however long a run is.
URL = re.compile(r"[A-Za-z0-9_.~+/:=?&@,;!*'()$%-]+")
#: An escaped byte; percent signs that were escaped eight times and more (%2525...) are unwrapped in one step.
URL_BYTE = re.compile(r"%((?:25){8,}|)([0-9A-Fa-f]{2})")
URL_ESCAPE = re.compile(r"((?:%(?:(?:25){8,}|)[0-9A-Fa-f]{2})+)")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&([A-Za-z][A-Za-z0-9]{1,31});")
LEAST_BLOB = 16
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_BLOB},}}={{0,2}}")
#: Base64 over several lines, of 60 characters or more as encoders wrap it, all alike but the last.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{60,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}")
#: Where compressed data may start among other bytes, and what text among them looks like.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
LEGIBLE = re.compile(r"[\t\n\r\x20-\x7e]{12,}")
#: Bytes that are inflated at once, and characters by which windows of larger content overlap.
WINDOW, OVERLAP = 1 << 24, 1 << 16
Span = tuple[int, int]
Find = tuple[str, int, int]
#: Start in the layer, span in the layer around it, and whether characters stand for themselves there.
Segment = tuple[int, int, int, bool]


def scan_layer(text: str) -> list[Find]:
    """Base finds of one layer, leftmost and non-overlapping per kind."""
    out: list[Find] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(finds) -> list[Find]:
    return sorted(finds, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


class Splice:
    """A text put together from plain and decoded parts of another."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.segments: list[Segment] = []
        self.size = 0

    def plain(self, text: str, start: int, end: int) -> None:
        if start < end:
            self._add(text[start:end], start, end, True)

    def decoded(self, inner: str, start: int, end: int) -> None:
        if inner:
            self._add(inner, start, end, False)

    def _add(self, part: str, start: int, end: int, itself: bool) -> None:
        self.segments.append((self.size, start, end, itself))
        self.parts.append(part)
        self.size += len(part)

    def splice(self, other: Splice) -> None:
        self.segments += [(self.size + at, start, end, itself) for at, start, end, itself in other.segments]
        self.parts += other.parts
        self.size += other.size

    def layer(self) -> tuple[str, list[Segment]]:
        return "".join(self.parts), self.segments


@dataclass
class Layer:
    text: str
    segments: list[Segment]
    """Spans are those of the whole text."""

    def outermost(self, start: int, end: int) -> Span:
        """The span of the whole text from which the characters from start to end come."""
        at, low, _, itself = self.segments[bisect.bisect_right(self.segments, start, key=itemgetter(0)) - 1]
        at_last, low_last, high, itself_last = self.segments[bisect.bisect_right(self.segments, end - 1, key=itemgetter(0)) - 1]
        return low + start - at if itself else low, low_last + end - at_last if itself_last else high

    def inside(self, segments: list[Segment]) -> list[Segment]:
        """The segments of a layer inside this one, which map to this one, as segments that map to the whole text."""
        out: list[Segment] = []
        for at, start, end, itself in segments:
            if not itself:
                out.append((at, *self.outermost(start, end), False))
                continue
            k = bisect.bisect_right(self.segments, start, key=itemgetter(0)) - 1
            while k < len(self.segments) and self.segments[k][0] < end:  # plain characters lie in one segment of this layer or several
                own, low, high, plain = self.segments[k]
                first, last = max(start, own), min(end, self.segments[k + 1][0] if k + 1 < len(self.segments) else end)
                out.append((at + first - start, low + first - own, low + last - own, True) if plain else (at + first - start, low, high, False))
                k += 1
        return out


def decoded_bytes(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0)


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of gzip or zlib data; what stands before a later error or a cut is content, too."""
    d, some = zlib.decompressobj(zlib.MAX_WBITS | 32), False
    try:
        for chunk in chunks:
            while chunk and not d.eof:
                if out := d.decompress(chunk, 1 << 20):
                    some = True
                    yield out
                chunk = d.unconsumed_tail
    except zlib.error:
        if not some:
            raise


def _opens(first: bytes) -> bool:
    """Whether a stream that starts so is compressed."""
    try:
        return is_packed(first) and bool(zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(first, 1 << 16))
    except zlib.error:
        return False


def unpacked(data: bytes) -> Iterator[bytes]:
    """The chunks of what gzip or zlib data hold in the end: compressed data in compressed data are inflated, too."""
    seen: set[bytes] = set()
    while _opens(data):
        digest = hashlib.sha256(data).digest()
        if digest in seen:  # data that inflate to themselves
            return
        seen.add(digest)
        stream, size, head = inflate([data]), 0, []
        for chunk in stream:
            head.append(chunk)
            size += len(chunk)
            if size > WINDOW:
                break
        if size > WINDOW:
            stream = itertools.chain(head, stream)
            while _opens(first := next(stream, b"")) and hashlib.sha256(first).digest() not in seen:
                seen.add(hashlib.sha256(first).digest())
                stream = inflate(itertools.chain([first], stream))
            yield first
            yield from stream
            return
        data = b"".join(head)
    yield data


def windows(chunks: Iterable[bytes]) -> Iterator[str]:
    """The chunks as text, in windows that overlap; bytes that aren't UTF-8 become U+FFFD."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for chunk in chunks:
        held += decoder.decode(chunk)
        if len(held) > WINDOW:
            yield held
            held = held[-OVERLAP:]
    yield held + decoder.decode(b"", True)


def blob_texts(blob: str) -> Iterator[str]:
    """The texts that a base64 or base64url blob holds, uncompressed.

    If the blob as it stands is text or compressed data, that is all. Else it may be glued to other characters:
    all four ways to group its characters are tried, and text or compressed data among other bytes counts.
    """
    body = blob.rstrip("=").replace("-", "+").replace("_", "/")
    ways = [_base64(body[k:]) for k in range(4)]
    if len(body) % 4 != 1:
        if _opens(ways[0]):
            found = [text for text in windows(unpacked(ways[0])) if LEGIBLE.search(text)]
            if found:
                yield from found
                return
        elif (text := decoded_bytes(ways[0])) is not None:
            if len(text) >= 4:
                yield text
            return
    for k, data in enumerate(ways):
        text = data.decode("utf-8", "replace")
        if LEGIBLE.search(text):
            yield text
        for m in PACKED.finditer(data):
            if (k or m.start()) and _opens(data[m.start() : m.start() + 4096]):
                yield from (text for text in windows(unpacked(data[m.start() :])) if LEGIBLE.search(text))


def _base64(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _among(text: str, found: list[tuple[int, int, Splice]]) -> tuple[str, list[Segment]]:
    """The text with decoded stretches in their places."""
    out, at = Splice(), 0
    for start, end, stretch in found:
        out.plain(text, at, start)
        out.splice(stretch)
        at = end
    out.plain(text, at, len(text))
    return out.layer()


def _url_stretches(text: str) -> list[tuple[int, int, Splice]]:
    found = []
    for m in URL.finditer(text):
        parts = URL_ESCAPE.split(m[0])  # escapes have the odd places
        if len(parts) == 1:
            continue
        stretch, at, any_decoded = Splice(), m.start(), False
        for k, part in enumerate(parts):
            units = URL_BYTE.findall(part) if k % 2 else []
            plain = decoded_bytes(bytes.fromhex("".join(b for _, b in units))) if units else None
            if plain is None:  # bytes that aren't UTF-8 stay as they stand
                stretch.plain(text, at, at + len(part))
                at += len(part)
                continue
            any_decoded, byte = True, 0
            for c in plain:
                size, n = len(c.encode("utf-8")), 0
                for again, _ in units[byte : byte + size]:
                    n += 3 + len(again)
                stretch.decoded(c, at, at + n)
                at, byte = at + n, byte + size
        if any_decoded:
            found.append((m.start(), m.end(), stretch))
    return found


def _unicode_stretches(text: str) -> list[tuple[int, int, Splice]]:
    found = []
    for m in UNICODE.finditer(text):
        if m[7]:
            if (named := html5.get(f"{m[7]};")) is not None:
                stretch = Splice()
                stretch.decoded(named, *m.span())
                found.append((*m.span(), stretch))
            continue
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            stretch = Splice()
            stretch.decoded(chr(code), *m.span())
            found.append((*m.span(), stretch))
    return found


def unwrapped(text: str) -> Iterator[tuple[str, list[Segment]]]:
    """The layers directly inside a text, with segments that map them to it.

    Decoded URL and base64 stretches are layers of their own, and stand among their surroundings in a copy of the text.
    """
    found = _url_stretches(text) if "%" in text else []
    yield from (stretch.layer() for _, _, stretch in found)
    if found:
        yield _among(text, found)
    if ("\\" in text or "&" in text) and (found := _unicode_stretches(text)):
        yield _among(text, found)
    found = []
    for m in BASE64.finditer(text):
        inner = list(blob_texts(m[0]))
        yield from ((t, [(0, *m.span(), False)]) for t in inner)
        if len(inner) == 1 and len(inner[0]) <= len(m[0]):
            stretch = Splice()
            stretch.decoded(inner[0], *m.span())
            found.append((*m.span(), stretch))
    if found:
        yield _among(text, found)
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = m[0].rstrip("=").split()
            if len({len(line) for line in lines[:-1]}) == 1 and len(lines[-1]) <= len(lines[0]):
                yield from ((t, [(0, *m.span(), False)]) for t in blob_texts("".join(lines)))


def find_secrets(text: str | None) -> tuple[list[Find], list[Find]]:
    """(base finds, all finds): spans in code points of the text, end exclusive."""
    text = text or ""
    first = Layer(text, [(0, 0, len(text), True)])
    base = scan_layer(first.text)
    every = set(base)
    seen: set[tuple[bytes, int]] = set()  # digests of texts, with a hash of the places that they come from
    work = [first]
    while work:
        around = work.pop()
        for inner, segments in unwrapped(around.text):
            segments = around.inside(segments)
            place = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hash(tuple(segments)))
            if place in seen:
                continue
            seen.add(place)
            layer = Layer(inner, segments)
            every |= {(kind, *layer.outermost(a, b)) for kind, a, b in scan_layer(inner)}
            work.append(layer)
    return base, in_order(every)


def joined(finds: list[Find]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in finds)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for x in batch.column(1):
            base, every = find_secrets(x.as_py())
            for column, kind in zip(counts, KINDS, strict=True):
                column.append(sum(f[0] == kind for f in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs; a scan without any shuffle."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
