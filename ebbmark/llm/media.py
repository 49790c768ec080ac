"""Media columns: signature sniffing, correction of declared types, and carving of embedded media.

One Aho-Corasick automaton finds the magic bytes of all formats in a value. A validator of the format then walks the
structure from there and gives the type and the length, or nothing. What is valid at the start corrects the declared type;
what is valid further on is carved out, outermost only. Formats: PNG, JPEG, GIF, BMP, TIFF, WebP, WAV, AVI, FLAC, MP3, Ogg,
PDF, ZIP, gzip, Matroska and WebM, and by its brand MP4, M4A, QuickTime, HEIC or AVIF.

Validators walk structures from header to header and never look beyond the next structure that their format allows, so
media that stand behind one another stay apart. What ends a PDF or a ZIP is looked up in the places of all end marks of the
value, found by the automaton at once, so time is linear in a value's length and finds, but for walks that go far before they fail.

Null values count as empty. A value in which no format is found keeps its declared type as it was and says it isn't
confirmed. Finds that overlap one that began before are not carved. Of signatures that begin at one place the one that is
first in SIGNATURES and valid counts. Repeated rows and equal values give equal rows; values are read as a whole.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrays, map_batches, text_of

# formats' signatures, how far from the start each stands, and media types.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"), (b"\xff\xd8\xff", 0, "image/jpeg"), (b"GIF87a", 0, "image/gif"), (b"GIF89a", 0, "image/gif"), (b"BM", 0, "image/bmp"),
    (b"II*\0", 0, "image/tiff"), (b"MM\0*", 0, "image/tiff"), (b"WEBPVP8", 8, "image/webp"), (b"WAVE", 8, "audio/wav"), (b"AVI LIST", 8, "video/x-msvideo"), (b"fLaC", 0, "audio/flac"), (b"ID3", 0, "audio/mpeg"),
    *[(bytes([0xFF, second]), 0, "audio/mpeg") for second in (0xFB, 0xFA, 0xF3, 0xF2)],
    (b"OggS", 0, "audio/ogg"), (b"%PDF-", 0, "application/pdf"), (b"PK\x03\x04", 0, "application/zip"), (b"\x1f\x8b\x08", 0, "application/gzip"), (b"ftyp", 4, "video/mp4"), (b"\x1a\x45\xdf\xa3", 0, "video/x-matroska"),
]
#: Marks that end a PDF and a ZIP.
PDF_END, ZIP_END = b"%%EOF", b"PK\x05\x06"
# Major brands of the ISO base format, sampling rates and bit rates (kbit/s) of MPEG audio layer 3.
BRANDS = {
    "heic": "image/heic", "heix": "image/heic", "heim": "image/heic", "heis": "image/heic", "mif1": "image/heif", "msf1": "image/heif", "avif": "image/avif", "avis": "image/avif",
    "M4A ": "audio/mp4", "M4B ": "audio/mp4", "qt  ": "video/quicktime",
}
MPEG_RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
MPEG_BITS = {True: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def _png(d: memoryview) -> int | None:
    at, first = 8, True
    while at + 12 <= len(d):
        size, kind = struct.unpack(">I4s", d[at : at + 8])
        end = at + 12 + size
        if end > len(d) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(d[at + 4 : end - 4]) != struct.unpack(">I", d[end - 4 : end])[0]:
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def _jpeg(d: memoryview) -> int | None:
    at, frame = 2, False
    while at + 4 <= len(d) and d[at] == 0xFF:
        kind = d[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", d[at + 2 : at + 4])[0]
        if kind in (0, 1) or 0xD0 <= kind <= 0xD9 or size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + size
        if kind == 0xDA:
            data = bytes(d[at:])
            k = 0
            while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
                if data[k + 1] == 0xD9:
                    return at + k + 2 if frame else None
                if data[k + 1] != 0 and not 0xD0 <= data[k + 1] <= 0xD7:
                    at += k
                    break
                k += 2
            else:
                return None
    return None


def _gif(d: memoryview) -> int | None:
    if len(d) < 14:
        return None
    at = 13 + (3 << ((d[10] & 7) + 1) if d[10] & 0x80 else 0)
    images = 0
    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 if images else None
        if d[at] == 0x2C and at + 10 < len(d):
            flags = d[at + 9]
            at += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            images += 1
        elif d[at] == 0x21:
            at += 2
        else:
            return None
        while at < len(d) and d[at]:
            at += d[at] + 1
        at += 1
    return None


def _bmp(d: memoryview) -> int | None:
    if len(d) < 54:
        return None
    size, reserved, offset, head, width, height, planes, bits, packing = struct.unpack("<IIIIiiHHI", d[2:34])
    if reserved or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or not 14 + head <= offset <= size <= len(d):
        return None
    row = (width * bits + 31) // 32 * 4
    return size if packing or offset + row * abs(height) <= size else None


def _riff(form: bytes) -> Callable[[memoryview], int | None]:
    def check(d: memoryview) -> int | None:
        if len(d) < 20 or d[:4] != b"RIFF" or d[8:12] != form:
            return None
        end = 8 + struct.unpack("<I", d[4:8])[0]
        if end > len(d):
            return None
        at, kinds = 12, []
        while at + 8 <= end:
            kind, size = struct.unpack("<4sI", d[at : at + 8])
            kinds.append(kind)
            at += 8 + size + size % 2
        needed = {b"fmt ", b"data"} <= set(kinds) if form == b"WAVE" else b"LIST" in kinds if form == b"AVI " else kinds[:1] and kinds[0].startswith(b"VP8")
        return end + end % 2 * (end < len(d)) if needed and at in (end, end + 1) else None

    return check


def _table(width: int, polynomial: int) -> list[int]:
    """Of a CRC, most significant bit first."""
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for x in range(256):
        r = x << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & mask
        out.append(r)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _flac_head(d: memoryview, at: int) -> int | None:
    """Bytes of the frame header at a place, if there is one: sync code, sizes, and the header's CRC-8."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8:
        return None
    block, rate = d[at + 2] >> 4, d[at + 2] & 15
    if not block or rate == 15 or d[at + 3] >> 4 > 10 or d[at + 3] & 1:
        return None
    first = d[at + 4]
    more = 0 if first < 0x80 else next((k for k, low, high in ((1, 0xC0, 0xE0), (2, 0xE0, 0xF0), (3, 0xF0, 0xF8), (4, 0xF8, 0xFC), (5, 0xFC, 0xFE), (6, 0xFE, 0xFF)) if low <= first < high), None)
    if more is None:
        return None
    size = 5 + more + {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if at + size >= len(d):
        return None
    crc = 0
    for x in d[at : at + size]:
        crc = _CRC8[crc ^ x]
    return size + 1 if crc == d[at + size] else None


def _flac(d: memoryview) -> int | None:
    """Metadata blocks, then frames: a frame ends where its CRC-16 holds and the next frame, or what is no FLAC, begins."""
    at, first, last, longest = 4, True, False, 0
    while not last:
        if at + 4 > len(d):
            return None
        kind, size = d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if (first and (kind, size) != (0, 34)) or kind == 127 or at + 4 + size > len(d):
            return None
        if first:
            longest = int.from_bytes(d[at + 11 : at + 14], "big") or 1 << 18  # largest frame as declared, else as large as frames get
        last, at, first = bool(d[at] & 0x80), at + 4 + size, False
    end = None
    while (head := _flac_head(d, at)) is not None:
        crc, closes = 0, None
        for k in range(at, min(len(d), at + longest)):
            # The CRC over a frame and its own CRC is zero.
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[k]]
            if not crc and k >= at + head + 2 and (k + 1 == len(d) or d[k + 1] == 0xFF and _flac_head(d, k + 1) or closes is None):
                closes = k + 1
                if k + 1 == len(d) or d[k + 1] == 0xFF and _flac_head(d, k + 1):
                    break
        if closes is None:
            return end
        at = end = closes
    return end


def _mpeg_frame(d: memoryview, at: int) -> int:
    """Bytes of the layer 3 frame at a place; 0 if there is none."""
    if at + 4 > len(d) or d[at] != 0xFF or d[at + 1] & 0xE6 != 0xE2:
        return 0
    version, bits, rate = d[at + 1] >> 3 & 3, d[at + 2] >> 4, d[at + 2] >> 2 & 3
    if version == 1 or bits in (0, 15) or rate == 3:
        return 0
    return (144 if version == 3 else 72) * MPEG_BITS[version == 3][bits - 1] * 1000 // MPEG_RATES[version][rate] + (d[at + 2] >> 1 & 1)


def _mp3(d: memoryview) -> int | None:
    """A tag if there is one, then at least three frames, or with a tag one; a tag of 128 bytes may follow."""
    at, frames, tag = 0, 0, d[:3] == b"ID3"
    if tag:
        if len(d) < 10 or d[3] == 0xFF or any(x & 0x80 for x in d[6:10]):
            return None
        at = 10 + (d[6] << 21 | d[7] << 14 | d[8] << 7 | d[9]) + (10 if d[5] & 0x10 else 0)
    while (size := _mpeg_frame(d, at)) and at + size <= len(d):
        at, frames = at + size, frames + 1
    if frames < (1 if tag else 3):
        return None
    return at + 128 if d[at : at + 3] == b"TAG" and at + 128 <= len(d) else at


def _tiff(d: memoryview) -> int | None:
    """Follows the directories, and takes in all values and strips that they point to."""
    order = "<" if d[0] == 0x49 else ">"
    if len(d) < 8:
        return None
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    at, end, seen = struct.unpack(order + "I", d[4:8])[0], 8, set()
    while at:
        if at in seen or at + 2 > len(d):
            return None
        seen.add(at)
        n = struct.unpack(order + "H", d[at : at + 2])[0]
        if not n or at + 6 + 12 * n > len(d):
            return None
        fields = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack(order + "HHII", d[at + 2 + 12 * k : at + 14 + 12 * k])
            if kind not in sizes:
                return None
            size = sizes[kind] * count
            where = at + 10 + 12 * k if size <= 4 else value
            if where + size > len(d):
                return None
            end = max(end, where + size)
            if kind in (3, 4):
                fields[tag] = (where, kind, count)
        if 256 not in fields or 257 not in fields:
            return None
        numbers = lambda f: struct.unpack(f"{order}{f[2]}{'H' if f[1] == 3 else 'I'}", d[f[0] : f[0] + f[2] * sizes[f[1]]])
        for offsets, lengths in ((273, 279), (324, 325)):
            if offsets in fields and lengths in fields:
                for a, m in zip(numbers(fields[offsets]), numbers(fields[lengths]), strict=False):
                    if a + m > len(d):
                        return None
                    end = max(end, a + m)
        end = max(end, at + 6 + 12 * n)
        at = struct.unpack(order + "I", d[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return end if seen else None


def _element(d: memoryview, at: int) -> tuple[int, int | None, int] | None:
    """(id, size or None if unknown, where the data begin) of an EBML element."""
    if at >= len(d) or not d[at]:
        return None
    n = 9 - d[at].bit_length()
    if n > 4 or at + n >= len(d) or not d[at + n]:
        return None
    m = 9 - d[at + n].bit_length()
    if at + n + m > len(d):
        return None
    size = int.from_bytes(d[at + n : at + n + m], "big") & ((1 << 7 * m) - 1)
    return int.from_bytes(d[at : at + n], "big"), None if size == (1 << 7 * m) - 1 else size, at + n + m


def _matroska(d: memoryview) -> tuple[str, int] | None:
    """A header that names its document type, and one segment of known size behind it."""
    head = _element(d, 0)
    if head is None or head[1] is None or head[2] + head[1] > len(d):
        return None
    at, behind, kind = head[2], head[2] + head[1], b""
    while at < behind:
        if (e := _element(d, at)) is None or e[1] is None or e[2] + e[1] > behind:
            return None
        kind, at = bytes(d[e[2] : e[2] + e[1]]) if e[0] == 0x4282 else kind, e[2] + e[1]
    segment = _element(d, behind)
    while segment is not None and segment[0] == 0xEC and segment[1] is not None:
        segment = _element(d, segment[2] + segment[1])
    if segment is None or segment[0] != 0x18538067 or segment[1] is None or segment[2] + segment[1] > len(d) or kind not in (b"matroska", b"webm"):
        return None
    return "video/webm" if kind == b"webm" else "video/x-matroska", segment[2] + segment[1]


def _ogg(d: memoryview) -> int | None:
    at, last = 0, None
    while at + 27 <= len(d) and d[at : at + 4] == b"OggS" and d[at + 4] == 0:
        n = d[at + 26]
        if at + 27 + n > len(d) or (not at and not d[at + 5] & 2):
            return None
        closes = d[at + 5] & 4
        at += 27 + n + sum(d[at + 27 : at + 27 + n])
        if at > len(d):
            return last
        last = at
        if closes:
            break
    return last


def _pdf(d: memoryview, ends: list[int], limit: int) -> int | None:
    """Up to the last end mark before the next PDF's header (limit) that a cross reference stands before; end marks and headers come from the automaton."""
    if len(d) < 9 or not 0x30 <= d[5] <= 0x39:
        return None
    for end in reversed(ends):
        if end + 5 <= limit and b"startxref" in bytes(d[max(0, end - 64) : end]):
            return end + 5 + (2 if d[end + 5 : end + 7] == b"\r\n" else d[end + 5 : end + 6] in (b"\n", b"\r"))
    return None


def _zip(d: memoryview, ends: list[int]) -> int | None:
    """Up to the first end record whose directory is where it says, with entries that lie in the file."""
    for at in ends:
        if at + 22 > len(d):
            return None
        entries, size, offset, comment = struct.unpack("<HIIH", d[at + 10 : at + 22])
        if offset + size == at and at + 22 + comment <= len(d):
            where, n = offset, 0
            while where + 46 <= at and d[where : where + 4] == b"PK\x01\x02":
                name, extra, note = struct.unpack("<HHH", d[where + 28 : where + 34])
                local = struct.unpack("<I", d[where + 42 : where + 46])[0]
                if d[local : local + 4] != b"PK\x03\x04":
                    break
                where, n = where + 46 + name + extra + note, n + 1
            if where == at and n == entries:
                return at + 22 + comment
    return None


def _gzip(d: memoryview) -> int | None:
    z, at = zlib.decompressobj(31), 0
    try:
        while at < len(d) and not z.eof:
            z.decompress(d[at : at + 65536])
            at += 65536
    except zlib.error:
        return None
    return min(at, len(d)) - len(z.unused_data) if z.eof else None


def _iso(d: memoryview) -> tuple[str, int] | None:
    """Boxes from the first, which names the brand, up to the next file's first or what is no box."""
    at, kinds = 0, []
    while at + 8 <= len(d):
        size, kind = struct.unpack(">I4s", d[at : at + 8])
        if size == 1 and at + 16 <= len(d):
            size = struct.unpack(">Q", d[at + 8 : at + 16])[0]
        if size < 8 or at + size > len(d) or not all(0x20 <= x < 0x7F for x in kind) or (kinds and kind == b"ftyp"):
            break
        kinds.append(kind)
        at += size
    brand = bytes(d[8:12]).decode("latin-1")
    needed = {b"meta"} if BRANDS.get(brand, "").startswith("image/") else {b"moov", b"mdat"}
    return (BRANDS.get(brand, "video/mp4"), at) if needed & set(kinds) or b"moov" in kinds else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/tiff": _tiff, "image/webp": _riff(b"WEBP"), "audio/wav": _riff(b"WAVE"), "video/x-msvideo": _riff(b"AVI "),
    "audio/flac": _flac, "audio/mpeg": _mp3, "audio/ogg": _ogg, "application/gzip": _gzip, "video/mp4": _iso, "video/x-matroska": _matroska,
}


@dataclass(frozen=True, slots=True)
class Find:
    kind: str
    start: int
    length: int


_AUTOMATON: list = []
_ORDER = {kind: place for place, (_, _, kind) in reversed(list(enumerate(SIGNATURES)))}


def automaton() -> ahocorasick.Automaton:
    """Of all signatures, read as characters of the same numbers."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic, back, kind in [*SIGNATURES, (PDF_END, 0, "pdf end"), (ZIP_END, 0, "zip end")]:
            a.add_word(magic.decode("latin-1"), (len(magic) + back, kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def finds(data: bytes) -> list[Find]:
    """Valid media in order, none inside another."""
    view, hits, marks = memoryview(data), [], {"pdf end": [], "zip end": [], "application/pdf": []}
    for end, (back, kind) in automaton().iter(data.decode("latin-1")):
        start = end + 1 - back
        if kind in marks:
            marks[kind].append(start)
        if start >= 0 and not kind.endswith(" end"):
            hits.append((start, _ORDER[kind], kind))
    out, free, refused = [], 0, {}
    for start, _, kind in sorted(hits):
        if start < free or refused.get(kind, -1) >= start:
            continue
        if kind == "application/pdf":
            headers = marks[kind]
            k = bisect.bisect_right(headers, start)
            limit = headers[k] if k < len(headers) else len(data)
            a, b = bisect.bisect_left(marks["pdf end"], start), bisect.bisect_left(marks["pdf end"], limit)
            found = _pdf(view[start:], [x - start for x in marks["pdf end"][a:b]], limit - start)
        elif kind == "application/zip":
            a = bisect.bisect_left(marks["zip end"], start)
            found = _zip(view[start:], [x - start for x in marks["zip end"][a:]])
            if found is None and a == len(marks["zip end"]):
                refused[kind] = len(data)  # no end record follows: no later one can be valid
        else:
            found = VALIDATORS[kind](view[start:])
        if found:
            kind, length = found if isinstance(found, tuple) else (kind, found)
            out.append(Find(kind, start, length))
            free = start + length
    return out


_CARVED = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))


def _sniffed(batch: pa.RecordBatch, value: str, declared: str) -> pa.RecordBatch:
    rows = []
    for data, told in zip(batch.column(value).to_pylist(), batch.column(declared).to_pylist(), strict=True):
        found = finds(data or b"")
        whole = found[0] if found and not found[0].start else None
        carved = [{"type": f.kind, "start": f.start, "length": f.length, "bytes": data[f.start : f.start + f.length]} for f in found if f.start]
        rows.append((whole.kind if whole else told, whole is not None, whole is not None and whole.kind != told, carved))
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.bool_(), _CARVED))]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "found_type", "confirmed", "corrected", "carved"])


def sniff(df: DataFrame, value: str = "media", declared: str = "type") -> DataFrame:
    """df with columns found_type (of what stands at the start, else as declared), confirmed, corrected, carved: array of (type, start, length, bytes) of media further on. Columns of these names are replaced."""
    new = "found_type string, confirmed boolean, corrected boolean, carved array<struct<type:string,start:long,length:long,bytes:binary>>"
    kept = df.select(*[c for c in df.columns if c not in ("found_type", "confirmed", "corrected", "carved")])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [new])
    return map_batches(kept, lambda batch: _sniffed(batch, value, declared), schema, rows=ROWS)


#: Rows that are in Python at once.
ROWS = 256
#: Payloads are padded to a multiple of UNIT with PAD, and stored as sounds of RATE 8-bit samples a second.
UNIT, PAD, RATE = 192, b" ", 8000
#: The declared type of stored texts.
UNKNOWN = "application/octet-stream"


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono sound; samples must be of even length."""
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVEfmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + (size := struct.unpack("<I", media[at + 4 : at + 8])[0]) + size % 2
    return media[at + 8 : at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]]


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def features(samples: bytes) -> str:
    """Of 8-bit samples: seconds, mean, root mean square around the middle, and crossings of the middle."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int32) - 128
    square = int((centred * centred).sum(dtype=np.int64))
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    return f"samples={len(x)};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};crossings={crossings}"


def _stored(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [x.encode() for x in batch.column("text").to_pylist()]
    types = {"key": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "type": pa.string()}
    return arrays(types, {"key": batch.column("key").to_pylist(), "n_bytes": [len(x) for x in texts], "media": [wav(padded(x)) for x in texts], "type": [UNKNOWN] * len(texts)})


def stored_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, type): each text's bytes, padded, as a sound; declared as unknown bytes, as a crawler would."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return map_batches(rows, _stored, "key long, n_bytes long, media binary, type string", rows=ROWS).withColumnRenamed("key", key)


_READ = {
    "key": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "found_type": pa.string(), "corrected": pa.bool_(),
}
_READ_SCHEMA = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, found_type string, corrected boolean"


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for k, n, media, kind, corrected in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "media", "found_type", "corrected")), strict=True):
        if kind != "audio/wav":
            raise ValueError(f"{kind} has no samples")
        payload = wav_samples(media)
        rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};{features(payload)}", kind, corrected))
    return arrays(_READ, {name: [r[i] for r in rows] for i, name in enumerate(_READ)})


def read_media(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """From sniffed sounds alone: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, found_type, corrected."""
    rows = stored.select(F.col(key).alias("key"), "n_bytes", "media", "found_type", "corrected")
    return map_batches(rows, _read, _READ_SCHEMA, rows=ROWS).withColumnRenamed("key", key)


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """read_media of sniffed stored_media, with few rows at once going through all three in one Python worker. Repeated rows give equal rows, and null or empty texts a sound of padding."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return map_batches(rows, lambda batch: _read(_sniffed(_stored(batch), "media", "type")), _READ_SCHEMA, rows=ROWS).withColumnRenamed("key", key)
