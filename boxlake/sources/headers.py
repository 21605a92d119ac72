"""Image headers by ranged reads: format, size and orientation without decoding, from a few kilobytes.

A walker follows the container of its format (JPEG segments, PNG and RIFF chunks, nested boxes) and asks
for the bytes that it needs by offset, so that pixel data is stepped over, however large it is.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

Read = Callable[[int, int], bytes]
MAX_STEPS = 10_000  # segments, chunks or boxes that are followed in one file
MAX_EXIF = 1 << 16


class Header(NamedTuple):
    format: str | None = None
    width: int | None = None
    height: int | None = None
    orientation: int = 1


class Blocks:
    """Reads from a random-access file in blocks, keeping the last few; counts the bytes it asked for."""

    def __init__(self, file, size: int, block: int = 2_048, keep: int = 4):
        self.file, self.size, self.block, self.keep = file, size, block, keep
        self.held: dict[int, bytes] = {}
        self.bytes_read = 0

    def __call__(self, offset: int, size: int) -> bytes:
        if offset < 0 or offset >= self.size:
            return b""
        end = min(offset + size, self.size)
        out = []
        for number in range(offset // self.block, -(-end // self.block)):
            own = self.held.pop(number, None)
            if own is None:
                self.file.seek(number * self.block)
                own = self.file.read(self.block)
                self.bytes_read += len(own)
            self.held[number] = own
            while len(self.held) > self.keep:
                self.held.pop(next(iter(self.held)))
            first = number * self.block
            out.append(own[max(0, offset - first) : end - first])
        return b"".join(out)


def of_bytes(data: bytes) -> Read:
    return lambda offset, size: data[offset : offset + size]


def exif_orientation(tiff: bytes) -> int:
    """Tag 274 of the first directory of a TIFF block; 1 without it."""
    tiff = tiff.removeprefix(b"Exif\0\0")
    if len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
        return 1
    order = "<" if tiff[:2] == b"II" else ">"
    start = struct.unpack(f"{order}I", tiff[4:8])[0]
    if start + 2 > len(tiff):
        return 1
    for i in range(struct.unpack(f"{order}H", tiff[start : start + 2])[0]):
        entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
        if len(entry) < 12:
            break
        if struct.unpack(f"{order}H", entry[:2])[0] == 274:
            return struct.unpack(f"{order}H", entry[8:10])[0]
    return 1


def _jpeg(read: Read) -> Header:
    width = height = None
    orientation, multi, at = 1, False, 2
    for _ in range(MAX_STEPS):
        head = read(at, 4)
        if len(head) < 4 or head[0] != 0xFF or head[1] == 0xDA:
            break
        marker, size = head[1], struct.unpack(">H", head[2:])[0]
        if marker == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            orientation = exif_orientation(read(at + 4, size - 2))
        elif marker == 0xE2 and read(at + 4, 4) == b"MPF\0":
            multi = True
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            body = read(at + 4, min(size - 2, 5))
            if len(body) == 5:
                height, width = struct.unpack(">HH", body[1:])
        at += 2 + size
    return Header("MPO" if multi else "JPEG", width, height, orientation)


def _png(read: Read) -> Header:
    head = read(16, 8)
    if len(head) < 8:
        return Header()
    orientation, at = 1, 8
    for _ in range(MAX_STEPS):
        chunk = read(at, 8)
        if len(chunk) < 8 or chunk[4:] in (b"IDAT", b"IEND"):
            break
        size = struct.unpack(">I", chunk[:4])[0]
        if chunk[4:] == b"eXIf":
            orientation = exif_orientation(read(at + 8, min(size, MAX_EXIF)))
        at += 12 + size
    return Header("PNG", *struct.unpack(">II", head), orientation)


def _bmp(read: Read) -> Header:
    head = read(18, 8)
    if len(head) < 8:
        return Header()
    width, height = struct.unpack("<ii", head)
    return Header("BMP", width, abs(height))


def _webp(read: Read) -> Header:
    """The canvas of an extended file, else the first frame; the size of RIFF chunks is padded to even."""
    end = 8 + struct.unpack("<I", read(4, 4))[0]
    width = height = None
    orientation, extended, at = 1, False, 12
    for _ in range(MAX_STEPS):
        head = read(at, 8)
        if at + 8 > end or len(head) < 8:
            break
        kind, size = head[:4], struct.unpack("<I", head[4:])[0]
        if kind == b"VP8X" and width is None:
            body = read(at + 8, 10)
            if len(body) == 10:
                extended = True
                width = 1 + int.from_bytes(body[4:7], "little")
                height = 1 + int.from_bytes(body[7:10], "little")
        elif kind == b"VP8L" and width is None:
            body = read(at + 8, 5)
            if len(body) == 5 and body[0] == 0x2F:
                bits = int.from_bytes(body[1:], "little")
                width, height = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"VP8 " and width is None:
            body = read(at + 8, 10)
            if len(body) == 10 and body[3:6] == b"\x9d\x01\x2a":
                sides = struct.unpack("<HH", body[6:])
                width, height = (s & 0x3FFF for s in sides)
        elif kind == b"EXIF":
            orientation = exif_orientation(read(at + 8, min(size, MAX_EXIF)))
        if width is not None and not extended:
            break  # a simple file has one chunk
        at += 8 + size + size % 2
    return Header("WEBP", width, height, orientation)


def _boxes(read: Read, start: int, end: int | None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes in a range, read header by header."""
    at = start
    for _ in range(MAX_STEPS):
        head = read(at, 8)
        if len(head) < 8 or (end is not None and at + 8 > end):
            return
        size, kind, body = struct.unpack(">I", head[:4])[0], head[4:], at + 8
        if size == 1:
            wide = read(at + 8, 8)
            if len(wide) < 8:
                return
            size, body = struct.unpack(">Q", wide)[0], at + 16
        stop = at + size if size else end if end is not None else 1 << 62
        if stop < body or (end is not None and stop > end):
            return
        yield kind, body, stop
        at = stop


# The orientation of a quarter-turn count (anti-clockwise) and of a mirror axis, alone and
# together.
TURNED = {0: 1, 1: 8, 2: 3, 3: 6}
MIRRORED = {(0, 0): 4, (0, 1): 2, (1, 0): 5, (1, 1): 7, (2, 0): 2, (2, 1): 4, (3, 0): 7, (3, 1): 5}


def _associations(read: Read, body: int, end: int) -> dict[int, list[int]]:
    """The property numbers (from 1) of each item, in order."""
    head = read(body, 8)
    if len(head) < 8:
        return {}
    version, wide = head[0], head[3] & 1
    count = struct.unpack(">I", head[4:])[0]
    at, out = body + 8, {}
    id_size = 4 if version else 2
    for _ in range(min(count, MAX_STEPS)):
        own = read(at, id_size + 1)
        if len(own) <= id_size or at + id_size + 1 > end:
            break
        item, number = int.from_bytes(own[:id_size], "big"), own[id_size]
        at += id_size + 1
        raw = read(at, number * (1 + wide))
        step = 1 + wide
        mask = 0x7FFF if wide else 0x7F
        out.setdefault(item, []).extend(
            int.from_bytes(raw[i : i + step], "big") & mask for i in range(0, len(raw), step)
        )
        at += number * step
    return out


def _avif(read: Read) -> Header:
    """Size and orientation of the primary item, from its associated properties."""
    primary, properties, linked = None, [], {}
    for kind, body, end in _boxes(read, 0, None):
        if kind != b"meta":
            continue
        for inner, first, stop in _boxes(read, body + 4, end):
            if inner == b"pitm":
                head = read(first, 8)
                size = 4 if head[:1] and head[0] else 2
                primary = int.from_bytes(head[4 : 4 + size], "big")
            elif inner == b"iprp":
                for part, a, b in _boxes(read, first, stop):
                    if part == b"ipco":
                        properties = [
                            (name, read(x, min(y - x, 12))) for name, x, y in _boxes(read, a, b)
                        ]
                    elif part == b"ipma":
                        linked.update(_associations(read, a, b))
        break
    width = height = turn = axis = None
    for number in linked.get(primary, ()):
        if not 0 < number <= len(properties):
            continue
        name, body = properties[number - 1]
        if name == b"ispe" and len(body) == 12:
            width, height = struct.unpack(">II", body[4:])
        elif name == b"irot" and body:
            turn = body[0] & 3
        elif name == b"imir" and body:
            axis = body[0] & 1
    orientation = TURNED[turn or 0] if axis is None else MIRRORED[turn or 0, axis]
    return Header("AVIF", width, height, orientation)


def _is_avif(head: bytes, read: Read) -> bool:
    if head[4:8] != b"ftyp":
        return False
    brands = read(8, min(struct.unpack(">I", head[:4])[0], 256) - 8)
    return any(brands[i : i + 4] in (b"avif", b"avis") for i in (0, *range(8, len(brands), 4)))


def probe(read: Read) -> Header:
    """The header that the bytes begin; all null for an unknown or broken one."""
    head = read(0, 16)
    if head[:2] == b"\xff\xd8":
        return _jpeg(read)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(read)
    if head[:2] == b"BM":
        return _bmp(read)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp(read)
    if len(head) >= 12 and _is_avif(head, read):
        return _avif(read)
    return Header()
