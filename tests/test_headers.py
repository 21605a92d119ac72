"""Image headers by ranged reads: containers written by hand, odd and broken ones, and a huge file."""

from __future__ import annotations

import random
import struct

import pytest

from boxlake.sources import headers, media


def chunk(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def webp(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    if wide:
        return struct.pack(">I", 1) + kind + struct.pack(">Q", 16 + len(body)) + body
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind, version, flags, *parts):
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def avif(properties, linked, primary=1, wide=False, version=0, before=b"", brand=b"avif"):
    """`linked`: {item: property numbers}."""
    id_size, step = (4 if version else 2), (2 if wide else 1)
    entries = b"".join(
        item.to_bytes(id_size, "big") + bytes([len(own)])
        + b"".join((n | 1 << (8 * step - 1) if n == own[-1] else n).to_bytes(step, "big") for n in own)
        for item, own in linked.items()
    )
    ipma = full(b"ipma", version, int(wide), struct.pack(">I", len(linked)), entries)
    meta = full(
        b"meta", 0, 0, full(b"hdlr", 0, 0, b"\0" * 20),
        full(b"pitm", version, 0, primary.to_bytes(id_size, "big")),
        box(b"iprp", box(b"ipco", *properties), ipma),
    )
    return box(b"ftyp", b"mif1" if brand != b"avif" else brand, b"\0\0\0\0", brand, b"miaf") + before + meta


def ispe(w, h):
    return full(b"ispe", 0, 0, struct.pack(">II", w, h))


TIFF = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 9) + struct.pack(
    "<HHIHH", 274, 3, 1, 5, 0) + b"\0\0\0\0"
LOSSY = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 4000 | 1 << 14, 3000)
LOSSLESS = b"\x2f" + struct.pack("<I", 799 | 599 << 14 | 1 << 28)
EXTENDED = b"\x08\0\0\0" + (69_999).to_bytes(3, "little") + (11).to_bytes(3, "little")
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 41) + b"\x08\0\0\0\0" + b"crc!"
FILES = {
    "lossy.webp": (webp(chunk(b"VP8 ", LOSSY + b"x" * 99)), ("WEBP", 4000, 3000, 1)),
    "lossless.webp": (webp(chunk(b"VP8L", LOSSLESS)), ("WEBP", 800, 600, 1)),
    "extended.webp": (
        webp(chunk(b"VP8X", EXTENDED), chunk(b"ICCP", b"odd"), chunk(b"ALPH", b"y" * 5_001),
             chunk(b"VP8 ", LOSSY), chunk(b"EXIF", b"Exif\0\0" + TIFF)), ("WEBP", 70_000, 12, 5)),
    "plain.avif": (avif([ispe(640, 480)], {1: [1]}), ("AVIF", 640, 480, 1)),
    "second.avif": (avif([ispe(9, 9), ispe(70_000, 480), box(b"irot", b"\3")], {1: [1], 7: [2, 3]}, 7, True, 1,
                         brand=b"avis"), ("AVIF", 70_000, 480, 6)),
    "late.avif": (avif([ispe(5, 6), box(b"imir", b"\0")], {1: [1, 2]}, before=box(b"free", b"z" * 70_000, wide=True)),
                  ("AVIF", 5, 6, 4)),
    "unlinked.avif": (avif([ispe(5, 6)], {2: [1]}), ("AVIF", None, None, 1)),
    "other.avif": (box(b"ftyp", b"heic", b"\0\0\0\0", b"mif1"), (None, None, None, 1)),
    "turned.png": (PNG + struct.pack(">I", len(TIFF)) + b"eXIf" + TIFF + b"crc!" + b"\0\0\0\1IDATx", ("PNG", 31, 41, 5)),
    "photo.jpg": (b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(TIFF)) + b"Exif\0\0" + TIFF + b"\xff\xe2\0\x08MPF\0xx"
                  b"\xff\xc2\0\x0b\x08" + struct.pack(">HH", 100, 300) + b"\1\1\x11\0\xff\xda", ("MPO", 300, 100, 5)),
    "bitmap.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9), ("BMP", 7, 9, 1)),
    "empty.png": (b"", (None, None, None, 1)), "text.jpeg": (b"hello", (None, None, None, 1)),
}


@pytest.mark.parametrize("name", FILES)
def test_headers(name):
    data, want = FILES[name]
    assert tuple(media.sniff(data)) == want
    read = headers.Blocks(__import__("io").BytesIO(data), len(data), block=7, keep=1)
    assert tuple(headers.probe(read)) == want


def test_broken_headers_end():
    rng = random.Random(3)
    for data, _ in FILES.values():
        for _ in range(150):
            torn = bytearray(data[: rng.randint(0, min(len(data), 400))])
            for _ in range(rng.randint(0, 4)):
                if torn:
                    torn[rng.randrange(len(torn))] = rng.choice((0, 1, 255, rng.randrange(256)))
            found = media.sniff(bytes(torn))
            assert found.format is None or found.orientation is not None
    assert tuple(media.sniff(None)) == (None, None, None, 1)


def test_files_cost_kilobytes(spark, tmp_path):
    folder = tmp_path / "set" / "images"
    folder.mkdir(parents=True)
    for name, (data, _) in FILES.items():
        (folder / name).write_bytes(data)
    with open(folder / "huge.webp", "wb") as file:  # sparse: 1 GB that is never read
        file.write(webp(chunk(b"VP8X", EXTENDED))[:30] + b"VP8 " + struct.pack("<I", 1 << 30))
        file.seek((1 << 30) + 38)
        file.write(chunk(b"EXIF", TIFF))
        end = file.tell()
        file.seek(4)
        file.write(struct.pack("<I", end - 8))
    (folder / "notes.txt").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.probe_files(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {*FILES, "huge.webp"} - {"empty.png"}  # files of no bytes are not listed
    for name, (_, want) in FILES.items():
        if name not in got:
            continue
        r = got[name]
        assert (r.format, r.width, r.height, r.orientation) == want
        assert ("cannot decode" in r.issues) == (want[1] is None)
    assert (got["huge.webp"].width, got["huge.webp"].orientation) == (70_000, 5)
    assert max(r.bytes_read for r in got.values()) < 20_000
    assert got["photo.jpg"].issues == "exif orientation,mpo,low resolution"
