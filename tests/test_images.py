"""Image headers from written files of every format, turned, damaged and strange ones."""

from __future__ import annotations

import struct

import pytest

from veritrail.sources import images


def exif(turn, order="<"):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(order + "IH", 8, 1) + struct.pack(order + "HHIHH", 274, 3, 1, turn, 0) + struct.pack(order + "I", 0)


def png(w, h, turn=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"x" * 50) + (chunk(b"eXIf", exif(turn)) if turn else b"")
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", b"pixels")


def jpeg(w, h, turn=None, order=">"):
    part = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    app = part(0xE1, b"Exif\0\0" + exif(turn, order)) if turn else b""
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + b"\0" * 9) + app + part(0xC4, b"\0" * 300) + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, h, w, 3)) + b"scan"


def tiff(w, h, turn=1, order="<"):
    tags = [(256, 4, w), (257, 3, h), (259, 3, 1), (274, 3, turn)]
    pack = lambda t, k, v: struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0))
    pixels = b"p" * 5000  # the directory stands behind the pixels
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(order + "I", 8 + len(pixels)) + pixels + struct.pack(order + "H", len(tags)) + b"".join(pack(*t) for t in tags) + b"\0" * 4


def webp(kind, data, more=b""):
    body = b"WEBP" + kind + struct.pack("<I", len(data)) + data + more
    return b"RIFF" + struct.pack("<I", len(body)) + body


EXTENDED = lambda w, h, flag=0: bytes([flag, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
FILES = {
    "a.png": (png(640, 480), ("png", 640, 480, 1, None)),
    "turned.png": (png(640, 480, 6), ("png", 480, 640, 6, None)),
    "a.jpg": (jpeg(3000, 2000), ("jpeg", 3000, 2000, 1, None)),
    "turned.jpg": (jpeg(3000, 2000, 8), ("jpeg", 2000, 3000, 8, None)),
    "mirrored.jpg": (jpeg(3000, 2000, 3, "<"), ("jpeg", 3000, 2000, 3, None)),
    "a.tif": (tiff(1200, 800), ("tiff", 1200, 800, 1, None)),
    "turned.tif": (tiff(1200, 800, 5, ">"), ("tiff", 800, 1200, 5, None)),
    "lossy.webp": (webp(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 320, 200)), ("webp", 320, 200, 1, None)),
    "lossless.webp": (webp(b"VP8L", b"\x2f" + ((319) | (199 << 14)).to_bytes(4, "little")), ("webp", 320, 200, 1, None)),
    "extended.webp": (webp(b"VP8X", EXTENDED(320, 200)), ("webp", 320, 200, 1, None)),
    "turned.webp": (webp(b"VP8X", EXTENDED(320, 200, 8), b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", 26) + exif(7)), ("webp", 200, 320, 7, None)),
    "a.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 64, -48), ("bmp", 64, 48, 1, None)),
    "old.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 64, 48), ("bmp", 64, 48, 1, None)),
    "text.jpg": (b"GIF89a" + b"x" * 50, (None, None, None, None, "unknown format")),
    "cut.png": (png(640, 480)[:20], (None, None, None, None, "damaged header")),
    "cut.jpg": (jpeg(640, 480)[:60], (None, None, None, None, "damaged header")),
    "cut.tif": (tiff(640, 480)[:5010], (None, None, None, None, "damaged header")),
    "cut.webp": (webp(b"VP8X", EXTENDED(320, 200))[:24], (None, None, None, None, "damaged header")),
    "none.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 0, 48), (None, None, None, None, "damaged header")),
    "bomb.png": (png(13300, 13300), ("png", 13300, 13300, 1, "too many pixels")),
    "large.png": (png(64, 48) + b"\0" * images.MOST_BYTES, ("png", 64, 48, 1, "too many bytes")),
    "broken exif.jpg": (jpeg(640, 480, 6).replace(b"MM\0*", b"MM\0+"), ("jpeg", 640, 480, 1, None)),
}


def test_headers_of_every_format(spark, tmp_path):
    (tmp_path / "inner").mkdir()
    for k, (name, (data, _)) in enumerate(FILES.items()):
        (tmp_path / ("inner" if k % 2 else ".") / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2].replace("%20", " "): (r["format"], r["width"], r["height"], r["orientation"], r["problem"]) for r in images.image_headers(spark, str(tmp_path)).collect()}
    assert got == {name: want for name, (_, want) in FILES.items()}


def test_an_empty_file_is_empty():
    assert images._judged(lambda at, n: b"", 0) == (None, None, None, None, "empty")


def test_providers_by_name(spark):
    @images.provider("plain")
    def read(files):
        return files.selectExpr("path as label_id")

    files = spark.createDataFrame([("a",)], "path string")
    assert images.extract("plain", files).first()["label_id"] == "a"
    with pytest.raises(ValueError, match="no provider other"):
        images.extract("other", files)
    del images.PROVIDERS["plain"]
