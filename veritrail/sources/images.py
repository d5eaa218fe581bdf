"""Image files: header checks before any decoding. Decoding and recognition are left to a provider."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PIXELS, MOST_BYTES = 40_000_000, 20 << 20
#: Parts of a file that are walked before it is given up: segments, chunks, directory entries.
MOST_PARTS = 4096
HEADER = "path string, format string, width int, height int, orientation int, problem string"
#: name -> function(DataFrame of path) -> word rows; a recogniser registers itself here.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}

#: read(offset, n): up to n bytes of a file from there; no format needs more than its directories.
Read = Callable[[int, int], bytes]


class Cut(Exception):
    """The file ends inside its header."""


def _need(read: Read, at: int, n: int) -> bytes:
    data = read(at, n)
    if len(data) < n:
        raise Cut
    return data


def _tiff(read: Read, base: int = 0) -> tuple[int | None, int | None, int]:
    """Width, height and orientation in the first directory of a TIFF structure (a file, or an Exif block)."""
    mark = _need(read, base, 8)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    if order is None or struct.unpack(order + "H", mark[2:4])[0] != 42:
        raise Cut
    at = base + struct.unpack(order + "I", mark[4:8])[0]
    n = struct.unpack(order + "H", _need(read, at, 2))[0]
    entries, found = _need(read, at + 2, 12 * min(n, MOST_PARTS)), {}
    for k in range(0, len(entries), 12):
        tag, kind = struct.unpack(order + "HH", entries[k : k + 4])
        if tag in (256, 257, 274) and kind in (3, 4):  # a short or a long, kept in the entry itself
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entries[k + 8 : k + (10 if kind == 3 else 12)])[0]
    turn = found.get(274, 1)
    return found.get(256), found.get(257), turn if 1 <= turn <= 8 else 1


def _turn(read: Read, at: int) -> int:
    """Orientation of an Exif block; 1 where it is damaged, as it turns nothing."""
    try:
        return _tiff(read, at)[2]
    except Cut:
        return 1


def _jpeg(read: Read) -> tuple[int, int, int]:
    at, turn = 2, 1
    for _ in range(MOST_PARTS):
        mark = _need(read, at, 2)
        if mark[0] != 0xFF:
            raise Cut
        if mark[1] == 0xFF or mark[1] == 0x01 or 0xD0 <= mark[1] <= 0xD8:  # filling, or a mark without a length
            at += 1 if mark[1] == 0xFF else 2
            continue
        size = struct.unpack(">H", _need(read, at + 2, 2))[0]
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", _need(read, at + 5, 4))
            return w, h, turn
        if mark[1] == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            turn = _turn(read, at + 10)
        at += 2 + size
    raise Cut


def _png(read: Read) -> tuple[int, int, int]:
    w, h = struct.unpack(">II", _need(read, 16, 8))
    at = 33
    for _ in range(MOST_PARTS):  # an Exif chunk stands before the pixels, where there is one
        head = read(at, 8)
        if len(head) < 8 or head[4:] in (b"IDAT", b"IEND"):
            break
        if head[4:] == b"eXIf":
            return w, h, _turn(read, at + 8)
        at += 12 + struct.unpack(">I", head[:4])[0]
    return w, h, 1


def _webp(read: Read) -> tuple[int, int, int]:
    kind = _need(read, 12, 4)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", _need(read, 26, 4))
        return w & 0x3FFF, h & 0x3FFF, 1
    if kind == b"VP8L":
        bits = int.from_bytes(_need(read, 21, 4), "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
    if kind != b"VP8X":
        raise Cut
    data = _need(read, 20, 10)
    w, h = 1 + int.from_bytes(data[4:7], "little"), 1 + int.from_bytes(data[7:10], "little")
    at = 30
    for _ in range(MOST_PARTS if data[0] & 8 else 0):
        head = read(at, 8)
        if len(head) < 8:
            break
        if head[:4] == b"EXIF":
            return w, h, _turn(read, at + 8 + (6 if read(at + 8, 6) == b"Exif\0\0" else 0))
        size = struct.unpack("<I", head[4:])[0]
        at += 8 + size + size % 2
    return w, h, 1


def _bmp(read: Read) -> tuple[int, int, int]:
    if struct.unpack("<I", _need(read, 14, 4))[0] == 12:  # the oldest header has short sizes
        return *struct.unpack("<HH", _need(read, 18, 4)), 1
    w, h = struct.unpack("<ii", _need(read, 18, 8))
    return w, abs(h), 1


def header_of(read: Read) -> tuple[str, int, int, int] | None:
    """Format, width, height and orientation; sizes are those after the turn. None: another format. Cut: it ends too early."""
    start = read(0, 12)
    if start[:8] == b"\x89PNG\r\n\x1a\n":
        name, got = "png", _png(read)
    elif start[:2] == b"\xff\xd8":
        name, got = "jpeg", _jpeg(read)
    elif start[:4] == b"RIFF" and start[8:12] == b"WEBP":
        name, got = "webp", _webp(read)
    elif start[:4] in (b"II*\0", b"MM\0*"):
        name, got = "tiff", _tiff(read)
    elif start[:2] == b"BM":
        name, got = "bmp", _bmp(read)
    else:
        return None
    w, h, turn = got
    if not w or not h or w < 0:
        raise Cut
    return (name, h, w, turn) if turn >= 5 else (name, w, h, turn)


def _judged(read: Read, size: int) -> tuple:
    if not size:
        return None, None, None, None, "empty"
    try:
        got = header_of(read)
    except Cut:
        return None, None, None, None, "damaged header"
    problem = "unknown format" if got is None else "too many bytes" if size > MOST_BYTES else "too many pixels" if got[1] * got[2] > MOST_PIXELS else None
    return *(got or (None,) * 4), problem


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
            scheme, _, place = path.partition(":")  # Spark gives paths with their spaces as they are
            store, name = fs.FileSystem.from_uri(f"{scheme}:{quote(place, safe='/:@')}")
            try:
                with store.open_input_file(name) as file:
                    rows.append((path, *_judged(lambda at, n: file.read_at(min(n, max(0, size - at)), at) if at < size else b"", size)))  # noqa: B023
            except OSError:
                rows.append((path, None, None, None, None, "unreadable"))
        names = [c.split()[0] for c in HEADER.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADER of the files below path: Spark lists them, tasks read the few bytes of their headers.

    Sizes are those after the turn that the file's Exif orientation asks for. A file that is cut short, of another format or too large has a problem and stops no other; Spark lists no empty files.
    The files must be where pyarrow reaches them (file, hdfs, s3, gs).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.mapInArrow(_headers, HEADER)


def provider(name: str):
    """Registers a recogniser under a name."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        PROVIDERS[name] = f
        return f

    return keep


def extract(name: str, files: DataFrame) -> DataFrame:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name](files)


def client_problem(name, size, kind):
    """What a client would say of a file before sending it; null if nothing."""
    return F.when(~F.startswith(kind, F.lit("image/")), "type").when(size == 0, "empty").when(size > MOST_BYTES, "too large")
