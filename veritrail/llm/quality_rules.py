"""Quality rules: word statistics and zstandard compression bands over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import own_name, table, without
from veritrail.llm.wordarrays import Words, blocks, mix

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
CHUNK_BYTES = 4096
LEVEL = 3
#: (texts of fewer bytes, least ratio, greatest ratio): raw bytes over compressed bytes. Short
#: texts compress badly whatever they say (frame header, no history), long ones better. The least
#: ratios lie between the greatest one measured for random base64, letters and digits, printable
#: ASCII and CJK of that length and the least one of clean prose cut to it. Under 224 bytes random
#: letters, and under 128 bytes all but printable noise, overlap with prose and are not told apart.
#: Nor are hex and random lower-case letters, which compress about as well as short prose.
BANDS = (
    (100, 0.0, 6.0), (128, 0.95, 6.0), (144, 1.04, 6.0), (160, 1.05, 6.0), (176, 1.06, 6.0), (192, 1.08, 6.0), (224, 1.115, 6.0), (256, 1.168, 6.0),
    (320, 1.18, 8.0), (384, 1.22, 8.0), (448, 1.27, 8.0), (512, 1.3, 8.0), (640, 1.33, 8.0), (768, 1.36, 8.0), (1024, 1.39, 8.0),
    (1536, 1.41, 9.0), (2048, 1.43, 9.0), (4096, 1.45, 9.0), (1 << 62, 1.45, 10.0),
)
#: Share of a text's chunks that may lie outside their band.
MAX_BAD_CHUNKS = 0.25

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, n_chunks int, n_bad_chunks int, kept boolean"
)


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for limit, low, high in bands if n_bytes < limit)


def compression(text: bytes, packer: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES, bands=BANDS) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, its chunks, those outside their band, and whether the text passes.

    Chunks are consecutive; a last piece under half a chunk joins the one before it. The empty
    text has ratio 0 and no chunks, and passes here (the word minimum rejects it).
    """
    n = len(text)
    if not n:
        return 0.0, 0, 0, True
    ratio = n / len(packer.compress(text))
    cuts = list(range(0, max(n - chunk_bytes // 2, 1), chunk_bytes)) + [n]
    bad = 0
    if len(cuts) > 2:
        for a, b in zip(cuts, cuts[1:]):
            low, high = band(b - a, bands)
            bad += not low <= (b - a) / len(packer.compress(text[a:b])) <= high
    low, high = band(n, bands)
    return ratio, len(cuts) - 1, bad, low <= ratio <= high and bad <= MAX_BAD_CHUNKS * (len(cuts) - 1)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(w: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside k-word windows that the text holds twice or more."""
    hashes = case_hashes(w)
    begin, h = w.windows(hashes, k)
    doc = w.doc()
    h = mix(h ^ (doc[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int32)
    step[begin[twice]] += 1
    step[begin[twice] + k] -= 1
    covered = np.cumsum(step)[:-1] > 0
    return np.bincount(doc[covered], minlength=len(w.at) - 1)


def case_hashes(w: Words) -> np.ndarray:
    """Word hashes that keep case apart, unlike Words.hashes()."""
    return mix(w.hashes() + _upper_sums(w))


def _upper_sums(w: Words) -> np.ndarray:
    """Per word, a hash of where its capital letters A-Z stand (0: none)."""
    n = len(w.raw)
    if not n or not len(w.start):
        return np.zeros(len(w.start), np.uint64)
    upper = (w.raw >= 65) & (w.raw <= 90)
    at = np.flatnonzero(upper)
    word = np.searchsorted(w.start, at, "right") - 1
    value = mix((at - w.start[word] + 1).astype(np.uint64))
    total = np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64)))
    edge = np.searchsorted(word, np.arange(len(w.start) + 1))
    sums = total[edge]
    return sums[1:] - sums[:-1]


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        texts = batch.column(0)
        strings = texts.to_pylist()
        cols: list[list] = [[] for _ in range(10)]
        for i, j, raw, at in blocks(texts):
            w = Words.of(raw, at)
            repeat = repeated_words(w)
            inside = np.zeros(len(raw) + 1, np.int64)
            spans = np.zeros(len(raw) + 1, np.int8)
            spans[w.start] += 1
            spans[w.end] -= 1
            np.cumsum((np.cumsum(spans[:-1], dtype=np.int8) > 0) & ((raw & 0xC0) != 0x80), out=inside[1:])
            symbols = np.concatenate(([0], np.cumsum(SYMBOL[raw])))
            n_words = w.counts
            chars, marks = inside[at[1:]] - inside[at[:-1]], symbols[at[1:]] - symbols[at[:-1]]
            data = raw.tobytes()
            for k in range(j - i):
                n, r = int(n_words[k]), int(repeat[k])
                failed = n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n
                ratio, chunks, bad, fine = compression(data[at[k] : at[k + 1]], packer)
                row = (n, int(chars[k]), int(marks[k]), duplicate_lines(strings[i + k] or ""), r, failed, ratio, chunks, bad, not failed and fine)
                for c, v in zip(cols, row):
                    c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds))], [*batch.schema.names[1:], *names])


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with the word statistics, the compression verdict and kept.

    One pass without a shuffle. A null text counts as empty: no words, base_failed. Repeated rows
    are judged each on its own; an empty table gives an empty result; input columns named as an
    output column are dropped. Texts of any length are read whole.
    """
    own = {x.split()[0] for x in COLUMNS.split(", ")}
    rest = without(docs if keep is None else docs.select(*keep), own)
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias(own_name(rest, "__judged")), *[F.col(f"`{c}`") for c in rest.columns])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return given.mapInArrow(_rules, f"{fields}, {COLUMNS}" if fields else COLUMNS)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with all their columns, whatever these are called.

    A null or empty text has no words and goes; repeated rows are judged alike, so all of them
    stay or go; an empty table gives an empty one.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    return quality_rules(rows, keep=["row"]).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
