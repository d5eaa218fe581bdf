"""Line hashing: of equal lines anywhere, the earliest ranked one stays. See passage_dedup for op10."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import materialise, without
from veritrail.llm.wordarrays import LOWER_TABLE

#: Least words of a line that counts as a unit; 1 takes every line with a word. Stock phrases of 8
#: to 13 words end many lines of otherwise different texts: counted on sf0.1, of the texts that share
#: no run of 50 words with another, lines of 8 and more change 31 %, of 12 and more 7 %, of 14 to 20
#: and more 2 %, and most of these repeat a line of their own.
MIN_WORDS = 16
SPAN = "struct<start: int, end: int>"
#: A text's id and hash: two texts under one id are two texts.
KEY = ("unit_doc", "unit_text")


def normalised(line: bytes) -> bytes:
    """A-Z as a-z, white space at the ends dropped and runs of it made one space."""
    return b" ".join(line.translate(LOWER_TABLE).split())


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, no, begin, end, digest = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                at = 0
                for k, line in enumerate((text or "").split("\n")):
                    unit = normalised(line.encode())
                    if unit and unit.count(b" ") + 1 >= min_words:
                        of.append(row)
                        no.append(k)
                        begin.append(at)
                        end.append(at + len(line))
                        digest.append(hashlib.blake2b(unit, digest_size=16).digest())
                    at += len(line) + 1
            row = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(no, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())],
                [*KEY, "unit_no", "start", "end", "digest"],
            )

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """unit_doc, unit_text, text, row: the other columns are in the struct row, where no name can clash."""
    text = F.col(f"`{text_col}`").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias(KEY[0]), F.xxhash64(text).alias(KEY[1]), text.alias("text"), F.struct(*others).alias("row"))


def restored(done: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns as docs had them, then removed and kept."""
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns], "removed", "kept")


def units(given: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """unit_doc, unit_text, unit_no, start, end (characters), digest: the lines of min_words words or more of keyed() texts."""
    usable = given.filter("unit_doc is not null and text is not null").select(*KEY, "text")
    return usable.mapInArrow(_units(min_words), "unit_doc long, unit_text long, unit_no int, start int, end int, digest binary")


def removed_spans(given: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """unit_doc, unit_text, removed: per text the spans of lines that an earlier (id, text hash, line number) holds.

    The second value are the written tables that the first one reads.

    Digests are counted and their first rank found with a map-side aggregate, so a line that a
    third of all texts share costs one row per task. Only digests met twice are joined back; Spark
    splits such a join where one digest has most rows.
    """
    rank = F.struct(*KEY, "unit_no")
    lines = materialise(units(given, min_words), "units")
    first = lines.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # written, so that both sides of the join are exchanged for it and Spark can split a common line
    first = materialise(first, "first")
    later = lines.join(first, "digest").filter(rank > F.col("first"))
    return later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed")), [lines, first]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated lines cut from text_col, plus removed and kept (spans of the original).

    Spans count characters; kept are the remaining lines with the original offsets, removed the
    lines taken out. Lines stand between \\n; the remaining ones are joined by \\n again. The rank
    of a line is (id, text hash, line number). Rows with a null id or text are returned as they are
    and claim no line. Rows that repeat id and text have the same rank: each loses the lines that
    the text loses. Two texts under one id lose each its own. An empty table gives an empty result;
    input columns named removed or kept are dropped, others may have any name.
    """
    rest = without(docs, {"removed", "kept"})
    return restored(lines_cut(keyed(rest, id_col, text_col), min_words)[0], rest.columns, text_col)


def lines_cut(given: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """keyed() texts without their repeated lines, removed and kept; and the written tables that it reads, to forget once its result is written."""
    gone, written = removed_spans(given, min_words)
    joined = given.join(gone, list(KEY), "left").select("text", "removed", *KEY, "row")
    row = given.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"text string, removed array<{SPAN}>, kept array<{SPAN}>, unit_doc long, unit_text long, row {row}"), written


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts, removed, kept = [], [], []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out = {(g["start"], g["end"]) for g in gone or ()}
            at, stays = 0, []
            for line in (text or "").split("\n") if text is not None else ():
                if (at, at + len(line)) not in out:
                    stays.append({"start": at, "end": at + len(line)})
                at += len(line) + 1
            texts.append("\n".join([text[s["start"] : s["end"]] for s in stays]) if out else text)
            removed.append(gone or [])
            kept.append(stays)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed, span), pa.array(kept, span), *batch.columns[2:]], [batch.schema.names[0], "removed", "kept", *batch.schema.names[2:]])
