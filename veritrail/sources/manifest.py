"""Batch manifests: CSV bytes to records with their ordinal, then validated rows.

A record's number counts blank records and the header, and a quoted cell may hold a line break,
so files are read whole as binary and parsed in the task that has them; files are small (2,000
records at most), many files spread over tasks.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators.triage import global_rank

# Columns, classes, limits, image suffixes and clutter of manifests.
REQUIRED = ("filename", "brand_name", "class_type", "alcohol_content", "net_contents")
OPTIONAL = ("beverage_class", "label_width_mm")
COLUMNS = REQUIRED + OPTIONAL
CLASSES = ("distilled_spirits",)
MOST_RECORDS, MOST_CELL = 2000, 1000
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
CLUTTER = (".ds_store", "thumbs.db", "desktop.ini")
RECORD = "manifest string, row_number int, cells array<string>, problem string"


def decode(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, data in zip(pdf["manifest"], pdf["content"]):
            for n, cells in enumerate(csv.reader(io.StringIO(decode(bytes(data)), newline="")), 1):
                problem = "too many records" if n > MOST_RECORDS + 1 else "cell too long" if any(len(c) > MOST_CELL for c in cells) else None
                rows.append((path, n, cells, problem))
        yield pd.DataFrame(rows, columns=["manifest", "row_number", "cells", "problem"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("manifest"), "content")
    return files.mapInPandas(_records, RECORD)


def header_name(c):
    """Case, outer blanks and runs of blanks or hyphens don't matter in headings."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), "^_+|_+$", "")


def basename(c):
    return F.regexp_extract(F.trim(c), r"[^\\/]*$", 0)


def is_clutter(c):
    low = F.lower(basename(c))
    return low.isin(*CLUTTER) | F.startswith(low, F.lit("._"))


def is_image(c):
    return F.regexp_extract(F.lower(basename(c)), r"^.+(\.[^.]+)$", 1).isin(*SUFFIXES)


def width_mm(c):
    """A width in millimetres; "mm" and thousands commas are allowed. Null if it can't be read."""
    v = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\s*mm$", ""), ",", "").try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


def parse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the manifest and its issues (kind, filename, row_number, message).

    The first record with content is the header; columns may come in any order, unknown ones are
    left out and of equal headings the first one counts. Blank records keep their number.
    """
    filled = records.filter(F.exists("cells", lambda c: F.trim(c) != ""))
    head = filled.groupBy("manifest").agg(F.min(F.struct("row_number", "cells")).alias("h")).select("manifest", F.col("h.row_number").alias("head_row"), F.transform("h.cells", header_name).alias("names"))
    body = filled.join(head, "manifest").filter(F.col("row_number") > F.col("head_row"))
    cell = lambda n: F.coalesce(F.trim(F.get(F.col("cells"), F.array_position("names", n).cast("int") - 1)), F.lit(""))
    # array_position gives 0 for a missing column; get(-1) is null, so the cell is blank
    read = body.select("manifest", "row_number", *[cell(n).alias(n) for n in COLUMNS])
    blank = F.array_compact(F.array(*[F.when(F.col(n) == "", F.lit(n.replace("_", " "))) for n in REQUIRED]))
    file = basename(F.col("filename"))
    kind = F.when(F.col("beverage_class") == "", F.lit(CLASSES[0])).otherwise(F.col("beverage_class"))
    problems = F.array_compact(
        F.array(
            F.when(F.size(blank) > 0, F.concat(F.lit("blank: "), F.array_join(blank, ", "))),
            F.when((F.col("filename") != "") & (file == ""), F.concat(F.lit('a folder, not a file: "'), F.col("filename"), F.lit('"'))),
            F.when(~kind.isin(*CLASSES), F.concat(F.lit('unsupported beverage class: "'), kind, F.lit('"'))),
            F.when((F.col("label_width_mm") != "") & width_mm(F.col("label_width_mm")).isNull(), F.concat(F.lit('unreadable width: "'), F.col("label_width_mm"), F.lit('"'))),
        )
    )
    judged = read.withColumn("problems", problems).withColumn("file", file).withColumn("kind", kind)
    missing = head.select("manifest", F.explode(F.array_except(F.array(*[F.lit(n) for n in REQUIRED]), "names")).alias("column"))
    rows = judged.filter(F.size("problems") == 0).join(missing.select("manifest").distinct(), "manifest", "left_anti").select(
        "manifest", "row_number", F.col("file").alias("filename"), "brand_name", "class_type", "alcohol_content", "net_contents", F.col("kind").alias("beverage_class"), width_mm(F.col("label_width_mm")).alias("label_width_mm")
    )
    bad = judged.filter(F.size("problems") > 0).join(missing.select("manifest").distinct(), "manifest", "left_anti").select(
        "manifest", F.lit("invalid_row").alias("kind"), F.when(F.col("file") != "", F.col("file")).alias("filename"), "row_number", F.array_join("problems", "; ").alias("message")
    )
    absent = missing.select("manifest", F.lit("missing_column").alias("kind"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("int").alias("row_number"), F.concat(F.lit("no column "), "column").alias("message"))
    return rows, bad.unionByName(absent)


def template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("label_front.png", "OLD TOM DISTILLERY", "Kentucky Straight Bourbon Whiskey", "45% Alc./Vol.", "750 mL", "distilled_spirits", "")], ", ".join(f"{c} string" for c in COLUMNS))


def cycled(spark: SparkSession, corpus: DataFrame, n: int, order_by: str = "filename") -> DataFrame:
    """n rows that repeat a corpus in turn under new names b0001_..., for load tests."""
    numbered = global_rank(corpus, [F.col(order_by).asc()]).withColumn("__k", F.col("rank") - 1).drop("rank")
    size = corpus.count()
    turns = spark.range(n).withColumn("__k", F.col("id") % size)
    return turns.join(numbered, "__k").withColumn(order_by, F.concat(F.format_string("b%04d_", F.col("id") + 1), F.col(order_by))).drop("__k", "id")
