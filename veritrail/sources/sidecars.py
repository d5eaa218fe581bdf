"""Recognised pages: JSON sidecars, inline lines and recogniser detections to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import geometry as G
from veritrail.schemas import SIDECAR

SUFFIX = ".ocr.json"
DEFAULT_CONFIDENCE, DEFAULT_WIDTH, DEFAULT_HEIGHT = 0.98, 1000, 1400
MIN_CONFIDENCE = 0.30


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """parse_pages() of the sidecars in a folder; label_id is the image's file name."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{SUFFIX}")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.ocr\.json$", "")
    return parse_pages(raw.select(F.url_decode(name).alias("label_id"), F.col("value").alias("document")))


def parse_pages(documents: DataFrame) -> DataFrame:
    """label_id, width, height, quality, lines, fault of documents (label_id, document: JSON of a page).

    null quality: not assessed. A document that can't be used has a fault, the first of those told
    here, and no lines: it is an unreadable item and stops no other. Null documents are unreadable.
    """
    page = F.from_json("document", f"{SIDECAR}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    parsed = documents.select("label_id", page.alias("p"))
    words = F.flatten(F.transform("p.lines", lambda x: F.coalesce(x["words"], F.array())))
    lost = lambda w: w.isNull() | w["text"].isNull() | w["left"].isNull() | w["top"].isNull() | w["width"].isNull() | w["height"].isNull()
    fault = (
        F.when(F.col("p").isNull() | F.col("p.broken").isNotNull(), "the page is no readable document")
        .when(F.col("p.lines").isNull(), "the page has no lines")
        .when(F.exists("p.lines", lambda x: x.isNull()) | F.exists(words, lost), "a word lacks its text or place")
        .when(F.exists(words, lambda w: (w["width"] < 0) | (w["height"] < 0)), "a word has a negative size")
        .when((F.coalesce("p.width", F.lit(1)) <= 0) | (F.coalesce("p.height", F.lit(1)) <= 0), "the page has no size")
    )
    kept = parsed.withColumn("fault", fault)
    lines = F.when(F.col("fault").isNull(), F.col("p.lines")).otherwise(F.array().cast(kept.select("p.lines").schema["lines"].dataType))
    return kept.select("label_id", F.coalesce("p.width", F.lit(DEFAULT_WIDTH)).alias("width"), F.coalesce("p.height", F.lit(DEFAULT_HEIGHT)).alias("height"), "p.quality", lines.alias("lines"), "fault")


def unreadable(pages: DataFrame, records: DataFrame) -> DataFrame:
    """label_id, error of records whose page has a fault or isn't there."""
    told = records.select("label_id").join(pages.select("label_id", "fault", F.lit(True).alias("there")), "label_id", "left")
    return told.select("label_id", F.when(F.col("there").isNull(), "there is no recognised page").otherwise(F.col("fault")).alias("error")).filter("error is not null")


def words_of(pages: DataFrame) -> DataFrame:
    """One row per word: label_id, line_no, word_no, text, confidence, box."""
    lines = pages.select("label_id", F.posexplode("lines").alias("line_no", "line"))
    words = lines.select("label_id", "line_no", F.posexplode("line.words").alias("word_no", "w"))
    return words.select("label_id", "line_no", "word_no", "w.text", F.coalesce("w.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), G.from_wire(F.col("w")).alias("box"))


def labels_of(pages: DataFrame) -> DataFrame:
    return pages.select("label_id", "width", "height", "quality")


def broken_pages(pages: DataFrame) -> DataFrame:
    """Pages with a line that has no words: an assertion query, zero rows when all is well."""
    return pages.filter(F.exists("lines", lambda line: F.size(F.coalesce(line["words"], F.array())) == 0)).select("label_id")


def inline_labels(words: DataFrame, margin: float = 1.1) -> DataFrame:
    """Labels for words given without a page: sizes from the content's extent, quality unassessed."""
    extent = words.groupBy("label_id").agg((F.max("box.right") * margin).cast("int").alias("width"), (F.max("box.bottom") * margin).cast("int").alias("height"))
    return extent.withColumn("quality", F.lit(None).cast("struct<usable: boolean, score: double, issues: array<string>, guidance: array<string>, metrics: map<string, double>>"))


def detections(rows: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Recogniser output (label_id, line_no, text, confidence, corners) to word rows.

    Blank, faint and flat detections go; a line's box is shared out to its words by characters,
    a space counting as one.
    """
    boxed = rows.withColumn("line", G.quad_box(F.col("corners")))
    good = boxed.filter((F.col("confidence") >= least) & (F.trim("text") != "") & (G.area(F.col("line")) > 0))
    pieces = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    total = F.aggregate(pieces, F.lit(0), lambda a, t: a + F.char_length(t)) + F.size(pieces) - 1
    before: Column = F.transform(pieces, lambda t, i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.char_length(x) + 1))
    split = good.select("label_id", "line_no", "confidence", "line", total.alias("units"), F.posexplode(F.arrays_zip(pieces.alias("text"), before.alias("at"))).alias("word_no", "w"))
    unit = G.width(F.col("line")) / F.col("units")
    left = F.col("line.left") + unit * F.col("w.at")
    return split.select("label_id", "line_no", "word_no", F.col("w.text").alias("text"), "confidence", G.box(left, F.col("line.top"), left + unit * F.char_length("w.text"), F.col("line.bottom")).alias("box"))
