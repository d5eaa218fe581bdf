"""Labels that are alike: what is printed and what is applied for, once for all labels that share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = (1, 2)


def _prints(words: DataFrame) -> DataFrame:
    """label_id, __print: 128 bits of each label's words, in whatever order they come; a word told twice counts twice."""
    parts = [F.col(c) for c in ("line_no", "word_no", "text", "confidence", "box.left", "box.top", "box.right", "box.bottom")]
    # a hash passes over nulls, so where they stand is hashed as well, a bit for each
    nulls = sum((F.when(c.isNull(), 1 << k).otherwise(0) for k, c in enumerate((*parts, F.col("box")))), F.lit(0))
    hashed = words.select("label_id", *[F.xxhash64(F.lit(salt), *parts, nulls).alias(f"h{salt}") for salt in SALTS])
    halves: list[Column] = []
    for salt in SALTS:
        # sums of halves don't overflow
        halves += [F.sum(F.col(f"h{salt}").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(f"h{salt}", 32))]
    return hashed.groupBy("label_id").agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), *[h.cast("string") for h in halves]).alias("__print"))


def designs(labels: DataFrame, words: DataFrame, records: DataFrame) -> DataFrame:
    """Records with quality, __page, equal for labels of one quality and equal words, and __design, for records as well that differ in label_id alone.

    Words are equal by 128 bits of hashes and their number, the rest by its SHA-256.
    """
    # a small file may hold many labels, so sizes that Spark takes from it would send whole tables to all executors
    rows = records.join(labels.select("label_id", "quality").hint("merge"), "label_id", "left").join(_prints(words).hint("merge"), "label_id", "left")
    told = F.to_json(F.struct(*[c for c in rows.columns if c != "label_id"]))
    page = F.to_json(F.struct("quality", "__print"))
    return rows.withColumn("__design", F.sha2(told, 256)).withColumn("__page", F.sha2(page, 256)).drop("__print")
