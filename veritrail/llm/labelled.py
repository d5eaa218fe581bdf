"""Bounded samples of labelled rows for the trained models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import id_crc


#: Bytes of text that the sample of one class takes; the text that passes the bound is its last one, whole.
SAMPLE_BYTES = 8 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, each: int, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """text and label (0 or 1) of up to `each` labelled rows of either class, whole texts of any length.

    Rows are taken in the order of a hash of doc_id, so the sample is the same in every run and
    knows no lengths. Both bounds are parameters. Rows with a null label are left out before
    anything is counted; labels without a text take their place and give none; an id met twice
    gives one row.
    """
    marks = labels.filter(allowed & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = [marks.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0))).filter(F.col("before") <= most_bytes)
    return taken.select("doc_id", "text", "label").toPandas().sort_values("doc_id").reset_index(drop=True)


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(id_crc("doc_id"), F.lit(modulus)) == remainder
