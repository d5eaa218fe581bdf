"""A corpus through five stages, each written and read again: run(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrail.llm.bpe import tokenise
from veritrail.llm.common import forget, materialise, table
from veritrail.llm.decontaminate import drop_contaminated
from veritrail.llm.passage_dedup import cut_repeats
from veritrail.llm.quality_rules import keep_good
from veritrail.llm.simhash import keep_one

STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", keep_one),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", tokenise),
]

#: zstandard ratios, XXH64 fingerprints and BPE merges aren't in SQL; tests use plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(*before)
        before = [docs]
    return docs
