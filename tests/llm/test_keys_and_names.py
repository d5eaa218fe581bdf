"""Two texts under one id; columns whose names operators use themselves."""

from __future__ import annotations

import pytest

pytest.importorskip("veritrail.llm")

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from veritrail.llm.bpe import encode_texts, round_trip
from veritrail.llm.passage_dedup import cut_repeats, dedup_passages
from veritrail.llm.quality_rules import keep_good, quality_rules
from veritrail.llm.sharding import histogram_shards
from veritrail.llm.simhash import keep_one
from veritrail.llm.substring_dedup import dedup_lines

SHARED = " ".join(f"shared{i}" for i in range(20))
OWN = " ".join(f"unique{i}" for i in range(20))
#: same length as SHARED's line, so that offsets alone can't tell the two apart
SAME_LENGTH = OWN[: len(SHARED)].ljust(len(SHARED), "x")
NAMES = ("__before", "__rank", "__judged", "__encoded", "unit_doc", "unit_text", "unit_no", "places", "starts", "digest", "first", "n", "h", "h2", "pos", "row", "removed", "kept", "n_words", "__keep_one_nth", "stay_id", "fp", "text_key", "rest", "unit", "shard", "slot", "ids", "n_tokens")


@pytest.mark.parametrize("cut", [dedup_lines, dedup_passages])
def test_a_text_keeps_its_own_line_under_a_shared_id(spark, cut):
    rows = [(1, SHARED + "\nfirst end"), (2, SHARED + "\nsecond end"), (2, SAME_LENGTH + "\nthird end")]
    got = {r["text"] for r in cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {SHARED + "\nfirst end", "second end", SAME_LENGTH + "\nthird end"}


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def given(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60)), "en", "web", 1) for i in range(12)]
    return clashing(spark, [*good, *good[:2], (None, good[3][1], "en", "web", 1), (20, None, None, None, None), (21, "", "en", "web", 0)]), clashing(spark, [])


def kept_columns(df):
    return {n: {r[n] for r in df.select(n).collect()} for n in NAMES if n in df.columns}


@pytest.mark.parametrize("stage", [keep_good, keep_one, cut_repeats])
def test_stages_pass_columns_of_any_name(spark, given, stage):
    full, empty = given
    out = stage(spark, full, "/root/testdata/sf0.001")
    assert out.columns == full.columns and out.count() > 0
    assert all(v == {f"mine {n}"} for n, v in kept_columns(out).items())
    assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_operators_pass_columns_of_any_name(spark, given):
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for full in given:
        n = full.count()
        for out in (histogram_shards(full, 3), quality_rules(full), encode_texts(full, file, pattern), round_trip(full, file, pattern, keep=("doc_id", "__encoded")), dedup_lines(full), dedup_passages(full)):
            assert out.count() == n
        last = dict(corpus_pipeline.STAGES)["byte-level bpe"](spark, full, "/root/testdata/sf0.001")
        assert last.count() == n and "__encoded" in last.columns
