"""Labels of all parts: those that print the same are read once, and their spans counted in the label's row."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from veritrail import catalogue
from veritrail.functions import geometry as G
from veritrail.operators import spans as S
from veritrail.sources.shelf import shelf

PART = "p_partkey long, p_name string, p_size int"
PLAIN = [(k + 30 * n, "old plate", 7 + 10 * (n % 3)) for n in range(5) for k in (0, 3, 5, 6, 8)] + [(99, "large hot ring", 4)]
# keys that stand for several parts, for two equal ones, for a part of no name or size; parts without a key
ODD = [(7, "old plate", 3), (7, "small bolt", 12), (37, "old plate", 3), (11, "red", 1), (11, "red", 1), (41, "red", 1), (-3, " x", -7), (13, None, 8), (14, "", None), (None, "a b", 3), (None, "a b", 3)]


def recount(words):
    """The counts from a row for each span, as span_index makes them."""
    strength = words.filter("line_no = 2").groupBy("label_id").agg(F.array(G.union_agg(F.col("box"))).alias("masks"))
    spans = S.span_index(words).join(strength.withColumnRenamed("label_id", "own"), F.col("label_id").eqNullSafe(F.col("own")), "left")
    free, n = F.coalesce(S.unmasked(F.col("box"), F.col("masks")), F.lit(True)), F.size("lines")
    return spans.groupBy("label_id").agg(F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("several"), F.count(F.lit(1)).alias("candidates"), F.count_if(free).alias("free"))


@pytest.mark.parametrize("name", ["mask_trace", "span_families"])
def test_labels_that_print_the_same_are_read_once(spark, monkeypatch, tmp_path, name):
    read, pages = [], S.pages
    monkeypatch.setattr(S, "pages", lambda words, *more: read.append(words.select("label_id").distinct().count()) or pages(words, *more))
    spark.createDataFrame(PLAIN, PART).write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert read == [6]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name, columns", [("mask_trace", ("candidates", "free")), ("span_families", ("single", "several"))])
def test_every_key_has_one_label(spark, tmp_path, name, columns):
    part = spark.createDataFrame(PLAIN + ODD, PART)
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select("label_id", *columns).collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in recount(shelf(part)[1]).select("label_id", *columns).collect()), key=repr)
    assert len(got) == len({k for k, _, _ in PLAIN + ODD})


def test_counts_in_the_row_equal_those_of_single_spans(spark):
    box = lambda n, k: (10.0 * k, 40.0 * n, 10.0 * k + 8, 40.0 * n + 20)
    texts = {"a": ["OLD TOM", "-- GIN 45%", "* ..."], "b": ["---", "..."], "c": ["x y", "z", "w", "v"]}
    rows = [(label, n, k, w, 0.9, box(n, k)) for label, lines in texts.items() for n, line in enumerate(lines) for k, w in enumerate(line.split())]
    rows += [("d", 0, 0, None, 0.9, box(0, 0)), ("d", 0, 1, "OLD", 0.9, None), (None, 0, 0, "X", None, box(0, 0))]
    words = spark.createDataFrame(rows, "label_id string, line_no int, word_no int, text string, confidence double, box struct<left: double, top: double, right: double, bottom: double>")
    masks = words.filter("label_id <> 'c'").groupBy("label_id").agg(F.array(F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(9.0).alias("right"), F.lit(30.0).alias("bottom"))).alias("masks"))
    every = S.span_index(words).join(masks, "label_id", "left").withColumn("is_free", F.coalesce(S.unmasked(F.col("box"), F.col("masks")), F.lit(True)))
    want = every.groupBy("label_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_free").alias("free"))
    got = S.candidate_trace(words, masks)
    assert got.dtypes == [("label_id", "string"), ("candidates", "bigint"), ("free", "bigint")]
    got = {tuple(r) for r in got.collect()}
    assert got == {tuple(r) for r in want.collect()} and {r[0] for r in got} == {"a", "c", "d", None} and any(f < c for _, c, f in got)


def test_no_mask_is_sent_to_all_executors(spark):
    words = shelf(spark.range(40).selectExpr("id AS p_partkey", "'old plate' AS p_name", "7 AS p_size"))[1]
    masks = words.groupBy("label_id").agg(F.array(G.union_agg(F.col("box"))).alias("masks"))
    plan = S.candidate_trace(words, masks)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
