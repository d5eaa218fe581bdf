"""Grading results against expectations, and the figures of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


EXPECTED = "schema_version int, fields array<struct<label_id: string, field: string, allowed: array<string>, elevated: boolean>>"


def load_expected(spark: SparkSession, path: str, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """Ground truth from JSON files; reading one whose schema_version isn't among versions, or has none, fails."""
    raw = spark.read.schema(EXPECTED).json(path, multiLine=True)
    known = F.coalesce(F.col("schema_version").isin(*versions), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("unknown schema_version: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))).cast("array<struct<label_id: string, field: string, allowed: array<string>, elevated: boolean>>")
    return raw.select(F.explode(F.when(known, F.col("fields")).otherwise(refuse)).alias("f")).select("f.*")


def grade(results: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: label_id, field, allowed (array), elevated (null: either), compliance; one row per pair.

    correct: an allowed verdict, elevated as stated. false_negative: MATCH where it isn't allowed.
    false_flag: a compliant label's field that must match and doesn't.
    """
    both = expected.withColumnRenamed("elevated", "want_elevated").join(results, ["label_id", "field"], "left")
    ok = F.array_contains("allowed", F.col("verdict")) & (F.col("want_elevated").isNull() | (F.col("want_elevated") == F.col("elevated")))
    must = F.array_contains("allowed", "MATCH")
    return both.select(
        "label_id", "field", "compliance", "verdict", "automated",
        F.coalesce(ok, F.lit(False)).alias("correct"),
        F.coalesce((F.col("verdict") == "MATCH") & ~must, F.lit(False)).alias("false_negative"),
        F.coalesce((F.col("compliance") == "compliant") & must & (F.size("allowed") == 1) & (F.col("verdict") != "MATCH"), F.lit(False)).alias("false_flag"),
        (~must).alias("violation"),
    )


def compliance(expected: DataFrame) -> DataFrame:
    """compliant: all fields exactly MATCH; non_compliant: some field may not MATCH; else judgment."""
    only = (F.size("allowed") == 1) & F.array_contains("allowed", "MATCH")
    return expected.groupBy("label_id").agg(F.when(F.bool_and(only), "compliant").when(F.bool_or(~F.array_contains("allowed", "MATCH")), "non_compliant").otherwise("judgment").alias("compliance"))


def accuracy(graded: DataFrame) -> DataFrame:
    """Per field: graded, checked, unchecked, correct, errors."""
    automated = F.coalesce("automated", F.lit(False))
    return graded.groupBy("field").agg(
        F.count(F.lit(1)).alias("graded"), F.count_if(automated).alias("checked"), F.count_if(~automated).alias("unchecked"),
        F.count_if(automated & F.col("correct")).alias("correct"), F.count_if(automated & ~F.col("correct")).alias("errors"),
    )


def missed(graded: DataFrame) -> DataFrame:
    """One row: fields missed and flagged; labels whose violations all passed."""
    per = graded.groupBy("label_id").agg(F.bool_and(F.when(F.col("violation"), F.col("verdict") == "MATCH")).alias("all_passed"))
    a = graded.agg(F.count_if("violation").alias("violations"), F.count_if("false_negative").alias("false_negatives"), F.count_if("false_flag").alias("false_flags"))
    return a.crossJoin(per.agg(F.count_if(F.coalesce("all_passed", F.lit(False))).alias("labels_missed")))


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def inversions(ranked: DataFrame, partition: str | None = None) -> DataFrame:
    """Pairs ranked wrongly: compliant labels that stand before a non-compliant one.

    With a partition, counted in each. Without, pairs are counted from positions: with N
    non-compliant labels of rank sum R, N(N+1)/2 fewer than R are compliant ones ahead of them; no
    window over everything is needed.
    """
    bad = F.col("compliance") == "non_compliant"
    graded = ranked.filter(F.col("compliance").isin("compliant", "non_compliant"))
    if partition:
        w = Window.partitionBy(partition).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = graded.withColumn("ahead", F.sum(F.when(bad, 0).otherwise(1)).over(w))
        return seen.groupBy(partition).agg(F.coalesce(F.sum(F.when(bad, F.col("ahead"))), F.lit(0)).alias("inversions"))
    from veritrail.operators.triage import global_rank

    placed = global_rank(graded.withColumnRenamed("rank", "__r"), [F.col("__r").asc()])
    sums = placed.agg(F.coalesce(F.sum(F.when(bad, F.col("rank"))), F.lit(0)).alias("r"), F.count_if(bad).alias("n"))
    return sums.select((F.col("r") - F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("inversions"))


def tier_mix(ranked: DataFrame, tiers: DataFrame) -> DataFrame:
    """tier by compliance with totals; tiers without labels have zeros."""
    kinds = ["compliant", "non_compliant", "judgment"]
    got = ranked.groupBy("tier").pivot("compliance", kinds).count()
    filled = tiers.join(got, "tier", "left").na.fill(0, kinds)
    return filled.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))


def per_minute(count: Column, milliseconds: Column) -> Column:
    return F.when(milliseconds > 0, count * 60000.0 / milliseconds)


def load_verdict(samples: Column, p95_seconds: Column) -> Column:
    return F.when(samples < 3, "INCONCLUSIVE").when(p95_seconds < 5, "PASS").otherwise("FAIL")


def readings(text: str, top: str, left: str, name: str = "readings") -> Column:
    """Aggregate: quoted texts in reading order, joined by commas."""
    return F.expr(f"""listagg(concat('"', `{text}`, '"'), ', ') WITHIN GROUP (ORDER BY `{top}`, `{left}`, concat('"', `{text}`, '"'))""").alias(name)
