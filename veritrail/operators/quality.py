"""Image quality from pixel counts: ink and paper apart, resolution, one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATION_REFERENCE, EDGE_REFERENCE, USABLE = 170.0, 1600.0, 0.35


def separation(histogram: DataFrame) -> DataFrame:
    """Per image, the distance of the mean grey of its two classes at the best split (Otsu).

    histogram: image_id, level (0-255), n; at most 256 rows an image, so a window holds them.
    """
    w = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    run = histogram.select("image_id", "level", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("level")).over(w).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    gap = F.when(w1 > 0, s1 / w1 - F.col("s0") / F.col("w0"))
    split = run.withColumn("gap", gap).withColumn("between", F.col("w0") * w1 * F.pow(gap, 2))
    return split.groupBy("image_id").agg(F.coalesce(F.max_by("gap", F.struct("between", -F.col("level"))), F.lit(0.0)).alias("separation"))


def assess(separation_: Column, width: Column, height: Column, reference: float = SEPARATION_REFERENCE, edge: float = EDGE_REFERENCE) -> Column:
    contrast = F.least(F.lit(1.0), separation_ / reference)
    resolution = F.least(F.lit(1.0), F.greatest(width, height) / edge)
    score = F.round(0.6 * contrast + 0.4 * resolution, 3)
    issues = F.array_compact(F.array(F.when(contrast < 0.5, F.lit("low_contrast")), F.when(resolution < 0.5, F.lit("low_resolution"))))
    return F.struct((score >= USABLE).alias("usable"), score.alias("score"), issues.alias("issues"), F.create_map(F.lit("ink_paper_separation"), F.round(separation_, 2), F.lit("width"), width.cast("double"), F.lit("height"), height.cast("double")).alias("metrics"))
