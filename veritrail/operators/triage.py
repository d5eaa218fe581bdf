"""Worst-first ranking of labels, snapshots of batches, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.schemas import TIERS
from veritrail.scratch import materialise


def summarise(field_results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per label: tier, counts, lowest score and the headline of its most severe field.

    field_results: label_id, field, display_order, verdict, score, elevated, automated, reason;
    errors: label_id, error of labels that could not be read. A field that is not automated counts
    as unchecked only. The headline is the first field, in display order, of the worst kind.
    """
    mismatch = F.col("verdict") == "MISMATCH"
    elevated = (F.col("verdict") == "REVIEW") & F.col("elevated")
    review = (F.col("verdict") == "REVIEW") & ~F.col("elevated") & F.col("automated")
    unchecked = ~F.col("automated")
    text = F.concat("field", F.lit(": "), "reason")
    lead = lambda c: F.min_by(F.when(c, text), F.when(c, F.col("display_order")))
    counts = field_results.groupBy("label_id").agg(
        F.count_if(mismatch).alias("mismatches"), F.count_if(elevated).alias("elevated"), F.count_if(review).alias("reviews"), F.count_if(unchecked).alias("unchecked"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("lowest_score"), F.coalesce(lead(mismatch), lead(elevated), lead(review), lead(unchecked)).alias("headline"),
    )
    out = counts.withColumn("tier", tier_of())
    if errors is not None:
        zero = F.lit(0).cast("long")
        failed = errors.select("label_id", *[zero.alias(c) for c in ("mismatches", "elevated", "reviews", "unchecked")], F.lit(0.0).alias("lowest_score"), F.col("error").alias("headline"), F.lit(TIERS["UNREADABLE"]).alias("tier"))
        out = out.unionByName(failed)
    return out


def verdict_counts(field_results: DataFrame) -> DataFrame:
    """label_id, matches, to_review, mismatches: a label's fields by verdict."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return field_results.groupBy("label_id").agg(of("MATCH").alias("matches"), of("REVIEW").alias("to_review"), of("MISMATCH").alias("mismatches"))


def tier_of() -> Column:
    t = TIERS
    return (
        F.when(F.col("mismatches") > 0, t["ASSERTED"]).when(F.col("elevated") > 0, t["MISSING_MANDATORY"])
        .when(F.col("reviews") > 0, t["REVIEW"]).when(F.col("unchecked") > 0, t["UNCHECKED"]).otherwise(t["CLEAR"])
    )


def worst_first(name: str = "label_id") -> list[Column]:
    problems = F.col("mismatches") + F.col("elevated") + F.col("reviews") + F.col("unchecked")
    return [F.col("tier").asc(), problems.desc(), F.col("lowest_score").asc(), F.lower(F.col(name)).asc(), F.col(name).asc()]


def worklist(summary: DataFrame, batch: str | None = None, name: str = "label_id") -> DataFrame:
    """summary with its rank; within each batch if one is named (a batch's labels then sort in one
    task, batches spread), else over all, exactly, by a global sort and counts per partition."""
    if batch:
        return summary.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(*worst_first(name))).cast("long"))
    return global_rank(summary, worst_first(name))


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank 1, 2, ... over a total order, without sorting everything in one task.

    A range exchange sorts; each partition counts its rows; the counts before a partition, one row
    for each partition, are added to the place within it.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # written once: computed twice, the bounds of the ranges and with them the places could differ
    tagged = materialise(by.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "ranked")
    sized = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sized.select("__part", "__first", before.alias("__before"))
    # as many rows as partitions
    return tagged.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before")


def category() -> Column:
    """attention, clear, pending or unchecked, of an item's state and needs_attention; unknown needs attention."""
    return (
        F.when(F.col("state") == "skipped", "unchecked").when(F.col("state").isin("pending", "running"), "pending")
        .when(F.col("needs_attention").eqNullSafe(F.lit(False)), "clear").otherwise("attention")
    )


def keep_polling(batch_state: Column, item_states: Column) -> Column:
    return batch_state.isin("queued", "running") | ((batch_state == "cancelled") & F.exists(item_states, lambda s: s == "running"))


def neighbours(ranked: DataFrame, key: str, partition: str | None = None) -> DataFrame:
    """Previous and next key in a ranked queue: within a partition by any order, else by ranks 1, 2, ... without gaps.

    Without a partition the rows beside a rank are joined to it, so that no task holds the queue.
    """
    if partition:
        w = Window.partitionBy(partition).orderBy("rank")
        return ranked.select("*", F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"))
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col(key).alias("previous"))
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("next"))
    return ranked.join(before, "rank", "left").join(after, "rank", "left")


def only(ranked: DataFrame, wanted: str) -> DataFrame:
    """The items of one category (category()), still in the queue's order."""
    return ranked.filter(category() == wanted).orderBy("rank")


def snapshot_order(items: DataFrame) -> DataFrame:
    """items with their place in a batch's snapshot: checked ones worst first, then running, pending and skipped ones as uploaded.

    items: batch_id, state, upload_no, label_id and the columns of summarise(), null where nothing was checked.
    """
    group = F.when(F.col("tier").isNotNull(), 0).when(F.col("state") == "running", 1).when(F.col("state") == "pending", 2).otherwise(3)
    keys = [group.asc(), *worst_first(), F.col("upload_no").asc()]
    return items.withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy(*keys)).cast("long"))


def item(rows: DataFrame, **key) -> DataFrame:
    """The rows that have these values: a point lookup, pushed down to the scan."""
    for name, value in key.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def polled(field_results: DataFrame) -> DataFrame:
    """What a poll carries: no boxes, checks or texts; the rest is read on demand by item()."""
    return field_results.select("label_id", "field", "display_order", "verdict", "score", "elevated", "automated")


def snapshot(items: DataFrame) -> DataFrame:
    """Per batch: total, completed, failed, needs_attention, held bytes, by category.

    items: batch_id, state, needs_attention, bytes, released.
    """
    cat = category()
    return items.withColumn("cat", cat).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "done").alias("completed"), F.count_if(F.col("state") == "error").alias("failed"),
        F.count_if((F.col("state").isin("done", "error") & F.coalesce("needs_attention", F.lit(True))) | (F.col("state") == "skipped")).alias("needs_attention"),
        F.coalesce(F.sum(F.when(~F.col("released"), F.col("bytes"))), F.lit(0)).alias("held_bytes"),
        *[F.count_if(F.col("cat") == c).alias(f"n_{c}") for c in ("attention", "clear", "pending", "unchecked")],
    )


def remaining_seconds(elapsed: Column, finished: Column, total: Column, over: Column) -> Column:
    """Elapsed time per finished item times the rest; null before the first one, 0 when over."""
    return F.when(over, F.lit(0.0)).when(finished > 0, elapsed / finished * (total - finished))


def retry_after(longest_remaining: Column) -> Column:
    # greatest() passes over nulls, so an unknown wait is told apart first
    return F.when(longest_remaining.isNull(), F.lit(60)).otherwise(F.least(F.lit(600), F.greatest(F.lit(30), F.ceil(longest_remaining))))


def evictable(batches: DataFrame, capacity: int = 20) -> DataFrame:
    """The finished batches to drop, oldest first, to come back under capacity."""
    over = batches.count() - capacity + 1
    ranked = global_rank(batches.filter("finished_at is not null"), [F.col("finished_at").asc(), F.col("batch_id").asc()])
    return ranked.filter(F.col("rank") <= max(over, 0)).drop("rank")


def first_messages(messages: Column, most: int = 3) -> Column:
    more = F.size(messages) - most
    shown = F.array_join(F.slice(messages, 1, most), "; ")
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)
