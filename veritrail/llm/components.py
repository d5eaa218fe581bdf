"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import forget, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or its smaller) neighbours on its smallest one."""
    both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
    if large:
        both = both.unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("top"))
    hung = both.join(least, "n")
    if large:
        out = hung.filter("m > n").select(F.col("m").alias("hi"), F.col("top").alias("lo"))
    else:
        out = hung.select(F.col("m").alias("hi"), F.col("top").alias("lo")).unionByName(least.select(F.col("n").alias("hi"), F.col("top").alias("lo")))
    return out.filter("hi <> lo").distinct()


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, root for every node of links (a, b): root is the smallest node of its component.

    Every round is a fixed number of shuffles over at most twice the links and is written to the
    shared folder, so a lost executor repeats one round at most. Rounds grow with the logarithm of
    the longest path. Nothing but the count of changed rows comes to the driver.
    """
    now = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = materialise(now, "stars")
    before = None
    for _ in range(most_rounds):
        new = materialise(_star(_star(now, True), False), "stars")
        # stars: each node hangs on one root that hangs on nothing
        open_ends = new.groupBy("hi").count().filter("count > 1").limit(1).count() or new.join(new.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()
        same = not open_ends
        if before is not None:
            forget(before)
        before, now = now, new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
