"""What is too long or too short for any known designation is none, and isn't kept for the search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from veritrail.operators.vocabulary import near_forms, within_reach

TERMS = ["LONDON DRY GIN", "STRAIGHT RYE WHISKEY", "VODKA BRANDY"]


def test_no_text_that_reads_as_a_term_is_left_out(spark):
    rng = random.Random(5)
    texts = set(TERMS) | {" ".join(["WORD"] * 9), "GIN"}
    for _ in range(300):
        out = list(rng.choice(TERMS))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(out))
            out[k : k + rng.randint(0, 1)] = [rng.choice("AEIN ")] * rng.randint(0, 1)
        texts.add(" ".join("".join(out).split()))
    rows = spark.createDataFrame([(x,) for x in sorted(texts)], "text string")
    kept = {r["text"] for r in rows.filter(within_reach(F.col("text"), TERMS, 0.8)).collect()}
    found = {r["text"] for r in near_forms(rows, spark.createDataFrame([(x,) for x in TERMS], "term string"), 0.8).collect()}
    assert len(TERMS) < len(found) and found <= kept and not {" ".join(["WORD"] * 9), "GIN"} & kept
    assert rows.filter(within_reach(F.col("text"), [], 0.8)).count() == 0
