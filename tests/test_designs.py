"""Labels that are alike are judged once, and every label gets its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators.designs import designs
from veritrail.plans import verify
from veritrail.rules import load
from veritrail.sources import samples
from veritrail.sources.shelf import shelf

PARTS = [(k + 30 * n, "old plate", 7) for n in range(4) for k in (0, 1, 2, 5)]


def test_labels_that_are_alike_are_judged_once(spark, monkeypatch):
    written, write = {}, verify.materialise

    def counted(df, name):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(verify, "materialise", counted)
    part = spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_size int")
    trace = {}
    got = verify.verify(*shelf(part), load(), trace).select("label_id", "field", "verdict", "elevated", "found").collect()
    assert written["labels"] == [4] and set(written["state"]) == {4}
    assert {t["labels"] for t in trace.values()} == {16}
    assert len(got) == 80 and len({(r["label_id"], r["field"]) for r in got}) == 80
    kinds = {}
    for r in got:
        kinds.setdefault((int(r["label_id"]) % 30, r["field"]), set()).add((r["verdict"], r["elevated"], r["found"]))
    assert all(len(k) == 1 for k in kinds.values())
    assert [next(iter(kinds[m, "government_warning"]))[:2] for m in (0, 5)] == [("MATCH", False), ("REVIEW", True)]


def test_what_tells_designs_apart(spark):
    labels, words, records, _ = samples.corpus(spark)
    one = lambda df: df.filter("label_id = 'net_litres'").drop("label_id")
    cases = spark.createDataFrame([(k,) for k in ("a", "same", "text", "no text", "no confidence", "place", "twice", "record", "quality", "no words")], "label_id string")
    case, first = F.col("label_id"), (F.col("line_no") == 0) & (F.col("word_no") == 0)
    shown = one(words).crossJoin(cases).filter(case != "no words")
    shown = shown.withColumn("text", F.when(first & (case == "text"), "x").when(first & (case == "no text"), None).otherwise(F.col("text")))
    shown = shown.withColumn("confidence", F.when(first & (case == "no confidence"), None).otherwise(F.col("confidence")))
    shown = shown.withColumn("box", F.when(first & (case == "place"), F.col("box").withField("left", F.col("box.left") + 0.25)).otherwise(F.col("box")))
    shown = shown.unionByName(shown.filter(first & (case == "twice"))).repartition(5)
    asked = one(records).crossJoin(cases).withColumn("brand_name", F.when(case == "record", "x").otherwise(F.col("brand_name")))
    seen = one(labels).crossJoin(cases).withColumn("quality", F.when(case != "quality", F.col("quality")))
    got = {r["label_id"]: r["__design"] for r in designs(seen, shown, asked).collect()}
    assert len(got) == 10 and got["a"] == got["same"] and len(set(got.values())) == 9
