"""A stream of item states against the snapshot of the last state of each item, over restarts."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritrail.operators import triage
from veritrail.streaming import progress


def moves(rng, n):
    out = []
    for _ in range(n):
        state = rng.choice(["pending", "running", "done", "error", "skipped"])
        out.append((rng.choice("abc") if rng.random() < 0.95 else None, f"i{rng.randint(0, 12)}", rng.randint(0, 30), state, rng.choice([True, False, None]), rng.choice([5, 7, None]), rng.choice([True, False])))
    return out


def test_snapshots_follow_the_items_over_a_restart(spark, tmp_path):
    with pytest.raises(RuntimeError, match="RocksDB"):
        progress.progress(spark.createDataFrame([], progress.EVENTS))
    spark.conf.set(progress.PROVIDER, progress.ROCKSDB)
    rng, told, names = random.Random(2), [], [c.split()[0] for c in progress.EVENTS.split(", ")]
    (tmp_path / "in").mkdir()
    try:
        for k in range(3):  # each round a new query on the same checkpoint
            rows = {}
            for m in moves(rng, 60):
                rows.setdefault((m[0], m[1], m[2]), m)  # one state for a version
            rows = [m for key, m in rows.items() if key not in {t[:3] for t in told}]
            told += rows
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, m))) for m in rows + rows[:9]))
            stream = progress.progress(spark.readStream.schema(progress.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
            out = str(tmp_path / "out")
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n, out=out: df.write.mode("overwrite").parquet(f"{out}/epoch={n}")).start()
            assert query.awaitTermination(120)
            got = {r["batch_id"]: r.asDict() for r in progress.latest(spark.read.parquet(out)).collect()}
            items = spark.createDataFrame(told, progress.EVENTS).filter("batch_id is not null")
            last = items.withColumn("nth", F.row_number().over(Window.partitionBy("batch_id", "item").orderBy(F.col("version").desc()))).filter("nth = 1")
            want = {r["batch_id"]: r.asDict() for r in triage.snapshot(last).collect()}
            assert got == want and len(got) == 3
    finally:
        spark.conf.unset(progress.PROVIDER)
