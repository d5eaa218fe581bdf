"""What bounds leave out before a comparison would not have counted."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from veritrail.functions.similarity import indel
from veritrail.plans import statement, verify


def spoiled(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        k = rng.randint(0, len(out))
        out[k : k + rng.randint(0, 1)] = [rng.choice("ABEIT ")] * rng.randint(0, 1)
    return " ".join("".join(out).split())


def test_unlike_texts_are_not_compared(monkeypatch):
    rng, compared, known = random.Random(3), [], verify.S.indel
    monkeypatch.setattr(verify.S, "indel", lambda a, b: compared.append(a) or known(a, b))
    want = "OID TAVERN BAITIC GIN"
    texts = [spoiled(rng, want, 14) for _ in range(300)] + ["QUIXQW", "XXXXXXXXXXXXXXXXXXXXXXXXXX", ""]
    got = verify.similarities.func(pd.Series([texts]), pd.Series([want]), pd.Series([0.6]))[0]
    assert not {"QUIXQW", "X" * 26} & set(compared)
    whole = verify.similarities.func(pd.Series([texts]), pd.Series([want]), pd.Series([float("nan")]))[0]
    assert [w if w >= 0.6 else None for w in whole] == [g if g >= 0.6 else None for g in got] and min(whole) < 0.6 <= max(whole)


def test_windows_that_reach_the_score_are_kept(spark):
    rng, target = random.Random(4), "GOVERNMENTWARNING"
    keys = sorted({spoiled(rng, target, 9).replace(" ", "") for _ in range(500)})
    windows = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("key").alias("key")))
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.size(statement._scored(windows, target, 0.8)).alias("n")).collect()
    assert len(rows) == len(keys) and {r["key"] for r in rows if r["n"]} == {k for k in keys if indel(k, target) >= 0.8}
    assert 0 < sum(r["n"] for r in rows) < len(keys)
