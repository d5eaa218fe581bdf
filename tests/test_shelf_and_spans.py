"""Work that the verification spares: words placed once, spans no field reads, texts compared anew for each label."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrail.operators.designs import designs
from veritrail.plans import verify
from veritrail.rules import load
from veritrail.sources.shelf import shelf

ODD = [(None, "a b", 3), (30001, None, 3), (30002, "a  b ", None), (30006, "", 7), (30009, " x", -7), (30008, "ß 水", 0), (30007, "old plate", 9), (-3, "neg key", 12)]
PART = "p_partkey long, p_name string, p_size int"


def placed(text, top, height):
    step, out = 0.55 * height, []
    for k, w in enumerate(text.split(" ")):
        left = 500.0 - len(text) * step / 2 + (len(" ".join(text.split(" ")[:k])) + (k > 0)) * step
        out.append((k, w, (left, top, left + len(w) * step, top + height)))
    return out


def test_words_of_odd_parts(spark):
    part = spark.createDataFrame(ODD, PART)
    words = shelf(part)[1]
    assert words._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = {}
    for r in words.orderBy("label_id", "line_no", "word_no").collect():
        got.setdefault((r["label_id"], r["line_no"]), []).append((r["word_no"], r["text"], tuple(r["box"])))
    fronts = shelf(part)[2].select("label_id", "class_type", "net_contents").collect()
    assert len(fronts) == len(ODD)
    for key, name, size in ODD:
        label = None if key is None else str(key)
        if name is not None:
            assert got[label, 0] == placed(name.upper().replace("ß", "SS") + " DISTILLERY", 159.0, 70.0)
        else:
            assert (label, 0) not in got
        if size is not None:
            content = 40 + (size % 10 if size >= 0 else -(-size % 10))
            assert got[label, 2] == placed(f"{content}% Alc./Vol. ({2 * content + (4 if key == 30007 else 0)} Proof)", 333.5, 33.0)
        else:
            assert (label, 2) not in got
        assert got[label, 3] == placed("730 mL" if key == 30008 else "750 mL", 395.5, 33.0)
    assert got["30006", 1][0][1] == "Vodka"


def test_no_table_of_labels_is_sent_to_all_executors(spark):
    part = spark.range(40).selectExpr("id AS p_partkey", "'old plate' AS p_name", "7 AS p_size")
    plan = designs(*shelf(part))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("field, spans", [("government_warning", False), ("net_contents", True)])
def test_spans_are_made_for_fields_that_read_them(spark, monkeypatch, field, spans):
    written, write = {}, verify.materialise
    monkeypatch.setattr(verify, "materialise", lambda df, name: written.setdefault(name, df.columns) and write(df, name))
    rules = load()
    rules = replace(rules, fields=tuple(f for f in rules.fields if f.id == field))
    part = spark.createDataFrame([(k, "old plate", 7) for k in (0, 3, 4, 5, 8)], PART)
    got = {r["label_id"]: (r["verdict"], r["elevated"]) for r in verify.verify(*shelf(part), rules).collect()}
    assert ("spans" in written["labels"]) == spans and "page" in written["labels"]
    if field == "government_warning":
        assert got == {"0": ("MATCH", False), "3": ("MATCH", False), "4": ("MISMATCH", False), "5": ("REVIEW", True), "8": ("MATCH", False)}
    else:
        assert got == {"0": ("MATCH", False), "3": ("MISMATCH", False), "4": ("MATCH", False), "5": ("MATCH", False), "8": ("REVIEW", False)}


def test_labels_that_ask_alike_compare_a_text_once(monkeypatch):
    compared, known = [], verify.S.indel
    monkeypatch.setattr(verify.S, "indel", lambda a, b: compared.append((a, b)) or known(a, b))
    texts = [["OLD PIATE", "OID", None], ["OLD PIATE", "OLD"], None, ["OLD PIATE", "OID"], ["OLD PIATE"]]
    asked = ["OLD PIATE GIN", "OLD PIATE GIN", "X", "OLD PIATE GIN", "OLD"]
    ask = lambda: [None if g is None else list(g) for g in verify.similarities.func(pd.Series(texts), pd.Series(asked), pd.Series([0.1] * 5))]
    got = ask()
    # two ratios a text
    assert len(compared) == 2 * 4 and got[0][:2] == got[3] and got[0][0] == got[1][0] != got[4][0] and got[0][2] is None and got[2] is None
    monkeypatch.setattr(verify, "MOST_KNOWN", 0)
    compared.clear()
    assert ask() == got and len(compared) > 8
