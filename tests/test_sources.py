"""Files to tables: sidecars, manifests; similarity against plain Python; the queries of the verification."""

from __future__ import annotations

import itertools
import json
import os
import random
from dataclasses import replace

import pandas as pd

from veritrail.functions import similarity as S
from veritrail.operators import triage
from veritrail.operators.spans import span_index
from veritrail.plans.verify import judge_pages
from veritrail.rules import load
from veritrail.schemas import TIERS
from veritrail.sources import manifest, samples, sidecars


def test_sidecars(spark, tmp_path):
    word = {"text": "OLD", "left": 1.0, "top": 2.0, "width": 3.0, "height": 4.0}
    page = {"width": 640, "lines": [{"words": [word, word | {"text": "TOM", "confidence": 0.5}]}, {"words": []}]}
    (tmp_path / "a b.png.ocr.json").write_text(json.dumps(page))
    (tmp_path / "c.png.ocr.json").write_text(json.dumps({"quality": {"usable": False, "score": 0.2}, "lines": []}))
    (tmp_path / "other.json").write_text("{}")
    pages = sidecars.read_sidecars(spark, str(tmp_path))
    rows = {r["label_id"]: r for r in sidecars.labels_of(pages).collect()}
    assert (rows["a b.png"]["width"], rows["a b.png"]["height"], rows["a b.png"]["quality"]) == (640, 1400, None)
    assert rows["c.png"]["quality"]["usable"] is False and set(rows) == {"a b.png", "c.png"}
    words = sorted(sidecars.words_of(pages).collect(), key=lambda r: r["word_no"])
    assert [(r["text"], r["confidence"]) for r in words] == [("OLD", 0.98), ("TOM", 0.5)]
    assert (words[0]["box"]["right"], words[0]["box"]["bottom"]) == (4.0, 6.0)
    assert [r["label_id"] for r in sidecars.broken_pages(pages).collect()] == ["a b.png"]


def test_bad_pages_stop_no_other(spark, tmp_path):
    """Five broken pages of a hundred: ninety-five are judged, five are unreadable, and one without a page."""
    word = {"text": "VODKA", "left": 1.0, "top": 2.0, "width": 50.0, "height": 20.0}
    good = {"width": 640, "height": 480, "lines": [{"words": [word]}]}
    bad = ["{", "", "[1, 2]", json.dumps({"lines": [{"words": [word | {"width": -1.0}]}]}), json.dumps({"lines": [{"words": [{"text": "X"}]}]})]
    for k in range(100):
        (tmp_path / f"{k}.png.ocr.json").write_text(bad[k] if k < 5 else json.dumps(good))
    pages = sidecars.read_sidecars(spark, str(tmp_path))
    records = spark.createDataFrame([(f"{k}.png", "Vodka", "Vodka", "40%", "1 L") for k in range(101)], "label_id string, brand_name string, class_type string, alcohol_content string, net_contents string")
    rules = replace(load(), fields=(load().of("net_contents"),))
    results, summary = judge_pages(pages, records, rules)
    assert results.count() == 95
    tiers = {r["label_id"]: (r["tier"], r["headline"]) for r in summary.collect()}
    assert len(tiers) == 101 and {k for k, v in tiers.items() if v[0] == TIERS["UNREADABLE"]} == {*(f"{k}.png" for k in range(5)), "100.png"}
    assert tiers["100.png"][1] == "there is no recognised page" and tiers["3.png"][1] == "a word has a negative size" and tiers["4.png"][1] == "a word lacks its text or place"


def test_manifests(spark, tmp_path):
    text = (
        "\r\nBrand-Name,FileName,class_type, Alcohol Content ,net_contents,label_width_mm,note\r\n"
        'X,dir/a.png,Vodka,40%,"750\nmL","1,000 mm",n\r\n\r\n,b.png,Gin,40%,1 L,,\r\nY,c.png,Rum,40%,1 L,wide,\r\n'
    )
    (tmp_path / "one.csv").write_bytes(text.encode("utf-8-sig"))
    (tmp_path / "two.csv").write_bytes("filename,brand_name\nd.png,É\n".encode("cp1252"))
    rows, issues = manifest.parse(manifest.read_records(spark, str(tmp_path)))
    got = [tuple(r)[1:] for r in rows.collect()]
    assert got == [(3, "a.png", "X", "Vodka", "40%", "750\nmL", "distilled_spirits", 1000.0)]
    found = sorted((os.path.basename(r["manifest"]), r["kind"], r["row_number"] or 0, r["filename"] or "") for r in issues.collect())
    assert found == [("one.csv", "invalid_row", 5, "b.png"), ("one.csv", "invalid_row", 6, "c.png")] + [("two.csv", "missing_column", 0, "")] * 3


def test_ratios_against_plain_python(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0)][1:]
        return row[-1]

    gen = random.Random(3)
    for _ in range(300):
        a, b = ("".join(gen.choice("ABC ") for _ in range(gen.randrange(15))) for _ in range(2))
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(S.indel(a, b) - want) < 1e-12
    made = S.edits("OLD TOM", "OLD TON X", 9)
    # one of the shortest ways: a letter changed, a blank and a letter added
    assert sorted(e["kind"] for e in made) == ["extra", "extra", "substituted"]
    assert pd.Series(S.edits("", "")).empty


def test_span_index_of_one_label(spark):
    _, words, _, _ = samples.corpus(spark)
    own = words.filter("label_id = 'brand_two_lines'")
    rows = span_index(own).collect()
    lines = {}
    for r in sorted(own.collect(), key=lambda r: (r["line_no"], r["word_no"])):
        lines.setdefault(r["line_no"], []).append(r["text"])
    want = []
    for ws in lines.values():
        want.append(" ".join(ws))
        want += [" ".join(ws[a:b]) for a in range(len(ws)) for b in range(a + 1, min(a + 6, len(ws)) + 1) if (a, b) != (0, len(ws))]
    single = sorted(r["raw"] for r in rows if len(r["lines"]) == 1)
    assert single == sorted(x for x in want if any(c.isalnum() for c in x))
    several = {r["raw"] for r in rows if len(r["lines"]) > 1}
    assert "LANTERN HOLLOW DISTILLING CO." in several and all(2 <= len(r["lines"]) <= 4 for r in rows if len(r["lines"]) > 1)
    assert sorted(r["span_id"] for r in rows) == list(range(len(rows)))


def test_global_rank_is_exact(spark):
    df = spark.range(500).selectExpr("id", "cast(id * 7919 % 1000 as int) as v").repartition(5)
    got = {r["id"]: r["rank"] for r in triage.global_rank(df, [df["v"].asc(), df["id"].asc()]).collect()}
    order = sorted(range(500), key=lambda i: (i * 7919 % 1000, i))
    assert got == {i: k for k, i in enumerate(order, 1)}


def test_verification_equals_its_sql(spark):
    import duckdb

    from veritrail import verification

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    for name in ("verify_labels", "verify_statement_checks"):
        df = verification.QUERIES[name](spark, sf)
        want = con.execute(verification.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
