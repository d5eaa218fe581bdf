"""Every query of the catalogue against its SQL; what has no query: ground truth, the CSV sheet, banded edits."""

from __future__ import annotations

import glob
import json
import random

import pytest

from veritrail import catalogue
from veritrail.functions import similarity as S
from veritrail.operators import evaluation, triage
from veritrail.sources import results

SF = "/root/testdata/sf0.001"
TABLES = "region part orders lineitem events documents pages".split()


def plain(value):
    return round(float(value), 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert order(df.select(*names).collect()) == order(want.fetchall())


def test_ground_truth_of_known_versions_only(spark, tmp_path):
    good = {"schema_version": 1, "fields": [{"label_id": "a", "field": "brand_name", "allowed": ["MATCH"]}, {"label_id": "b", "field": "brand_name", "allowed": ["REVIEW"], "elevated": True}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    rows = sorted(tuple(r) for r in evaluation.load_expected(spark, str(tmp_path / "good.json")).collect())
    assert rows == [("a", "brand_name", ["MATCH"], None), ("b", "brand_name", ["REVIEW"], True)]
    for k, other in enumerate((good | {"schema_version": 2}, {"fields": good["fields"]})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(other))
        with pytest.raises(Exception, match="unknown schema_version"):
            evaluation.load_expected(spark, str(tmp_path / f"bad{k}.json")).collect()


def test_csv_sheet(spark, tmp_path):
    sheet = spark.createDataFrame([(2, "=b", None), (1, "a, \"x\"", "MATCH")], "rank int, label_id string, brand_name string")
    results.write_csv(sheet, str(tmp_path / "sheet"))
    (file,) = glob.glob(str(tmp_path / "sheet" / "*.csv"))
    assert open(file).read().splitlines() == ["rank,label_id,brand_name", '1,"a, ""x""",MATCH', "2,'=b,"]


def test_csv_sheet_for_a_spreadsheet(spark, tmp_path):
    sheet = spark.createDataFrame([(2, "é", None), (1, "a,b", "MATCH")], "rank int, label_id string, brand_name string")
    results.write_csv(sheet, str(tmp_path / "sheet"), spreadsheet=True)
    (file,) = glob.glob(str(tmp_path / "sheet" / "*.csv"))
    assert open(file, "rb").read() == '\ufeffrank,label_id,brand_name\r\n1,"a,b",MATCH\r\n2,é,\r\n'.encode()


def test_counts_of_verdicts(spark):
    rows = spark.createDataFrame([("a", "MATCH"), ("a", "MATCH"), ("a", "REVIEW"), ("b", "MISMATCH"), ("b", None)], "label_id string, verdict string")
    assert {tuple(r) for r in triage.verdict_counts(rows).collect()} == {("a", 2, 1, 0), ("b", 0, 0, 1)}


def test_queue_of_no_labels(spark):
    none = spark.createDataFrame([], "label_id string, rank long")
    assert triage.neighbours(none, "label_id").count() == 0


def test_banded_edits_undo_to_the_other_text():
    gen = random.Random(5)
    for _ in range(200):
        a, b = ("".join(gen.choice("acd") for _ in range(gen.randrange(40))) for _ in range(2))
        made = S.edits(a, b, 99)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if not b else _next(row, i, x, b)
        assert len(made) == row[-1]
    long = "ab" * 3000
    assert [e["kind"] for e in S.edits(long, long + "c")] == ["extra"]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out
