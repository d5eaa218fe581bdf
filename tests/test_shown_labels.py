"""Labels of one page are read once, however many records are compared with it."""

from __future__ import annotations

import pytest

from veritrail.plans import verify
from veritrail.rules import load
from veritrail.sources.shelf import shelf

# one page, four records: nothing, the brand, the content and the volume differ; and two pages more
KEYS = (0, 21, 12, 3, 9, 5)
PAGES = 3


@pytest.mark.parametrize("most", [1000, 1])
def test_records_of_one_page_share_its_reading(spark, monkeypatch, most):
    written, write, asked, judge = {}, verify.materialise, [], verify.judge_statements

    def counted(df, name):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(verify, "materialise", counted)
    monkeypatch.setattr(verify, "MOST_SHOWN", most)
    monkeypatch.setattr(verify, "judge_statements", lambda rows, *more: asked.append(rows.count()) or judge(rows, *more))
    part = spark.createDataFrame([(k + 30 * n, "old plate", 7) for k in KEYS for n in range(3)], "p_partkey long, p_name string, p_size int")
    got = verify.verify(*shelf(part), load()).select("label_id", "field", "verdict", "elevated").collect()
    assert written["labels"] == [len(KEYS)] and len(got) == 5 * 3 * len(KEYS)
    # some four of a page are dealt by chance where one is to be shown by each
    assert written["pages"] == asked and (asked == [PAGES] if most > 1 else PAGES < asked[0] <= len(KEYS))
    odd = {(int(r["label_id"]) % 30, r["field"], r["verdict"], r["elevated"]) for r in got if r["verdict"] != "MATCH"}
    assert odd == {(21, "brand_name", "REVIEW", False), (12, "alcohol_content", "MISMATCH", False), (3, "net_contents", "MISMATCH", False), (9, "government_warning", "MISMATCH", False), (5, "government_warning", "REVIEW", True)}
