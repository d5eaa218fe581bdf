"""The corpus of known labels, end to end."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions.alignment import bits_of, opcodes
from veritrail.operators import evaluation, triage
from veritrail.operators.spans import reading_lines
from veritrail.plans import statement, verify
from veritrail.rules import STATUTE, load
from veritrail.sources import samples


@pytest.fixture(scope="module")
def judged(spark):
    labels, words, records, expected = samples.corpus(spark)
    results = verify.verify(labels, words, records).cache()
    return results, expected


def test_every_field_gets_an_allowed_verdict(judged):
    results, expected = judged
    graded = evaluation.grade(results, expected.join(evaluation.compliance(expected), "label_id"))
    wrong = graded.filter("not correct").join(results.select("label_id", "field", "found", "reason", "score"), ["label_id", "field"]).collect()
    assert wrong == []
    row = evaluation.missed(graded).first()
    assert (row["violations"], row["false_negatives"], row["false_flags"], row["labels_missed"]) == (16, 0, 0, 0)


def test_graded_checks(judged):
    results, _ = judged
    rows = {r["label_id"]: {c["id"]: c["outcome"] for c in r["checks"]} for r in results.filter("field = 'government_warning'").collect()}
    for name, case in samples.CASES.items():
        for check in ("header_capitalisation", "text_accuracy"):
            assert rows[name][check] in case[3].get(check, ("pass",)), (name, check, rows[name])


def test_invariants_and_ranking(judged):
    results, expected = judged
    assert verify.broken_invariants(results).count() == 0
    ranked = triage.worklist(triage.summarise(results))
    both = ranked.join(evaluation.compliance(expected), "label_id")
    assert evaluation.inversions(both.select("rank", "compliance")).first()["inversions"] == 0
    attention = {r["label_id"] for r in ranked.filter("tier < 5").collect()}
    assert {r["label_id"] for r in both.filter("compliance = 'non_compliant'").collect()} <= attention
    mix = {r["tier"]: r["total"] for r in evaluation.tier_mix(both, results.sparkSession.range(6).select(F.col("id").cast("int").alias("tier"))).collect()}
    assert sum(mix.values()) == 29 and len(mix) == 6


def test_one_exchange_order_does_not_matter(spark, judged):
    labels, words, records, _ = samples.corpus(spark)
    again = verify.verify(labels, words.orderBy(F.rand(1)).repartition(3), records.repartition(2))
    key = ["label_id", "field", "verdict", "found", "score"]
    assert sorted(map(tuple, again.select(key).collect()), key=str) == sorted(map(tuple, judged[0].select(key).collect()), key=str)


def test_labels_without_words(spark):
    labels, words, records, _ = samples.corpus(spark)
    rows = verify.verify(labels, words.limit(0), records.filter("label_id = 'net_litres'")).collect()
    assert len(rows) == 5 and all(r["verdict"] == "REVIEW" and r["found"] is None for r in rows)
    assert [r["elevated"] for r in rows if r["field"] == "government_warning"] == [True]


def test_thresholds_are_data(spark):
    labels, words, records, _ = samples.corpus(spark)
    only = records.filter("label_id in ('brand_long_one_letter_off', 'abv_mismatch')")
    loose = verify.verify(labels, words, only, load(max_residual_edits=1, tolerance_abv=2.0))
    got = {(r["label_id"], r["field"]): r["verdict"] for r in loose.collect()}
    assert got["brand_long_one_letter_off", "brand_name"] == "MATCH"
    assert got["abv_mismatch", "alcohol_content"] == "REVIEW"


def test_rules_refuse_nonsense():
    from veritrail.rules import Field, Rules

    with pytest.raises(ValueError):
        Field("x", 1, 1, "anchored", "", match=0.5, mismatch=0.6)
    with pytest.raises(ValueError):
        load(beverage_class="wine")
    with pytest.raises(ValueError):
        Rules(families={"a": ("Gin",), "b": ("Gin",)})


def lines(*texts, confidence=0.95, height=20.0, gap=30.0):
    out = []
    for n, text in enumerate(texts):
        x = 10.0
        for k, w in enumerate(text.split()):
            end = x + 0.55 * height * len(w)
            out.append((n, k, w, confidence, (x, gap * n, end, gap * n + height)))
            x = end + 8
    return out


def wrapped(text):
    return lines(*samples.wrap(text))


def joined(*numbers):
    """The statute with no spaces in lines of these numbers."""
    return lines(*[x.replace(" ", "") if k in numbers else x for k, x in enumerate(samples.wrap(STATUTE))])


BODY = STATUTE.removeprefix("GOVERNMENT WARNING: ")
SWAP = STATUTE.replace
#: words, quality score, verdict, outcome of the capitals, part of a difference
STATEMENTS = {
    "as prescribed": (wrapped(STATUTE), 0.9, "MATCH", "pass", None),
    "title case": (wrapped(samples.TITLE), 0.9, "MISMATCH", "fail", None),
    "title case, glued": (wrapped(SWAP("GOVERNMENT WARNING:", "GovernmentWarning:")), 0.9, "MISMATCH", "fail", None),
    "one small letter": (wrapped(SWAP("GOVERNMENT", "GoVERNMENT")), 0.9, "MATCH", "pass", None),
    "scattered": (wrapped(SWAP("GOVERNMENT WARNING", "GoVeRnMeNt WaRnInG")), 0.9, "REVIEW", "fail", None),
    "misread": (wrapped(SWAP("pregnancy", "pregnancv")), 0.9, "MATCH", "pass", None),
    "enumerator misread": (wrapped(SWAP("(1)", "(l)")), 0.9, "MATCH", "pass", None),
    "enumerators alike": (wrapped(SWAP("(2)", "(1)")), 0.9, "MISMATCH", "pass", ("substituted", "(2)", "(1)")),
    "other word": (wrapped(SWAP("may cause", "will cause")), 0.9, "MISMATCH", "pass", ("substituted", "may", "will")),
    "other vowel": (wrapped(SWAP("women", "woman")), 0.9, "MISMATCH", "pass", ("substituted", "women", "woman")),
    "two edits": (wrapped(SWAP("machinery", "machines")), 0.9, "REVIEW", "pass", ("substituted", "machinery", "machines")),
    "cut off": (wrapped(SWAP("defects", "defect")), 0.9, "MISMATCH", "pass", ("substituted", "defects", "defect")),
    "word missing": (wrapped(SWAP("women should", "women")), 0.9, "MISMATCH", "pass", ("missing", "should", None)),
    "word added": (wrapped(SWAP("may cause", "may sometimes cause")), 0.9, "MISMATCH", "pass", ("extra", None, "sometimes")),
    "no colon": (wrapped(SWAP("WARNING:", "WARNING")), 0.9, "REVIEW", "pass", None),
    "split word": (wrapped(SWAP("Consumption", "Consump tion")), 0.9, "MATCH", "pass", None),
    "merged pair": (wrapped(SWAP("health problems", "healthproblems")), 0.9, "MATCH", "pass", None),
    "merged, misread": (wrapped(SWAP("health problems", "heaithprob1ems").replace("or operate", "oroperatc")), 0.9, "MATCH", "pass", None),
    "merged runs": (wrapped(SWAP("of alcoholic beverages impairs your ability", "ofalcoholicbeveragesimpairsyourability").replace("car or operate", "caroroperate")), 0.9, "MATCH", "pass", None),
    # more words than a run may merge: the wording holds, the score falls short
    "first body line merged": (joined(1), 0.9, "REVIEW", "pass", None),
    "last line merged": (joined(len(samples.wrap(STATUTE)) - 1), 0.9, "MATCH", "pass", None),
    "header missing, closed": (lines("OLD TOM DISTILLERY OF THE OLD TOWN IN KENTUCKY STATE", *samples.wrap(BODY)), 0.9, "MISMATCH", "not_evaluable", ("missing", "GOVERNMENT WARNING", None)),
    "header missing, at the top": (wrapped(BODY), 0.9, "REVIEW", "not_evaluable", ("missing", "GOVERNMENT WARNING", None)),
    "text before and after": (lines("OLD TOM DISTILLERY", *samples.wrap(STATUTE), "Bottled by Old Tom", "750 mL"), 0.9, "MATCH", "pass", None),
    "absent": (lines("OLD TOM DISTILLERY", "750 mL"), 0.9, "REVIEW", "not_evaluable", None),
    "faint": (lines(*samples.wrap(STATUTE), confidence=0.3), 0.9, "REVIEW", "pass", None),
    "degraded": (wrapped(samples.TITLE), 0.5, "REVIEW", "fail", None),
    "unassessed": (wrapped(samples.TITLE), None, "MISMATCH", "fail", None),
    "no words": ([], 0.9, "REVIEW", "not_evaluable", None),
}


@pytest.fixture(scope="module")
def statements(spark):
    box = "struct<left: double, top: double, right: double, bottom: double>"
    words = spark.createDataFrame([(k, *w) for k, c in STATEMENTS.items() for w in c[0]], f"label_id string, line_no int, word_no int, text string, confidence double, box {box}")
    page = reading_lines(words).groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("line", "box", "glyph", "words"))).alias("page"))
    given = spark.createDataFrame([(k, c[1]) for k, c in STATEMENTS.items()], "label_id string, score double")
    quality = F.when(F.col("score").isNotNull(), F.struct(F.lit(True).alias("usable"), F.col("score").alias("score"), F.array().cast("array<string>").alias("issues")))
    rows = given.join(page, "label_id", "left").select("label_id", "page", quality.alias("quality"))
    return {r["label_id"]: r["w"] for r in statement.judge_statements(rows, load()).collect()}


@pytest.mark.parametrize("case", STATEMENTS)
def test_statement(statements, case):
    _, _, verdict, capitals, difference = STATEMENTS[case]
    got = statements[case]
    assert (got["verdict"], got["capitals"]) == (verdict, capitals), got["reason"]
    said = [(d["kind"], d["expected"], d["found"]) for d in got["differences"]]
    assert said == ([difference] if difference else []) or capitals == "not_evaluable" and (difference is None or difference in said), said
    assert got["located"] == (case not in ("absent", "no words"))
    if case == "text before and after":
        assert got["found"].endswith("problems.") and got["gaps"]["above"] is not None and got["gaps"]["below"] is not None


def test_resolution_of_read_tokens(spark):
    tokens = statement.Statute().tokens
    asked = ["HEAITHPROBIEMS", "HEAITHPROBIEM", "HEAITHPROBEMS", "WOMEN", "WOMAN", "DRINX", "I", "Z", "", None, "X" * 9000, "OFTHERISKOFBIRTHDEFECTS", "OFTHERISKOFBIRTH"]
    got = {r["token"]: r["run"] for r in statement.resolve_tokens(spark.createDataFrame([(t,) for t in asked], "token string"), ["token"], tokens, 5).collect()}
    assert got["HEAITHPROBIEMS"] == got["HEAITHPROBIEM"] == got["HEAITHPROBEMS"] == ["HEAITH", "PROBIEMS"]
    assert got["DRINX"] == ["DRINK"] and got["I"] == ["1"] and got["Z"] == ["2"] and got["OFTHERISKOFBIRTH"] == ["OF", "THE", "RISK", "OF", "BIRTH"]
    assert not {"WOMEN", "WOMAN", "", None, "X" * 9000} & set(got)


def test_opcodes_equal_the_library(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 15))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abcdef") for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = [rng.choice("abcdefg") for _ in range(rng.randint(0, 2))]
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", opcodes(F.col("a"), F.col("b")).alias("o")).collect()
    assert len(got) == 600
    for r in got:
        assert [tuple(o) for o in r["o"]] == difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_opcodes()


def test_a_statute_too_long_for_bits_is_refused():
    with pytest.raises(ValueError):
        bits_of([str(i) for i in range(62)])
