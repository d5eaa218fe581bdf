"""Verification of labels against their records: one row per label, five fields in turn.

A label's spans are an array in its row, built with one exchange by label and written once. Each
field is judged with array expressions over the spans that earlier fields have not taken (masks);
only text similarity runs in Python batches. What a field hands on, masks and results, is a narrow
table written after it: else the plan of a field would hold the plans of all before it, once for
each use of a mask, and grow without end.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions import geometry as G
from veritrail.functions import patterns as P
from veritrail.functions import similarity as S
from veritrail.functions import text as X
from veritrail.functions.bound import bound
from veritrail.operators import triage
from veritrail.operators.designs import designs
from veritrail.operators.spans import label_spans, pages, unmasked
from veritrail.operators.vocabulary import SHORTLIST, near_terms, within_reach
from veritrail.plans.statement import judge_statements
from veritrail.rules import Field, RuleColumns, Rules, abbreviation_table, expanded_families, expanded_terms, load, rule_rows, shape
from veritrail.schemas import BOX, CHECK
from veritrail.scratch import forget, materialise, shuffle_parts
from veritrail.sources import sidecars

RESULT = f"struct<located: boolean, verdict: string, expected: string, found: string, box: {BOX}, score: double, confidence: double, reason: string, checks: array<{CHECK}>>"

#: strategy name -> function(label rows, rules, field id) that adds the column `result`.
STRATEGIES: dict[str, Callable[[DataFrame, Rules, str], DataFrame]] = {}
#: those of them that read the page alone: where no field reads spans, none are made.
PAGE_ALONE: set[str] = set()


def strategy(name: str, page_alone: bool = False):
    def keep(f):
        STRATEGIES[name] = f
        if page_alone:
            PAGE_ALONE.add(name)
        return f

    return keep


def result(located, verdict, expected, found, box, score, confidence, reason, checks=None) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = {"located": c(located), "verdict": c(verdict), "expected": c(expected), "found": c(found), "box": c(box), "score": c(score).cast("double"), "confidence": c(confidence).cast("double"), "reason": c(reason), "checks": checks if checks is not None else F.array()}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(RESULT)


def not_found(expected: Column, reason: str) -> Column:
    return result(False, "REVIEW", expected, None, None, 0.0, 0.0, reason)


def one_check(id_: str, outcome: Column, summary: Column | str, citation: str) -> Column:
    return F.struct(F.lit(id_).alias("id"), outcome.alias("outcome"), F.lit(citation).alias("citation"), (summary if isinstance(summary, Column) else F.lit(summary)).alias("summary")).cast(CHECK)


#: similarities that a batch of labels keeps at once
MOST_KNOWN = 100_000


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def similarities(candidates: pd.Series, expected: pd.Series, least: pd.Series) -> pd.Series:
    """For each text of an array, its similarity to the expected one (word order and spaces aside); 0 where its letters show that it is below least."""
    out = []
    # labels of a batch that ask alike share what they print: the statement, the designation
    batch: dict[tuple[str, float], dict[str, float]] = {}
    held = 0
    for texts, want, floor in zip(candidates, expected, least):
        if texts is None or want is None:
            out.append(None)
            continue
        if held > MOST_KNOWN:
            batch, held = {}, 0
        known = batch.setdefault((want, floor), {})
        before = len(known)
        ordered, bare = " ".join(sorted(want.split())), want.replace(" ", "")
        letters = [(c, bare.count(c)) for c in set(bare)]
        spaces = ordered.count(" ")
        for x in texts:
            if x not in known:
                if x is None:
                    known[x] = None
                    continue
                plain = x.replace(" ", "")
                # a common subsequence has no more of a letter than both texts have
                shared, both = 2 * sum(min(plain.count(c), k) for c, k in letters), len(plain) + len(bare)
                own = max(len(x.split()) - 1, 0)
                most = max(shared / both if both else 1.0, (shared + 2 * min(own, spaces)) / (both + own + spaces) if both else 1.0)
                known[x] = max(S.indel(" ".join(sorted(x.split())), ordered), S.indel(plain, bare)) if not most < floor - 1e-9 else 0.0
        held += len(known) - before
        out.append([known[x] for x in texts])
    return pd.Series(out)


def wording_scores(phrases: tuple[str, ...]):
    """For each wording of an array, its best ratio to one of the phrases; 0 below five letters."""

    def best(wordings: pd.Series) -> pd.Series:
        return pd.Series([None if ws is None else [max((S.indel(w, p) for p in phrases), default=0.0) if len(w) >= 5 else 0.0 for w in ws] for ws in wordings])

    best.__annotations__ = {"wordings": pd.Series, "return": pd.Series}
    return F.pandas_udf(best, T.ArrayType(T.DoubleType()))


def label_rows(records: DataFrame, read: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per record with the page (lines with their words, in reading order) of the label it shows and, if rules are given, spans in generation order and barred lines.

    records name in __shown a label of read, pages(). Spans are made once for all records that show it.
    """
    parts = shuffle_parts(read.sparkSession)
    read = read.repartition(parts, "label_id")
    if rules is not None:
        spans = label_spans(F.col("page"), F.col("label_glyph"))
        kept = ("raw", "canonical", "canonical_words", "numeric", "box", "confidence", "glyph", "n_words")
        read = read.withColumn("spans", F.transform(spans, lambda s: F.struct(s["span_id"], s["lines"], s["run"].isNull().alias("whole"), *[s[c] for c in kept])))
        read = read.withColumn("barred", barred_lines(rules))
    read = read.drop("label_glyph").withColumnRenamed("label_id", "__shown")
    # pages are far larger than their files
    rows = records.repartition(parts, "__shown").join(read.hint("merge"), "__shown", "left")
    for c in read.columns[1:]:
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(read.schema[c].dataType)))
    return rows


#: records that show one label and are given its page and spans by one task
MOST_SHOWN = 1000


def shown_labels(designs: DataFrame, which: list[str]) -> DataFrame:
    """designs with __shown: one of those (label_id) that have their page, quality and rules in common, for some MOST_SHOWN each."""
    page = ["__page", *which]
    counted = designs.join(designs.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).hint("merge"), page)
    dealt = counted.withColumn("__share", F.pmod(F.xxhash64("label_id"), F.ceil(F.col("__n") / MOST_SHOWN))).drop("__n")
    first = dealt.groupBy(*page, "__share").agg(F.min("label_id").alias("__shown"))
    return dealt.join(first.hint("merge"), [*page, "__share"]).drop("__page", "__share")


def free(masks: Column) -> Column:
    return F.filter("spans", lambda s: unmasked(s["box"], masks))


def barred_lines(rules: Rules) -> Column:
    """Lines that on their own hold the statement's header or one of its phrases."""
    marks = [X.fold_confused(F.lit(p)) for p in (rules.header, *rules.tails)]

    def holds(s: Column) -> Column:
        text = X.despaced(s["canonical"])
        out = F.lit(False)
        for m in marks:
            out = out | F.contains(text, X.despaced(m))
        return out

    return F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda s: s["whole"] & (F.size(s["lines"]) == 1) & holds(s)), lambda s: s["lines"])))


def good_image(rules: Rules) -> Column:
    """Whether quality was assessed and is good; unassessed counts as not good."""
    return F.coalesce(F.col("quality.usable") & (F.col("quality.score") >= rules.good_quality), F.lit(False))


@strategy("warning", page_alone=True)
def warning(rows: DataFrame, rules: Rules, field: str) -> DataFrame:
    # the page, its quality and the rules are all that is asked
    shown = rows.filter(F.col("label_id") == F.col("__shown")).select("label_id", "page", "quality", *[c for c in rows.columns if c == "rule"])
    w = rows.join(judge_statements(shown, rules).withColumnRenamed("label_id", "__shown"), "__shown", "left")
    cite = rules.of(field).citation
    here = lambda outcome: F.when(F.col("w.located"), outcome).otherwise("not_evaluable")
    gaps = F.array_join(F.array(*[F.concat(F.coalesce(F.format_string("%.1f line heights", F.col(f"w.gaps.{n}")), F.lit("no text")), F.lit(f" {n}")) for n in ("above", "below", "beside")]), ", ")
    room = F.when(F.col("w.located"), F.concat(F.lit("nearest other text: "), gaps, F.when(F.col("w.shares_line"), "; other text shares a line").otherwise(""))).otherwise("room around the block")
    checks = F.array(
        one_check("header_capitalisation", F.col("w.capitals"), "the header stands in capitals", "27 CFR 16.22(a)(2)"),
        one_check("text_accuracy", F.col("w.text"), "the text is as prescribed", cite),
        one_check("header_bold", F.lit("not_evaluable"), "stroke widths are not measured", "27 CFR 16.22(a)(2)"),
        one_check("contrast", F.lit("not_evaluable"), "contrast is not measured", "27 CFR 16.22(a)(1)"),
        one_check("separation", here(F.lit("advisory")), room, cite),
        one_check("type_size", F.lit("not_evaluable"), "sizes are not measured", "27 CFR 16.22(b)"),
    )
    out = result(F.col("w.located"), F.col("w.verdict"), F.lit(""), F.col("w.found"), F.col("w.box"), F.col("w.score"), F.col("w.confidence"), F.col("w.reason"), checks)
    return w.withColumn("result", out).drop("w")


def _hits(spans: Column, strict: Callable[[Column], Column]) -> Column:
    """Hits of spans read whole, or of their bracketed parts where a span is one unparted token."""

    def of(s: Column, hit: Column) -> Column:
        return F.struct(hit.alias("hit"), s["box"].alias("box"), s["raw"].alias("raw"), s["confidence"].alias("confidence"))

    whole = F.filter(F.transform(spans, lambda s: of(s, strict(s["numeric"]))), lambda h: h["hit"].isNotNull())
    parts = F.flatten(F.transform(F.filter(spans, lambda s: (F.instr(s["numeric"], " ") == 0) & strict(s["numeric"]).isNull()), lambda s: F.transform(X.fragments(s["numeric"]), lambda f: of(s, strict(f)))))
    return F.concat(whole, F.filter(parts, lambda h: h["hit"].isNotNull()))


def _reported(hits: Column, expected: Column) -> Column:
    """Best tier, read exactly, nearest to the expectation, then by place and text."""
    keyed = F.transform(hits, lambda h: F.struct(h["hit"]["tier"].alias("a"), (~h["hit"]["exact"]).alias("b"), F.coalesce(F.round(F.abs(h["hit"]["value"] - expected), 2), F.lit(0.0)).alias("c"), h["box"]["top"].alias("d"), h["box"]["left"].alias("e"), h["raw"].alias("f"), h.alias("h")))
    return F.array_min(F.transform(keyed, lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), k["c"].alias("c"), k["d"].alias("d"), k["e"].alias("e"), k["f"].alias("f"), k["h"].alias("h"))))["h"]


def _readings(hits: Column) -> Column:
    """What hits read, in reading order, quoted."""
    placed = F.array_sort(F.transform(hits, lambda h: F.struct(h["box"]["top"].alias("top"), h["box"]["left"].alias("left"), h["raw"].alias("raw"))))
    return F.array_join(F.transform(placed, lambda h: F.concat(F.lit('"'), h["raw"], F.lit('"'))), ", ")


def _eligible() -> Column:
    """Free spans with a digit, without which no pattern of a content or a volume matches, outside the barred lines."""
    digits = F.filter("spans", lambda s: s["numeric"].rlike(r"(?U)\d"))
    return F.filter(digits, lambda s: unmasked(s["box"], F.col("masks")) & ~F.arrays_overlap(s["lines"], F.col("barred")))


def _fuzzy_alcohol(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds fuzzy: hits whose number reads strictly beside wording that is nearly a known phrase."""
    out, made = rows, []
    for k, (tier, phrases, pattern, n, w) in enumerate(P.FUZZY):
        out, hits = _fuzzy_pattern(out, k, tier, phrases, P.whole(pattern), n, w, rules.wording_similarity)
        made.append(hits)
    return out.withColumn("fuzzy", F.concat(*made)).drop(*[f"_{x}{k}" for x in "fs" for k in range(len(P.FUZZY))])


def _fuzzy_pattern(rows: DataFrame, k: int, tier: int, phrases: tuple[str, ...], pattern: str, n: int, w: int, least: float) -> tuple[DataFrame, Column]:
    at = F.filter("eligible", lambda s: s["numeric"].rlike(pattern) & P.alcohol(s["numeric"]).isNull())
    out = rows.withColumn(f"_f{k}", at)
    words = F.transform(f"_f{k}", lambda s: X.unit_wording(F.regexp_extract(s["numeric"], pattern, w)))
    out = out.withColumn(f"_s{k}", wording_scores(phrases)(words))

    def hit(s: Column, score: Column) -> Column:
        number = F.regexp_extract(s["numeric"], pattern, n)
        value = X.printed_number(number)
        value = F.when(value.between(0, 200), value / 2) if tier == 1 else F.when(value.between(0, 100), value)
        h = F.when((score >= least) & value.isNotNull(), F.struct(F.lit(tier).alias("tier"), value.alias("value"), number.alias("printed"), F.lit("proof" if tier == 1 else "%").alias("unit"), F.lit(False).alias("exact")))
        return F.struct(h.alias("hit"), s["box"].alias("box"), s["raw"].alias("raw"), s["confidence"].alias("confidence"))

    return out, F.filter(F.zip_with(f"_f{k}", f"_s{k}", hit), lambda h: h["hit"].isNotNull())


@strategy("alcohol_content")
def alcohol_content(rows: DataFrame, rules: Rules, field: str) -> DataFrame:
    cite = rules.of(field).citation
    expected = P.alcohol_expected(X.canonical_numeric(F.col("alcohol_content")))["value"]
    base = rows.withColumn("eligible", _eligible()).withColumn("want", expected)
    base = _fuzzy_alcohol(base, rules)
    base = base.withColumn("hits", F.concat(_hits(F.col("eligible"), P.alcohol), "fuzzy"))
    base = base.withColumn("hits", F.when(F.exists("hits", lambda h: h["hit"]["tier"] < 2), F.filter("hits", lambda h: h["hit"]["tier"] < 2)).otherwise(F.col("hits")))
    base = base.withColumn("best", _reported(F.col("hits"), F.col("want")))
    labelled = F.filter("hits", lambda h: h["hit"]["tier"] == 0)
    proofs = F.filter("hits", lambda h: h["hit"]["tier"] == 1)
    b, v = F.col("best"), F.col("best.hit.value")
    tier = F.col("best.hit.tier")
    abv = F.when(tier == 0, v).otherwise(F.get(labelled, F.lit(0))["hit"]["value"])
    two = F.size(F.array_distinct(F.transform(labelled, lambda h: F.round(h["hit"]["value"], 2)))) > 1
    off = F.coalesce(F.exists(proofs, lambda h: F.abs(2 * h["hit"]["value"] - 2 * abv) > rules.tolerance_proof), F.lit(False)) & abv.isNotNull()
    inconsistent, backed = two | off, (F.size(proofs) > 0) & abv.isNotNull() & ~off
    same = S.equal_2dp(v, F.col("want"))
    beyond = ~same & (F.abs(v - F.col("want")) > rules.tolerance_abv + 1e-9)
    low = F.col("best.confidence") < rules.min_confidence
    assertable = F.col("best.hit.exact") & (F.col("best.confidence") >= rules.numeric_assert_confidence) & good_image(rules)
    cases = [
        (low, "REVIEW", 0.5, "read with low confidence"),
        (F.col("want").isNull(), "REVIEW", 0.5, "the application's value could not be read"),
        (tier == 2, "REVIEW", 0.5, "a percentage without wording"),
        (inconsistent & beyond, "REVIEW", 0.0, "the label contradicts itself and the application"),
        (inconsistent, "REVIEW", 0.5, "the label's statements contradict each other"),
        (beyond & assertable, "MISMATCH", 0.0, "the label states another content"),
        (beyond, "REVIEW", 0.0, "the label seems to state another content"),
        (~same, "REVIEW", 0.75, "within tolerance, but not equal"),
        (tier == 1, "REVIEW", 1.0, "stated as proof only"),
    ]
    verdict, agreement, reason = F.lit("MATCH"), F.lit(1.0), F.lit("the label states the same content")
    for c, word, a, why in reversed(cases):
        c = F.coalesce(c, F.lit(False))
        verdict, agreement, reason = F.when(c, word).otherwise(verdict), F.when(c, a).otherwise(agreement), F.when(c, why).otherwise(reason)
    penalty = F.when(b["hit"]["exact"], 1.0).otherwise(0.95) * F.when(inconsistent, 0.6).otherwise(1.0) * F.when(tier == 1, 0.85).when(tier == 2, 0.6).otherwise(1.0)
    bonus = F.when(backed & (agreement > 0), 0.05).otherwise(0.0)
    checks = F.array_compact(F.array(
        F.when((F.size(proofs) > 0) & abv.isNotNull(), one_check("proof_consistency", F.when(off, "fail").otherwise("pass"), "proof is twice the content", cite)),
        F.when(F.size(labelled) > 1, one_check("abv_statement_consistency", F.when(two, "fail").otherwise("pass"), F.when(two, F.concat(F.lit("statements read: "), _readings(labelled))).otherwise("all statements agree"), cite)),
        F.when(tier > 0, one_check("abv_wording", F.lit("advisory"), "stated without the labelled form", cite)),
    ))
    found = result(True, verdict, F.col("alcohol_content"), b["raw"], b["box"], S.triage_score(agreement, b["confidence"], penalty, bonus), b["confidence"], reason, checks)
    out = F.when(F.size("hits") == 0, not_found(F.col("alcohol_content"), "no alcohol content was found")).otherwise(found)
    return base.withColumn("result", out).drop("eligible", "want", "fuzzy", "hits", "best")


@strategy("net_contents")
def net_contents(rows: DataFrame, rules: Rules, field: str) -> DataFrame:
    base = rows.withColumn("wanted", P.volume_expected(X.canonical_numeric(F.col("net_contents")))).withColumn("hits", _hits(_eligible(), P.volume))
    base = base.withColumn("best", _reported(F.col("hits"), F.col("wanted.value")))
    b, v = F.col("best"), F.col("best.hit.value")
    converted = lambda t1, t2: (t1 == 1) | (t2 == 1)
    differs = lambda x, y, how: F.when(how, F.abs(x - y) > rules.tolerance_ml + 1e-9).otherwise(~S.equal_2dp(x, y))
    inconsistent = F.exists("hits", lambda h: differs(h["hit"]["value"], v, converted(h["hit"]["tier"], b["hit"]["tier"])))
    off = differs(v, F.col("wanted.value"), converted(b["hit"]["tier"], F.col("wanted.tier")))
    fills = rules.standards_of_fill if isinstance(rules.standards_of_fill, Column) else F.array(*[F.lit(float(x)) for x in rules.standards_of_fill])
    standard = F.exists(fills, lambda x: F.abs(x - v) <= F.when(b["hit"]["tier"] == 1, rules.tolerance_ml).otherwise(0.005))
    assertable = b["hit"]["exact"] & (b["confidence"] >= rules.numeric_assert_confidence) & good_image(rules)
    cases = [
        (b["confidence"] < rules.min_confidence, "REVIEW", 0.5, "read with low confidence"),
        (F.col("wanted").isNull(), "REVIEW", 0.5, "the application's value could not be read"),
        (inconsistent, "REVIEW", 0.5, "the label's statements contradict each other"),
        (off & assertable, "MISMATCH", 0.0, "the label states another volume"),
        (off, "REVIEW", 0.0, "the label seems to state another volume"),
        (~standard, "REVIEW", 1.0, "not a standard of fill"),
    ]
    verdict, agreement, reason = F.lit("MATCH"), F.lit(1.0), F.lit("the label states the same volume")
    for c, word, a, why in reversed(cases):
        c = F.coalesce(c, F.lit(False))
        verdict, agreement, reason = F.when(c, word).otherwise(verdict), F.when(c, a).otherwise(agreement), F.when(c, why).otherwise(reason)
    penalty = F.when(inconsistent, 0.6).otherwise(1.0) * F.when(~standard, 0.8).otherwise(1.0)
    checks = F.array_compact(F.array(
        F.when(inconsistent, one_check("volume_statement_consistency", F.lit("fail"), F.concat(F.lit("statements read: "), _readings(F.col("hits"))), rules.of(field).citation)),
        one_check("standard_of_fill", F.when(standard, "pass").otherwise("fail"), "an authorised volume", "27 CFR 5.203"),
    ))
    found = result(True, verdict, F.col("net_contents"), b["raw"], b["box"], S.triage_score(agreement, b["confidence"], penalty, F.lit(0.0)), b["confidence"], reason, checks)
    out = F.when(F.size("hits") == 0, not_found(F.col("net_contents"), "no net contents were found")).otherwise(found)
    return base.withColumn("result", out).drop("wanted", "hits", "best")


def _ranked(spans: str, sims: str, words: Column, penalty: float, weight: float) -> Column:
    """Spans with sim, score (order, negated) and score but for the confidence (by), best first; equal scores by generation order."""
    by = lambda s, m: m * S.length_penalty(s["canonical_words"], words, penalty)
    scored = F.zip_with(spans, sims, lambda s, m: F.struct((-(by(s, m) * S.confidence_factor(s["confidence"], weight))).alias("order"), s["span_id"].alias("id"), m.alias("sim"), by(s, m).alias("by"), s.alias("s")))
    return F.array_sort(scored)


def _reachable(pool: str, want: Column, f, floor: Column | float | None = None) -> tuple[Column, Column]:
    """Spans whose lengths allow a score above the mismatch threshold, or floor and more but for the confidence; the least similarity of such scores."""
    lengths = F.struct(F.char_length(want).alias("n"), F.char_length(X.despaced(want)).alias("bare"), F.size(X.tokens(want)).alias("words"))
    most = lambda a, b: F.try_divide(2.0 * F.least(a, b), a + b)
    factor = lambda s: S.confidence_factor(s["confidence"], f.confidence_weight)

    def reaches(s: Column, k: Column) -> Column:
        by = F.greatest(most(F.char_length(s["canonical"]), k["n"]), most(F.char_length(X.despaced(s["canonical"])), k["bare"])) * S.length_penalty(s["canonical_words"], k["words"], f.length_penalty)
        enough = by * factor(s) > f.mismatch - 1e-9
        return F.coalesce(enough if floor is None else enough | (by >= floor - 1e-9), F.lit(True))

    # confidences above 1 are no one's promise, but they'd raise a score
    least = f.mismatch / F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(pool, factor)), F.lit(1.0)))
    return bound(lengths, lambda k: F.filter(pool, lambda s: reaches(s, k))), least if floor is None else F.least(least, floor if isinstance(floor, Column) else F.lit(floor))


@strategy("anchored")
def anchored(rows: DataFrame, rules: Rules, field: str) -> DataFrame:
    f = rules.of(field)
    want = X.canonical(F.col(field))
    base = rows.withColumn("want", want).withColumn("pool", free(F.col("masks")))
    # what stays at or below the mismatch threshold can't be the place, so it isn't compared
    reachable, least = _reachable("pool", F.col("want"), f)
    base = base.withColumn("pool", reachable).withColumn("sims", similarities(F.transform("pool", lambda s: s["canonical"]), F.col("want"), least))
    base = base.withColumn("best", F.get(_ranked("pool", "sims", F.size(X.tokens(F.col("want"))), f.length_penalty, f.confidence_weight), F.lit(0)))
    score, s = -F.col("best.order"), F.col("best.s")
    judged = S.verdict(s["confidence"], score, f.match, f.mismatch, rules.min_confidence)
    left = S.residual_edits(s["canonical"], F.col("want"))
    verdict = F.when((judged == "MATCH") & (left > rules.max_residual_edits), "REVIEW").otherwise(judged)
    reason = F.when(verdict == "MATCH", "the label reads the same").when(left > rules.max_residual_edits, F.concat(F.lit("the label differs in "), left.cast("string"), F.lit(" characters"))).otherwise("the label reads nearly the same")
    found = result(True, verdict, F.col(field), s["raw"], s["box"], F.round(score, 4), s["confidence"], reason)
    missing = F.col("best").isNull() | (score <= f.mismatch) | (F.col("want") == "")
    out = F.when(F.coalesce(missing, F.lit(True)), not_found(F.col(field), "could not be located")).otherwise(found)
    return base.withColumn("result", out).drop("want", "pool", "sims", "best")


def _expansion(rules: Rules | RuleColumns) -> Callable[[Column], Column]:
    """Canonical text with abbreviations expanded."""
    if isinstance(rules, Rules):
        return lambda c: X.expand(c, abbreviation_table(rules))
    return lambda c: F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(rules.abbreviations, t), t)), " ")


def _families(text: Column, rules: Rules | RuleColumns) -> Column:
    """The families that one of whose terms a designation holds."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    families = rules.families
    if isinstance(rules, Rules):
        families = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(m) for m in ms]).alias("members")) for n, ms in expanded_families(rules).items()])
    held = F.filter(families, lambda f: F.exists(f["members"], lambda m: F.contains(padded, F.concat(F.lit(" "), m, F.lit(" ")))))
    return F.transform(held, lambda f: f["name"])


def _sets(rules: Rules | RuleColumns) -> list[Rules]:
    return [rules] if isinstance(rules, Rules) else rules.sets


def all_terms(rules: Rules | RuleColumns) -> list[str]:
    """The known designations of all rule sets."""
    return list(dict.fromkeys(t for r in _sets(rules) for t in expanded_terms(r)))


def known_terms(texts: DataFrame, rules: Rules | RuleColumns, least: float) -> DataFrame:
    """text, hits (term, sim): the known designations of any rule set that each text reads as."""
    sets, terms = _sets(rules), all_terms(rules)
    listed = texts.sparkSession.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, place int")
    near = near_terms(texts, listed, least, max(SHORTLIST, len(terms) if len(sets) > 1 else 0))
    return near.groupBy("text").agg(F.collect_list(F.struct("term", F.col("score").alias("sim"))).alias("hits"))


@strategy("class_type")
def class_type(rows: DataFrame, rules: Rules, field: str) -> DataFrame:
    """The designation: a read of the expected one, the likest text beside the brand, or another known designation."""
    f = rules.of(field)
    expand, least = _expansion(rules), rules.least_match(field)
    want = expand(X.canonical(F.col(field)))
    brand = F.col("done.brand_name.box")
    outside = lambda s: brand.isNull() | ~G.overlaps(s["box"], brand, 0.25)
    pool = F.transform(F.filter(free(F.col("masks")), outside), lambda s: s.withField("own_words", s["canonical_words"]).withField("canonical", expand(s["canonical"])))
    base = rows.withColumn("want", want).withColumn("pool", pool)
    base = base.withColumn("pool", F.transform("pool", lambda s: s.withField("canonical_words", F.size(X.tokens(s["canonical"])))))
    # positions are told at four digits
    reachable, lowest = _reachable("pool", F.col("want"), f, rules.positional_floor - 1e-4)
    base = base.drop("page").withColumn("near", reachable).withColumn("sims", similarities(F.transform("near", lambda s: s["canonical"]), F.col("want"), lowest))
    base = base.withColumn("ranked", _ranked("near", "sims", F.size(X.tokens(F.col("want"))), f.length_penalty, f.confidence_weight)).drop("near", "sims", "spans", "barred")
    # from here on the pool is asked for known designations alone
    listed = all_terms(rules)
    base = materialise(base.withColumn("pool", F.filter("pool", lambda s: within_reach(s["canonical"], listed, least))), "pools")
    # known designations, for each text once however many labels print it
    printed = base.select("label_id", F.explode(F.array_distinct(F.transform("pool", lambda s: s["canonical"]))).alias("text"))
    found = materialise(known_terms(printed.select("text").unionByName(base.select(F.col("want").alias("text"))), rules, least), "designations")
    of_label = printed.join(found, "text").groupBy("label_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "hits"))).alias("known"))
    base = base.join(of_label, "label_id", "left").join(found.select(F.col("text").alias("want"), F.col("hits").alias("same")), "want", "left")
    # the terms of the row's own rules, in their order, and those that the application's value is
    terms = F.array(*[F.lit(t) for t in expanded_terms(rules)]) if isinstance(rules, Rules) else rules.terms
    base = base.withColumn("same", F.transform(F.filter("same", lambda t: t["sim"] >= f.match), lambda t: t["term"]))

    def best_term(s: Column) -> Column:
        by = lambda t: t["sim"] * S.length_penalty(s["canonical_words"], F.size(X.tokens(t["term"])), f.length_penalty)
        own = F.filter(F.try_element_at("known", s["canonical"]), lambda t: F.array_contains(terms, t["term"]))
        rated = F.filter(F.transform(own, lambda t: F.struct((-by(t)).alias("by"), F.array_position(terms, t["term"]).alias("place"), t["term"].alias("term"), t["sim"].alias("sim"), by(t).alias("score"))), lambda t: t["score"] >= f.match)
        return F.array_min(rated)

    near_brand = lambda box: brand.isNotNull() & F.coalesce(G.near(box, brand, rules.reach_heights), F.lit(False))
    weigh = lambda s, score: score * S.confidence_factor(s["confidence"], f.confidence_weight)
    met = F.filter(F.transform("pool", lambda s: F.struct(best_term(s).alias("hit"), s.alias("s"))), lambda o: o["hit"].isNotNull())
    met = F.filter(met, lambda o: ~F.array_contains(F.coalesce("same", F.array().cast("array<string>")), o["hit"]["term"]))
    others = F.transform(met, lambda o: F.struct(o["hit"]["term"].alias("term"), o["hit"]["sim"].alias("sim"), weigh(o["s"], o["hit"]["score"]).alias("score"), near_brand(o["s"]["box"]).alias("near"), o["s"].alias("s")))
    base = base.withColumn("others", others).withColumn("others", F.coalesce("others", F.array().cast(base.withColumn("others", others).schema["others"].dataType)))
    first = F.get("ranked", F.lit(0))
    residual = lambda r: S.residual_edits(r["s"]["canonical"], F.col("want"))

    def likeliest(hits: Column) -> Column:
        """In position, then the strongest, then the longest; grown to the most specific one that holds it."""
        best = F.array_min(F.transform(hits, lambda o: F.struct((~o["near"]).alias("a"), (-F.round(o["score"], 4)).alias("b"), (-o["s"]["own_words"]).alias("c"), o["s"]["span_id"].alias("d"), o.alias("o"))))["o"]
        return best

    def grown(hits: Column, best: Column) -> Column:
        wider = F.filter(hits, lambda o: G.contains(o["s"]["box"], best["s"]["box"]) & (o["s"]["own_words"] > best["s"]["own_words"]))
        return F.coalesce(F.array_min(F.transform(wider, lambda o: F.struct((-o["s"]["own_words"]).alias("a"), (-o["score"]).alias("b"), o["s"]["span_id"].alias("c"), o.alias("o"))))["o"], best)

    # 1: a read of the expected designation; of those that clear, the best without residual edits
    clearing = F.filter("ranked", lambda r: -r["order"] >= f.match)
    exact = F.get(F.filter(clearing, lambda r: residual(r) <= rules.max_residual_edits), F.lit(0))
    base = base.withColumn("chosen", F.coalesce(exact, F.get(clearing, F.lit(0)), first)).withColumn("top", -first["order"])
    c = F.col("chosen")
    base = base.withColumn("longer", F.filter("others", lambda o: G.contains(o["s"]["box"], c["s"]["box"]) & (o["s"]["own_words"] > c["s"]["own_words"])))
    base = base.withColumn("refined", likeliest(F.col("longer"))).withColumn("refined", grown(F.col("longer"), F.col("refined")))
    # 2: the likest text near the brand
    beside = F.array_min(F.transform(F.filter("ranked", lambda r: near_brand(r["s"]["box"])), lambda r: F.struct((-F.round(r["by"], 4)).alias("a"), r["order"].alias("b"), r["id"].alias("c"), r.alias("r"))))["r"]
    base = base.withColumn("beside", beside).withColumn("beside", F.when(F.col("beside.by") >= rules.positional_floor, F.col("beside")))
    # 3: another known designation, not a part of a plausible read of the expected one
    base = base.withColumn("plausible", F.concat(F.filter("ranked", lambda r: -r["order"] > f.mismatch), F.array_compact(F.array("beside"))))
    mine = X.tokens(F.col("want"))
    within = lambda o: F.size(F.array_except(X.tokens(o["term"]), mine)) == 0
    fragment = lambda o: within(o) & F.exists("plausible", lambda r: G.contains(r["s"]["box"], o["s"]["box"]) & (r["s"]["own_words"] > o["s"]["own_words"]))
    base = base.withColumn("left", F.filter("others", lambda o: ~fragment(o))).withColumn("hit", likeliest(F.col("left"))).withColumn("hit", grown(F.col("left"), F.col("hit")))
    h = F.col("hit")
    theirs = X.tokens(F.col("hit.term"))
    fam_a, fam_b = _families(F.col("want"), rules), _families(F.col("hit.term"), rules)
    # a hit need not read like the expected designation, so it may have gone uncompared
    base = base.withColumn("read", similarities(F.array("hit.s.canonical", "refined.s.canonical"), F.col("want"), F.lit(0.0)))
    agreed = lambda o, k: F.coalesce(F.get("read", F.lit(k)) * S.length_penalty(o["s"]["canonical_words"], F.size(mine), f.length_penalty) * S.confidence_factor(o["s"]["confidence"], f.confidence_weight), F.lit(0.0))
    base = base.withColumn("agreement", agreed(h, 0))
    competing = F.exists("plausible", lambda r: ~G.overlaps(r["s"]["box"], F.col("hit.s.box"), 0.25))
    part = (F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0)
    blockers = F.array_compact(F.array(
        F.when(part, "refinement"),
        F.when(~part & ((F.size(fam_a) == 0) | (F.size(fam_b) == 0)), "unknown_family"),
        F.when(~part & F.arrays_overlap(fam_a, fam_b), "same_family"),
        F.when(F.col("hit.sim") < rules.vocabulary_assert_similarity, "weak_read"),
        F.when(F.col("hit.s.confidence") < F.greatest(F.lit(rules.class_assert_confidence), F.lit(rules.min_confidence)), "low_confidence"),
        F.when(brand.isNull(), "no_brand_anchor"),
        F.when(brand.isNotNull() & ~F.col("hit.near"), "not_in_position"),
        F.when(~good_image(rules), "degraded_image"),
        F.when(F.col("agreement") > f.mismatch, "close_to_expected"),
        F.when(competing, "competing_read"),
    ))
    base = base.withColumn("blockers", blockers)
    low = lambda r: r["s"]["confidence"] < rules.min_confidence
    read = lambda r, verdict, why: result(True, verdict, F.col(field), r["s"]["raw"], r["s"]["box"], F.round(-r["order"], 4), r["s"]["confidence"], why)
    said = lambda o, verdict, score, why: result(True, verdict, F.col(field), o["s"]["raw"], o["s"]["box"], F.round(score, 4), o["s"]["confidence"], F.concat(F.lit("the label reads "), o["term"], why))
    clean = F.when(low(c) | (residual(c) > rules.max_residual_edits), "REVIEW").otherwise("MATCH")
    why = F.when(clean == "MATCH", "the label reads the same").otherwise("the label reads nearly the same")
    r = F.col("refined")
    other = said(h, F.when(F.size("blockers") == 0, "MISMATCH").otherwise("REVIEW"), F.col("agreement"), F.when(F.size("blockers") > 0, F.concat(F.lit(" ("), F.array_join("blockers", ", "), F.lit(")"))).otherwise(""))
    out = (
        F.when(F.col("want") == "", not_found(F.col(field), "the application states no designation"))
        .when((F.col("top") >= f.match) & r.isNotNull(), said(r, "REVIEW", agreed(r, 1), F.lit(" (a longer designation is printed)")))
        .when(F.col("top") >= f.match, read(c, clean, why))
        .when(h.isNotNull(), other)
        .when((F.col("top") > f.mismatch) & (near_brand(first["s"]["box"]) | F.col("beside").isNull()), read(first, "REVIEW", F.lit("resembles the expected designation")))
        .when(F.col("beside").isNotNull(), read(F.col("beside"), "REVIEW", F.lit("stands where the designation should")))
        .otherwise(not_found(F.col(field), "could not be located"))
    )
    return base.select("label_id", "masks", "done", out.alias("result"))


def verify(labels: DataFrame, words: DataFrame, records: DataFrame, rules: Rules | None = None, trace: dict[str, dict] | None = None) -> DataFrame:
    """Field results: five rows for each record, in display order.

    labels: label_id, quality; words: label_id, line_no, word_no, text, confidence, box; records: one
    row per label. A label without words gives not-found rows; a field without a strategy is
    reviewed as not automated. A located value masks its spans for the fields after it. trace, if
    given, gets per field how many labels and candidate spans it had and how many spans are free
    after it, observed while the results are written: no pass is added.
    """
    return _judge(labels, words, records, rules or load(), None, trace)


def verify_versions(labels: DataFrame, words: DataFrame, records: DataFrame, sets: list[Rules]) -> DataFrame:
    """Field results of records under their own rules: rules_version and beverage_class name one of the sets.

    Sets that agree in fields, strategies and statute are judged in one plan, to which they are
    joined as rows; thresholds, vocabularies and the rest are then columns. Records that no set
    covers give no row: see refused().
    """
    made = None
    groups: dict[tuple, list[Rules]] = {}
    for r in sets:
        groups.setdefault(shape(r), []).append(r)
    for own in groups.values():
        # a row for each rule set: MOST_SETS at most
        table = F.broadcast(rule_rows(records.sparkSession, own))
        done = _judge(labels, words, records.join(table.select("rules_version", "beverage_class"), ["rules_version", "beverage_class"], "left_semi"), RuleColumns(own), table, None)
        made = done if made is None else made.unionByName(done)
    return made


def refused(records: DataFrame, sets: list[Rules]) -> DataFrame:
    """Records whose class and version no rule set covers; null is covered by none."""
    covered = F.broadcast(rule_rows(records.sparkSession, sets).select("rules_version", "beverage_class"))
    return records.join(covered, ["rules_version", "beverage_class"], "left_anti")


def _judge(labels: DataFrame, words: DataFrame, records: DataFrame, rules: Rules | RuleColumns, table: DataFrame | None, trace: dict[str, dict] | None) -> DataFrame:
    ruled = lambda df: df if table is None else df.join(table, ["rules_version", "beverage_class"])
    which = [] if table is None else ["rules_version", "beverage_class"]
    # labels that are alike are judged once, under the name of their design
    members = materialise(designs(labels, words, records.filter("label_id is not null")), "members")
    copies = members.groupBy("__design").agg(F.min("label_id").alias("__printed"), F.count(F.lit(1)).alias("__copies"))
    own = copies.join(members.dropDuplicates(["__design"]).drop("label_id"), "__design").withColumnRenamed("__design", "label_id")
    designed = own = materialise(shown_labels(own, which), "designs")
    shown = own.filter(F.col("label_id") == F.col("__shown")).select("label_id", "__printed")
    page = materialise(pages(words.withColumnRenamed("label_id", "__printed").join(shown, "__printed").drop("__printed")), "pages")
    own = own.drop("__printed")
    fields = sorted(rules.fields, key=lambda f: f.order)
    spanned = trace is not None or any(f.strategy in STRATEGIES.keys() - PAGE_ALONE for f in fields)
    # the wide rows are written once; what fields hand on is a narrow table
    rows = label_rows(own, page, rules if spanned else None)
    started = {"masks": F.array().cast(f"array<{BOX}>"), "done": F.struct("__copies")}
    written = None
    if spanned and trace is None and fields and fields[0].strategy in PAGE_ALONE:
        # a first field that reads the page alone is judged while spans are made
        with ThreadPoolExecutor(1) as pool:
            writing = pool.submit(inheritable_thread_target(page.sparkSession)(materialise), rows, "labels")
            state = written = _judge_field(ruled(label_rows(own, page).withColumns(started)), rules, fields.pop(0), None)
            wide = writing.result()
    else:
        wide = materialise(rows, "labels")
        state = wide.select("label_id", *[c.alias(name) for name, c in started.items()])
    for field in fields:
        state = _judge_field(ruled(wide.join(state, "label_id")), rules, field, trace)
        if written is not None:
            forget(written)
        written = state
    rows = ruled(materialise(wide.select("label_id", "quality", *which).join(state, "label_id").select("label_id", "quality", "done", *which), "judged"))
    forget(wide, state, page, designed)
    alert = ~F.col("done.government_warning.located") & good_image(rules)
    made = []
    for field in rules.fields if table is not None else sorted(rules.fields, key=lambda f: f.display_order):
        r = F.col("done")[field.id]
        up = alert if field.id == "government_warning" else F.lit(False)
        reason = F.when(up, "the mandatory statement is missing from a clear image").otherwise(r["reason"])
        made.append(F.struct(
            F.lit(field.id).alias("field"), F.lit(field.display_order).alias("display_order"), r["verdict"].alias("verdict"), r["expected"].alias("expected"), r["found"].alias("found"), r["box"].alias("box"),
            r["score"].alias("score"), r["confidence"].alias("ocr_confidence"), reason.alias("reason"), up.alias("elevated"), F.lit(field.strategy in STRATEGIES).alias("automated"), r["checks"].alias("checks"),
        ))
    results = rows.select(F.col("label_id").alias("__design"), F.lit(rules.version).alias("rules"), F.explode(F.array(*made)).alias("r"))
    return members.select("label_id", "__design").join(results, "__design").select("label_id", "r.*", "rules")


def _judge_field(rows: DataFrame, rules: Rules | RuleColumns, field: Field, trace: dict[str, dict] | None) -> DataFrame:
    """label_id, masks, done after one more field, written."""
    known, given = STRATEGIES.get(field.strategy), rows
    rows = known(rows, rules, field.id) if known else rows.withColumn("result", not_found(F.lit(None).cast("string"), "this field is not automated"))
    box = F.when(F.col("result.located"), F.col("result.box"))
    before = F.col("masks")
    seen = None
    if trace is not None and "spans" in given.columns:
        rows = rows if "spans" in rows.columns else rows.join(given.select("label_id", "spans"), "label_id")
        seen, copied = Observation(field.id), F.col("done.__copies")
        rows = rows.observe(seen, F.coalesce(F.sum(copied), F.lit(0)).alias("labels"), F.sum(copied * F.size(free(before))).alias("available"), F.sum(copied * F.size(free(F.when(box.isNotNull(), F.concat("masks", F.array(box.cast(BOX)))).otherwise(before)))).alias("remaining"))
    state = rows.select(
        "label_id", F.when(box.isNotNull(), F.concat("masks", F.array(box.cast(BOX)))).otherwise(F.col("masks")).alias("masks"), F.col("done").withField(field.id, F.col("result")).alias("done")
    )
    state = materialise(state, "state")
    if seen is not None:
        trace[field.id] = dict(seen.get)
    return state


def judge_pages(pages: DataFrame, records: DataFrame, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Field results of the records with a readable page (sidecars.parse_pages), and one summary row for every record.

    A bad page, or none, gives its record an UNREADABLE row with the fault; the others are judged.
    """
    errors = sidecars.unreadable(pages, records)
    good = pages.filter("fault is null")
    results = verify(sidecars.labels_of(good), sidecars.words_of(good), records.join(good.select("label_id"), "label_id", "left_semi"), rules)
    return results, triage.summarise(results, errors)


def broken_invariants(field_results: DataFrame) -> DataFrame:
    """Rows that can't be: a value not found yet mismatched, or a mismatch without a box. None, when all is well."""
    return field_results.filter((F.col("verdict") == "MISMATCH") & (F.col("found").isNull() | F.col("box").isNull()))
