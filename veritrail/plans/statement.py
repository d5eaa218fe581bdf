"""The statutory warning: find the block among a label's words, compare it word by word.

One label is one row and its words are an array, so everything but the resolution of misread and
merged words is an expression of that row. Those words alone are exploded and joined to an index of
the statute's words and word runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import alignment as A
from veritrail.functions import geometry as G
from veritrail.functions import patterns as P
from veritrail.functions import similarity as S
from veritrail.functions import text as X
from veritrail.functions.bound import bound
from veritrail.rules import HEADER, STATUTE, TAILS, Rules

MOST_MERGED = 6  # words of the statute read as one
HEADER_UNITS = 4

DIFFERENCES = "array<struct<position: int, expected: string, found: string, kind: string>>"
FINDINGS = "array<struct<header: boolean, position: int, expected: string, found: string, kind: string, assertable: boolean>>"


def fixed_tokens(text: str) -> list[str]:
    """Canonical tokens of a plain fixed text, one for each of its words."""
    fold = lambda w: w if w.isdigit() else "".join(X.CONFUSED.get(c, c) for c in w)
    out = [[fold(t) for t in re.findall(r"\w+", w.upper())] for w in text.split()]
    if any(len(ts) != 1 for ts in out):
        raise ValueError("every word of a fixed text must be one token")
    return [ts[0] for ts in out]


@dataclass(frozen=True)
class Statute:
    text: str = STATUTE
    header: str = HEADER
    tails: tuple[str, ...] = TAILS

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def tokens(self) -> list[str]:
        return fixed_tokens(self.text)

    @property
    def header_size(self) -> int:
        return len(self.header.split())


def run_index(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """variant, text, rank, run: runs of 1 to MOST_MERGED tokens joined, and each with one letter left out.

    Equal joined texts keep their first run; rank orders by length in tokens and place.
    """
    runs: dict[str, list[str]] = {}
    for size in range(1, MOST_MERGED + 1):
        for at in range(len(tokens) - size + 1):
            runs.setdefault("".join(tokens[at : at + size]), tokens[at : at + size])
    rows = [(text, k, run) for k, (text, run) in enumerate(runs.items())]
    table = spark.createDataFrame(rows, "text string, rank int, run array<string>")
    return table.select(F.explode(A.deletions(X.enumerator_fold(F.col("text")))).alias("variant"), "text", "rank", "run")


def resolve_tokens(tokens: DataFrame, key: list[str], statute: list[str], least: int | Column) -> DataFrame:
    """key, run: what tokens (key, token) stand for, where it is no word of the statute read as it is.

    In this order: a run of statutory words without its spaces; a statutory word but for noise; a
    run within one edit; of several the earliest. Texts one edit apart share a variant, so
    candidates come from an equi-join; the distance is computed for those alone. Tokens that
    stand for nothing, null ones and those read as statutory words give no row.
    """
    index = run_index(tokens.sparkSession, statute)
    longest = max(len("".join(statute[i : i + MOST_MERGED])) for i in range(len(statute))) + 1
    tokens = tokens.withColumn("least", F.lit(least))
    asked = tokens.filter(F.char_length("token").between(1, longest) & ~F.col("token").isin(sorted(set(statute))))
    near = asked.select(*key, "token", "least", F.explode(A.deletions(X.enumerator_fold(F.col("token")))).alias("variant"))
    # the index is as long as the statute is, and fixed with it
    met = near.join(F.broadcast(index), "variant").select(*key, "token", "least", "text", "rank", "run")
    one = F.size("run") == 1
    order = (
        F.when(~one & (F.col("text") == F.col("token")), 0)
        .when(one & (S.token_class(F.col("text"), F.col("token"), F.col("least")) == "noise"), 1)
        .when(~one & (F.levenshtein("text", "token") <= 1), 2)
    )
    return met.withColumn("order", order).filter("order is not null").groupBy(*key).agg(F.min(F.struct("order", "rank", "run")).alias("best")).select(*key, F.col("best.run").alias("run"))


def _units(page: Column) -> Column:
    """Words with tokens, in reading order: line, text, confidence, box, tokens."""
    of_line = lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w["text"].alias("text"), w["confidence"].alias("confidence"), w["box"].alias("box"), X.tokens(w["canonical"]).alias("tokens")))
    return F.filter(F.flatten(F.transform(page, of_line)), lambda u: F.size(u["tokens"]) > 0)


def _windows(units: Column, most: int) -> Column:
    """start, end, key of runs of up to most units that step over no line."""
    n = F.size(units)

    def at(s: Column) -> Column:
        wide = F.sequence(F.lit(1), F.least(F.lit(most), n - s))
        made = F.transform(wide, lambda w: F.struct(s.alias("start"), (s + w).alias("end"), F.slice(units, s + 1, w).alias("us")))
        steps = lambda us: F.zip_with(F.slice(us, F.lit(2), F.size(us)), F.slice(us, F.lit(1), F.size(us) - 1), lambda b, a: b["line"] - a["line"])
        near = F.filter(made, lambda x: F.forall(steps(x["us"]), lambda d: d <= 1))
        return F.transform(near, lambda x: F.struct(x["start"], x["end"], F.array_join(F.flatten(F.transform(x["us"], lambda u: u["tokens"])), "").alias("key")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def _scored(windows: Column, target: str, least: float, size: int | None = None) -> Column:
    """score, start, end of windows that reach least; bounds by lengths and by the built-in distance come before the score."""
    k = len(target)

    def may_reach(w: Column) -> Column:
        lengths = F.char_length(w["key"]) + k
        near = 2 * F.least(F.char_length(w["key"]), F.lit(k)) >= least * lengths
        # a substitution is one edit to the distance and two to the ratio, so no window that reaches least is farther
        return near & (F.lit(True) if size is None else w["end"] - w["start"] <= size) & (F.levenshtein(w["key"], F.lit(target)) <= (1 - least) * lengths + 1e-9)

    possible = F.filter(windows, may_reach)
    scored = F.transform(possible, lambda w: F.struct(A.fixed_ratio(w["key"], target).alias("score"), w["start"].alias("start"), w["end"].alias("end")))
    return F.filter(scored, lambda w: w["score"] >= least)


def _anchor(windows: Column, statute: Statute, rules: Rules) -> tuple[Column, Column]:
    """(start, end) of the header, the shorter and then the earlier of equal reads; and of a phrase further on, the first."""
    header = _scored(windows, "".join(fixed_tokens(statute.header)), rules.header_score)
    best = F.array_max(F.transform(header, lambda w: F.struct(w["score"].alias("a"), (w["start"] - w["end"]).alias("b"), (-w["start"]).alias("c"), w["end"].alias("end"))))
    found = []
    for k, phrase in enumerate(statute.tails):
        hits = _scored(windows, "".join(fixed_tokens(phrase)), rules.tail_score, len(phrase.split()) + 1)
        found.append(F.transform(hits, lambda w, k=k: F.struct(w["score"].alias("a"), F.lit(-k).alias("b"), (-w["start"]).alias("c"), (-w["end"]).alias("d"))))
    tail = F.array_max(F.concat(*found))
    place = lambda x, end: F.when(x.isNotNull(), F.struct((-x["c"]).alias("start"), end.alias("end")))
    return place(best, best["end"]), place(tail, -tail["d"])


def _running(units: Column, n: int, backward: bool) -> Column:
    """After each unit of an array, 2 LCS / (sum of lengths) of what was read so far and the statute."""
    field = "back" if backward else "ahead"
    start = F.struct(A.full_row(n).alias("row"), F.lit(0).alias("read"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, u: Column) -> Column:
        row = F.aggregate(u[field], s["row"], lambda v, m: A.lcs_step(v, m, n))
        read = s["read"] + F.size(u[field])
        return F.struct(row.alias("row"), read.alias("read"), F.concat(s["out"], F.array(2.0 * A.lcs_of(row, n) / (read + n))).alias("out"))

    return F.aggregate(units, start, step, lambda s: s["out"])


def _expand(units: Column, start: Column, end: Column, n: int, backward: bool) -> Column:
    """The end (backward: the start) of the block, widened line by line while it comes closer to the statute."""
    side = F.reverse(F.slice(units, F.lit(1), end)) if backward else F.slice(units, start + 1, F.size(units) - start)
    scores = _running(side, n, backward)
    cuts = F.zip_with(F.transform(side, lambda u, k: F.struct(u["line"].alias("line"), (k + 1).alias("cut"))), scores, lambda c, s: F.struct(c["line"].alias("line"), c["cut"].alias("cut"), s.alias("score")))
    # the running scores serve all lines, so they are bound
    cut = bound(cuts, lambda cs: bound(end - start, lambda inside: _widest(cs, inside, backward)))
    return end - cut if backward else start + cut


def _widest(cuts: Column, inside: Column, backward: bool) -> Column:
    """Of cuts (line, cut, score) beyond that of the block, inside, the one it is widened to."""
    here = F.element_at(F.slice(cuts, F.lit(1), inside), F.lit(-1))
    later = F.filter(cuts, lambda c: c["cut"] > inside)

    def of(here: Column, beyond: Column) -> Column:
        # of equal cuts the one nearest the block; in the line it starts from, going backward, the farthest
        far = lambda c: (c["line"] == here["line"]) if backward else F.lit(False)
        rank = lambda c: F.struct(c["score"].alias("score"), F.when(far(c), c["cut"]).otherwise(-c["cut"]).alias("tie"), c["cut"].alias("cut"))
        lines = F.array_distinct(F.transform(beyond, lambda c: c["line"]))
        best = F.transform(lines, lambda x: F.struct(x.alias("line"), F.array_max(F.transform(F.filter(beyond, lambda c: c["line"] == x), rank)).alias("best")))
        first = F.struct(here["score"].alias("score"), inside.alias("cut"), F.lit(False).alias("over"))

        def step(s: Column, x: Column) -> Column:
            wider = ~s["over"] & (x["best"]["score"] > s["score"])
            over = s["over"] | (~wider & (x["line"] != here["line"]))
            return F.struct(F.when(wider, x["best"]["score"]).otherwise(s["score"]).alias("score"), F.when(wider, x["best"]["cut"]).otherwise(s["cut"]).alias("cut"), over.alias("over"))

        return F.aggregate(best, first, step, lambda s: s["cut"])

    return bound(here, lambda h: bound(later, lambda b: of(h, b)))


def _median(values: Column) -> Column:
    x, n = F.array_sort(values), F.size(values)
    return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2


def _closed(rules: Rules) -> Column:
    """For each place 0 to n between units, whether what stands there leaves no room for unread words.

    On one line an ordinary word gap; across lines the next line at ordinary leading, the upper one
    read to the block's right edge and the lower one from its left edge, as far as they belong to it.
    """
    block_lines = F.array_distinct(F.transform("block", lambda u: u["line"]))
    own = F.filter("page", lambda x: F.array_contains(block_lines, x["line"]))
    gaps = F.zip_with(F.slice(F.col("own"), F.lit(2), F.size("own")), F.slice(F.col("own"), F.lit(1), F.size("own") - 1), lambda b, a: G.vertical_gap(a["box"], b["box"]))
    glyph = F.coalesce(F.nullif(_median(F.transform("own", lambda x: x["glyph"])), F.lit(0.0)), F.lit(1.0))
    leading = F.coalesce(_median(gaps), F.col("glyph") * 0.5) + F.col("glyph") * rules.line_gap_slack
    line = lambda n: F.get(F.filter("page", lambda x: x["line"] == n), F.lit(0))["box"]
    box = F.col("box")

    def at(k: Column) -> Column:
        a, b = F.get("units", k - 1), F.get("units", k)
        same = b["box"]["left"] - a["box"]["right"] <= F.col("glyph") * rules.word_gap
        next_line = (b["line"] - a["line"] == 1) & (G.vertical_gap(line(a["line"]), line(b["line"])) <= F.col("leading"))
        full = (k <= F.col("start")) | (a["box"]["right"] >= box["right"] - G.width(box) * rules.ragged_right)
        flush = (k >= F.col("end")) | (b["box"]["left"] <= box["left"] + F.col("glyph") * rules.indent)
        return F.coalesce(F.when(a["line"] == b["line"], same).otherwise(next_line & full & flush), F.lit(False))

    places = F.transform(F.sequence(F.lit(0), F.size("units")), lambda k: F.when((k > 0) & (k < F.size("units")), at(k)).otherwise(F.lit(False)))
    return own, glyph, leading, places


def _words(words: Column, start: Column, end: Column) -> Column:
    return X.quote_trim(F.array_join(F.slice(words, start + 1, end - start), " "))


def _capitals(rules: Rules) -> tuple[Column, Column, Column, Column]:
    """The header's own letters; its outcome; whether a failure may be asserted; whether a colon was read."""
    units = F.slice("units", F.col("header.start") + 1, F.col("header.end") - F.col("header.start"))
    joined = F.array_join(F.transform(units, lambda u: u["text"]), " ")
    raw = P.cut_header(joined)
    styled = F.exists(F.filter(F.split(raw, r"\s+"), lambda w: w != ""), lambda w: P.miscapitalised(w, rules.case_run))
    lower = F.length(F.regexp_replace(raw, r"[^\p{Ll}]", ""))
    outcome = F.when(F.col("header").isNull(), "not_evaluable").when(X.all_caps(raw), "pass").when(styled | (lower > rules.sporadic_lowercase), "fail").otherwise("pass")
    confidence = F.try_divide(F.aggregate(units, F.lit(0.0), lambda a, u: a + u["confidence"]), F.size(units))
    # unassessed quality does not count as degraded here
    q = F.col("quality")
    degraded = q["score"].isNotNull() & (~F.coalesce(q["usable"], F.lit(False)) | (F.size(F.coalesce(q["issues"], F.array().cast("array<string>"))) > 0) | (q["score"] < rules.good_quality))
    sure = styled & (confidence >= rules.min_confidence) & ~F.coalesce(degraded, F.lit(False))
    after = F.get("units", F.col("header.end"))["text"]
    colon = F.startswith(F.substr(joined, F.char_length(raw) + 1), F.lit(":")) | F.coalesce(F.startswith(after, F.lit(":")), F.lit(False))
    return F.trim(raw), outcome, F.coalesce(sure, F.lit(False)), F.coalesce(colon, F.lit(True))


def _grades(rules: Rules) -> Column:
    """Opcodes with segmented (a run that differs in its spaces only) and grades of its paired words."""

    def of(o: Column) -> Column:
        want, got = F.slice("statute", o["i1"] + 1, o["i2"] - o["i1"]), F.slice("read", o["j1"] + 1, o["j2"] - o["j1"])
        replace = o["tag"] == "replace"
        spaces = replace & (F.size(want) != F.size(got)) & (S.token_class(F.array_join(want, ""), F.array_join(got, ""), rules.noise_length) == "noise")
        paired = F.least(F.size(want), F.size(got))
        both = F.zip_with(F.slice(want, F.lit(1), paired), F.slice(got, F.lit(1), paired), lambda e, f: S.token_class(e, f, rules.noise_length))
        return F.struct(o["tag"].alias("tag"), o["i1"].alias("i1"), o["i2"].alias("i2"), o["j1"].alias("j1"), o["j2"].alias("j2"), spaces.alias("spaces"), F.when(replace & ~spaces, both).otherwise(F.array().cast("array<string>")).alias("grades"))

    return F.transform("opcodes", of)


def _findings(rules: Rules, statute: Statute) -> Column:
    """Differences of the block's words: substituted and missing ones with what is asserted, extra ones."""
    raw = F.array(*[F.lit(w) for w in statute.words])
    unit = lambda j: F.get("of_unit", j)
    text = lambda j1, j2: X.quote_trim(F.array_join(F.transform(F.array_distinct(F.slice("of_unit", j1 + 1, j2 - j1)), lambda k: F.get("units", k)["text"]), " "))
    sure = lambda j1, j2: F.forall(F.slice("of_unit", j1 + 1, j2 - j1), lambda k: F.get("units", k)["confidence"] >= rules.min_confidence)
    say = lambda position, expected, found, kind, assertable: F.struct(F.lit(False).alias("header"), position.alias("position"), expected.alias("expected"), found.alias("found"), F.lit(kind).alias("kind"), assertable.alias("assertable"))
    by_tail = F.col("header").isNull()
    null = F.lit(None).cast("string")

    def missing(i1: Column, i2: Column, j: Column) -> Column:
        within = (j > 0) & (j < F.size("of_unit")) & (unit(j) == unit(j - 1))
        closed = F.get("closed", F.coalesce(unit(j), F.col("end")))
        return say(i1, _words(raw, i1, i2), null, "missing", F.coalesce(within | closed, F.lit(False)))

    def extra(j1: Column, j2: Column, i: Column) -> Column:
        return say(i, null, text(j1, j2), "extra", sure(j1, j2))

    def of(o: Column) -> Column:
        n = F.size(o["grades"])
        swaps = F.filter(F.transform(o["grades"], lambda g, k: F.struct(g.alias("grade"), k.alias("k"))), lambda g: g["grade"] != "noise")
        swapped = F.transform(swaps, lambda g: say(o["i1"] + g["k"], _words(raw, o["i1"] + g["k"], o["i1"] + g["k"] + 1), text(o["j1"] + g["k"], o["j1"] + g["k"] + 1), "substituted",
            (g["grade"] == "wording") & sure(o["j1"] + g["k"], o["j1"] + g["k"] + 1) & ~(by_tail & (o["i1"] + g["k"] < statute.header_size))))
        odd = (o["tag"] != "equal") & ~o["spaces"]
        rest = F.array_compact(F.array(F.when(odd & (o["i2"] - o["i1"] > n), missing(o["i1"] + n, o["i2"], o["j1"] + n)), F.when(odd & (o["j2"] - o["j1"] > n), extra(o["j1"] + n, o["j2"], o["i2"]))))
        return F.concat(swapped.cast(FINDINGS), rest.cast(FINDINGS))

    return F.flatten(F.transform("graded", of)).cast(FINDINGS)


def judge_statements(rows: DataFrame, rules: Rules, statute: Statute | None = None) -> DataFrame:
    """label_id, w: what rows (label_id, page, quality, and rule if rules are columns) say of the statement; one row per label.

    page: the lines in reading order (line, box, glyph, words with text, confidence, box, canonical). w: located,
    box, found, score, confidence, verdict, reason, capitals, capitals_assertable, text, gaps,
    shares_line, precision, differences. A label without words, or without anything like the
    statement, is not located. Null quality is unassessed. Labels repeat as often as their rows;
    rows with a null label_id get no w.
    """
    statute = statute or Statute(rules.statute, rules.header, rules.tails)
    carried = [c for c in rows.columns if c == "rule"]
    tokens = statute.tokens
    n = len(tokens)
    base = rows.filter("label_id is not null").select("label_id", F.coalesce("page", F.array().cast(rows.schema["page"].dataType)).alias("page"), "quality", *carried).withColumn("units", _units(F.col("page")))
    # misread and merged words
    each = base.select("label_id", *carried, F.posexplode("units").alias("u", "unit")).select("label_id", "u", F.lit(rules.noise_length).alias("noise"), F.posexplode("unit.tokens").alias("k", "token"))
    known = resolve_tokens(each, ["label_id", "u", "k"], tokens, F.col("noise"))
    entry = F.struct(F.concat_ws("_", "u", "k").alias("key"), "run")
    known = known.groupBy("label_id").agg(F.map_from_entries(F.collect_set(entry)).alias("runs"))
    base = base.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label_id").join(known, "label_id", "left")
    stand = lambda u, k: F.flatten(F.transform(u["tokens"], lambda t, m: F.coalesce(F.try_element_at(F.col("runs"), F.concat_ws("_", k.cast("string"), m.cast("string"))), F.array(t))))
    base = base.withColumn("stood", F.transform("units", stand))
    ahead, back = A.bits_of(tokens), A.bits_of(tokens, True)
    scored = F.zip_with("units", "stood", lambda u, s: F.struct(u["line"].alias("line"), A.masks(s, ahead).alias("ahead"), F.reverse(A.masks(s, back)).alias("back")))
    base = base.withColumn("scored", scored).withColumn("windows", _windows(F.col("units"), HEADER_UNITS))
    header, tail = _anchor(F.col("windows"), statute, rules)
    base = base.withColumn("header", header).withColumn("tail", F.when(F.col("header").isNull(), tail)).drop("windows", "stood", "runs")
    base = base.withColumn("start", F.coalesce("header.start", "tail.start")).withColumn("end", F.coalesce("header.end", "tail.end"))
    located = F.col("start").isNotNull()
    base = base.withColumn("end", F.when(located, _expand(F.col("scored"), F.col("start"), F.col("end"), n, False)))
    by_tail = located & F.col("header").isNull()
    base = base.withColumn("start", F.when(by_tail, _expand(F.col("scored"), F.col("start"), F.col("end"), n, True)).otherwise(F.col("start")))
    base = base.withColumn("end", F.when(by_tail, _expand(F.col("scored"), F.col("start"), F.col("end"), n, False)).otherwise(F.col("end")))
    size = F.col("end") - F.col("start")
    base = base.withColumn("block", F.when(located, F.slice("units", F.col("start") + 1, size)).otherwise(F.array().cast(base.schema["units"].dataType)))
    score = F.element_at(_running(F.slice("scored", F.col("start") + 1, size), n, False), F.lit(-1))
    base = base.withColumn("score", F.when(located, score)).withColumn("box", G.union(F.transform("block", lambda u: u["box"])))
    own, glyph, leading, closed = _closed(rules)
    base = base.withColumn("own", own).withColumn("glyph", glyph).withColumn("leading", leading).withColumn("closed", F.when(located, closed))
    # the diff is of the words as read
    base = base.withColumn("read", F.flatten(F.transform("block", lambda u: u["tokens"]))).withColumn("of_unit", F.flatten(F.transform("block", lambda u, k: F.transform(u["tokens"], lambda t: k + F.col("start")))))
    base = base.withColumn("statute", F.array(*[F.lit(t) for t in tokens])).withColumn("opcodes", F.when(located, A.opcodes(F.col("statute"), F.col("read"))))
    base = base.withColumn("graded", _grades(rules)).withColumn("wording", _findings(rules, statute))
    clean = F.aggregate("graded", F.lit(0), lambda a, o: a + F.when((o["tag"] == "equal") | o["spaces"], o["j2"] - o["j1"]).otherwise(F.size(F.filter(o["grades"], lambda g: g == "noise"))))
    base = base.withColumn("precision", F.when(F.size("read") > 0, clean / F.size("read")).otherwise(F.lit(0.0)))
    raw, outcome, sure, colon = _capitals(rules)
    base = base.withColumn("raw", raw).withColumn("capitals", outcome).withColumn("capitals_assertable", sure & (F.col("capitals") == "fail")).withColumn("colon", colon)
    said = lambda header, position, expected, found, kind, assertable: F.struct(F.lit(header).alias("header"), F.lit(position).alias("position"), F.lit(expected).alias("expected"), found.cast("string").alias("found"), F.lit(kind).alias("kind"), assertable.alias("assertable"))
    about = F.array_compact(F.array(
        F.when(F.col("capitals") == "fail", said(True, 0, statute.header, F.col("raw"), "capitalisation", F.col("capitals_assertable"))),
        F.when(F.col("header").isNotNull() & ~F.col("colon"), said(False, statute.header_size, ":", F.lit(None), "missing", F.lit(False))),
    ))
    base = base.withColumn("findings", F.concat(about.cast(FINDINGS), "wording"))
    base = base.withColumn("confidence", F.try_divide(F.aggregate("block", F.lit(0.0), lambda a, u: a + u["confidence"]), F.size("block")))
    asserted = F.exists("findings", lambda f: f["assertable"] & (f["header"] | (F.col("precision") >= rules.clean_read)))
    low, field = F.col("confidence") < rules.min_confidence, rules.of("government_warning")
    verdict = F.when(low, "REVIEW").when(F.size("findings") > 0, F.when(asserted, "MISMATCH").otherwise("REVIEW")).when(F.col("score") >= field.match, "MATCH").otherwise("REVIEW")
    parts = F.transform("findings", lambda f: F.concat(f["kind"], F.lit(": expected "), F.coalesce(F.concat(F.lit("'"), f["expected"], F.lit("'")), F.lit("nothing")), F.lit(", found "), F.coalesce(F.concat(F.lit("'"), f["found"], F.lit("'")), F.lit("nothing"))))
    more = F.size("findings") - 3
    listed = F.concat(F.array_join(F.slice(parts, F.lit(1), F.lit(3)), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    reason = F.when(low, "the statement was read with low confidence").when(F.size("findings") > 0, listed).when(verdict == "MATCH", "the statement reads as prescribed").otherwise("the statement resembles the prescribed one")
    gaps, shares = _neighbours()
    differences = F.array_sort(F.transform(F.filter("wording", lambda f: ~f["header"]), lambda f: F.struct(f["position"].alias("position"), f["expected"].alias("expected"), f["found"].alias("found"), f["kind"].alias("kind"))))
    w = F.struct(
        located.alias("located"), F.col("box").alias("box"), F.when(located, F.array_join(F.transform("block", lambda u: u["text"]), " ")).alias("found"), F.coalesce(F.round("score", 4), F.lit(0.0)).alias("score"),
        F.when(located, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(located, verdict).otherwise("REVIEW").alias("verdict"), F.when(located, reason).otherwise("the statement was not found").alias("reason"),
        F.when(located, F.col("capitals")).otherwise("not_evaluable").alias("capitals"), F.coalesce(located & F.col("capitals_assertable"), F.lit(False)).alias("capitals_assertable"),
        F.when(~located, "not_evaluable").when(F.exists("findings", lambda f: ~f["header"]), "fail").otherwise("pass").alias("text"),
        F.when(located, gaps).alias("gaps"), F.when(located, shares).otherwise(F.lit(False)).alias("shares_line"), F.when(located, F.col("precision")).alias("precision"),
        F.when(located, differences).otherwise(F.array().cast(DIFFERENCES)).cast(DIFFERENCES).alias("differences"),
    )
    return base.select("label_id", w.alias("w"))


def _neighbours() -> tuple[Column, Column]:
    """Gaps to the nearest other text above, below and beside the block, in line heights; whether another text shares a line."""
    box = F.col("box")
    block_lines = F.transform("own", lambda x: x["line"])
    others = F.filter("page", lambda x: ~F.array_contains(block_lines, x["line"]))
    gap = lambda where, of: F.greatest(F.lit(0.0), F.array_min(F.transform(F.filter(others, where), of))) / F.col("glyph")
    none = lambda where, c: F.when(F.exists(others, where), c)
    above = lambda x: (x["box"]["bottom"] <= box["top"]) & (G.column_overlap(x["box"], box) > 0)
    below = lambda x: (x["box"]["top"] >= box["bottom"]) & (G.column_overlap(x["box"], box) > 0)
    beside = lambda x: G.vertical_gap(x["box"], box) == 0
    gaps = F.struct(
        none(above, gap(above, lambda x: box["top"] - x["box"]["bottom"])).alias("above"), none(below, gap(below, lambda x: x["box"]["top"] - box["bottom"])).alias("below"),
        none(beside, gap(beside, lambda x: F.greatest(box["left"] - x["box"]["right"], x["box"]["left"] - box["right"]))).alias("beside"),
    )
    shares = F.exists(F.transform("units", lambda u, k: F.struct(u["line"].alias("line"), k.alias("k"))), lambda u: F.array_contains(block_lines, u["line"]) & ((u["k"] < F.col("start")) | (u["k"] >= F.col("end"))))
    return gaps, shares
