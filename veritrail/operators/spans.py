"""Candidate spans of a label's words: lines, word runs within lines, runs of coherent lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import geometry as G
from veritrail.functions.bound import bound
from veritrail.functions.text import canonical, canonical_numeric, tokens
from veritrail.scratch import shuffle_parts

MAX_LINES, MAX_WORDS = 4, 6
FORMS = {"canonical": canonical, "numeric": canonical_numeric}
ROW_SHARE, GAP_SHARE, COLUMN_SHARE, GLYPH_RATIO = 0.5, 1.5, 0.3, 0.6


def middle(values: Column) -> Column:
    """The median of an array of numbers; null for an empty one."""
    at = lambda x: (F.get(x, ((F.size(x) - 1) / 2).cast("int")) + F.get(x, (F.size(x) / 2).cast("int"))) / 2
    return bound(F.array_sort(values), lambda x: F.when(F.size(x) > 0, at(x)))


def pages(words: DataFrame, forms: tuple[str, ...] = tuple(FORMS)) -> DataFrame:
    """label_id, label_glyph, page: a label's lines (line, box, glyph, words) in reading order; one exchange by label.

    Lines sort by the middle of their height; one joins the current row while it lies within half
    the label's median glyph height of the row's first line, and rows read from left to right. The
    row's first line is carried along a sorted array, since no window frame can hold it. Words get
    their canonical and numeric forms here, or those asked for, once for all spans they are part of.
    """
    # by number: the work is many times what the bytes suggest, so small partitions stay apart
    words = words.repartition(shuffle_parts(words.sparkSession), "label_id")
    words = words.withColumns({f: FORMS[f](F.col("text")) for f in forms})
    line = words.groupBy("label_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text", "confidence", "box", *forms))).alias("words"))
    heights = lambda ws: F.transform(ws, lambda w: G.height(w["box"]))
    line = line.withColumn("box", G.union(F.transform("words", lambda w: w["box"])))
    page = line.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct(G.centre_y(F.col("box")).alias("cy"), "line_no", F.col("box.left").alias("left"), "words", "box", middle(heights(F.col("words"))).alias("glyph")))).alias("lines"))
    tall = F.filter(F.flatten(F.transform("lines", lambda x: heights(x["words"]))), lambda h: h > 0)
    page = page.withColumn("label_glyph", F.coalesce(middle(tall), F.lit(1.0)))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(x["cy"] - acc["anchor"]) > F.col("label_glyph") * ROW_SHARE)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, x["cy"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    rows = page.withColumn("rows", F.aggregate("lines", start, step, lambda a: a["rows"]))
    ordered = F.array_sort(F.zip_with("rows", "lines", lambda r, x: F.struct(r.alias("row"), x["left"].alias("left"), x["line_no"].alias("line_no"), x["words"].alias("words"), x["box"].alias("box"), x["glyph"].alias("glyph"))))
    return rows.select("label_id", "label_glyph", F.transform(ordered, lambda x, n: F.struct(n.alias("line"), x["box"].alias("box"), x["glyph"].alias("glyph"), x["words"].alias("words"))).alias("page"))


def reading_lines(words: DataFrame) -> DataFrame:
    """label_id, label_glyph, line (position in reading order), words, box, glyph; one row per line of pages()."""
    return pages(words).select("label_id", "label_glyph", F.explode("page").alias("x")).select("label_id", "label_glyph", "x.line", "x.words", "x.box", "x.glyph")


def coherent(upper: Column, lower: Column, upper_glyph: Column, lower_glyph: Column, label_glyph: Column) -> Column:
    """Whether two neighbouring lines may belong to one value."""
    unit = F.when(label_glyph > 0, label_glyph).otherwise(F.lit(1.0))
    close = G.vertical_gap(upper, lower) <= unit * GAP_SHARE
    beside = G.column_overlap(upper, lower) >= COLUMN_SHARE
    alike = (upper_glyph > 0) & (lower_glyph > 0) & (upper_glyph / lower_glyph).between(GLYPH_RATIO, 1 / GLYPH_RATIO)
    return F.coalesce(close & beside & alike, F.lit(False))


def word_runs(n: Column, most: int = MAX_WORDS) -> Column:
    """All (start, end) runs of 1 to most of n words, the run of all words left out; by start, then end."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(s + 1, F.least(s + most, n)), lambda e: F.struct(s.alias("start"), e.alias("end")))))
    return F.filter(runs, lambda r: ~((r["start"] == 0) & (r["end"] == n)))


def _span(x: Column) -> Column:
    """A span of lines, run and words; no rule of the forms looks beyond a space, so its forms are the words' forms joined."""
    words = x["words"]
    form = lambda name: F.array_join(F.filter(words[name], lambda f: f != ""), " ")
    mean = F.aggregate(words["confidence"], F.lit(0.0), lambda a, c: a + c) / F.size(words)
    return F.struct(
        x["lines"].alias("lines"), x["run"].alias("run"), F.array_join(words["text"], " ").alias("raw"), form("canonical").alias("canonical"), form("numeric").alias("numeric"),
        G.union(words["box"]).alias("box"), mean.alias("confidence"), middle(F.transform(words["box"], G.height)).alias("glyph"), F.size(words).alias("n_words"),
    )


def _parts(page: Column, label_glyph: Column) -> Column:
    """What the spans of a page are made of, in generation order: lines, run and words."""
    none = F.lit(None).cast("struct<start: int, end: int>")
    part = lambda lines, run, words: F.struct(lines.alias("lines"), run.alias("run"), words.alias("words"))

    def inside(x: Column) -> Column:
        runs = F.transform(word_runs(F.size(x["words"])), lambda r: part(F.array(x["line"]), r.cast("struct<start: int, end: int>"), F.slice(x["words"], r["start"] + 1, r["end"] - r["start"])))
        return F.concat(F.array(part(F.array(x["line"]), none, x["words"])), runs)

    follows = F.zip_with(F.slice(page, F.lit(1), F.greatest(F.size(page) - 1, F.lit(0))), F.slice(page, F.lit(2), F.size(page)), lambda a, b: coherent(a["box"], b["box"], a["glyph"], b["glyph"], label_glyph))

    def across(at: Column, follows: Column) -> Column:
        lasting = F.filter(F.sequence(F.lit(1), F.least(F.lit(MAX_LINES - 1), F.size(page) - 1 - at)), lambda k: (at + k < F.size(page)) & (k > 0) & F.forall(F.slice(follows, at + 1, F.greatest(k, F.lit(0))), lambda ok: ok))
        taken = F.transform(lasting, lambda k: F.slice(page, at + 1, k + 1))
        return F.transform(taken, lambda xs: part(xs["line"], none, F.flatten(xs["words"])))

    starts = F.when(F.size(page) > 1, F.sequence(F.lit(0), F.size(page) - 2)).otherwise(F.array().cast("array<int>"))
    several = bound(follows, lambda f: F.flatten(F.transform(starts, lambda at: across(at, f))))
    return F.concat(F.flatten(F.transform(page, inside)), several)


def label_spans(page: Column, label_glyph: Column, keep_blank: bool = False) -> Column:
    """All spans of a page in generation order, with span_id (their place in it) and canonical_words."""
    # the words of a span are bound before it is made of them: each of its values reads them
    made = F.transform(_parts(page, label_glyph), _span)
    if not keep_blank:
        made = F.filter(made, lambda s: s["canonical"] != "")
    return F.transform(made, lambda s, n: F.struct(n.alias("span_id"), *[s[c].alias(c) for c in ("lines", "run", "raw", "canonical", "numeric", "box", "confidence", "glyph", "n_words")], F.size(tokens(s["canonical"])).alias("canonical_words")))


def span_index(words: DataFrame, keep_blank: bool = False) -> DataFrame:
    """One row per span: span_id (its place in generation order, the tie-break), lines, texts, box.

    Generation order: for each line the whole line, then its runs by start and end; afterwards runs
    of two to four coherent lines by start and length. Spans of punctuation only vanish. One
    exchange by label serves the whole index; the rest is an expression of a label's own lines.
    """
    spans = pages(words).select("label_id", F.explode(label_spans(F.col("page"), F.col("label_glyph"), keep_blank)).alias("s"))
    return spans.select("label_id", "s.*")


def _counts(page: DataFrame, value: Callable[[Column], Column], **taken: Callable[[Column], Column]) -> DataFrame:
    """Per label that has spans, of how many of them the value (of lines, run and words) is taken; spans are those of span_index().

    They are counted in their label's row, without their texts.
    """
    shown = F.filter(_parts(F.col("page"), F.col("label_glyph")), lambda x: F.exists(x["words"]["canonical"], lambda f: f != ""))
    size = lambda xs: F.size(xs).cast("long")
    counts = bound(F.transform(shown, value), lambda xs: F.struct(size(xs).alias("spans"), *[size(F.filter(xs, f)).alias(n) for n, f in taken.items()]))
    # labels without spans go here: a filter of rows would be pushed down and make spans, and for each of them the page, again
    return page.select("label_id", F.explode(F.filter(F.array(counts), lambda c: c["spans"] > 0)).alias("c")).select("label_id", *[f"c.{n}" for n in taken])


def family_counts(words: DataFrame) -> DataFrame:
    """Per label, how many candidate spans lie in a single line and how many in several."""
    return _counts(pages(words, ("canonical",)), lambda x: F.size(x["lines"]), single=lambda n: n == 1, several=lambda n: n > 1)


def candidate_trace(words: DataFrame, masks: DataFrame) -> DataFrame:
    """Per label, how many candidate spans there are and how many the masks (label_id, masks; a row a label at most) leave free."""
    # a small file may hold many labels, so no size that Spark takes from it sends all masks to all executors
    both = pages(words, ("canonical",)).join(masks.hint("merge"), "label_id", "left")
    free = lambda b: F.coalesce(unmasked(b, F.col("masks")), F.lit(True))
    return _counts(both, lambda x: bound(x["words"]["box"], G.union), candidates=lambda b: F.lit(True), free=free)


def neighbour_gaps(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Per block (label_id, first_line, last_line, box, glyph) the least gap to other text above, below and beside it.

    lines: label_id, line, box. Gaps are in the block's line heights, null where no text is there;
    above and below only lines count that share some of the block's columns. Only advice: borders
    and panels set a block apart as well, and boxes don't show them.
    """
    b, x = F.col("b.box"), F.col("x.box")
    other = F.col("x.line").isNotNull() & ~F.col("x.line").between(F.col("b.first_line"), F.col("b.last_line"))
    above = other & (x["bottom"] <= b["top"]) & (G.column_overlap(x, b) > 0)
    below = other & (x["top"] >= b["bottom"]) & (G.column_overlap(x, b) > 0)
    beside = other & (G.vertical_gap(x, b) == 0)
    least = lambda where, gap: F.greatest(F.lit(0.0), F.min(F.when(where, gap)))
    out = blocks.alias("b").join(lines.alias("x"), F.col("b.label_id") == F.col("x.label_id"), "left").groupBy(F.col("b.label_id").alias("label_id"), F.col("b.glyph").alias("glyph")).agg(
        F.max(above).alias("has_above"), F.max(below).alias("has_below"), F.max(beside).alias("has_beside"),
        least(above, b["top"] - x["bottom"]).alias("above"), least(below, x["top"] - b["bottom"]).alias("below"),
        least(beside, F.greatest(b["left"] - x["right"], x["left"] - b["right"])).alias("beside"),
    )
    return out.select("label_id", *[F.when(F.col(f"has_{n}"), F.col(n) / F.col("glyph")).alias(n) for n in ("above", "below", "beside")])


def unmasked(box: Column, masks: Column, share: float = 0.5) -> Column:
    """Whether less than that share of the box lies in any one mask."""
    return ~F.exists(masks, lambda m: G.overlaps(box, m, share))
