"""Texts that read as a term of a vocabulary: shared letter pairs by an equi-join, the exact ratio for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import similarity as S
from veritrail.functions import text as X

GRAM = 2


def grams(text: Column) -> Column:
    """Pairs of neighbouring letters with their number among equal ones, so that shared ones count as often as both have them."""
    n = F.char_length(text)
    pairs = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    ranked = F.array_sort(pairs)
    return F.transform(ranked, lambda g, k: F.concat(g, (k - F.array_position(ranked, g)).cast("string")))


def least_shared(lengths: Column, least: float) -> Column:
    """Letter pairs that two texts whose lengths sum to this share at least, if their ratio is that or more.

    (1 - ratio) * lengths letters are put in or left out on the way from one to the other; one spoils
    two pairs of the text that has it and one of the other.
    """
    return F.ceil(lengths / 2 - (GRAM - 1) - (2 * GRAM - 1) / 2 * (1 - least) * lengths - 1e-9)


SHORTLIST = 3


def near_forms(texts: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """text, term, form, score: canonical texts (text) and terms (term) whose ratio is least or more in a form.

    Forms: 0 tokens in order of the alphabet, 1 no spaces. A pair that reaches least has lengths
    near enough and shares least_shared() letter pairs, so none is lost before its ratio is
    computed. Repeated texts give their pairs once; null and empty ones none. Terms too short for
    the bound are refused: they'd have to be met by all texts.
    """
    forms = lambda c: F.array(F.struct(F.lit(0).alias("form"), X.sorted_tokens(c).alias("as")), F.struct(F.lit(1).alias("form"), X.despaced(c).alias("as")))
    shaped = terms.select("term").distinct().select("term", F.explode(forms(F.col("term"))).alias("f")).select("term", "f.form", F.col("f.as").alias("term_as"), F.char_length("f.as").alias("m"))
    reach = (2 - least) / least
    # a term's nearest length is the shortest that can reach least
    bound = shaped.agg(F.min(least_shared(F.col("m") + F.ceil(F.col("m") / reach), least)).alias("shared"), F.min("m").alias("short"), F.max("m").alias("long")).first()
    if bound["shared"] is None:
        return texts.sparkSession.createDataFrame([], "text string, term string, form int, score double")
    if bound["shared"] < 1:
        raise ValueError(f"a term of {bound['short']} letters has too few letter pairs for ratios of {least}")
    possible = texts.select("text").distinct().select("text", F.explode(forms(F.col("text"))).alias("f")).select("text", "f.form", F.char_length("f.as").alias("n"), F.col("f.as").alias("text_as"))
    possible = possible.filter(F.col("n").between(bound["short"] / reach, bound["long"] * reach))
    asked = possible.select("text", "form", "n", "text_as", F.explode(grams(F.col("text_as"))).alias("gram"))
    known = shaped.select("term", "form", "m", "term_as", F.explode(grams(F.col("term_as"))).alias("gram"))
    met = asked.join(known, ["form", "gram"]).filter((F.col("n") <= F.col("m") * reach) & (F.col("m") <= F.col("n") * reach))
    counted = met.groupBy("text", "term", "form", "text_as", "term_as").count().filter(F.col("count") >= least_shared(F.char_length("text_as") + F.char_length("term_as"), least))
    return counted.select("text", "term", "form", S.ratio(F.col("text_as"), F.col("term_as")).alias("score")).filter(F.col("score") >= least)


def within_reach(text: Column, terms: list[str], least: float) -> Column:
    """Whether a canonical text is neither too long nor too short for near_forms() to find one of the terms in it."""
    if not terms:
        return F.lit(False)
    reach = (2 - least) / least
    short, long = min(len(t.replace(" ", "")) for t in terms), max(map(len, terms))
    return (F.char_length(text) >= short / reach - 1e-9) & (F.char_length(X.despaced(text)) <= long * reach + 1e-9)


def near_terms(texts: DataFrame, terms: DataFrame, least: float, shortlist: int = SHORTLIST) -> DataFrame:
    """text, term, score: per text and form the shortlist best terms, each with its better form; terms: term, place.

    Equal ratios go to the term listed first. See near_forms() for what is left out.
    """
    placed = near_forms(texts, terms, least).join(terms.groupBy("term").agg(F.min("place").alias("place")), "term")
    order = Window.partitionBy("text", "form").orderBy(F.col("score").desc(), "place")
    top = placed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= shortlist)
    return top.groupBy("text", "term", "place").agg(F.max("score").alias("score"))
