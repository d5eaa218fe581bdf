"""Labels for a whole table of parts: what is printed differs from the record by the part's key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import geometry as G
from veritrail.functions.bound import bound
from veritrail.rules import STATUTE
from veritrail.schemas import BOX, QUALITY
from veritrail.scratch import shuffle_parts
from veritrail.sources.samples import wrap

KINDS = ("Vodka", "Straight Rye Whiskey", "London Dry Gin")
TITLE, CAN = STATUTE.replace("GOVERNMENT WARNING", "Government Warning"), STATUTE.replace("may cause", "can cause")
WORD = f"array<struct<line_no: int, word_no: int, text: string, box: {BOX}>>"
#: top and height of the lines of a front: brand, designation, strength, volume.
FRONT = ((159.0, 70.0), (271.5, 39.0), (333.5, 33.0), (395.5, 33.0))
MIDDLE, WIDE, NARROW = 500.0, 0.55, 0.42


def _placed(*lines: tuple) -> list[dict]:
    """The words of lines (line_no, text, top, height, left or None for one in the middle)."""
    out = []
    for line_no, text, top, height, left in lines:
        step = (WIDE if left is None else NARROW) * height
        start, before = MIDDLE - len(text) * step / 2 if left is None else left, 0
        for word_no, w in enumerate(text.split(" ")):
            x = start + before * step
            out.append({"line_no": line_no, "word_no": word_no, "text": w, "box": {"left": x, "top": top, "right": x + len(w) * step, "bottom": top + height}})
            before += len(w) + 1
    return out


def _literal(value: list | dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _one_of(text: Column, texts: list[str], line_no: int) -> Column:
    """The words of a line of the front that reads as one of a few texts: these are placed once, not once a label."""
    return F.try_element_at(_literal({t: _placed((line_no, t, *FRONT[line_no], None)) for t in texts}, f"map<string, {WORD}>"), text)


def _middle(text: Column, line_no: int) -> Column:
    """The words of a line in the middle of the front."""
    top, height = FRONT[line_no]
    step = WIDE * height

    def word(ws: Column, start: Column, w: Column, k: Column) -> Column:
        left = start + (F.length(F.array_join(F.slice(ws, F.lit(1), k), " ")) + F.when(k > 0, 1).otherwise(0)) * F.lit(step)
        return bound(left, lambda x: F.struct(F.lit(line_no).alias("line_no"), k.alias("word_no"), w.alias("text"), G.box(x, top, x + F.length(w) * F.lit(step), top + height).alias("box")))

    start = F.lit(MIDDLE) - F.length(text) * F.lit(step) / 2
    return bound(F.struct(F.split(text, " ").alias("ws"), start.alias("start")), lambda b: F.transform(b["ws"], lambda w, k: word(b["ws"], b["start"], w, k)))


def shape() -> Column:
    """What a part's label and record are made from, as a text: those of equal shapes differ in label_id alone."""
    return F.to_json(F.struct((F.col("p_partkey") % (10 * len(KINDS))).alias("key"), (F.col("p_size") % 10).alias("size"), F.col("p_name").alias("name")))


def _told() -> list[Column]:
    """The columns of part, of the remainders that a shape is told by."""
    return [(F.col("p_partkey") % (10 * len(KINDS))).alias("p_partkey"), F.col("p_name"), (F.col("p_size") % 10).alias("p_size")]


def shapes(part: DataFrame) -> DataFrame:
    """A part for each shape of those in part, of the remainders that a shape is told by; parts without a key have none."""
    return part.filter("p_partkey is not null").select(*_told()).distinct()


def label_shapes(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """label_id and shape of each label of part, one a key, and the parts that shelf() prints a label of each shape from, by their column shape.

    A label's shape is its part's. If a key stands for several parts, its label has the words of all and a shape of its own.
    """
    key = Window.partitionBy("p_partkey")
    part = part.select("p_partkey", "p_name", "p_size", F.count(F.lit(1)).over(key).alias("parts"), F.row_number().over(key.orderBy("p_name", "p_size")).alias("place"))
    part = part.withColumn("shape", F.when(F.col("parts") == 1, shape()).otherwise(F.to_json(F.struct("parts", "p_partkey"))))
    labels = part.filter("place = 1").select(F.col("p_partkey").cast("string").alias("label_id"), "shape")
    return labels, part.select("shape", "place", *_told()).distinct()


def shelf(part: DataFrame, label_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """labels, words and records of the rows of part (p_partkey, p_name, p_size), named by label_id (by default the key), by p_partkey % 10:

    1 the record has another brand, 2 another content, 3 another volume, 6 another designation; printed
    are at 4 the statement's header in title case, at 5 no statement, at 7 a proof that contradicts
    the content, at 8 a volume that is no standard one, at 9 a statement with a word changed; 0 agrees.
    """
    # a file of a few bytes a part is one task, and a part becomes a label of some sixty words
    part = part.withColumn("label_id", F.col("p_partkey").cast("string") if label_id is None else label_id).repartition(shuffle_parts(part.sparkSession), "label_id")
    m = F.col("p_partkey") % 10
    content = F.lit(40) + F.col("p_size") % 10
    kind = F.when(m == 6, KINDS[0]).otherwise(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 3 + 1).cast("int")))
    brand = F.concat(F.upper("p_name"), F.lit(" DISTILLERY"))
    abv = F.concat(content.cast("string"), F.lit("% Alc./Vol."))
    proof = F.when(m == 7, 2 * content + 4).otherwise(2 * content)
    net = F.when(m == 8, "730 mL").otherwise("750 mL")
    given = part.select(
        "label_id", m.alias("m"), brand.alias("brand"), kind.alias("kind"), abv.alias("abv"), net.alias("net"),
        F.concat(abv, F.lit(" ("), proof.cast("string"), F.lit(" Proof)")).alias("strength"), F.concat((content + 5).cast("string"), F.lit("% Alc./Vol.")).alias("more"),
    )
    none = F.array().cast(WORD)
    block = lambda text: _literal(_placed(*[(len(FRONT) + k, x, 1212.7 + 30.45 * k, 21.0, 70.0) for k, x in enumerate(wrap(text))]), WORD)
    back = F.when(F.col("m") == 4, block(TITLE)).when(F.col("m") == 9, block(CAN)).when(F.col("m") == 5, none).otherwise(block(STATUTE))
    # made in a step of their own, else all words of a label would be taken apart by interpreted code
    given = given.withColumn("first", F.coalesce(_middle(F.col("brand"), 0).cast(WORD), none))
    # a remainder is -9 to 9
    strengths = [f"{c}% Alc./Vol. ({2 * c + more} Proof)" for c in range(31, 50) for more in (0, 4)]
    front = [F.coalesce(_one_of(F.col(c), texts, n), none) for n, c, texts in ((1, "kind", KINDS), (2, "strength", strengths), (3, "net", ("750 mL", "730 mL")))]
    words = given.select("label_id", F.explode(F.concat("first", *front, back)).alias("w"))
    words = words.select("label_id", "w.line_no", "w.word_no", "w.text", F.lit(0.98).alias("confidence"), "w.box")
    quality = F.struct(F.lit(True).alias("usable"), F.lit(0.95).alias("score"), F.array().cast("array<string>").alias("issues"), F.array().cast("array<string>").alias("guidance"), F.create_map().cast("map<string, double>").alias("metrics")).cast(QUALITY)
    labels = given.select("label_id", F.lit(1000).alias("width"), F.lit(1400).alias("height"), quality.alias("quality"))
    other = F.when(F.col("m") == 1, "QUIET MEADOW").otherwise(F.col("brand"))
    records = given.select(
        "label_id", other.alias("brand_name"), F.when(F.col("m") == 6, "Gin").otherwise(F.col("kind")).alias("class_type"), F.when(F.col("m") == 2, F.col("more")).otherwise(F.col("abv")).alias("alcohol_content"),
        F.when(F.col("m") == 3, "700 mL").otherwise(F.col("net")).alias("net_contents"), F.lit("distilled_spirits").alias("beverage_class"), F.lit(None).cast("double").alias("label_width_mm"),
    )
    return labels, words, records
