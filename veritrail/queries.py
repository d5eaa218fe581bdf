"""The generic operators on ordinary tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import geometry as G
from veritrail.functions import patterns as P
from veritrail.functions import similarity as S
from veritrail.functions import text as X
from veritrail.operators import evaluation as E
from veritrail.operators import pairing, triage
from veritrail.operators.spans import coherent, unmasked, word_runs
from veritrail.rules import STANDARDS_OF_FILL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# canonical text in SQL: accents, ß and typography off, upper case, punctuation to spaces but for dots between digits
_CANON = r"""trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(
  replace(upper(strip_accents(replace({c}, 'ß', 'SS'))), '''', ''),
  '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), chr(1), 'QQDOTQQ'),
  '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), 'QQDOTQQ', '.'), '\s+', ' ', 'g'))"""


def canon(c: str) -> str:
    return _CANON.format(c=c)


@query(f"SELECT doc_id, {canon('text')} AS canonical FROM documents")
def canonical_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.canonical(F.col("text"), fold=False).alias("canonical"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name || ' ' || p_brand || ' ' || p_size), ' '),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9.,]+$') THEN x ELSE translate(x, '01L5826', 'OIISBZG') END), ' ') AS folded FROM part""")
def ocr_fold_tokens(spark, sf_dir):
    text = F.upper(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")))
    return t(spark, sf_dir, "part").select("p_partkey", X.fold_confused(text).alias("folded"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') AS all_caps FROM documents")
def all_caps_check(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.all_caps(F.col("text")).alias("all_caps"))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM conversations),
r AS (SELECT conv_id, turn, ws, s FROM w, unnest(range(0, len(ws))) AS u(s))
SELECT conv_id, turn, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", array_to_string(ws[s + 1:e], ' ') AS gram
FROM r, unnest(range(s + 1, least(s + 6, len(ws)) + 1)) AS v(e) WHERE NOT (s = 0 AND e = len(ws))""")
def word_ngrams_1_6(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    runs = t(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("ws")).select("conv_id", "turn", "ws", F.explode(word_runs(F.size("ws"))).alias("r"))
    return runs.select("conv_id", "turn", "r.start", "r.end", F.array_join(F.slice("ws", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), " ").alias("gram"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(upper(p_name), ' '), lambda x: x <> '')), ' ') AS token_key FROM part")
def token_sort_key(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.sorted_tokens(F.upper("p_name")).alias("token_key"))


@query("""
WITH n AS (SELECT DISTINCT upper(p_name) AS name, p_brand AS brand FROM part)
SELECT a.brand, a.name AS name_a, b.name AS name_b, CAST(levenshtein(replace(a.name, ' ', ''), replace(b.name, ' ', '')) AS INTEGER) AS edits
FROM n a JOIN n b ON a.brand = b.brand AND a.name < b.name""")
def residual_edits(spark, sf_dir):
    names = t(spark, sf_dir, "part").select(F.upper("p_name").alias("name"), F.col("p_brand").alias("brand")).distinct()
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.name") < F.col("b.name")))
    return pairs.select(F.col("a.brand").alias("brand"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), S.residual_edits(F.col("a.name"), F.col("b.name")).alias("edits"))


TARGETS = ("GREEN COPPER", "SMALL BRASS BOLT", "LARGE STEEL", "RED TIN")


@query(f"""
WITH p AS (SELECT p_partkey, upper(p_name) AS name FROM part), x AS (SELECT unnest({list(TARGETS)!r}) AS target),
s AS (SELECT p_partkey, name, target, round(1 - levenshtein(name, target) / greatest(length(name), length(target)), 6) AS score FROM p, x),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, target) AS k FROM s)
SELECT p_partkey, target, score, CASE WHEN score >= 0.92 THEN 'MATCH' WHEN score <= 0.3 THEN 'MISMATCH' ELSE 'REVIEW' END AS verdict FROM r WHERE k = 1""")
def anchored_top1(spark, sf_dir):
    # the stated targets as an array of each row: no join
    scored = F.transform(F.array(*[F.lit(x) for x in TARGETS]), lambda x: F.struct((-F.round(S.edit_ratio(F.upper("p_name"), x), 6)).alias("s"), x.alias("target")))
    best = t(spark, sf_dir, "part").select("p_partkey", F.array_min(scored).alias("b")).select("p_partkey", F.col("b.target").alias("target"), (-F.col("b.s")).alias("score"))
    return best.withColumn("verdict", S.verdict(F.lit(1.0), F.col("score"), 0.92, 0.3, 0.45))


def _contained(spark, sf_dir) -> DataFrame:
    """Per document the best benchmark item: verbatim share of its words' four-grams.

    Documents and items meet on shared four-word shingles only (an equi join), never all with all.
    """

    def grams(df, key):
        words = F.split(X.canonical(F.col("text"), fold=False), " ")
        n = F.size("w")
        starts = F.when(n >= 4, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>"))
        cut = df.select(key, words.alias("w")).select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 4), " "))))).alias("g"))
        return cut  # digests, a tenth of the words' bytes in the exchange

    items = grams(t(spark, sf_dir, "benchmark"), "item_id")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    shared = grams(t(spark, sf_dir, "documents"), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("m")).join(sizes, "item_id")
    scored = shared.select("doc_id", "item_id", F.round(F.col("m") / F.col("n"), 6).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"), F.max("score").alias("score"))
    verdict = F.when(F.col("score") >= 0.92, "MATCH").otherwise("REVIEW")
    return best.withColumn("verdict", verdict).withColumn("tier", F.when(F.col("verdict") == "MATCH", 5).otherwise(3))


_CONTAINED = f"""
d AS (SELECT doc_id, string_split({canon('text')}, ' ') AS w FROM documents),
b AS (SELECT item_id, string_split({canon('text')}, ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, len(w) - 2)) AS u(i)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 3], ' ') AS g FROM b, unnest(range(1, len(w) - 2)) AS u(i)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id),
s AS (SELECT doc_id, item_id, round(count(*) / any_value(n.n), 6) AS score FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s),
v AS (SELECT doc_id, item_id, score, CASE WHEN score >= 0.92 THEN 'MATCH' ELSE 'REVIEW' END AS verdict, CAST(CASE WHEN score >= 0.92 THEN 5 ELSE 3 END AS INTEGER) AS tier FROM k WHERE r = 1)"""


@query(f"WITH {_CONTAINED} SELECT *, row_number() OVER (ORDER BY tier, score, doc_id) AS rank FROM v")
def containment_worklist(spark, sf_dir):
    return triage.global_rank(_contained(spark, sf_dir), [F.col("tier").asc(), F.col("score").asc(), F.col("doc_id").asc()])


def _statement(spark, sf_dir) -> DataFrame:
    value = F.format_string("%d.%d%% ALC./VOL.", (F.col("p_size") % 60) + 1, F.col("p_partkey") % 10)
    proof = F.format_string("(%d PROOF)", (F.col("p_size") % 60) * 2 + 1)
    kind = F.col("p_partkey") % 4
    said = F.when(kind == 0, value).when(kind == 1, proof).when(kind == 2, F.format_string("%d%%", F.col("p_size"))).otherwise(F.concat_ws(" ", "p_name", value))
    return t(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@query("""
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size % 60 + 1) || '.' || (p_partkey % 10) || '% ALC./VOL.'
  WHEN 1 THEN '(' || ((p_size % 60) * 2 + 1) || ' PROOF)' WHEN 2 THEN p_size || '%' ELSE p_name || ' ' || (p_size % 60 + 1) || '.' || (p_partkey % 10) || '% ALC./VOL.' END AS said FROM part)
SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN 1 WHEN p_partkey % 4 = 2 THEN 2 ELSE -1 END AS INTEGER) AS tier,
  round(CASE WHEN p_partkey % 4 = 1 THEN CAST(regexp_extract(said, '[0-9]+') AS DOUBLE) / 2 WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(regexp_extract(said, '[0-9.]+') AS DOUBLE) END, 4) AS abv FROM s""")
def percent_extract(spark, sf_dir):
    hit = P.alcohol(X.canonical_numeric(F.col("said")))
    return _statement(spark, sf_dir).select("p_partkey", hit.alias("h")).select("p_partkey", F.coalesce("h.tier", F.lit(-1)).alias("tier"), F.round("h.value", 4).alias("abv"))


UNIT_NAMES = ("mL", "cL", "L", "fl. oz.", "Litres")


@query(r"""
WITH s AS (SELECT p_partkey, p_size AS n, (['mL', 'cL', 'L', 'fl. oz.', 'Litres'])[1 + p_partkey % 5] AS u FROM part)
SELECT p_partkey, round(n * CASE u WHEN 'mL' THEN 1 WHEN 'cL' THEN 10 WHEN 'fl. oz.' THEN 29.5735 ELSE 1000 END, 4) AS ml FROM s""")
def unit_extract(spark, sf_dir):
    said = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in UNIT_NAMES]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(")"))
    hit = P.volume(X.canonical_numeric(said))
    return t(spark, sf_dir, "part").select("p_partkey", F.round(hit["value"], 4).alias("ml"))


@query("""
WITH v AS (SELECT p_partkey, CAST(p_size * 10 AS DOUBLE) AS a, p_size * 10 + (p_partkey % 7) * 0.5 AS b, p_partkey % 2 = 0 AS converted FROM part)
SELECT p_partkey, CASE WHEN converted THEN abs(a - b) <= 2.0 + 1e-9 ELSE round(a, 2) = round(b, 2) END AS agrees FROM v""")
def unit_normalise_tolerance(spark, sf_dir):
    a = S.to_ml(F.col("p_size").cast("double"), F.lit("cL"))
    b = F.col("p_size") * 10 + (F.col("p_partkey") % 7) * 0.5
    return t(spark, sf_dir, "part").select("p_partkey", S.agrees(a, b, 2.0, F.col("p_partkey") % 2 == 0).alias("agrees"))


@query(f"SELECT p_partkey, p_size * 50 AS ml, list_contains({list(STANDARDS_OF_FILL)}, p_size * 50) AS standard FROM part")
def standards_lookup(spark, sf_dir):
    ml = F.col("p_size") * 50
    fills = F.array(*[F.lit(int(x)) for x in STANDARDS_OF_FILL])
    return t(spark, sf_dir, "part").select("p_partkey", ml.alias("ml"), F.exists(fills, lambda f: F.abs(f - ml) < 1).alias("standard"))


@query("""
WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS found FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderkey, found, round(found + (o_orderkey % 5) * 0.004 + CASE WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE 0 END, 3) AS printed FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN found IS NULL THEN 'REVIEW' WHEN abs(printed - found) <= 0.01 + 1e-9 THEN 'MATCH' WHEN abs(printed - found) <= 1 THEN 'REVIEW' ELSE 'MISMATCH' END AS verdict,
  found IS NOT NULL AS located FROM e""")
def numeric_reconcile(spark, sf_dir):
    found = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("found"))
    both = t(spark, sf_dir, "orders").select("o_orderkey").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    printed = F.round(F.col("found") + (F.col("o_orderkey") % 5) * 0.004 + F.when(F.col("o_orderkey") % 7 == 0, 1.5).otherwise(0.0), 3)
    off = F.abs(printed - F.col("found"))
    verdict = F.when(F.col("found").isNull(), "REVIEW").when(off <= 0.01 + 1e-9, "MATCH").when(off <= 1, "REVIEW").otherwise("MISMATCH")
    return both.select("o_orderkey", verdict.alias("verdict"), F.col("found").isNotNull().alias("located"))


@query("""
SELECT l_orderkey, count(*) AS n, bool_or(abs(l_quantity * 2 - (l_quantity * 2 + l_linenumber % 3)) > 0.6) AS proof_off,
  count(DISTINCT round(l_discount + 0.0, 2)) > 1 AS disagree FROM lineitem GROUP BY l_orderkey""")
def band_consistency(spark, sf_dir):
    proof = F.col("l_quantity") * 2 + F.col("l_linenumber") % 3
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.abs(proof - 2 * F.col("l_quantity")) > 0.6).alias("proof_off"),
        (F.count_distinct(F.round(F.col("l_discount") + 0.0, 2)) > 1).alias("disagree"),
    )


def _boxes(spark, sf_dir) -> DataFrame:
    # whole numbers from event ids, so that both engines compute exactly
    left, top = F.col("event_id") * 37 % 900, F.col("event_id") * 53 % 1300
    box = G.box(left, top, left + 20 + F.col("event_id") % 60, top + 10 + F.col("event_id") % 30)
    return t(spark, sf_dir, "events").select("event_id", "user_id", box.alias("box"))


_BOXES = """b AS (SELECT event_id, user_id, event_id * 37 % 900 AS l, event_id * 53 % 1300 AS t,
  event_id * 37 % 900 + 20 + event_id % 60 AS r, event_id * 53 % 1300 + 10 + event_id % 30 AS u FROM events)"""


@query(f"""WITH {_BOXES} SELECT user_id, CAST(min(l) AS DOUBLE) AS "left", CAST(min(t) AS DOUBLE) AS top, CAST(max(r) AS DOUBLE) AS "right", CAST(max(u) AS DOUBLE) AS bottom FROM b GROUP BY user_id""")
def box_union(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("user_id").agg(G.union_agg(F.col("box")).alias("b")).select("user_id", "b.*")


@query(f"""WITH {_BOXES}, m AS (SELECT user_id, l AS ml, t AS mt, l + 300 AS mr, t + 400 AS mu FROM b WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id))
SELECT event_id FROM b JOIN m USING (user_id)
WHERE greatest(0, least(r, mr) - greatest(l, ml)) * greatest(0, least(u, mu) - greatest(t, mt)) < 0.5 * (r - l) * (u - t)""")
def overlap_mask(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    first = boxes.groupBy("user_id").agg(F.min_by("box", "event_id").alias("m"))
    masks = first.select("user_id", F.array(G.box(F.col("m.left"), F.col("m.top"), F.col("m.left") + 300, F.col("m.top") + 400)).alias("masks"))
    return boxes.join(masks, "user_id").filter(unmasked(F.col("box"), F.col("masks"))).select("event_id")


@query(f"""WITH {_BOXES}, p AS (SELECT *, lag(l) OVER w AS pl, lag(t) OVER w AS pt, lag(r) OVER w AS pr, lag(u) OVER w AS pu FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT *, coalesce(greatest(0, t - pu, pt - u) <= 60 AND greatest(0, least(r, pr) - greatest(l, pl)) >= 0.3 * least(r - l, pr - pl)
  AND 1.0 * (pu - pt) / (u - t) BETWEEN 0.6 AND 1 / 0.6, false) AS joins FROM p)
SELECT event_id, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS run FROM f""")
def coherent_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("box.top", "event_id")
    b = _boxes(spark, sf_dir).withColumn("p", F.lag("box").over(w))
    joins = F.coalesce(coherent(F.col("p"), F.col("box"), G.height(F.col("p")), G.height(F.col("box")), F.lit(40.0)), F.lit(False))
    return b.withColumn("joins", joins).select("event_id", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w).alias("run"))


def _rows_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and files made of page ids: some doubled, some in other case, some alone."""
    pages = t(spark, sf_dir, "pages").select("page_id")
    name = F.format_string("Page%d.png", "page_id")
    rows = pages.filter("page_id % 11 <> 0").select((F.col("page_id") * 2 + 2).cast("int").alias("row_number"), name.alias("filename"))
    again = pages.filter("page_id % 13 = 0 and page_id % 11 <> 0").select((F.col("page_id") * 2 + 3).cast("int").alias("row_number"), name.alias("filename"))
    files = pages.filter("page_id % 7 <> 0").select((F.col("page_id") * 2).alias("upload_no"), F.when(F.col("page_id") % 3 == 0, F.lower(name)).otherwise(name).alias("file"))
    twice = pages.filter("page_id % 17 = 0 and page_id % 7 <> 0").select((F.col("page_id") * 2 + 1).alias("upload_no"), F.when(F.col("page_id") % 3 == 0, F.upper(name)).otherwise(name).alias("file"))
    return rows.unionByName(again), files.unionByName(twice)


_PAIRS = """
r0 AS (SELECT CAST(page_id * 2 + 2 AS INTEGER) AS row_number, 'Page' || page_id || '.png' AS filename FROM pages WHERE page_id % 11 <> 0
  UNION ALL SELECT CAST(page_id * 2 + 3 AS INTEGER), 'Page' || page_id || '.png' FROM pages WHERE page_id % 13 = 0 AND page_id % 11 <> 0),
f0 AS (SELECT page_id * 2 AS upload_no, CASE WHEN page_id % 3 = 0 THEN lower('Page' || page_id || '.png') ELSE 'Page' || page_id || '.png' END AS file FROM pages WHERE page_id % 7 <> 0
  UNION ALL SELECT page_id * 2 + 1, CASE WHEN page_id % 3 = 0 THEN upper('Page' || page_id || '.png') ELSE 'Page' || page_id || '.png' END FROM pages WHERE page_id % 17 = 0 AND page_id % 7 <> 0),
r AS (SELECT * FROM r0 QUALIFY count(*) OVER (PARTITION BY filename) = 1), f AS (SELECT * FROM f0 QUALIFY count(*) OVER (PARTITION BY file) = 1),
ex AS (SELECT filename, row_number, file, upload_no FROM r JOIN f ON filename = file),
lr AS (SELECT *, lower(filename) AS k, count(*) OVER (PARTITION BY lower(filename)) AS n FROM r WHERE filename NOT IN (SELECT file FROM f)),
lf AS (SELECT *, lower(file) AS k, count(*) OVER (PARTITION BY lower(file)) AS n FROM f WHERE file NOT IN (SELECT filename FROM r)),
lo AS (SELECT filename, row_number, file, upload_no FROM lr JOIN lf USING (k) WHERE lr.n = 1 AND lf.n = 1),
al AS (SELECT *, false AS loose FROM ex UNION ALL SELECT *, true FROM lo)"""


@query(f"WITH {_PAIRS} SELECT filename, row_number, upload_no FROM al WHERE NOT loose")
def pair_exact(spark, sf_dir):
    return pairing.pair(*_rows_files(spark, sf_dir))[0].filter(~F.col("loose")).select("filename", "row_number", "upload_no")


@query(f"WITH {_PAIRS} SELECT filename, row_number, file, upload_no FROM al WHERE loose")
def pair_casefold(spark, sf_dir):
    return pairing.pair(*_rows_files(spark, sf_dir))[0].filter("loose").drop("loose")


@query(f"""WITH {_PAIRS}
SELECT 'duplicate_file' AS kind, file AS filename, -1 AS row_number FROM f0 GROUP BY file HAVING count(*) > 1
UNION ALL SELECT 'duplicate_row', filename, min(row_number) FROM r0 GROUP BY filename HAVING count(*) > 1
UNION ALL SELECT 'row_without_image', filename, row_number FROM r WHERE row_number NOT IN (SELECT row_number FROM al) AND filename NOT IN (SELECT file FROM f0 GROUP BY file HAVING count(*) > 1)
UNION ALL SELECT 'image_without_row', file, -1 FROM f WHERE upload_no NOT IN (SELECT upload_no FROM al) AND file NOT IN (SELECT filename FROM r0 GROUP BY filename HAVING count(*) > 1)""")
def pair_issues(spark, sf_dir):
    return pairing.pair(*_rows_files(spark, sf_dir))[1].select("kind", "filename", F.coalesce("row_number", F.lit(-1)).alias("row_number"))


@query("SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1")
def duplicate_exclusion(spark, sf_dir):
    # counted by a digest, so that a text shared by many rows costs one row per task
    docs = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").select("doc_id")


def _field_results(spark, sf_dir) -> DataFrame:
    """A label for each user, a field for each event kind, judged by the events' values."""
    e = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    k = (F.col("user_id") * 7 + F.col("n") + F.ascii("event_type")) % 10
    verdict = F.when(k == 0, "MISMATCH").when(k <= 3, "REVIEW").otherwise("MATCH")
    return e.select(
        F.col("user_id").cast("string").alias("label_id"), F.col("event_type").alias("field"), F.ascii("event_type").alias("display_order"), verdict.alias("verdict"),
        ((F.col("n") % 10) / 10.0).alias("score"), (k == 1).alias("elevated"), (k != 2).alias("automated"), F.concat(F.lit("seen "), F.col("n").cast("string")).alias("reason"),
    )


_FIELDS = """
e AS (SELECT user_id, event_type, count(*) AS n, ascii(event_type) AS o FROM events GROUP BY ALL),
f AS (SELECT CAST(user_id AS VARCHAR) AS label_id, event_type AS field, o, n, (user_id * 7 + n + o) % 10 AS k FROM e),
g AS (SELECT label_id, count(*) FILTER (k = 0) AS mismatches, count(*) FILTER (k = 1) AS elevated, count(*) FILTER (k = 3) AS reviews, count(*) FILTER (k = 2) AS unchecked,
  round(min((n % 10) / 10.0), 4) AS lowest_score, coalesce(min_by(field || ': seen ' || n, o) FILTER (k = 0), min_by(field || ': seen ' || n, o) FILTER (k = 1),
  min_by(field || ': seen ' || n, o) FILTER (k = 3), min_by(field || ': seen ' || n, o) FILTER (k = 2)) AS headline FROM f GROUP BY label_id),
w AS (SELECT *, CAST(CASE WHEN mismatches > 0 THEN 0 WHEN elevated > 0 THEN 1 WHEN reviews > 0 THEN 3 WHEN unchecked > 0 THEN 4 ELSE 5 END AS INTEGER) AS tier FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY tier, mismatches + elevated + reviews + unchecked DESC, lowest_score, lower(label_id), label_id) AS rank FROM w)"""


@query(f"WITH {_FIELDS} SELECT label_id, mismatches, elevated, reviews, unchecked, lowest_score, headline, tier FROM w")
def tier_counts(spark, sf_dir):
    return triage.summarise(_field_results(spark, sf_dir)).withColumn("lowest_score", F.round("lowest_score", 4))


@query(f"WITH {_FIELDS} SELECT label_id, tier, rank FROM k")
def worklist_rank(spark, sf_dir):
    return triage.worklist(triage.summarise(_field_results(spark, sf_dir))).select("label_id", "tier", "rank")


@query("""SELECT event_id, coalesce(lag(event_id) OVER w, -1) AS previous, coalesce(lead(event_id) OVER w, -1) AS "next" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prev_next(spark, sf_dir):
    queue = t(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("rank"))
    return triage.neighbours(queue, "event_id", "user_id").select("event_id", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type""")
def nearest_rank_latency(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(*[E.nearest_rank("value", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max("value").alias("most"))


@query("""
WITH r AS (SELECT l.doc_id, quality, row_number() OVER (ORDER BY n_chars, d.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT *, sum(quality) OVER (ORDER BY rank) AS ahead FROM r) SELECT CAST(sum(CASE WHEN quality = 0 THEN ahead ELSE 0 END) AS BIGINT) AS inversions FROM s""")
def ranking_inversions(spark, sf_dir):
    labels = t(spark, sf_dir, "labels").select("doc_id", "quality")
    both = labels.join(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    ranked = triage.global_rank(both, [F.col("n_chars").asc(), F.col("doc_id").asc()])
    return E.inversions(ranked.select("rank", F.when(F.col("quality") == 0, "non_compliant").otherwise("compliant").alias("compliance")))


@query("""
WITH x AS (SELECT CAST(CASE WHEN toxic = 1 THEN 0 WHEN n_chars < 200 THEN 3 ELSE 5 END AS INTEGER) AS tier, CASE WHEN quality = 0 THEN 'non_compliant' WHEN toxic = 1 THEN 'judgment' ELSE 'compliant' END AS c
  FROM labels JOIN documents USING (doc_id))
SELECT CAST(t AS INTEGER) AS tier, count(*) FILTER (c = 'compliant') AS compliant, count(*) FILTER (c = 'non_compliant') AS non_compliant, count(*) FILTER (c = 'judgment') AS judgment, count(c) AS total
FROM range(0, 6) AS u(t) LEFT JOIN x ON tier = t GROUP BY t""")
def tier_compliance_mix(spark, sf_dir):
    both = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    tier = F.when(F.col("toxic") == 1, 0).when(F.col("n_chars") < 200, 3).otherwise(5)
    kind = F.when(F.col("quality") == 0, "non_compliant").when(F.col("toxic") == 1, "judgment").otherwise("compliant")
    return E.tier_mix(both.select(tier.alias("tier"), kind.alias("compliance")), spark.range(6).select(F.col("id").cast("int").alias("tier")))


def _graded(spark, sf_dir) -> DataFrame:
    d, labels = t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), t(spark, sf_dir, "labels")
    guess = F.when(F.instr("text", "!!") > 0, "MISMATCH").when(F.char_length("text") < 60, "REVIEW").otherwise("MATCH")
    results = d.select("doc_id", F.col("lang").alias("field"), guess.alias("verdict"), F.lit(False).alias("elevated"), (F.char_length("text") >= 30).alias("automated"))
    want = F.when(F.col("quality") == 1, F.array(F.lit("MATCH"))).otherwise(F.array(F.lit("REVIEW"), F.lit("MISMATCH")))
    rows = labels.join(d.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("label_id"), F.col("lang").alias("field"), want.alias("allowed"), F.lit(None).cast("boolean").alias("elevated"), F.when(F.col("quality") == 1, "compliant").otherwise("non_compliant").alias("compliance"))
    return E.grade(results.withColumnRenamed("doc_id", "label_id"), rows)


_GRADED = """g AS (SELECT doc_id, lang AS field, quality, length(text) >= 30 AS auto,
  CASE WHEN instr(text, '!!') > 0 THEN 'MISMATCH' WHEN length(text) < 60 THEN 'REVIEW' ELSE 'MATCH' END AS v FROM labels JOIN documents USING (doc_id)),
h AS (SELECT *, CASE WHEN quality = 1 THEN v = 'MATCH' ELSE v <> 'MATCH' END AS ok FROM g)"""


@query(f"WITH {_GRADED} SELECT field, count(*) AS graded, count(*) FILTER (auto) AS checked, count(*) FILTER (NOT auto) AS unchecked, count(*) FILTER (auto AND ok) AS correct, count(*) FILTER (auto AND NOT ok) AS errors FROM h GROUP BY field")
def accuracy_rows(spark, sf_dir):
    return E.accuracy(_graded(spark, sf_dir))


@query(f"WITH {_GRADED} SELECT count(*) FILTER (quality = 0) AS violations, count(*) FILTER (quality = 0 AND v = 'MATCH') AS false_negatives, count(*) FILTER (quality = 1 AND v <> 'MATCH') AS false_flags, count(*) FILTER (quality = 0 AND v = 'MATCH') AS labels_missed FROM h")
def false_negative_flags(spark, sf_dir):
    return E.missed(_graded(spark, sf_dir))


@query("""
WITH b AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 3 <> 0) AS finished, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS BIGINT) AS seconds FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN seconds > 0 THEN total * 60.0 / seconds END, 6) AS per_minute, round(CASE WHEN finished = total THEN 0.0 WHEN finished > 0 THEN CAST(seconds AS DOUBLE) / finished * (total - finished) END, 4) AS eta FROM b""")
def throughput_eta(spark, sf_dir):
    b = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 3 != 0).alias("finished"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    seconds = F.floor(F.col("us") / 1000000)
    eta = triage.remaining_seconds(seconds, F.col("finished"), F.col("total"), F.col("finished") == F.col("total"))
    return b.select("user_id", F.round(E.per_minute(F.col("total"), seconds * 1000), 6).alias("per_minute"), F.round(eta, 4).alias("eta"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def results_pivot(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query(r"""
WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '=' || url WHEN 1 THEN '  @' || url WHEN 2 THEN url ELSE chr(9) || '-1' END AS cell FROM pages)
SELECT page_id, CASE WHEN regexp_matches(cell, '^[ \t\r\n]*[=+\-@\t\r]') THEN '''' || cell ELSE cell END AS cell FROM c""")
def safe_cells(spark, sf_dir):
    k = F.col("page_id") % 4
    cell = F.when(k == 0, F.concat(F.lit("="), "url")).when(k == 1, F.concat(F.lit("  @"), "url")).when(k == 2, F.col("url")).otherwise(F.lit("\t-1"))
    return t(spark, sf_dir, "pages").select("page_id", P.safe_cell(cell).alias("cell"))


@query("""
WITH c AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END AS state, o_totalprice > 150000 AS att, o_orderkey FROM orders)
SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (state = 'done') AS completed, count(*) FILTER (state = 'error') AS failed, count(*) FILTER (state IN ('done', 'error') AND att) AS needs_attention,
  CAST(coalesce(sum(CASE WHEN state = 'pending' THEN o_orderkey END), 0) AS BIGINT) AS held_bytes, count(*) FILTER (state <> 'pending' AND att) AS n_attention, count(*) FILTER (state <> 'pending' AND NOT att) AS n_clear,
  count(*) FILTER (state = 'pending') AS n_pending, CAST(0 AS BIGINT) AS n_unchecked FROM c GROUP BY o_custkey""")
def batch_snapshot(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    items = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), state.alias("state"), (F.col("o_totalprice") > 150000).alias("needs_attention"), F.col("o_orderkey").alias("bytes"), (state != "pending").alias("released"))
    return triage.snapshot(items)


@query("""
WITH h AS (SELECT user_id AS image_id, CAST(event_id * 31 % 256 AS INTEGER) AS level, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS w0, sum(n * level) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * level) OVER (PARTITION BY image_id) AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY level)),
g AS (SELECT *, CASE WHEN w > w0 THEN CAST(s - s0 AS DOUBLE) / (w - w0) - CAST(s0 AS DOUBLE) / w0 END AS gap FROM r),
b AS (SELECT *, w0 * (w - w0) * gap * gap AS between_ FROM g)
SELECT image_id, coalesce(round(max_by(gap, between_), 4), 0) AS separation FROM b WHERE gap IS NOT NULL OR true GROUP BY image_id""")
def ink_separation(spark, sf_dir):
    from veritrail.operators.quality import separation

    h = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image_id"), (F.col("event_id") * 31 % 256).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return separation(h).withColumn("separation", F.round("separation", 4))


@query("""
WITH p AS (SELECT DISTINCT upper(p_name) AS e FROM part), w AS (SELECT DISTINCT unnest(string_split(e, ' ')) AS w FROM p)
SELECT a.w AS expected, b.w AS found, CAST(levenshtein(a.w, b.w) AS INTEGER) AS edits,
  CASE WHEN a.w = b.w THEN 'noise' WHEN length(a.w) < 5 THEN 'wording' WHEN starts_with(a.w, b.w) OR starts_with(b.w, a.w) THEN 'wording'
  WHEN levenshtein(a.w, b.w) = 2 THEN 'ambiguous' WHEN levenshtein(a.w, b.w) = 1 AND NOT (length(a.w) = length(b.w) AND
    translate(a.w, 'EIOU', 'AAAA') = translate(b.w, 'EIOU', 'AAAA')) THEN 'noise' ELSE 'wording' END AS kind
FROM w a JOIN w b ON a.w[1] = b.w[1]""")
def token_classes(spark, sf_dir):
    words = t(spark, sf_dir, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("w")).distinct()
    a, b = words.select(F.col("w").alias("expected"), F.substring("w", 1, 1).alias("k")), words.select(F.col("w").alias("found"), F.substring("w", 1, 1).alias("k"))
    e, f = F.col("expected"), F.col("found")
    return a.join(b, "k").select("expected", "found", F.levenshtein(e, f).alias("edits"), S.token_class(e, f).alias("kind"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_worklist(spark, sf_dir)


