"""Substring dedup by hashing lines, then paragraphs of WORDS words wherever lines break.

A repeated passage need not begin or end where a line does, so whole lines alone would leave it.
After the lines (substring_dedup) every run of WORDS words of what is left is a unit as well:
normalised, digested, grouped globally, the earliest ranked one kept.

Two steps find the runs without a row for each word of the corpus. First each text gives its
winnowed grams of GRAM words: of every WORDS - GRAM + 1 grams in a row the one of least hash, so
that equal runs of WORDS words have an equal gram among those given. Then only the runs around a
gram that is met twice are hashed and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import forget, materialise, table, without
from veritrail.llm.substring_dedup import KEY, MIN_WORDS, SPAN, keyed, lines_cut, restored
from veritrail.llm.wordarrays import Words, blocks, mix

WORDS = 50
GRAM = 25


def _sliding(h: np.ndarray, k: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over each k values in a row, by doubling."""
    size = 1
    while 2 * size <= k:
        h = of(h[:-size], h[size:])
        size *= 2
    return of(h[: len(h) - (k - size)], h[k - size :]) if k > size else h


def winnowed(w: Words, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the grams given: the least ones of every words - gram + 1 in a row."""
    begin, h = w.windows(w.hashes(), gram)
    k = words - gram + 1
    if len(h) < k:
        return begin[:0], h[:0]
    doc = w.doc()[begin]
    least = _sliding(h, k, np.minimum)
    least[doc[: len(least)] != doc[k - 1 :]] = 0
    edge = np.zeros(k - 1, np.uint64)
    given = np.flatnonzero((_sliding(np.concatenate((edge, least, edge)), k, np.maximum) == h) & (h > 0))
    return begin[given], h[given]


def _grams(words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in blocks(batch.column(2)):
                w = Words.of(raw, at)
                begin, h = winnowed(w, words, gram)
                doc = w.doc()[begin]
                keys = [c.slice(i, j - i).take(pa.array(doc)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(h.view(np.int64))], [*KEY, "pos", "h"])

    return run


def _runs(words: int, gram: int):
    """The runs of a text that hold one of its grams in the array places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in blocks(batch.column(2)):
                w = Words.of(raw, at)
                hashes = w.hashes()
                begin, h = w.windows(hashes, words)
                other = w.windows(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), words)[1]
                near = np.zeros(len(hashes) + 1, np.int32)
                for k, places in enumerate(batch.column(3).slice(i, j - i).to_pylist()):
                    p = w.first[k] + np.array(places, np.int64)
                    np.add.at(near, np.maximum(p + gram - words, w.first[k]), 1)
                    np.add.at(near, p + 1, -1)
                some = np.cumsum(near)[begin] > 0
                begin, h, other = begin[some], h[some], other[some]
                doc = w.doc()[begin]
                keys = [c.slice(i, j - i).take(pa.array(doc)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(other.view(np.int64))], [*KEY, "pos", "h", "h2"])

    return run


def _cut(words: int):
    """Text without the runs that begin at the words of the array starts; spans of the original.

    lines: the spans of the original that the given text's lines, joined by \\n, come from.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for text, starts, gone, lines in zip(*(batch.column(k).to_pylist() for k in range(4))):
                cuts = []
                if starts:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    w = Words.of(raw, np.array([0, len(raw)]))
                    char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    first = char[np.append(w.start, len(raw))]
                    step = np.zeros(len(w.start) + 1, np.int32)
                    np.add.at(step, starts, 1)
                    np.add.at(step, np.array(starts) + words, -1)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(step)[:-1] > 0, [0])).astype(np.int8)))
                    cuts = [(int(first[a]), int(first[b])) for a, b in zip(edge[::2], edge[1::2])]
                spans, stays, at = [], [], 0
                for a, b in [*cuts, (len(text or ""), 0)]:
                    if a > at:
                        stays.append((at, a))
                    at = b
                moved = [(s["start"], s["end"]) for s in gone or ()]
                if cuts:
                    spans = [x for c in cuts for x in original(c, lines)]
                    kept = [x for c in stays for x in original(c, lines)]
                    text = "".join([text[a:b] for a, b in stays])
                else:
                    kept = [(s["start"], s["end"]) for s in lines or () if s["start"] < s["end"]]
                for o, v in zip(out, (text, sorted(moved + spans), kept)):
                    o.append(v if o is out[0] else [{"start": a, "end": b} for a, b in v])
            arrays = [pa.array(out[0], pa.string()), pa.array(out[1], span), pa.array(out[2], span), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], "removed", "kept", *batch.schema.names[4:]])

    return run


def original(cut: tuple[int, int], lines: list[dict]) -> list[tuple[int, int]]:
    """Where a span of the lines joined by \\n stood: a piece for each line that it meets."""
    out, at = [], 0
    for s in lines:
        size = s["end"] - s["start"]
        a, b = max(cut[0], at), min(cut[1], at + size)
        if a < b:
            out.append((s["start"] + a - at, s["start"] + b - at))
        at += size + 1
    return out


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines of min_words (dedup_lines) and then repeated runs of words words cut from text_col.

    Adds removed and kept, spans of the original in characters, each within a line. A run goes if
    an equal one (A-Z as a-z, any white space) begins at a lower rank (id, text hash, word number)
    of the texts without repeated lines; runs that overlap go as one, with the white space after
    them. Rows with a null id or text claim no run and are returned as they are. Rows that repeat
    id and text are one text given twice: each loses what the text loses. Two texts under one id
    are two texts, in lines as in runs. Texts of any length are hashed whole; an empty table gives
    an empty result; input columns named removed or kept are dropped, others may have any name.
    """
    rest = without(docs, {"removed", "kept"})
    by_line, written = lines_cut(keyed(rest, id_col, text_col), min_words)
    lined = materialise(by_line, "lined")
    forget(*written)
    usable = lined.filter("unit_doc is not null and text is not null")
    grams = materialise(usable.select(*KEY, "text").mapInArrow(_grams(words, gram), "unit_doc long, unit_text long, pos int, h long"), "grams")
    # written, so that Spark can split the joins where one gram or run has most rows
    twice = materialise(grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "twice")
    places = grams.join(twice, "h").groupBy(*KEY).agg(F.collect_set("pos").alias("places"))
    placed = materialise(lined.join(places, list(KEY), "left"), "placed")
    forget(lined, grams, twice)
    met = placed.filter("places is not null")
    form = "unit_doc long, unit_text long, pos int, h long, h2 long"
    runs = materialise(met.dropDuplicates(list(KEY)).select(*KEY, "text", "places").mapInArrow(_runs(words, gram), form), "runs")
    rank = F.struct(*KEY, "pos")
    first = materialise(runs.groupBy("h", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "h2", "first"), "first-runs")
    starts = runs.join(first, ["h", "h2"]).filter(rank > F.col("first")).groupBy(*KEY).agg(F.array_sort(F.collect_list("pos")).alias("starts"))
    cut = met.join(starts, list(KEY), "left").unionByName(placed.filter("places is null").withColumn("starts", F.lit(None).cast("array<int>")))
    row = lined.schema["row"].dataType.simpleString()
    done = cut.select("text", "starts", "removed", "kept", "row").mapInArrow(_cut(words), f"text string, removed array<{SPAN}>, kept array<{SPAN}>, row {row}")
    return restored(done, rest.columns, text_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines and runs; nulls, repeats and empty tables as dedup_passages() states."""
    done = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("removed").alias("n_removed"), flat("removed").alias("removed_spans"), flat("kept").alias("kept_spans"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines and passages go from the texts; n_chars, where there is one, follows.

    Rows stay, whatever is cut; those with a null id or text are returned as they are. Repeated
    ids as in dedup_passages.
    """
    rows = docs.select(F.col("doc_id").alias("unit"), F.col("text").cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    done = dedup_passages(rows, "unit")
    cols = []
    for c in docs.columns:
        was = F.col("text") if c == "text" else F.col(f"rest.`{c}`")
        cols.append((F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(was) if c == "n_chars" else was).alias(c))
    return done.select(*cols)


#: Pieces of a line are its words with the white space after them, and the white space before the
#: first one; a piece of white space goes with the word before it, as does the end of a line.
OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (
  SELECT doc_id, i AS k, ls[i] AS line, CAST(coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS a,
    list_filter(string_split_regex(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM l, unnest(range(1, len(ls) + 1)) AS r(i)),
f AS (
  SELECT *, len(w) >= 16 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, k) > 1 AS gone FROM u),
kept AS (
  SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, max(k) OVER (PARTITION BY doc_id) AS last
  FROM f WHERE NOT gone),
t AS (SELECT doc_id, flatten(list(w ORDER BY k)) AS w FROM kept GROUP BY doc_id),
runs AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS run FROM t, unnest(range(1, len(w) - 48)) AS r(p)),
later AS (SELECT doc_id, p FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, p + j AS p FROM later, unnest(range(0, 50)) AS r(j)),
parts AS (
  SELECT doc_id, k, a, first, line, k = last AS final, regexp_extract_all(line, '^[ 	-
]+|[^ 	-
]+[ 	-
]*') AS ps FROM kept),
pieces AS (
  SELECT doc_id, k, i, a + coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS b, ps[i] AS piece,
    first + i - CASE WHEN regexp_matches(line, '^[ 	-
]') THEN 1 ELSE 0 END AS p
  FROM parts, unnest(range(1, len(ps) + 1)) AS r(i)
  UNION ALL
  SELECT doc_id, k, len(ps) + 1, a + length(line), chr(10), first + len(ps) - CASE WHEN regexp_matches(line, '^[ 	-
]') THEN 1 ELSE 0 END FROM parts WHERE NOT final),
marked AS (
  SELECT s.*, c.p IS NOT NULL AS gone FROM pieces s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.p = c.p),
islands AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id, k ORDER BY i) AS island
  FROM (SELECT *, CASE WHEN gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id, k ORDER BY i) THEN 1 ELSE 0 END AS step FROM marked WHERE piece <> chr(10))),
spans AS (
  SELECT doc_id, CAST(min(b) AS INTEGER) AS b, CAST(max(b + length(piece)) AS INTEGER) AS e, gone FROM islands GROUP BY doc_id, k, island, gone
  UNION ALL SELECT doc_id, a, a + length(line), true FROM f WHERE gone),
texts AS (SELECT doc_id, string_agg(piece, '' ORDER BY k, i) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id),
sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(concat(b, '-', e), ',' ORDER BY b, e) FILTER (gone) AS out, string_agg(concat(b, '-', e), ',' ORDER BY b, e) FILTER (NOT gone) AS stay
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(texts.text, '') AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_removed, coalesce(out, '') AS removed_spans, coalesce(stay, '') AS kept_spans
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
