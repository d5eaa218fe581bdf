"""Benchmark decontamination: MinHash containment search by size classes, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import materialise, table
from veritrail.llm.wordarrays import LOWER_TABLE, Words, blocks, hash_words

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows that one pass over the documents searches for (some 30 bytes each); more items take more passes.
BLOCK_HASHES = 1_000_000
SKETCH = "key long, piece int, width int, n int, least int, hash long"
FOUND = "doc_id long, doc_key long, text string, key long"
ROWS = "doc_id long, doc_key long, item_id long, n_shingles int, n_shared int, containment double"


def shingles(text: str | None, k: int = SHINGLE) -> tuple[int, set[bytes]]:
    """The shingle width and the distinct shingles; a text of fewer than k words is one shingle."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    width = min(k, len(words))
    return width, {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def needed(n: int, share: float = CONTAINMENT) -> int:
    """Least number of an item's n shingles that a text must hold."""
    return math.ceil(round(share * n, 9))


def hits_wanted(n: int) -> int:
    """Sketch hashes that a text must hold, beyond what an item of n shingles may lack: by powers of two of n."""
    return max(1, 1 << max(n.bit_length() - 4, 0))


def _sketches(block_hashes: int):
    """The smallest hashes of each item's shingles (bottom MinHash).

    A text that holds enough of an item's n shingles lacks at most r = n - needed(n), so of any r + h
    of them it holds h or more, whatever else it holds. The size class gives h. An item whose
    sketch would fill a pass comes in pieces of r + 1 hashes in all, one of which is enough.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["text"]):
                width, own = shingles(text)
                if not own:
                    continue
                n = len(own)
                h = np.unique(hash_words((text or "").encode().translate(LOWER_TABLE).split(), width))
                lacks = n - needed(n)
                size = min(lacks + hits_wanted(n), len(h))
                if size > block_hashes // 2:
                    size = min(lacks + 1, len(h))
                piece = np.arange(size) // max(1, block_hashes // 2)
                least = max(1, size - lacks) if size and not piece[-1] else 1
                out.append(pd.DataFrame({"key": key, "piece": piece.astype(np.int32), "width": width, "n": n, "least": least, "hash": h[:size].view(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SKETCH.split(", ")])

    return run


def sketch_items(texts: DataFrame, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """key, piece, width, n (distinct shingles), least (hashes to be found), hash; texts: key, text."""
    return texts.select("key", "text").mapInPandas(_sketches(block_hashes), SKETCH)


def _search(sketch: pd.DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's search for one block of items: texts that hold enough hashes of a sketch.

    Items fall into partitions by width and powers of two of their shingle count. A text is looked
    up in a partition only if it has as many words as the partition's least item needs.
    """
    sketch = sketch.sort_values("hash", kind="stable", ignore_index=True, key=lambda x: x.to_numpy(np.int64).view(np.uint64) if x.name == "hash" else x)
    h = sketch["hash"].to_numpy(np.int64).view(np.uint64)
    unit, _ = pd.factorize(pd.MultiIndex.from_frame(sketch[["key", "piece"]]))
    key, least, n = (np.zeros(int(unit.max()) + 1, np.int64) for _ in range(3))
    key[unit], least[unit], n[unit] = sketch["key"], sketch["least"], sketch["n"]
    parts = []
    for (width, _), rows in sketch.groupby([sketch["width"], np.frexp(sketch["n"])[1]]):
        at = rows.index.to_numpy()
        few = min(needed(int(x)) for x in rows["n"].unique()) + int(width) - 1
        parts.append((int(width), few, h[at], unit[at]))
    widths = sorted({p[0] for p in parts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = []
        for _, _, hashes, _ in parts:
            small.append(np.zeros(1 << 16, bool))
            small[-1][(hashes >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            for i, j, raw, at in blocks(batch.column(2)):
                w = Words.of(raw, at)
                words, doc, counts = w.hashes(), w.doc(), w.counts
                docs, keys = [], []
                for width in widths:
                    begin, x = w.windows(words, width)
                    top, of = (x >> np.uint64(48)).astype(np.int64), doc[begin]
                    for (wide, few, hashes, units), filled in zip(parts, small):
                        if wide != width:
                            continue
                        hit = np.flatnonzero(filled[top])
                        hit = hit[counts[of[hit]] >= few]
                        a, b = np.searchsorted(hashes, x[hit], "left"), np.searchsorted(hashes, x[hit], "right")
                        met = np.flatnonzero(b > a)
                        if not len(met):
                            continue
                        # each hash counts once for a text, however often the text repeats it
                        text, low, high = np.unique(np.stack([of[hit[met]], a[met], b[met]]), axis=1)
                        times = high - low
                        rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        both, tally = np.unique(np.stack([np.repeat(text, times), units[rows]]), axis=1, return_counts=True)
                        enough = tally >= least[both[1]]
                        docs.append(both[0][enough])
                        keys.append(key[both[1][enough]])
                if docs and sum(map(len, docs)):
                    found = np.unique(np.stack([np.concatenate(docs), np.concatenate(keys)]), axis=1)
                    cols = [c.slice(i, j - i).take(pa.array(found[0])) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(found[1], pa.int64())], ["doc_id", "doc_key", "text", "key"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact containment of candidates; texts of one batch are cut into shingles once for each width."""
    for batch in batches:
        out, have, own = [], {}, {}
        for d, doc_key, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns)):
            if item not in own:
                own[item] = shingles(item)
            width, want = own[item]
            if (doc_key, width) not in have:
                words = text.encode().translate(LOWER_TABLE).split()
                have = {(doc_key, width): {b" ".join(words[p : p + width]) for p in range(len(words) - width + 1)}}
            shared = len(want & have[doc_key, width])
            if shared >= needed(len(want)):
                out.append((d, doc_key, item_id, len(want), shared, shared / len(want)))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "doc_key", "item_id", "n_shingles", "n_shared", "containment"])


def _blocks(sketch: DataFrame, total: int, block_hashes: int) -> list[pd.DataFrame]:
    """The sketch in blocks of block_hashes rows at most; whole pieces of items stay together."""
    parts = 1 if total <= block_hashes else -(-2 * total // block_hashes)
    while True:
        tagged = sketch.withColumn("block", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)))
        most = tagged.groupBy("block").count().agg(F.max("count")).first()[0]
        if most <= max(block_hashes, 1) or parts > total:
            return [tagged.filter(F.col("block") == k).drop("block") for k in range(parts)]
        parts *= 2


def contained_rows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, block_hashes: int) -> DataFrame:
    """doc_id, doc_key (hash of the text), item_id and the counts of contained_items(); items without an id too."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).filter("item is not null").distinct()
    own = own.withColumn("key", F.xxhash64("item"))
    sketch = materialise(sketch_items(own.select("key", F.col("item").alias("text")).distinct(), block_hashes), "sketch")
    total = sketch.count()
    if not total:
        return spark.createDataFrame([], ROWS)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("doc_key"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    found = None
    for block in _blocks(sketch, total, block_hashes):
        rows = block.toPandas()
        if len(rows):
            part = given.mapInArrow(_search(rows), FOUND)
            found = part if found is None else found.unionByName(part)
    # written, so that no task searches and verifies at once, with two Python workers
    found = materialise(found, "found")
    # an item in pieces may be found once for each; no other pair is met twice for one row
    several = sketch.groupBy("key").agg(F.max("piece").alias("piece")).filter("piece > 0").select("key")
    if not several.isEmpty():
        found = found.join(several, "key", "left_anti").unionByName(found.join(several, "key", "left_semi").distinct())
    return found.join(own, "key").select("doc_id", "doc_key", "text", "item_id", "item").mapInArrow(_verify, ROWS)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Pairs (doc_id, item_id) where the text holds at least 0.8 of the item's distinct shingles.

    Shingles have five lower-cased words; an item of fewer words is one shingle of all its words.
    Items without words, and null texts, match nothing; null ids of texts are carried as null,
    items without an id are left out. Repeated rows give repeated pairs, repeated items one pair
    each; items with one id and several texts are told apart and may each give a pair. (An item
    too long for one pass gives rows that repeat id and text one pair.) Tables may be empty; other
    columns are ignored. Only the items' hashes are sent to the tasks, block_hashes of them in one
    pass; a larger benchmark takes several passes over the texts, and so does an item too long for
    one. Candidates' texts are joined to the items' for the exact count.
    """
    found = contained_rows(docs, items.filter("item_id is not null"), id_col, text_col, block_hashes)
    return found.drop("doc_key")


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.

    A row is judged by its own text: of rows that share an id only those that hold an item go, and
    rows without an id go by the same rule. Rows without a text stay. Items need no id.
    """
    bad = contained_rows(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", BLOCK_HASHES)
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("doc_key").alias("bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"])
    return docs.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


OP4_SQL = r"""
WITH b AS (
  SELECT item_id, row_number() OVER () AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
bs AS (
  SELECT item, item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s
  FROM (SELECT *, least(5, len(w)) AS k FROM b WHERE len(w) > 0)),
bn AS (SELECT item, k, count(*) AS n FROM bs GROUP BY ALL),
d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
ds AS (
  SELECT doc_id, r, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s
  FROM d, (SELECT DISTINCT k FROM bn) WHERE len(w) >= k),
m AS (SELECT r, doc_id, item, item_id, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
SELECT m.doc_id, m.item_id, CAST(n AS INTEGER) AS n_shingles, CAST(shared AS INTEGER) AS n_shared, CAST(shared AS DOUBLE) / n AS containment
FROM m JOIN bn USING (item) WHERE shared >= ceil(round(0.8 * n, 9))
"""
