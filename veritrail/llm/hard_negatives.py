"""Hard negatives by two-dimensional block products of integer vectors (SUMMA style).

Anchors and rows are sharded to blocks and their components to chunks. A block of rows stays in its
task; the panels of each block of anchors are sent there, multiplied chunk by chunk and added up
in place; a finished tile keeps no more than the few best cells of each anchor, or of each window
that a positive's score opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import forget, materialise, table

ANCHOR_EVERY, NOISE_EVERY, CLASSES = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
SCALE = 256
ANCHOR_BLOCK, ROW_BLOCK, CHUNK = 256, 4096, 32
ROWS = -1  # the place of a block's own rows among the blocks of anchors: before them
NO_ID = 2**63 - 1  # rows without an id, after all others
LOWEST = -(2**63)


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector, grp (0) of the rows that take part: integers, labels shifted where the id is divisible by 7.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Rows
    equal in id, label and integers count once. A row without an id sorts after all others.
    """
    x = F.col("embedding")
    fine = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.when(F.col("vec_id") % NOISE_EVERY == 0, (F.col("label").cast("long") + 1) % CLASSES).otherwise(F.col("label").cast("long"))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.alias("label"), scaled.alias("vector")).distinct().withColumn("grp", F.lit(0).cast("long"))


def _pack(batches: Iterator[pa.RecordBatch], chunk: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, block, vec_id) to one row per block and chunk: ids, labels, windows, matrix."""
    kept_key, kept = None, []

    def packed():
        ids = np.array([r[0] for r in kept], np.int64)
        labels = np.array([r[1] for r in kept], np.int64)
        windows = np.full((len(kept), POSITIVES, 2), -1, np.int64)
        full = np.zeros((len(kept), chunk * chunks), np.int64)
        for k, (_, _, vector, found) in enumerate(kept):
            full[k, : len(vector)] = vector
            if found:
                windows[k, : len(found)] = found
        for c in range(chunks):
            part = np.ascontiguousarray(full[:, c * chunk : (c + 1) * chunk])
            first = c == 0
            rows.append((*kept_key, c, len(kept), ids.tobytes() if first else None, labels.tobytes() if first else None, windows.tobytes() if first else None, part.tobytes()))

    names = ["grp", "block", "chunk", "n", "ids", "labels", "windows", "matrix"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    rows: list[tuple] = []

    def made():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows.clear()
        return out

    for batch in batches:
        found = batch["windows"].to_pylist() if "windows" in batch.schema.names else [None] * len(batch)
        for grp, block, i, label, vector, w in zip(*(batch[c].to_pylist() for c in ("grp", "block", "vec_id", "label", "vector")), found):
            if (grp, block) != kept_key:
                if kept_key is not None:
                    packed()
                    yield made()
                kept_key, kept = (grp, block), []
            kept.append((i, label, vector, [(x["positive_id"], x["positive_score"]) for x in w] if w else None))
    if kept_key is not None:
        packed()
        yield made()


def blocks(rows: DataFrame, size: int, chunk: int, chunks: int) -> DataFrame:
    """grp, block, chunk, n, ids, labels, windows, matrix: rows (grp, vec_id, label, vector) in blocks of about size.

    A row's block is a hash of its id, so that a group of any size is cut evenly.
    """
    counts = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    placed = rows.join(counts, "grp").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks"))).drop("blocks")
    schema = "grp long, block long, chunk int, n long, ids binary, labels binary, windows binary, matrix binary"
    return placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "vec_id").mapInArrow(lambda b: _pack(b, chunk, chunks), schema)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64; by floating point, which is faster, where every sum is an integer that it holds exactly."""
    most = [max(abs(float(x.min(initial=0))), abs(float(x.max(initial=0)))) for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _tiles(batches: Iterator[pa.RecordBatch], chunk: int, reduce: Callable) -> Iterator[pa.RecordBatch]:
    """Panels sorted by (grp, j, i, chunk), those of block j's rows first: sums each tile's products where it stays, and reduces it."""
    group, panels, about_rows = None, {}, None
    place, cells, about = None, None, None
    for batch in batches:
        for k in range(len(batch)):
            grp, j, i, c = (batch[n][k].as_py() for n in ("grp", "j", "i", "chunk"))
            of = lambda n: np.frombuffer(batch[n][k].as_buffer(), np.int64).copy()  # noqa: B023, E731
            if (grp, j, i) != place:
                if cells is not None:
                    yield reduce(cells, *about, *about_rows)
                place, cells = (grp, j, i), None
                if (grp, j) != group:
                    group, panels = (grp, j), {}
            panel = of("matrix").reshape(-1, chunk)
            if i == ROWS:
                panels[c] = panel
                if c == 0:  # ids are sent with the first chunk only
                    about_rows = [of("ids"), of("labels")]
            elif panels:  # a block that no row's hash fell into has none
                if c == 0:
                    about = [of("ids"), of("labels"), of("windows")]
                part = _product(panel, panels[c])
                cells = part if cells is None else np.add(cells, part, out=cells)
    if cells is not None:
        yield reduce(cells, *about, *about_rows)


def best_cells(cells: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the greatest cell of each row, then the next; LOWEST is none. Cells are changed.

    Of equal cells the first is taken, and columns are in order of ids.
    """
    for _ in range(min(most, cells.shape[1])):
        at = cells.argmax(axis=1)
        rows = np.flatnonzero(cells[np.arange(len(cells)), at] != LOWEST)
        if not len(rows):
            return
        yield rows, at[rows]
        cells[rows, at[rows]] = LOWEST


def tile_positives(cells, anchors, labels, windows, rows, row_labels) -> pa.RecordBatch:
    open_ = np.where((labels[:, None] == row_labels) & (anchors[:, None] != rows), cells, LOWEST)
    found = [(anchors[r], rows[c], cells[r, c]) for r, c in best_cells(open_, POSITIVES)]
    out = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor_id", "positive_id", "positive_score"])


def tile_negatives(cells, anchors, labels, windows, rows, row_labels) -> pa.RecordBatch:
    windows = windows.reshape(len(anchors), POSITIVES, 2)
    other = labels[:, None] != row_labels
    found = []
    for k in range(POSITIVES):
        positive, score = windows[:, k, 0], windows[:, k, 1]
        low, high = -(-LOW * score // 100), HIGH * score // 100
        inside = other & (cells >= low[:, None]) & (cells <= high[:, None]) & (score >= 0)[:, None]
        for r, c in best_cells(np.where(inside, cells, LOWEST), NEGATIVES):
            found.append((anchors[r], positive[r], score[r], rows[c], cells[r, c]))
    out = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def reduced_tiles(anchors: DataFrame, rows: DataFrame, reduce: Callable, schema: str, chunk: int, chunks: int) -> DataFrame:
    """What reduce keeps of each finished tile of anchors by rows (blocks of the same grp).

    A block of anchors is sent to each block of rows of its group: anchors are the smaller side by
    the query's definition, and each meets every row. Products are added where they are made: a tile
    is never sent, written or held beside another one. No key is hot: it is a block.
    """
    per = rows.filter("chunk = 0").groupBy("grp").agg(F.max("block").alias("last"))
    # a row per group, which is a label
    sent = anchors.join(F.broadcast(per), "grp").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    panel = ["chunk", "ids", "labels", "windows", "matrix"]
    a = sent.select("grp", "j", F.col("block").alias("i"), *panel)
    b = rows.withColumn("windows", F.lit(None).cast("binary")).select("grp", F.col("block").alias("j"), F.lit(ROWS).cast("long").alias("i"), *panel)
    # by number: a tile's work is many times what the panels' bytes suggest
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = a.unionByName(b).repartition(parts, "grp", "j").sortWithinPartitions("grp", "j", "i", "chunk")
    return placed.mapInArrow(lambda x: _tiles(x, chunk, reduce), schema)


def first_of(df: DataFrame, by: list[str], score: str, id_col: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings (vec_id, embedding, label).

    Scores are exact integer inner products; a shorter vector counts as filled with zeros. Rows of
    the anchor's own id are not its positives; of rows that share another id the best counts for a
    positive once. An anchor without positives, or a window without rows, gives no row; nor does an
    empty table. Block sizes change no result.
    """
    rows = materialise(quantised(embeddings), "vectors")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    chunks = max(1, -(-longest // chunk))
    anchors = rows.filter((F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != NO_ID))
    # positives: a group for each label that has anchors
    kinds = materialise(anchors.select("label").distinct(), "kinds")
    of_label = lambda df: df.select(F.col("label").alias("grp"), "vec_id", "label", "vector")
    own = materialise(blocks(of_label(anchors), anchor_block, chunk, chunks), "anchors")
    alike = materialise(blocks(of_label(rows.join(kinds, "label", "left_semi")), row_block, chunk, chunks), "alike")
    near = reduced_tiles(own, alike, tile_positives, "anchor_id long, positive_id long, positive_score long", chunk, chunks)
    near = near.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    positives = materialise(first_of(near, ["anchor_id"], "positive_score", "positive_id", POSITIVES), "positives")
    forget(own, alike, kinds)
    # negatives: all anchors by all rows, in blocks
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))
    asked = materialise(blocks(anchors.join(windows, "vec_id").select("grp", "vec_id", "label", "vector", "windows"), anchor_block, chunk, chunks), "asked")
    whole = materialise(blocks(rows.select("grp", "vec_id", "label", "vector"), row_block, chunk, chunks), "rows")
    kept = reduced_tiles(asked, whole, tile_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", chunk, chunks)
    best = first_of(kept, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return best.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row against all rows; as hard_negatives() states for nulls, ties and empty tables."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS mine, b.vec_id AS other_id, b.label AS theirs, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE mine = theirs QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE mine <> theirs AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
