"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import forget, materialise, own_name, table
from veritrail.llm.components import components
from veritrail.llm.wordarrays import LOWER_TABLE

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: At most 3 differing bits spoil at most 3 of the 8 bytes, so linked fingerprints share 5 or
#: more positional bytes. Any 5 positions include one of these 14 sets of four (the planes of
#: the 8-point affine space: numbers whose exclusive or is 0), so a posting list per set and
#: its four bytes meets every pair that reaches the guaranteed count, and few others.
PLANES = tuple(p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0)
MIN_SHARED = 8 - DISTANCE


def fingerprint(text: bytes) -> int:
    """64 majority bits of the XXH64 of all 3-word shingles; 0 without words."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[SHINGLE:])])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint((t or "").encode()) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp, the fingerprint as a signed 64-bit number; one row for each row of docs."""
    given = docs.select(F.col(text_col).cast("string").alias("__hashed"), F.col(id_col).cast("long").alias(id_col))
    return given.mapInArrow(_fingerprints, f"`{id_col}` long, fp long")


def _near(a: np.ndarray, x: np.uint64) -> np.ndarray:
    """Which of a share MIN_SHARED positional bytes with x (tallied first) and differ in DISTANCE bits."""
    diff = a ^ x
    shared = np.zeros(len(a), np.int8)
    for k in range(8):
        shared += ((diff >> np.uint64(8 * k)) & np.uint64(0xFF)) == 0
    out = shared >= MIN_SHARED
    out[out] = np.bitwise_count(diff[out]) <= DISTANCE
    return out


def bucket_links(fps: np.ndarray, plane: tuple[int, ...] | None = None, direct: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one posting list.

    A list of m gives at most m - 1 links. Short lists are compared outright, each against those
    not reached yet. Above direct, neighbours are looked up instead: all changes of up to DISTANCE
    bits outside the shared bytes, so the work is in proportion to m.
    """
    fps = np.sort(fps)
    free = [b for b in range(64) if plane is None or 7 - b // 8 not in plane]
    masks = None
    if len(fps) > direct:
        masks = np.array([sum(1 << b for b in c) for r in range(1, DISTANCE + 1) for c in combinations(free, r)], np.uint64)
    links, left = [], np.ones(len(fps), bool)
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            x = fps[front.pop()]
            if masks is None:
                rest = np.flatnonzero(left)
                if not len(rest):
                    break
                found = rest[_near(fps[rest], x)]
            else:
                want = masks ^ x
                at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                found = at[(fps[at] == want) & left[at]]
            left[found] = False
            front += found.tolist()
            links += [(int(fps[seed]), int(fps[k])) for k in found]
    return links


def _link_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings arrive sorted by key; each key's list may continue in the next batch."""
    kept_key, kept = None, []

    def links_of(key, parts):
        fps = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return bucket_links(fps.view(np.uint64), PLANES[int(key[0])]) if len(fps) > 1 else []

    for pdf in batches:
        plane, key, fp = pdf["plane"].to_numpy(), pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        cut = np.flatnonzero((plane[1:] != plane[:-1]) | (key[1:] != key[:-1])) + 1
        begin, end = np.append(0, cut), np.append(cut, len(key))
        # inside a batch a list of one can't link; the first and last may go on elsewhere
        run = np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(key)))
        out = []
        for a, b in zip(begin[run].tolist(), end[run].tolist()):
            if a == b:
                continue
            this = (plane[a], key[a])
            if this != kept_key:
                if kept_key is not None:
                    out += links_of(kept_key, kept)
                kept_key, kept = this, []
            kept.append(fp[a:b].copy())
        if out:
            yield _frame(out)
    if kept_key is not None and (out := links_of(kept_key, kept)):
        yield _frame(out)


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    x = np.array(links, np.uint64).view(np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints lie within DISTANCE bits; distinct: fp, unique.

    Each fingerprint is posted once per plane under that plane's four bytes; a list of one cannot
    link and goes before the lists are sorted together.
    """
    posted = []
    for k, plane in enumerate(PLANES):
        mask = sum(0xFF << (56 - 8 * p) for p in plane)
        mask -= (mask >> 63) << 64
        posted.append(F.struct(F.lit(k).alias("plane"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    postings = distinct.select("fp", F.explode(F.array(*posted)).alias("p")).select("p.plane", "p.key", "fp")
    shared = postings.repartition("plane", "key").sortWithinPartitions("plane", "key")
    return shared.mapInPandas(_link_buckets, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (hex), component_id (smallest id reachable over links); a row for each row.

    Equal fingerprints are one node whatever their number, so a large group of copies costs one
    row after a map-side minimum. Null and empty texts have fingerprint zero and link like any
    other. A null id keeps its row and never names a component unless all ids in it are null
    (then the component is null). Repeated rows give repeated results; an empty table none.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    return prints.join(component_ids(prints, id_col), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(prints: DataFrame, id_col: str) -> DataFrame:
    """fp, component (its smallest fingerprint) and component_id (its smallest id), a row for each fingerprint."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    links = materialise(fingerprint_links(nodes.select("fp")), "links")
    linked = materialise(nodes.join(components(links), F.col("fp") == F.col("node")).select("fp", "least", "root"), "linked")
    # written tables on both sides of each join below, so that Spark can split one that a large
    # component or a fingerprint of many copies makes uneven
    groups = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    named = linked.join(groups, "root").select("fp", F.col("root").alias("component"), "component_id")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"))
    ids = materialise(named.unionByName(alone), "ids")
    forget(nodes, links, linked, groups)
    return ids


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one document stays, the one with the smallest id.

    Rows are told apart by id and text: of rows that share an id, each goes or stays by its own
    component. Rows without an id come after all others; of equal ids, and of rows without one, the
    least text hash is first; of rows equal in both, one stays. Null and empty texts are one
    component, as in near_duplicates.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    given = rows.select(F.col("text").cast("string").alias("__hashed"), "doc_id", "text_key")
    prints = materialise(given.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    stays = prints.join(component_ids(prints, "doc_id"), "fp").groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.id").alias("stay_id"), F.col("first.key").alias("stay_key"))
    stays = materialise(stays, "stays")
    same = docs["doc_id"].cast("long").eqNullSafe(stays["stay_id"]) & (F.xxhash64(docs["text"]) == stays["stay_key"])
    kept = docs.join(stays, same, "left_semi")
    if not prints.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        equal = Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64("text")).orderBy(F.lit(1))
        nth = own_name(docs, "__keep_one_nth")
        kept = kept.withColumn(nth, F.row_number().over(equal)).filter(F.col(nth) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
