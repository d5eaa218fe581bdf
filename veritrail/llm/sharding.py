"""Histogram sort: exact counts below candidate boundaries, refined, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import materialise, own_name, table, without

SHARDS = 24
#: A shard's bytes may miss an equal share by this part of it.
TOLERANCE = 1e-3
#: Candidate boundaries counted at once: in the first round over all keys, later in each open range.
PROBES, REFINE = 1 << 14, 1 << 9
#: Bytes that one task sorts.
PART_BYTES = 16 << 20

KEY_LOW, KEY_HIGH = 0, 1 << 62


#: Columns of the written rows beside those of the table.
KEY, BYTES, PART, SHARD = "__histogram_sort_key", "__histogram_sort_bytes", "__histogram_sort_part", "__histogram_sort_shard"


def sort_key(id_col: str, text_col: str) -> Column:
    """Key in 0..2**62-1: a hash of id, text and the row's number, so the global order is a shuffle.

    The number parts equal rows: however many there are, they spread over all keys.
    """
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.monotonically_increasing_id()), 2)


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + 8


def _ranges(key: Column, edges: list[int], values: list[Column]) -> Column:
    """values[i] for keys in edges[i] <= key < edges[i + 1], by halving: a tree of comparisons."""
    if len(values) == 1:
        return values[0]
    m = len(values) // 2
    return F.when(key < F.lit(edges[m]), _ranges(key, edges[:m], values[:m])).otherwise(_ranges(key, edges[m:], values[m:]))


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """Boundaries of the key and the exact bytes below each; keyed: key, bytes.

    Each round counts the bytes between candidate boundaries inside the ranges that still hold an
    open splitter (one aggregate over all partitions; the driver gets at most shards - 1 ranges of
    REFINE counts) and narrows every range to the candidates next to its target.
    """
    low, high = KEY_LOW, KEY_HIGH
    step = (high - low) // PROBES
    rows = keyed.groupBy(F.shiftright("key", step.bit_length() - 1).alias("bin")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    counted = {int(r["bin"]): (int(r["b"]), r["n"]) for r in rows}
    total = sum(b for b, _ in counted.values())
    targets = [total * (i + 1) // shards for i in range(shards - 1)]
    slack = tolerance * total / shards / 2
    # for each target: [low, high) of the key and the bytes below low
    found: dict[int, tuple[int, int]] = {}
    open_ranges = _narrow(targets, range(shards - 1), [(low, step, [counted.get(k, (0, 0)) for k in range(PROBES)], 0)], slack, found)
    while open_ranges:
        ranges = sorted(set(open_ranges.values()))
        edges, values = [low], [F.lit(None).cast("struct<r: int, bin: long>")]
        for k, (a, b, _) in enumerate(ranges):
            width = max(1, (b - a) // REFINE)
            inside = F.struct(F.lit(k).alias("r"), F.shiftright(F.col("key") - F.lit(a), width.bit_length() - 1).alias("bin"))
            if edges[-1] == a:
                values[-1] = inside
            else:
                edges.append(a)
                values.append(inside)
            edges.append(b)
            values.append(F.lit(None).cast("struct<r: int, bin: long>"))
        rows = keyed.select(_ranges(F.col("key"), edges, values).alias("at"), "bytes").filter("at is not null").groupBy("at").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in rows:
            counts.setdefault(r["at"]["r"], {})[r["at"]["bin"]] = int(r["b"]), r["n"]
        probed = []
        for k, (a, b, below) in enumerate(ranges):
            width = max(1, (b - a) // REFINE)
            probed.append((a, width, [counts.get(k, {}).get(x, (0, 0)) for x in range((b - a) // width)], below))
        open_ranges = _narrow(targets, open_ranges, probed, slack, found)
    return [found[i][0] for i in range(shards - 1)], [found[i][1] for i in range(shards - 1)]


def _narrow(targets, still_open, probed, slack, found) -> dict[int, tuple[int, int, int]]:
    """Settle targets whose best candidate is near enough, or whose range can't be narrowed."""
    out = {}
    for i in still_open:
        for a, width, counts, below in probed:
            if not below <= targets[i] <= below + sum(b for b, _ in counts):
                continue
            k, under = 0, below
            while k < len(counts) - 1 and under + counts[k][0] < targets[i]:
                under += counts[k][0]
                k += 1
            left, right = (a + k * width, under), (a + (k + 1) * width, under + counts[k][0])
            best = min((left, right), key=lambda x: abs(x[1] - targets[i]))
            if abs(best[1] - targets[i]) <= slack or counts[k][1] <= 1 or width == 1:
                found[i] = best
            else:
                out[i] = (left[0], right[0], under)
            break
    return out


def histogram_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with shard (0..shards-1) and slot (0, 1, ... in each shard, gapless), sizes near equal.

    The law is bytes: a row weighs its text's UTF-8 bytes plus 8 (a null text 8). Shards are runs
    of one global order, by a hash of id, text and row number. Rows are numbered and written once,
    so equal rows are told apart and spread over all shards like others, and a lost executor can't
    number them anew. A shard of one text larger than the share stays larger. Null ids and texts
    hash like any value; an empty table gives an empty result; input columns named shard or slot,
    or like the four above, are dropped. Built-in functions only; texts are exchanged once.
    """
    spark = docs.sparkSession
    rest = without(docs, {"shard", "slot", KEY, BYTES, PART, SHARD})
    rows = materialise(rest.select("*", sort_key(id_col, text_col).alias(KEY), size_of(text_col).alias(BYTES)), "shard-rows")
    keyed = rows.select(F.col(KEY).alias("key"), F.col(BYTES).alias("bytes"))
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return rest.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts, _ = splitters(keyed, shards, tolerance)
    edges = [KEY_LOW, *cuts]
    ends = [*cuts, KEY_HIGH]
    # several parts for each of Spark's partitions, which get them by a hash
    per_shard = max(1, round(total / shards / part_bytes), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    key = F.col(KEY)
    # (shard, part): each shard's key range in per_shard equal pieces, which hashed keys fill evenly
    place = [F.lit(s) * per_shard + F.floor((key - F.lit(a)) / F.lit(max(1, (b - a + per_shard - 1) // per_shard))).cast("int") for s, (a, b) in enumerate(zip(edges, ends))]
    keep_edges = [k for k in range(shards) if k == 0 or edges[k] > edges[k - 1]]
    # of equal boundaries the last shard has the keys; those before stay empty
    last = {edges[k]: k for k in range(shards)}
    order = [last[edges[k]] for k in keep_edges]
    part = _ranges(key, [edges[k] for k in keep_edges], [place[k] for k in order])
    counts = rows.select(part.alias(PART)).groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    by_shard = Window.partitionBy(SHARD).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before, rank = own_name(rest, "__before"), own_name(rest, "__rank")
    offsets = counts.withColumn(SHARD, F.floor(F.col(PART) / per_shard).cast("int")).select(PART, SHARD, F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias(before))
    offsets = materialise(offsets, "offsets")
    # equal keys of different rows, should a hash meet twice, follow the size: any order is as good
    in_part = Window.partitionBy(PART).orderBy(KEY, BYTES)
    ranked = rows.withColumn(PART, part).withColumn(rank, F.row_number().over(in_part))
    # offsets has a row for each part_bytes of text; up to 100,000 such rows are small enough to send
    small = shards * per_shard <= 100_000
    out = ranked.join(F.broadcast(offsets) if small else offsets, PART)
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(SHARD).alias("shard"), (F.col(before) + F.col(rank) - 1).alias("slot"))


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
