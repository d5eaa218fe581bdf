"""Prefix trie of conversations: shared first turns, their branches, leaves and the words that sharing saves.

Turns become digests before anything is shuffled, equal conversations become one path with a count.
Paths are dealt by the digest of their first turn; pointer dictionary tries are built inside
applyInPandas. A first turn with many paths below it is split by the turn that follows the longest
common prefix of its paths, again and again; the few nodes above a split are sums over its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import materialise, table

BLOCK = 20  # conversations c to c + 19 take their first turns from c, a multiple of it
MOST_TAKEN = 3
PACK = 1000  # conv_ids whose quotient by it is equal are joined before they are hashed
SPLIT_TURNS = 2048  # more turns below one first turn are split by the next turn
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "up binary, up_round int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (key, words) in order; key is the MD5 of role and text.

    Null turns come first; equal turns are ordered by role and then key. Rows without a conv_id
    belong to no conversation and are left out. A repeated row is a turn of its own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "key", "words")
    made = given.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(placed)).alias("turns"))
    return made.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuild(convs: DataFrame) -> DataFrame:
    """conv_id, path: the first h turns of conversation c - c % 20, then c's own after its first h; h = crc32(c) % 4."""
    base = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_TAKEN).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("int")
    own = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")).join(base, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.when(F.col("first").isNull(), rest).otherwise(F.concat(F.slice("first", F.lit(1), F.col("h")), rest)).alias("path"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq, n, least, ends_sha256, path from packs sorted by seq and pack; a sequence may go on in the next batch."""
    kept: list = []  # seq, its first row, n, least, hash

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches([k[1] for k in kept]).combine_chunks().to_batches()[0]
        made = [pa.array([k[2] for k in kept], pa.int64()), pa.array([k[3] for k in kept], pa.int64()), pa.array([k[4].hexdigest() for k in kept])]
        return pa.RecordBatch.from_arrays([rows["seq"], *made, rows["path"]], ["seq", "n", "least", "ends_sha256", "path"])

    for batch in batches:
        seqs, ids, n, least = (batch[c].to_pylist() for c in ("seq", "ids", "n", "least"))
        for i, seq in enumerate(seqs):
            if kept and kept[-1][0] == seq:
                kept[-1][4].update(b",")
            else:
                kept.append([seq, batch.slice(i, 1), 0, least[i], hashlib.sha256()])
            kept[-1][4].update(ids[i].encode())
            kept[-1][2] += n[i]
        last = kept[-1:]
        kept = kept[:-1]
        if kept:
            yield flush()
        kept = last
    if kept:
        yield flush()


def distinct_paths(rebuilt: DataFrame) -> DataFrame:
    """seq, n, least, ends_sha256, path: equal conversations as one row, their ids hashed in ascending order.

    Ids are joined in packs, map-side first, and packs stream through the hash, so that a group
    of copies needs the memory of one pack however large it is.
    """
    seq = F.unhex(F.md5(F.array_join(F.transform("path", lambda p: F.hex(p["key"])), "")))
    packs = rebuilt.select(seq.alias("seq"), F.floor(F.col("conv_id") / PACK).alias("pack"), "conv_id", "path")
    packs = packs.groupBy("seq", "pack").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"))
    packs = packs.select("seq", "pack", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("least"), "path")
    path = packs.schema["path"].dataType.simpleString()
    return packs.repartition("seq").sortWithinPartitions("seq", "pack").mapInArrow(_hash_ends, f"seq binary, n long, least long, ends_sha256 string, path {path}")


def _tries(paths: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all subtries of one bucket: a pointer dictionary for each node, sums in iterative postorder."""
    children: list[dict[bytes, int]] = []
    count, least, words, depth, parent, ends, top = [], [], [], [], [], [], []
    tops: dict[bytes, int] = {}

    def node(above: int, at: int, w: int, of) -> int:
        children.append({})
        for column, value in ((count, 0), (least, None), (words, w), (depth, at), (parent, above), (ends, NO_ENDS), (top, of)):
            column.append(value)
        return len(children) - 1

    for row in paths.itertuples(index=False):
        head = bytes(row.head)
        here = -1
        for k, (key, w) in enumerate(zip(row.keys, row.words)):
            links = tops if here < 0 else children[here]
            key = head if here < 0 else bytes(key)
            new = links.get(key)
            if new is None:
                new = links[key] = node(here, row.cut + k, int(w), (row.up, row.up_round) if here < 0 else None)
            here = new
            count[here] += row.n
            least[here] = row.least if least[here] is None else min(least[here], row.least)
        ends[here] = row.ends_sha256
    leaves, saved = [0] * len(children), [0] * len(children)
    order, stack = [], list(tops.values())
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(children[at].values())
    for at in reversed(order):  # children before their parents
        saved[at] += (count[at] - 1) * words[at]
        leaves[at] = leaves[at] or 1
        if parent[at] >= 0:
            saved[parent[at]] += saved[at]
            leaves[parent[at]] += leaves[at]
    out = [(*(top[i] or (None, None)), depth[i], least[i], None if parent[i] < 0 else least[parent[i]], count[i], len(children[i]), leaves[i], saved[i], ends[i]) for i in order]
    made = pd.DataFrame(out, columns=["up", "up_round", *[c.split()[0] for c in NODE.split(", ")[2:]]])
    made["parent_conv_id"] = made["parent_conv_id"].astype("Int64")
    made["up_round"] = made["up_round"].astype("Int32")
    return made


def _common(lo: Column, hi: Column) -> Column:
    """How many first turns two paths share; over the least and greatest of a group, how many all of it share."""
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a["key"] == b["key"], F.lit(False)))
    return F.array_position(same, F.lit(False)).cast("int") - 1


def _split(paths: DataFrame, most_turns: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Paths by subtrie (head, cut, up, up_round); per round the groups split and the paths that end where one splits.

    A round splits every group of more than most_turns turns and two or more paths after what its
    paths share, so rounds count the branchings met on the way down, not turns.
    """
    todo = paths.filter(F.size("path") > 0).select("path", "n", "least", "ends_sha256", F.get("path", F.lit(0))["key"].alias("head"), F.lit(1).alias("cut"), F.lit(None).cast("binary").alias("up"), F.lit(-1).alias("up_round"))
    whole, splits, ended = None, [], []
    while True:
        sizes = todo.groupBy("head").agg(F.sum(F.size("path") - F.col("cut") + 1).alias("turns"), F.count(F.lit(1)).alias("paths"))
        large = materialise(sizes.filter((F.col("turns") > most_turns) & (F.col("paths") > 1)).select("head"), "large")
        if large.isEmpty():
            return (todo if whole is None else whole.unionByName(todo)), splits, ended
        bounds = todo.join(large, "head").groupBy("head", "up", "up_round", "cut").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
        split = materialise(bounds.select("head", "up", "up_round", "cut", "lo", _common(F.col("lo"), F.col("hi")).alias("shared")), "splits")
        kept = todo.join(split.select("head"), "head", "left_anti")
        whole = kept if whole is None else whole.unionByName(kept)
        below = todo.select("path", "n", "least", "ends_sha256", "head").join(split.select("head", "shared"), "head")
        ended.append(materialise(below.filter(F.size("path") == F.col("shared")).select("head", F.col("n").alias("end_n"), F.col("least").alias("end_least"), "ends_sha256"), "ended"))
        key = F.get("path", F.col("shared"))["key"]
        todo = below.filter(F.size("path") > F.col("shared")).select(
            "path", "n", "least", "ends_sha256", F.unhex(F.md5(F.concat("head", key))).alias("head"), (F.col("shared") + 1).alias("cut"), F.col("head").alias("up"), F.lit(len(splits)).alias("up_round"),
        )
        todo = materialise(todo, "below")
        splits.append(split)


def _above(split: DataFrame, ended: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of what the paths of each split group share, from the tops of its parts: NODE and head."""
    parts = tops.groupBy(F.col("up").alias("head")).agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("kids"))
    both = split.join(parts, "head").join(ended, "head", "left").withColumn("n", F.col("n") + F.coalesce("end_n", F.lit(0))).withColumn("least", F.least("least", "end_least"))
    each = both.select("*", F.explode(F.sequence("cut", "shared")).alias("depth"))
    below = F.aggregate(F.slice("lo", F.col("depth"), F.col("shared") - F.col("depth") + 1), F.lit(0).cast("long"), lambda a, t: a + t["words"])
    first, last = F.col("depth") == F.col("cut"), F.col("depth") == F.col("shared")
    return each.select(
        F.when(first, F.col("up")).alias("up"), F.when(first, F.col("up_round")).alias("up_round"), F.col("depth").cast("long").alias("depth"), F.col("least").alias("conv_id"), F.when(~first, F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * below).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), "head",
    )


def prefix_trie(conversations: DataFrame, split_turns: int = SPLIT_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text): COLUMNS.

    Conversations are rebuilt as rebuild() says, equal ones end at one node. Null role or text is
    empty text; rows without a conv_id are left out, a conversation may be turnless once rebuilt
    and then ends at the root; other columns are not read. An empty table gives no node. One
    conversation's digests (24 bytes a turn) are one row; nothing else is gathered by key beyond
    split_turns turns, which changes no result.
    """
    spark = conversations.sparkSession
    paths = materialise(distinct_paths(rebuild(conversation_turns(conversations))), "paths")
    whole, splits, ended = _split(paths, split_turns)
    # first-turn digests hashed to buckets: many small subtries share one call
    turns = paths.agg(F.sum(F.size("path"))).first()[0]
    if turns is None:
        return spark.createDataFrame([], NODE).select(*COLUMNS)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), turns // (8 * split_turns))
    rest = F.slice("path", F.col("cut"), F.size("path") - F.col("cut") + 1)
    dealt = whole.select(
        F.pmod(F.xxhash64("head"), F.lit(buckets)).alias("bucket"), "head", "up", "up_round", "cut", "n", "least", "ends_sha256",
        F.transform(rest, lambda t: t["key"]).alias("keys"), F.transform(rest, lambda t: t["words"]).alias("words"),
    )
    nodes = materialise(dealt.groupBy("bucket").applyInPandas(_tries, NODE), "nodes")
    upper = None
    for k in reversed(range(len(splits))):
        tops = nodes.filter(F.col("up_round") == k)
        if upper is not None:
            tops = tops.unionByName(upper.filter(F.col("up_round") == k).drop("head"))
        above = materialise(_above(splits[k], ended[k], tops), "above")
        upper = above if upper is None else upper.unionByName(above)
    every = nodes if upper is None else nodes.unionByName(upper.drop("head"))
    tops = every.filter("up_round = -1")
    empty = paths.filter(F.size("path") == 0)
    sums = tops.agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    at_root = empty.select("n", "least", "ends_sha256").first()  # one path at most is turnless
    n = (sums["n"] or 0) + (at_root["n"] if at_root else 0)
    least = min(x for x in (sums["least"], at_root["least"] if at_root else None) if x is not None)
    root = spark.createDataFrame([(least, 0, None, n, sums["kids"], sums["leaves"] or 1, sums["saved"] or 0, at_root["ends_sha256"] if at_root else NO_ENDS)], ", ".join(NODE.split(", ")[3:4] + NODE.split(", ")[2:3] + NODE.split(", ")[4:]))
    placed = every.filter("up_round is null").select(*COLUMNS).unionByName(tops.withColumn("parent_conv_id", F.lit(least).cast("long")).select(*COLUMNS)).unionByName(root)
    if upper is None:
        return placed
    # at most one row for each group that was split
    joint = upper.groupBy("head").agg(F.min("conv_id").alias("joint"))
    inner = every.filter("up_round >= 0").join(joint, F.col("up") == F.col("head")).withColumn("parent_conv_id", F.col("joint"))
    return placed.unionByName(inner.select(*COLUMNS))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, a row per node; as prefix_trie() states for nulls, ties and empty tables."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, turns, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 4 AS h FROM own, tab),
built AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS path FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth, path FROM built),
keyed AS (SELECT conv_id, size, depth, CASE WHEN depth > 0 THEN md5(to_json(path[1:depth])::VARCHAR) ELSE '' END AS node, CASE WHEN depth > 0 THEN len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM steps),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends FROM keyed GROUP BY depth, node),
above AS (SELECT k.node, k.depth, p.node AS up, n.conv_id AS up_id FROM (SELECT DISTINCT ON (node, depth) node, depth, conv_id FROM keyed WHERE depth > 0) k JOIN keyed p ON p.conv_id = k.conv_id AND p.depth = k.depth - 1 JOIN nodes n ON n.node = p.node AND n.depth = p.depth),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM above GROUP BY ALL),
-- each node hangs, by its smallest member, below all that the member passes
sums AS (SELECT a.node, a.depth, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM nodes v JOIN keyed a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN kids k ON k.up = v.node AND k.depth = v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, a.up_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN sums s USING (node, depth) LEFT JOIN above a ON a.node = v.node AND a.depth = v.depth LEFT JOIN kids k ON k.up = v.node AND k.depth = v.depth
"""
