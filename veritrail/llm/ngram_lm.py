"""Language-model scoring: a bigram model in Elias-Fano tries, counted and queried in shards.

The model is p(w | u) = (c(u w) + MU * p(w)) / (c(u) + MU) with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
Its pairs are spread over shards by a hash, each shard holds its pairs in a trie (see eliasfano),
and every text's pairs are looked up where they belong. Texts travel as numbers: a chunk of texts
goes to words' counts and back (to learn ids and counts), then its distinct pairs to the shards, whose
answers for those pairs come back. No step holds the model, the vocabulary or the corpus in one place.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import forget, id_crc, materialise, table
from veritrail.llm.eliasfano import Trie
from veritrail.llm.wordarrays import Words, blocks, mix

MU = 50.0
ADD = 0.1
CHUNK_BYTES = 6 << 20
#: Bytes of text for each shard: there are as many as that takes, so that none grows with the corpus.
SHARD_BYTES = 8 << 20
#: Values that a shard's trie tells apart; answers travel in half precision, which is finer.
LEVELS = 256
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_U = np.uint64


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: equal bytes of all numbers side by side, then zstandard."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        out.append(struct.pack("<8sq", a.dtype.str.encode(), len(a)) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def load(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(n):
        name, size = struct.unpack_from("<8sq", raw, at)
        kind = np.dtype(name.rstrip(b"\0").decode())
        at += 16
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _read(shards: int):
    """Texts to chunks: the stream of each text's word numbers, and the chunk's words by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            train = ~np.array(batch.column(1).to_pylist(), bool)
            for i, j, raw, at in blocks(batch.column(2), CHUNK_BYTES):
                chunk = part << 24 | n
                n += 1
                # a smaller block's powers fit the cache; hashes don't depend on the block
                hashes, counts = [], []
                for a, b, piece, begins in blocks(batch.column(2).slice(i, j - i), 1 << 20):
                    w = Words.of(piece, begins)
                    hashes.append(w.hashes())
                    counts.append(w.counts)
                h, per_text = np.concatenate(hashes), np.concatenate(counts)
                own, stream = np.unique(h, return_inverse=True)
                learnt = np.repeat(train[i:j], per_text)
                c = np.bincount(stream[learnt], minlength=len(own)).astype(np.uint32)
                doc_ids = ids.slice(i, j - i)
                rows = [(0, chunk, -1, dump(np.array(doc_ids.fill_null(0)), np.array(doc_ids.is_null(), bool), train[i:j], per_text.astype(np.uint32), stream.astype(np.uint32)))]
                cut = np.searchsorted(own, np.array([(k << 64) // shards for k in range(shards)], np.uint64))
                for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(own)])):
                    if a < b:
                        rows.append((1, chunk, k, dump(steps(own[a:b]), c[a:b])))
                yield _batch(rows, ("kind", "chunk", "shard", "data"))

    return run


def _batch(rows, names) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "chunk": pa.int64(), "shard": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows), names)], list(names))


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's words of all chunks: each word's place in the shard and count, for each chunk."""
    pdf = pdf.sort_values("chunk", kind="stable")
    given = [load(d) for d in pdf["data"]]
    hashes = [np.cumsum(s, dtype=np.uint64) for s, _ in given]
    own, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c for _, c in given]), minlength=len(own)).astype(np.int64)
    shard = int(pdf["shard"].iloc[0])
    edge = np.cumsum([0] + [len(h) for h in hashes])
    rows = [(2, int(chunk), shard, dump(steps(place[a:b].astype(np.uint64)), total[place[a:b]])) for chunk, a, b in zip(pdf["chunk"], edge, edge[1:])]
    rows.append((3, -1, shard, dump(np.array([len(own), (total > 0).sum(), total.sum()], np.int64))))
    return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "data"])


def _pairs(shards: int, offsets: list[int], n_docs: int, n_tokens: int, n_kinds: int):
    """A chunk's texts with its words' counts: what can be summed here, and its pairs by shard."""
    begin, end = offsets[-1], offsets[-1] + 1  # ids before and after all words
    below = math.log10(n_tokens + ADD * (n_kinds + 1)) if n_tokens or n_kinds else 0.0
    hot = max(1, n_tokens // (2 * shards))

    def unigram(c):
        return np.log10(c + ADD) - below

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        doc, null, train, per_text, stream = load(pdf.loc[pdf["kind"] == 0, "data"].iloc[0])
        replies = pdf[pdf["kind"] == 2].sort_values("shard")
        got = [(np.cumsum(p, dtype=np.uint64).astype(np.int64) + offsets[s], c) for s, (p, c) in zip(replies["shard"], map(load, replies["data"]))]
        ids = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
        count = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        n = len(doc)
        per_text = per_text.astype(np.int64)
        # each text's tokens: its words, then the end
        size = per_text + 1
        at = np.concatenate(([0], np.cumsum(size)))
        last = at[1:] - 1
        word, c = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        inner = np.ones(at[-1], bool)
        inner[last] = False
        word[inner], c[inner] = ids[stream], count[stream]
        word[last], c[last] = end, n_docs
        before, c_before = np.empty_like(word), np.empty_like(c)
        before[1:], c_before[1:] = word[:-1], c[:-1]
        before[at[:-1]], c_before[at[:-1]] = begin, n_docs
        of = np.repeat(np.arange(n), size)
        log_p = unigram(c)
        base = np.bincount(of, weights=log_p, minlength=n)
        # every token as if its pair were unseen; the shards add what seen pairs have more
        unseen = np.bincount(of, weights=math.log10(MU) + log_p - np.log10(c_before + MU), minlength=n)
        known = np.bincount(of, weights=c > 0, minlength=n).astype(np.int64)
        spread = np.where(c_before > hot, word, 0).astype(np.uint64)
        to = (mix(before.astype(np.uint64) ^ mix(spread)) % _U(shards)).astype(np.int64)
        # a pair whose words training has not is unseen, as is one after an unknown word
        may = np.flatnonzero((c > 0) & (c_before > 0))
        order = may[np.lexsort((word[may], before[may], to[may]))]
        cut = np.searchsorted(to[order], np.arange(shards + 1))
        new = np.ones(len(order), bool)
        new[1:] = (before[order][1:] != before[order][:-1]) | (word[order][1:] != word[order][:-1])
        # the shards answer for each distinct pair, in this order; the chunk keeps in which texts it stands
        uses = np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.uint32)
        rows = [(4, chunk, -1, dump(doc, null, train, size, known, base, unseen, of[order].astype(np.uint32), uses))]
        for k in np.flatnonzero(np.diff(cut)).tolist():
            o = order[cut[k] : cut[k + 1]]
            first = np.flatnonzero(new[cut[k] : cut[k + 1]])
            learnt = np.add.reduceat(train[of[o]].astype(np.int64), first)
            key = before[o][first].astype(np.uint64) << _U(32) | word[o][first].astype(np.uint64)
            rows.append((5, chunk, k, dump(steps(key), learnt.astype(np.uint32), quantised(log_p[o][first]))))
        return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "data"])

    return run


def quantised(log_p: np.ndarray) -> np.ndarray:
    """Unigram log10 probabilities in steps of 1/64: what a pair carries of its word."""
    return np.clip(np.round(-log_p * 64), 0, 65535).astype(np.uint16)


def codebook(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEVELS equal steps of the values' range: the mean of those in each, and each value's step.

    No value is farther from its step's mean than the step is wide (log10 of at most some 8 / 256).
    """
    if not len(values):
        return np.zeros(1), np.zeros(0, np.uint8)
    low, high = values.min(), values.max()
    code = np.minimum((values - low) / max(high - low, 1e-12) * LEVELS, LEVELS - 1).astype(np.uint8)
    n = np.bincount(code, minlength=LEVELS)
    return np.bincount(code, weights=values, minlength=LEVELS) / np.maximum(n, 1), code


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Build one shard's trie of the pairs in training texts, and look up those of all chunks."""
    given = [load(d) for d in pdf["data"]]
    keys = [np.cumsum(g[0], dtype=np.uint64) for g in given]
    every = np.concatenate(keys)
    learnt, log_p = np.concatenate([g[1] for g in given]), np.concatenate([g[2] for g in given])
    seen = learnt > 0
    own, first, place = np.unique(every[seen], return_index=True, return_inverse=True)
    count = np.bincount(place, weights=learnt[seen], minlength=len(own))
    p = 10.0 ** (log_p[seen][first] / -64.0)
    book, code = codebook(np.log10(1 + count / (MU * p)))
    trie = Trie(own >> _U(32), own & _U(0xFFFFFFFF), code, book)
    shard = int(pdf["shard"].iloc[0])
    out = [(6, int(chunk), shard, dump(trie.lookup(key >> _U(32), key & _U(0xFFFFFFFF)).astype(np.float16))) for chunk, key in zip(pdf["chunk"], keys)]
    return pd.DataFrame(out, columns=["kind", "chunk", "shard", "data"])


def _finish(n_tokens: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, null, train, size, known, base, unseen, of, uses = load(pdf.loc[pdf["kind"] == 4, "data"].iloc[0])
        answers = [load(d)[0] for d in pdf[pdf["kind"] == 6].sort_values("shard")["data"]]
        more = np.concatenate(answers) if answers else np.zeros(0, np.float16)
        score = unseen + np.bincount(of, weights=np.repeat(more.astype(np.float64), uses), minlength=len(doc))
        ids = pd.array(doc, dtype="Int64")
        ids[null.astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": ~train, "n_tokens": size, "n_known": known, "train_tokens": n_tokens, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row.

    held_out: a boolean column, the rows that the model does not learn from (default: crc32 of the
    id as text leaves remainder 0 by 10; a null id counts as empty text). Null texts are empty: the
    end alone. Repeated rows count as often as they occur. Without training rows every token is
    unknown. An empty table gives an empty result; other columns are ignored. Words are told apart
    by 64-bit hashes, up to 2**32 - 2 of them. There is a shard for each shard_bytes of text. A
    frequent context's pairs are spread over all shards, and a frequent pair is sent once by each
    chunk of texts, so that neither fills one.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    out_of = F.pmod(id_crc(F.col(f"`{id_col}`")), F.lit(10)) == 0 if held_out is None else held_out
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(out_of, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    form = "kind int, chunk long, shard int, data binary"
    read = materialise(given.mapInArrow(_read(shards), form), "lm-words")
    counted = materialise(read.filter("kind = 1").groupBy("shard").applyInPandas(_count, form), "lm-counts")
    # one row of three numbers for each shard
    stats = {r["shard"]: load(bytes(r["data"]))[0].tolist() for r in counted.filter("kind = 3").select("shard", "data").collect()}
    offsets = np.cumsum([0] + [stats.get(k, [0])[0] for k in range(shards)]).tolist()
    if offsets[-1] >= 2**32 - 2:
        raise ValueError("more than 2**32 - 2 words")
    n_docs = given.filter(~F.col("held_out")).count()
    n_tokens = sum(s[2] for s in stats.values()) + n_docs
    n_kinds = sum(s[1] for s in stats.values()) + (n_docs > 0)
    chunks = read.filter("kind = 0").unionByName(counted.filter("kind = 2"))
    pairs = materialise(chunks.groupBy("chunk").applyInPandas(_pairs(shards, offsets, n_docs, n_tokens, n_kinds), form), "lm-pairs")
    forget(read, counted)
    answers = pairs.filter("kind = 5").groupBy("shard").applyInPandas(_shard, form)
    return pairs.filter("kind = 4").unionByName(answers).groupBy("chunk").applyInPandas(_finish(n_tokens), OUT)


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
