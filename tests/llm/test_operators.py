"""The training-data operators against plain Python on small hostile tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("veritrail.llm")

import public_tokenizers
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from veritrail.llm import bpe, components, decontaminate, eliasfano, labelled, ngram_lm, passage_dedup, quality_cnn, quality_rules, sharding, simhash, substring_dedup, token_counts, toxicity_crf

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "Delta", "épa", "ñu", "zeta,", "ETA!", "theta", "iota", "kappa", "lambda"] + [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(40) for _ in range(120))
PASSAGE = prose(60)
TEXTS = [
    (1, prose(120)), (2, ""), (3, None), (4, " \t\n \x0b"), (5, "one"), (6, "one two"), (7, prose(50) + "\n" + PASSAGE + "\n" + prose(30)),
    (8, PASSAGE + "\n" + prose(20)), (9, LONG), (10, LONG + " tail"), (11, "a b c d e f g h " * 40), (12, "ÄÖ x 日本語 text\r\nnext\fpage"),
    (None, prose(30)), (13, prose(25)), (13, prose(25)), (14, PASSAGE.upper()), (15, " ".join([prose(5), prose(6)])), (16, "x" * 5000), (17, "line of five plain words\nother\nline of five plain words"),
]
TEXTS += [(100 + i, TEXTS[0][1]) for i in range(30)]
TEXTS += [(200 + i, LONG.replace("alpha", "alphas", 1) if i % 2 else LONG) for i in range(6)]
SCHEMA = "doc_id long, text string, component_id string, removed int, shard string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7, "s", "t") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().translate(LOW).split()


def test_shards_near_equal_and_gapless(spark, docs, none):
    rows = sharding.histogram_shards(docs, 4).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((i or -1, t or "") for i, t in TEXTS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], len((r["text"] or "").encode()) + 8))
    for got in by.values():
        assert sorted(s for s, _ in got) == list(range(len(got)))
    sizes = [sum(b for _, b in by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * (len(LONG.encode()) + 100)
    assert "shard" in rows[0].asDict() and isinstance(rows[0]["shard"], int)
    assert sharding.histogram_shards(none, 4).count() == 0


def test_shards_of_many_even_rows(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('ab', cast(id % 50 as int)) as text")
    rows = sharding.histogram_shards(df, 24).groupBy("shard").agg({"slot": "max", "*": "count", "text": "max"}).collect()
    assert len(rows) == 24 and all(r["max(slot)"] + 1 == r["count(1)"] for r in rows)
    sizes = [r["b"] for r in sharding.histogram_shards(df, 24).withColumn("b", sharding.size_of("text")).groupBy("shard").agg({"b": "sum"}).withColumnRenamed("sum(b)", "b").collect()]
    assert max(sizes) / min(sizes) < 1.01


@pytest.mark.parametrize("n", [2400, 2411])
def test_shards_split_equal_rows(spark, n):
    df = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(5)
    rows = sharding.histogram_shards(df).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_shards_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sharding.op1_histogram_sort(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode()), "bytes", None) for d, t in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == want
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(w[1] for w in want)


def test_quality_rules(docs, none):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS)
    texts = collections.defaultdict(list)
    for i, t in TEXTS:
        texts[i].append(t)
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for r in rows:
        options = []
        for t in texts[r["doc_id"]]:
            w = (t or "").encode().split()
            windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            inside = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
            seen, dup = set(), 0
            for line in (t or "").split("\n"):
                if line.encode().split():
                    dup += line in seen
                    seen.add(line)
            failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
            fine = quality_rules.compression((t or "").encode(), packer)[3]
            options.append((len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(inside), failed, not failed and fine))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) in options
    assert quality_rules.quality_rules(none).count() == 0


def test_compression_rejects_repeats_and_noise():
    packer = zstandard.ZstdCompressor(level=3)
    noise = bytes(np.random.default_rng(1).integers(128, 255, 20000, dtype=np.uint8))
    assert not quality_rules.compression(b"same words again. " * 2000, packer)[3]
    assert not quality_rules.compression(noise, packer)[3]
    assert quality_rules.compression(LONG.encode(), packer)[3]


def noise_texts(n, seed):
    """Junk of n bytes that is valid UTF-8."""
    gen = random.Random(seed)
    mix = lambda k, chars: "".join(gen.choices(chars, k=k))
    code = base64.b64encode(gen.randbytes(n)).decode()
    return {
        "base64": code[:n],
        "base64 lines": "\n".join(code[i : i + 76] for i in range(0, n, 76))[:n],
        "alphanumeric": mix(n, string.ascii_letters + string.digits),
        "alphanumeric words": " ".join(mix(gen.randrange(7, 14), string.ascii_letters + string.digits) for _ in range(n // 7))[:n],
        "printable": mix(n, string.printable[:95]),
        "CJK": "".join(chr(gen.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3)),
    }


def test_compression_rejects_utf8_noise_and_keeps_prose(spark):
    packer = zstandard.ZstdCompressor(level=3)
    fine = lambda t: quality_rules.compression(t.encode(), packer)[3]
    for n in (200, 256, 400, 600, 1000, 2000, 4000, 8000, 50000):
        for seed in range(5):
            junk = noise_texts(n, seed)
            # a short text with white space at random is noise of a smaller alphabet
            assert [k for k, t in junk.items() if fine(t) and (n >= 600 or "words" not in k)] == [], n
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = [r for r in quality_rules.quality_rules(spark.createDataFrame(rows)).collect() if not r["base_failed"]]
    loose = tuple((limit, 0.0, high) for limit, _, high in quality_rules.BANDS)
    assert [r["doc_id"] for r in got if not r["kept"] and quality_rules.compression(r["text"].encode(), packer, bands=loose)[3]] == []
    assert sum(r["kept"] for r in got) > 0.9 * len(got) and len(got) > 500


def brute_print(t):
    w = words(t)
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    prints = [brute_print(t) for _, t in TEXTS]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in prints)
    least = {p: min((i for (i, _), q in zip(TEXTS, prints) if (p ^ q).bit_count() <= 3 and i is not None), default=None) for p in prints}
    for _ in range(len(TEXTS)):
        least = {p: min((least[q] for q in least if (p ^ q).bit_count() <= 3 and least[q] is not None), default=None) for p in least}
    for r in got:
        assert r["component_id"] == least[int(r["fingerprint"], 16)]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("direct", [10_000, 4])
def test_simhash_index_finds_all_links(spark, direct):
    gen = np.random.default_rng(3)
    base = gen.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(12):
            y = x
            for b in gen.integers(0, 64, gen.integers(1, 6)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(root, a)] = find(root, b)
    want = sorted(sorted(x for x in fps if find(root, x) == r) for r in {find(root, x) for x in fps})
    # each posting list on its own gives a forest; together they must connect the same sets
    other = {x: x for x in fps}
    for plane in simhash.PLANES:
        lists = collections.defaultdict(list)
        for x in fps:
            lists[tuple(x >> (56 - 8 * p) & 255 for p in plane)].append(x)
        for members in lists.values():
            links = simhash.bucket_links(np.array(members, np.uint64), plane, direct)
            assert len(links) < max(len(members), 1)
            for a, b in links:
                other[find(other, a)] = find(other, b)
    assert sorted(sorted(x for x in fps if find(other, x) == r) for r in {find(other, x) for x in fps}) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299), (None, 4)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).distinct().collect())
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def after_lines(texts, least):
    """(id, text) pairs without the lines that a lower (id, line number) holds."""
    first = {}
    for i, t in texts:
        for k, line in enumerate(t.split("\n") if t is not None and i is not None else ()):
            unit = tuple(words(line))
            if unit and len(unit) >= least:
                first[unit] = min(first.get(unit, (i, k)), (i, k))
    out = []
    for i, t in texts:
        if t is not None and i is not None:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if not 0 < first.get(tuple(words(x)), (i + 1, 0))[0] <= i or first[tuple(words(x))] >= (i, k))
        out.append((i, t))
    return out


def after_passages(texts, size=50):
    """(id, words) pairs without the runs of size words that a lower (id, text, word) holds."""
    first, given = {}, sorted({(i, t) for i, t in texts if i is not None and t is not None})
    rank = {x: (x[0], F_HASH(x[1])) for x in given}
    for x in given:
        w = words(x[1])
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, (*rank[x], p)), (*rank[x], p))
    out = []
    for x in texts:
        w = words(x[1])
        cover = [False] * len(w)
        if x in rank:
            for p in range(len(w) - size + 1):
                if first[tuple(w[p : p + size])] < (*rank[x], p):
                    cover[p : p + size] = [True] * size
        out.append((x[0], b" ".join(v for v, c in zip(w, cover) if not c)))
    return out


def F_HASH(text):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


@pytest.mark.parametrize("least", [1, 5, 16])
def test_line_dedup(docs, none, least):
    rows = substring_dedup.dedup_lines(docs, min_words=least).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, after_lines(TEXTS, least)))
    originals = collections.defaultdict(list)
    for i, t in TEXTS:
        originals[i].append(t)
    for r in rows:
        if r["text"] is not None:
            assert any("\n".join(t[s["start"] : s["end"]] for s in r["kept"]) == r["text"] for t in originals[r["doc_id"]])
            assert any(all(t[s["start"] : s["end"]].count("\n") == 0 for s in r["removed"]) for t in originals[r["doc_id"]])
    assert substring_dedup.dedup_lines(none).count() == 0


def test_passage_dedup(spark, docs, none):
    gen = random.Random(8)
    own = lambda n: " ".join(f"v{gen.randrange(10**6)}" for _ in range(n))
    run = own(60)
    short = "\n".join(" ".join(run.split()[i : i + 3]) for i in range(0, 60, 3))
    line = own(9)
    texts = {1: f"{own(20)} {run} {own(20)}", 2: f"{own(7)} é\n{own(5)} {run.upper()} {own(30)}\n{own(4)}", 3: f"{own(6)}\n{short}\n{own(40)}", 4: own(200), 5: f"{own(3)} {run.rsplit(' ', 11)[0]} {own(9)}", 6: f"{line}\n{own(80)}", 7: f"{line}\n{own(9)} {run}"}
    df = spark.createDataFrame([*texts.items(), (8, None), (None, texts[1]), (4, own(10))], "doc_id long, text string").repartition(3)
    rows = passage_dedup.dedup_passages(df, min_words=5).collect()
    assert len(rows) == 10
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["text"] == texts[1] and not got[1][0]["removed"] and got[None][0]["text"] == texts[1] and got[8][0]["text"] is None
    assert len(got[4]) == 2 and all(not r["removed"] for r in got[4])
    want = words(run)
    for i in (2, 3, 7):
        r, t = got[i][0], texts[i]
        assert not set(want) & set(words(r["text"])), i
        # the rest stays, and offsets are those of the original
        gone = words(" ".join(t[s["start"] : s["end"]] for s in r["removed"]))
        assert collections.Counter(words(r["text"])) + collections.Counter(gone) == collections.Counter(words(t))
        assert words(" ".join(t[s["start"] : s["end"]] for s in r["kept"])) == words(r["text"])
    assert got[7][0]["text"].split() == texts[7].split()[9:18]
    assert got[5][0]["text"] == texts[5]  # 49 words of the run
    assert passage_dedup.dedup_passages(none).count() == 0

    # every run of 50 words that a lower rank holds goes, and nothing else; ids may repeat
    again = [(13, LONG), (13, LONG), (1, PASSAGE), (18, "x y\n" + TEXTS[0][1])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(again, "doc_id long, text string"))
    for least in (5, 16):
        got = passage_dedup.dedup_passages(df, min_words=least).collect()
        want = after_passages(after_lines(TEXTS + again, least))
        assert sorted(map(str, ((r["doc_id"], b" ".join(words(r["text"]))) for r in got))) == sorted(map(str, want))


def test_containment_search(spark, docs, none):
    items = [(1, PASSAGE), (2, "one two"), (3, " ".join(PASSAGE.split()[:50]) + " quite other words at the end"), (4, ""), (5, None), (6, prose(30)), (7, "d e f g h a"), (None, "one"), (8, "absent words that no text holds"), (1, PASSAGE)]
    got = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        for j, x in {(j, x) for j, x in items if j is not None}:
            k, s = decontaminate.shingles(x)
            w = words(t)
            have = {b" ".join(w[p : p + k]) for p in range(len(w) - k + 1)} if k else set()
            if s and len(s & have) >= math.ceil(round(0.8 * len(s), 9)):
                want[i, j, len(s), len(s & have)] += 1
    assert collections.Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got) == want
    assert len(want) >= 6
    several = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string"), block_hashes=5).collect()
    assert sorted(map(str, several)) == sorted(map(str, got))
    assert decontaminate.contained_items(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contained_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_containment_of_items_with_one_id(spark):
    gen = random.Random(21)
    own = lambda n: " ".join(f"i{gen.randrange(10**6)}" for _ in range(n))
    a, b = own(40), own(60)
    df = spark.createDataFrame([(1, f"{own(200)} {a} {own(50)}"), (2, f"{own(30)} {b} {own(900)}"), (3, own(90))], "doc_id long, text string")
    items = spark.createDataFrame([(5, a), (5, b), (None, a)], "item_id long, text string")
    assert sorted(tuple(r)[:2] for r in decontaminate.contained_items(df, items).collect()) == [(1, 5), (2, 5)]


def test_containment_sends_no_item_texts(spark):
    """A long item costs a few hashes on the driver, and is found in pieces where it fills a pass."""
    gen = random.Random(22)
    own = lambda n: " ".join(f"j{gen.randrange(10**7)}" for _ in range(n))
    long = own(20_000)
    texts = spark.createDataFrame([(1, long)], "key long, text string")
    sketch = decontaminate.sketch_items(texts)
    assert sketch.columns == ["key", "piece", "width", "n", "least", "hash"] and sketch.count() == 19_996 - decontaminate.needed(19_996) + 2048
    w = long.split()
    df = spark.createDataFrame([(1, f"{own(40)} {long} {own(40)}"), (2, " ".join(w[:15_950])), (3, " ".join(w[:16_100])), (3, " ".join(w[:16_100])), (4, own(20_000))], "doc_id long, text string")
    items = spark.createDataFrame([(9, long), (8, "short item of six words")], "item_id long, text string")
    want = [(1, 9), (3, 9), (3, 9)]
    assert sorted(tuple(r)[:2] for r in decontaminate.contained_items(df, items).collect()) == want
    assert {tuple(r)[:2] for r in decontaminate.contained_items(df, items, block_hashes=900).collect()} == set(want)


def test_stages_decide_by_row(spark):
    gen = random.Random(23)
    own = lambda n: " ".join(f"s{gen.randrange(10**6)}" for _ in range(n))
    base, other, third = own(300), own(200), own(150)
    rows = [(3, base, 1), (5, base + " tail", 2), (5, other, 3), (None, base, 4), (None, third, 5), (6, third, 6), (7, third, 7), (7, third, 8), (8, None, 9), (9, "", 10), (3, base, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stay_id long")
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(spark, df, "").collect()), key=str)
    assert got == sorted([(3, base), (5, other), (6, third), (8, None)], key=str)
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(5, other, "a"), (5, f"{own(20)} {items[0]} {own(20)}", "b"), (None, f"x {items[1]}", "c"), (None, None, "d"), (7, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad_key string")
    kept = decontaminate.drop_contaminated(spark, df, "/root/testdata/sf0.001").collect()
    assert sorted(r["bad_key"] for r in kept) == ["a", "d", "e"]


def coder():
    enc = bpe.encoder(RANKS, PATTERN)
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_bpe_equals_library(docs, none):
    theirs = coder()
    enc = bpe.encoder(RANKS, PATTERN)
    gen = random.Random(2)
    odd = ["".join(gen.choice("aabcdeétionñ日本 \n\t'!*<|endoftext|>0123456789") for _ in range(gen.randrange(400))) for _ in range(300)]
    for t in [t or "" for _, t in TEXTS] + odd + ["a" * 3000, "ab" * 1500, "=" * 777, " " * 999, "\U0001f600" * 50]:
        ids = enc.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()
    rows = bpe.round_trip(docs, RANKS, PATTERN).collect()
    want = sorted((i or -1, len(ids := theirs.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    encoded = bpe.encode_texts(docs, RANKS, PATTERN)
    back = bpe.decode_ids(encoded, RANKS, PATTERN).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for _, t in TEXTS)
    assert bpe.round_trip(none, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, none, rule):
    rows = token_counts.section_tokens(docs, RANKS, PATTERN, rule=rule).filter("doc_id <> 13").collect()
    theirs = coder()
    texts = {i: t or "" for i, t in TEXTS if i is not None}
    per = collections.defaultdict(dict)
    for r in rows:
        per[r["doc_id"]][r["section"]] = r
    for i, got in per.items():
        t = texts[i]
        cuts = [0]
        for line in t.split("\n"):
            cuts.append(cuts[-1] + len(line) + 1)
        want = collections.Counter()
        ids = theirs.encode_ordinary(t)
        data, at = t.encode(), 0
        for x in ids:
            n = len(theirs.decode_single_token_bytes(x))
            a = len(data[: at + 1].decode(errors="ignore")) - 1 if (data[at] & 0xC0) != 0x80 and data[at] < 0x80 else sum((b & 0xC0) != 0x80 for b in data[: at + 1]) - 1
            b = sum((c & 0xC0) != 0x80 for c in data[: at + n])
            at += n
            share = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(cuts, cuts[1:])]
            inside = [k for k, s in enumerate(share) if s]
            want[inside[0] if rule == "first" else inside[-1] if rule == "last" else share.index(max(share))] += 1
        assert {k: r["n_tokens"] for k, r in got.items() if r["n_tokens"]} == dict(want)
        assert all(r["doc_tokens"] == len(ids) for r in got.values())
    assert token_counts.section_tokens(none, RANKS, PATTERN).count() == 0


def test_sections_with_gaps(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta", [(0, 5), (11, 16)])], "doc_id long, text string, parts array<struct<start: int, end: int>>")
    rows = {r["section"]: r for r in token_counts.section_tokens(df, RANKS, PATTERN, sections_col="parts", rule="most").collect()}
    assert sum(r["n_tokens"] for r in rows.values()) == rows[0]["doc_tokens"] and rows[-1]["n_tokens"] > 0


def test_section_tokens_of_long_runs(spark):
    texts = ["a" + " " * 1_500_000 + "b", " " * 6000 + "x\n" + "\t" * 7000, "plain words " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_counts.section_tokens(df, RANKS, PATTERN).collect()
    enc = bpe.encoder(RANKS, PATTERN)
    for i, t in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"] == len(enc.encode(t))
    assert enc.encode(texts[1]) == coder().encode_ordinary(texts[1])


def test_elias_fano_and_trie():
    gen = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (5, 3), (1000, 10), (1000, 10**6), (20000, 1 << 40)):
        v = np.sort(gen.integers(0, top, n))
        e = eliasfano.EliasFano.encode(v)
        assert (e[np.arange(n)] == v.astype(np.uint64)).all()
        q = np.concatenate([gen.integers(0, top + 10, 500), v])
        assert (e.find(q) == np.searchsorted(v, q, "left")).all()
    key = np.unique(gen.integers(0, 300, 5000).astype(np.uint64) << np.uint64(32) | gen.integers(0, 50, 5000).astype(np.uint64))
    c, w = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    trie = eliasfano.Trie(c, w, gen.integers(0, 256, len(key)).astype(np.uint8), np.arange(1, 257, dtype=np.float64))
    assert (trie.lookup(c, w) == trie.book[trie.code]).all()
    assert ((trie.lookup(c, w + np.uint64(1)) > 0) == np.isin(key + np.uint64(1), key)).all()


def test_lm_scores(docs, none):
    rows = ngram_lm.score_texts(docs).collect()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    count, pair, n_docs = collections.Counter(), collections.Counter(), 0
    for i, t in TEXTS:
        if crc(i):
            w = words(t) + [None]
            n_docs += 1
            count.update(w)
            pair.update(zip(["<s>"] + w[:-1], w))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in TEXTS:
        w = words(t) + [None]
        p = lambda x: (count[x] + 0.1) / (n + 0.1 * (v + 1))
        score = sum(math.log10((pair[u, x] + ngram_lm.MU * p(x)) / ((n_docs if u == "<s>" else count[u]) + ngram_lm.MU)) for u, x in zip(["<s>"] + w[:-1], w))
        want.append((i or -1, crc(i) == 0, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score))
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) <= 0.02 * a[2]
    assert ngram_lm.score_texts(none).count() == 0
    # many small shards give the same, but for the steps that each shard's values are rounded to
    small = {r["doc_id"] or -1: r["score"] for r in ngram_lm.score_texts(docs.filter("doc_id <> 13 or doc_id is null"), shard_bytes=700).collect()}
    whole = {r["doc_id"] or -1: (r["score"], r["n_tokens"]) for r in ngram_lm.score_texts(docs.filter("doc_id <> 13 or doc_id is null")).collect()}
    assert small.keys() == whole.keys() and all(abs(small[i] - x) <= 0.03 * n for i, (x, n) in whole.items())


def test_quality_network(spark, docs, none):
    gen = random.Random(4)
    good = [prose(gen.randrange(20, 150)) for _ in range(150)]
    bad = [" ".join(x + "%%%" for x in prose(gen.randrange(20, 150)).split()) for _ in range(150)]
    net = quality_cnn.train(good[:100] + bad[:100], [1] * 100 + [0] * 100, epochs=6)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good[100:] + bad[100:])], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in quality_cnn.score_quality(df, net).collect()}
    assert sum(got[i] == (i < 50) for i in got) >= 95
    rows = quality_cnn.score_quality(docs, net).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    alone = [quality_cnn.scores(net, np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for _, t in TEXTS]
    assert np.allclose(sorted(alone), sorted(r["score"] for r in rows), atol=1e-3)
    assert quality_cnn.score_quality(none, net).count() == 0
    assert quality_cnn.train([], []).out_b[0] == 0


def test_quality_gradients_are_numeric_ones():
    gen = np.random.default_rng(3)
    net = quality_cnn.Net.start(gen)
    for bias in (net.conv_b, net.mid_b):  # off the kink of an empty text, where all is zero
        bias += gen.uniform(0.05, 0.1, len(bias)).astype(np.float32)
    raw = gen.integers(97, 123, 900).astype(np.uint8)
    at, want, weight = np.array([0, 500, 500, 900]), np.array([1, 0, 1], np.float32), np.full(3, 1 / 3, np.float32)
    loss, grads = quality_cnn._gradients(net, raw, at, want, weight)
    p = np.clip(quality_cnn.scores(net, raw, at), 1e-7, 1 - 1e-7)
    assert abs(loss + (weight * np.where(want == 1, np.log(p), np.log(1 - p))).sum()) < 1e-4
    for param, grad in zip(net.params(), grads):
        flat, g = param.reshape(-1), grad.reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old, eps = flat[k], 3e-4
            flat[k] = old + eps
            above = quality_cnn._gradients(net, raw, at, want, weight)[0]
            flat[k] = old - eps
            below = quality_cnn._gradients(net, raw, at, want, weight)[0]
            flat[k] = old
            assert abs((above - below) / (2 * eps) - g[k]) < 0.1 * abs(g[k]) + 3e-3


def test_long_texts_are_trained_on_and_scored_whole():
    gen = random.Random(6)
    many = lambda n: " ".join(f"w{gen.randrange(4000)}" for _ in range(n))
    toxic = [f"{many(4500)} vilewort grubling {many(4500)}" for _ in range(39)]
    clean = [many(60 + 230 * k) for k in range(1, 40)]
    field = toxicity_crf.train(toxic[::2] + clean[::2], [1] * 20 + [0] * 20)
    got = list(toxicity_crf._tag(field, 0.5)(iter([pa.RecordBatch.from_arrays([pa.array(toxic[1::2] + clean[1::2])], ["text"])])))[0]
    assert got.column(1).to_pylist() == [1] * 19 + [0] * 19
    assert toxicity_crf.chains(np.array([0, 1, 256, 257, 600])).tolist() == [1, 256, 256, 1, 256, 256, 88]


def test_classifier_queries(spark):
    sf = "/root/testdata/sf0.001"
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    crc = {i: zlib.crc32(str(i).encode()) for i in ids}
    for query, out, least in ((quality_cnn.op2_byte_cnn_quality, lambda c: c % 4 == 2, 0.7), (toxicity_crf.op8_crf_toxicity, lambda c: c % 5 == 0, 0.5)):
        rows = query(spark, sf).collect()
        assert sorted((r["doc_id"], r["held_out"]) for r in rows) == sorted((i, out(crc[i])) for i in ids)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least) for r in rows)


def test_crf(spark, docs, none):
    gen = random.Random(4)
    many = lambda: " ".join(f"w{gen.randrange(5000)}" for _ in range(gen.randrange(20, 80)))
    clean = [many() for _ in range(200)]

    def spoil(t):
        w = t.split()
        for _ in range(2):
            w.insert(gen.randrange(len(w)), gen.choice(["Vilewort!", "grubling", "vilewort"]))
        return " ".join(w)

    toxic = [spoil(many()) for _ in range(120)]
    field = toxicity_crf.train(clean[:150] + toxic[:80], [0] * 150 + [1] * 80)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean[150:] + toxic[80:])], "doc_id long, text string")
    rows = toxicity_crf.tag_toxic(df, field).collect()
    assert all(r["predicted"] == (r["doc_id"] >= 50) for r in rows)
    texts = clean[150:] + toxic[80:]
    assert {texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"]} == {"vilewort", "grubling"}
    assert toxicity_crf.tag_toxic(docs, field).count() == len(TEXTS)
    assert toxicity_crf.tag_toxic(none, field).count() == 0
    assert not any(toxicity_crf.train([], []).weight)


def test_crf_marginals_are_exact():
    gen = np.random.default_rng(2)
    counts = np.array([3, 0, 5, 1])
    e = gen.standard_normal(9)
    step = gen.standard_normal((2, 2))
    p = toxicity_crf.pack(counts)
    got, pairs = toxicity_crf.marginals(e[p.order], p, step)
    m = np.empty(9)
    m[p.order] = got
    want, expected, at = np.zeros(9), np.zeros((2, 2)), 0
    for n in counts:
        total, mass, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n) if n else ():
            y = [code >> k & 1 for k in range(n)]
            s = math.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += s
            mass += s * np.array(y)
            for a, b in zip(y, y[1:]):
                trans[a, b] += s
        if n:
            want[at : at + n] = mass / total
            expected += trans / total
        at += n
    assert np.allclose(m, want) and np.allclose(pairs, expected)


def test_labelled_sample(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 18)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, labels, "quality", ~labelled.held_out(4, 2), 3)
    assert set(got["label"]) == {0, 1} and (got.groupby("label").size() <= 3).all()
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in got["doc_id"])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    kept = []
    for r in rows:
        w = r["text"].encode().split()
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        if not (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and quality_rules.compression(r["text"].encode(), packer)[3]:
            kept.append(r)
    prints = {r["doc_id"]: brute_print(r["text"]) for r in kept}
    root = {i: i for i in prints}
    for _ in prints:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == root:
            break
        root = new
    kept = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    lined = dict(after_lines([(r["doc_id"], r["text"]) for r in kept], 16))
    cut = dict(after_passages(list(lined.items())))
    after = {r["doc_id"]: r["text"] for r in passage_dedup.dedup_passages(spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "doc_id long, text string")).collect()}
    for r in kept:
        r["text"] = after[r["doc_id"]]
        assert b" ".join(words(r["text"])) == cut[r["doc_id"]]
    items = [decontaminate.shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    theirs, want = coder(), []
    for r in kept:
        own = decontaminate.shingles(r["text"])[1]
        if not any(len(s & own) >= math.ceil(round(0.8 * len(s), 9)) for _, s in items):
            ids = theirs.encode_ordinary(r["text"])
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_last_stage_returns_ids(spark, docs, none):
    theirs = coder()
    rows = bpe.tokenise(spark, docs, "").collect()
    assert sorted((r["doc_id"] or -1, r["ids"], r["n_tokens"], r["removed"]) for r in rows) == sorted((i or -1, ids := theirs.encode_ordinary(t or ""), len(ids), 7) for i, t in TEXTS)
    assert bpe.tokenise(spark, none, "").count() == 0


def test_pipeline_returns_ids(spark):
    import corpus_pipeline

    theirs = coder()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 50 and {"lang", "source"} <= set(rows[0].asDict())
    for r in rows:
        text = theirs.decode(r["ids"])
        assert hashlib.sha256(text.encode()).hexdigest() == r["decoded_sha256"] and theirs.encode_ordinary(text) == r["ids"] and len(r["ids"]) == r["n_tokens"]


def test_every_query_runs(spark):
    from veritrail.llm.registry import oracle_sql, queries

    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(oracle_sql()) <= set(queries())


def test_buffers_of_sliced_and_null_arrays():
    from veritrail.llm.wordarrays import text_buffer

    raw, at = text_buffer(pa.array(["ab", None, "é", ""]).slice(1, 3))
    assert raw.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
