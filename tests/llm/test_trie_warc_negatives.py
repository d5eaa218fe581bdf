"""Prefix trie, WARC archives and hard negatives against plain Python on small hostile tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("veritrail.llm")

from veritrail.llm.hard_negatives import _product, blocks, hard_negatives, quantised, reduced_tiles, tile_positives
from veritrail.llm.prefix_trie import prefix_trie
from veritrail.llm.warc import archived_pages, member, page_record, parse_record, read_archives, reachable, record_candidates, warc_record, write_archives
from veritrail.scratch import scratch_path

TURNS = "conv_id long, turn long, role string, text string, path string, head int, key string"
PAGES = "page_id long, url string, html string, digest string, offset int"
VECTORS = "vec_id long, embedding array<float>, label int, vector string, grp int"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, role, key), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    built = {c: own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = set()
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        kids = [m for m in below if len(m) == len(n) + 1]
        leaves = sum(not any(x[:-1] == m for x in members if x) for m in below)
        saved = sum((len(members[m]) - 1) * words(m) for m in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(n)))
        out.add((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(rng):
    rows = []
    for c in [*range(-25, 200), 10**12, 10**12 + 1]:
        if c % 20 == 0 and c % 3 == 0:
            continue  # an absent base
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "", None, "ü x y", "z" * 5000]), "x", 1, "k"))
    rows += rows[:7] + [(None, 0, "user", "lost", "x", 1, "k")]
    # a common beginning with branches far down
    for c in range(1000, 1400):
        rows += [(c, t, "system", f"shared {t}", "x", 1, "k") for t in range(30)] + [(c, 30 + t, "user", f"{c % 7} {c % (t + 2)}", "x", 1, "k") for t in range(c % 5)]
    return rows


@pytest.mark.parametrize("split", [5, 40, 2048])
def test_trie_equals_plain_python(spark, split):
    rows = trie_rows(random.Random(7))
    got = prefix_trie(spark.createDataFrame(rows, TURNS), split).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "t", "", 0, "")], TURNS)).collect() == []
    # 13's crc32 leaves 2 of its turns to a base that is absent
    h = zlib.crc32(b"13") % 4
    rows = [(13, t, "u", "t", "", 0, "") for t in range(h)]
    got = prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert h and {tuple(r) for r in got} == plain_trie(rows) and len(got) == 1


def test_copies_beyond_one_pack_keep_their_order(spark):
    rows = [(20 * c, 0, "u", "same", "", 0, "") for c in range(700)] + [(20 * c, 0, "u", "same", "", 0, "") for c in range(-600, -590)]
    assert {tuple(r) for r in prefix_trie(spark.createDataFrame(rows, TURNS)).collect()} == plain_trie(rows)


def hostile_pages():
    inner = member(page_record(999, "http://in/", b"inner " * 50, None)).decode("latin-1")
    big = "x" * 999_999
    rows = [(i, f"http://a/{i}", "<p>" + "same " * 300 + "</p>", "d", 0) for i in (1, 5, 9)]
    rows += [(2, None, None, "d", 0), (3, "http://b/\r\nWARC-Type: x", "", "d", 0), (4, "u", "short", "d", 0), (6, "u", "short", "d", 0)]
    rows += [(7, "u", inner, "d", 0), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "d", 0), (10, "u", big, "d", 0), (11, "u", big, "d", 0)]
    rows += [(None, "u", "n" * 2000, "d", 0), (None, "u", "n" * 2000, "d", 0), (None, "u", big, "d", 0), (12, "u", "r" * 1000, "d", 0), (12, "u", "r" * 1000, "d", 0), (13, "u", "é" * 500, "d", 0), (14, "u", "é" * 500, "d", 0)]
    return rows


def plain_pages(rows):
    last = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(i, last.get(html, i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        to = last.get(html) if len(data) >= 1000 else None
        again = to is not None and to != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes,range_bytes", [(1 << 30, 4 << 20), (600, 64), (3000, 501)])
def test_archives_give_back_every_page(spark, file_bytes, range_bytes):
    rows, root = hostile_pages(), scratch_path(spark, "warc-test")
    archives = write_archives(spark.createDataFrame(rows, PAGES), root, file_bytes)
    records = read_archives(archives, root, range_bytes, payload=True)
    assert sorted((tuple(r) for r in archived_pages(records).collect()), key=str) == plain_pages(rows)
    kept = {r["record_id"]: r["payload"].decode() for r in records.filter("record_type = 'response' and record_id <> 'urn:veritrail:page:'").collect()}
    assert all(kept[f"urn:veritrail:page:{i}"] == (html or "") for i, _, html, *_ in rows if i in (2, 3, 4, 6, 7, 8, 9, 11))


def test_no_pages_no_archives(spark):
    root = scratch_path(spark, "warc-test")
    archives = write_archives(spark.createDataFrame([], PAGES), root)
    assert archives.count() == 0 and read_archives(archives, root).count() == 0


def test_magic_inside_a_payload_and_damage(spark, tmp_path):
    """A stored record inside another's payload is a candidate and no record; a cut file ends before the cut."""
    inner = member(page_record(999, "http://in/", b"inner", None))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = page_record(1, "http://out/", b"before" + inner + b"after", None)
    outer = stored.compress(outer) + stored.flush()
    data = member(warc_record("warcinfo", [], b"x")) + outer + member(page_record(2, "u", b"two", None))
    whole, cut = data, data[:-5]
    (tmp_path / "whole.warc.gz").write_bytes(whole)
    (tmp_path / "cut.warc.gz").write_bytes(cut)
    root = f"file://{tmp_path}"
    archives = spark.createDataFrame([("whole.warc.gz", len(whole), 0), ("cut.warc.gz", len(cut), 0)], "file string, bytes long, records long")
    ids = lambda df: sorted((r["file"], r["record_id"][-3:]) for r in df.filter("record_type = 'response'").collect())
    assert ("whole.warc.gz", "999") in ids(record_candidates(archives, root, 37))
    assert ids(read_archives(archives, root, 37)) == [("cut.warc.gz", "e:1"), ("whole.warc.gz", "e:1"), ("whole.warc.gz", "e:2")]


def test_chain_of_any_length_is_followed(spark):
    rng = random.Random(3)
    chain = [0, *sorted(rng.sample(range(1, 100_000), 700))]
    links = [("f", a, b) for a, b in zip(chain, chain[1:])] + [("f", chain[-1], 100_000), ("f", 50_001, 50_003), ("g", 5, 9), ("h", 0, 4)]
    got = {tuple(r) for r in reachable(spark.createDataFrame(links, "file string, offset long, successor long")).collect()}
    assert got == {("f", x) for x in chain} | {("h", 0)}


def test_record_that_lies_about_its_length_is_none():
    good = page_record(1, "u", b"text", None)
    assert parse_record(good)["payload"] == b"text"
    assert parse_record(good[:-1]) is None and parse_record(good + b"x") is None and parse_record(b"WARC/1.1\r\nContent-Length: \xb2\r\n\r\n\r\n\r\n") is None


def plain_negatives(rows):
    kept = set()
    for i, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and math.fmod(i, 7) == 0 else label
        kept.add((2**63 - 1 if i is None else i, label, tuple(math.floor(256 * v) for v in x)))
    out = set()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for a, mine, x in kept:
        if a == 2**63 - 1 or math.fmod(a, 50):
            continue
        same = {}
        for i, label, y in kept:
            if label == mine and i != a:
                same[i] = max(dot(x, y), same.get(i, -(10**18)))
        for p, ps in sorted(same.items(), key=lambda v: (-v[1], v[0]))[:5]:
            found = sorted(((-dot(x, y), i) for i, label, y in kept if label != mine and 50 * ps <= 100 * dot(x, y) <= 95 * ps))
            out |= {(a, None if p == 2**63 - 1 else p, k + 1, None if i == 2**63 - 1 else i, ps, -s) for k, (s, i) in enumerate(found[:3])}
    return out


@pytest.mark.parametrize("sizes", [(128, 512, 32), (2, 3, 2)])
def test_negatives_equal_plain_python(spark, sizes):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0, rng.random()]) for _ in range(rng.choice([5, 5, 5, 3, 0]))], rng.choice([1, 2, 3, 4]), "v", 0) for i in range(-100, 400, 2)]
    rows += [(50, None, 1, "v", 0), (100, [0.1, None, 0.2], 2, "v", 0), (150, [float("nan")] * 5, 2, "v", 0), (200, [float("inf")] * 5, 2, "v", 0), (None, [0.4] * 5, 2, "v", 0), (None, [0.3] * 5, 1, "v", 0), (7, [0.3] * 5, None, "v", 0)]
    rows += rows[:40]
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), *sizes).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_negatives(rows)


def test_no_vectors_no_negatives(spark):
    assert hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1, "v", 0)], VECTORS)).collect() == []


def test_tiles_stay_where_they_are_made(spark):
    """Only panels of vectors are exchanged: cells, whose number is the product of anchors and rows, are not."""
    rows = quantised(spark.createDataFrame([(i, [0.1 * i, 1.0], 1, "v", 0) for i in range(200)], VECTORS))
    anchors = blocks(rows.filter("vec_id % 50 = 0"), 2, 2, 1)
    tiles = reduced_tiles(anchors, blocks(rows, 16, 2, 1), tile_positives, "anchor_id long, positive_id long, positive_score long", 2, 1)
    assert tiles.filter("anchor_id % 50 = 0").select("anchor_id").distinct().count() == 4
    assert "cells" not in tiles._jdf.queryExecution().executedPlan().toString()
    # products beyond what floating point holds are added as integers
    big = np.array([[2**31 + 1, 3]], np.int64)
    assert _product(big, big)[0, 0] == (2**31 + 1) ** 2 + 9
