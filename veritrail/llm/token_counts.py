"""Token counts by section: whole texts encoded once, token spans joined to section spans."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.bpe import encoder
from veritrail.llm.common import table

#: What a token that crosses a boundary counts for: the section of its first character, of its
#: last one, or the one with most of its characters (the earlier one of equals).
RULES = ("first", "last", "most")
#: The library's splitter overflows its stack on long runs of white space; a text with one of this length goes to the encoder of bpe.py.
LONG_SPACE = re.compile(r"\s{5000}")
OUT = "doc_id long, section int, char_start int, char_end int, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def _coder(ranks_file: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for b, i in ranks.items():
        lengths[i] = len(b)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, coder: tiktoken.Encoding, ranks_file: str, pattern: str) -> list[int]:
    """Token ids of a whole text, as the library has them."""
    return encoder(ranks_file, pattern).encode(text) if LONG_SPACE.search(text) else coder.encode_ordinary(text)


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token; a token of part of a character has that one."""
    ids = np.array(ids, np.int64)
    ends = np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return leads[begins + 1] - 1, leads[ends]


def join_spans(begin: np.ndarray, end: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it counts for (-1: none) and whether it crosses a boundary.

    Sections are sorted and don't overlap; they may leave gaps. A token crosses if it isn't inside
    one section whole; one that touches a gap and a section counts by the same rule.
    """
    if not len(lows):
        return np.full(len(begin), -1), np.zeros(len(begin), bool)

    def holding(at):
        k = np.searchsorted(lows, at, "right") - 1
        return np.where((k >= 0) & (at < highs[np.maximum(k, 0)]), k, -1)

    a, b = holding(begin), holding(end - 1)
    crossing = (a != b) | ((a < 0) & (np.searchsorted(lows, begin, "right") < np.searchsorted(lows, end - 1, "right")))
    out = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            first = max(int(np.searchsorted(lows, begin[t], "right")) - 1, 0)
            last = int(np.searchsorted(lows, end[t] - 1, "right"))
            shares = [min(end[t], highs[k]) - max(begin[t], lows[k]) for k in range(first, last)]
            covered = sum(max(s, 0) for s in shares)
            best = max(shares, default=0)
            out[t] = first + shares.index(best) if best > 0 and best >= end[t] - begin[t] - covered else -1
    return out, crossing


def _attribution(ranks_file: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = _coder(ranks_file, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text, sections in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                begin, end = token_spans(text, encode(text, coder, ranks_file, pattern), lengths)
                if sections is None:
                    cuts = np.cumsum([0] + [len(x) + 1 for x in text.split("\n")])
                    lows, highs = cuts[:-1], np.minimum(cuts[1:], len(text))
                else:
                    spans = np.array(sorted((s["start"], s["end"]) for s in sections), np.int64).reshape(-1, 2)
                    lows, highs = spans[:, 0], spans[:, 1]
                to, crossing = join_spans(begin, end, lows, highs, rule)
                n = np.bincount(to + 1, minlength=len(lows) + 1)
                over = np.bincount(to + 1, weights=crossing, minlength=len(lows) + 1).astype(np.int64)
                rows = range(1, len(lows) + 1) if not n[0] else range(len(lows) + 1)
                cols[0] += [doc_id] * len(rows)
                cols[1] += [k - 1 for k in rows]
                cols[2] += [int(lows[k - 1]) if k else None for k in rows]
                cols[3] += [int(highs[k - 1]) if k else None for k in rows]
                cols[4] += [int(n[k]) for k in rows]
                cols[5] += [int(over[k]) for k in rows]
                cols[6] += [len(begin)] * len(rows)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in OUT.split(", ")])

    return run


def section_tokens(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens: a row per section.

    The whole text is encoded once, so tokens are those of the text and not of its pieces, and the
    sections of a text add up to doc_tokens. sections_col: array of struct(start, end) in
    characters, not overlapping; tokens outside all of them are counted in a row of section -1.
    Without it, or where it is null, sections are lines, each with its \\n. Null and empty texts
    have one empty line and no tokens; rows are independent, so repeated ids and ties need no
    rule; an empty table gives an empty result; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spans = F.col(f"`{sections_col}`") if sections_col else F.lit(None)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), spans.cast("array<struct<start: int, end: int>>").alias("sections"))
    return given.mapInArrow(_attribution(ranks_file, pattern, rule), OUT)


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
