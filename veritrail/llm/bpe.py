"""Byte-level BPE over an Aho-Corasick automaton: longest matches, backed off where needed.

A sequence of tokens is what BPE makes of its bytes exactly if every two neighbours are what
BPE makes of theirs. So the encoder goes left to right, takes the longest token that starts
here and is compatible with the token before, and steps back when none is; positions found to
lead nowhere are struck out, which keeps the work in proportion to the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import own_name, table, without

#: Pieces whose encoding a worker remembers, and neighbours it has judged; when full, either starts anew.
MEMORY, JUDGED = 250_000, 300_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: merge the adjacent pair of lowest rank, leftmost first. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that BPE merges last into this one; None for a byte and for what it can't reach."""
    below = {}
    for i in range(len(token)):
        for n in range(2, len(token) - i + 1):
            part = token[i : i + n]
            if part in ranks and n < len(token):
                below[part] = ranks[part]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((below.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 62:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Encoder(dict):
    """Token ids of pieces by mergeable ranks; as a mapping it remembers each piece met (str -> ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int | None] = {}
        # only tokens that merging can reach may stand in a sequence
        self.reached = {b for b, i in ranks.items() if merge(b, ranks) == [i]}
        self.parts = {ranks[b]: (ranks[h[0]], ranks[h[1]]) for b in self.reached if (h := halves(b, ranks))}
        # in ranks from training a token comes after its halves; without that, neighbours are merged anew
        self.ordered = all(max(h) < i for i, h in self.parts.items())
        self.finder = ahocorasick.Automaton()
        for b in self.reached:
            self.finder.add_word(b.decode("latin-1"), (ranks[b], len(b)))
        self.finder.make_automaton()
        self.most = max(map(len, self.reached), default=1)

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) > JUDGED:
                self.fits.clear()
            apart = self.apart(left, right) if self.ordered else merge(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
            known = self.fits[left << 32 | right] = apart
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two.

        Undoes the merges beside the border, the latest first. A pair met on the way would have been
        merged if it ranks before the merge undone last; of equal pairs the one further left is first.
        """
        before = 1 << 62
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], before) < before:
                return False
            x, y = self.parts.get(left), self.parts.get(right)
            if x and (left > right or not y):
                before, left = left, x[1]
            elif y:
                before, right = right + 1, y[0]
            else:
                return True

    def prefix(self, token: int) -> int | None:
        """The next shorter token that begins the same."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.reached), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, as the tiktoken library has it."""
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        text = piece.decode("latin-1")
        fits, sizes, compatible, shorter, search, most = self.fits, self.sizes, self.compatible, self.prefix, self.finder.iter_long, self.most
        out: list[int] = []
        open_at = bytearray(b"\x01") * (len(text) + 1)
        # a search copies the string it is given, so it gets no more than a token can take
        at, token = 0, next(search(text[:most]))[1][0]
        while True:
            end = at + sizes[token]
            if open_at[end]:
                known = fits.get(out[-1] << 32 | token) if out else True
                if known is None:
                    known = compatible(out[-1], token)
                if known:
                    out.append(token)
                    if end == len(text):
                        return out
                    at, token = end, next(search(text[end : end + most]))[1][0]
                    continue
            less = shorter(token)
            if less is None:
                open_at[at] = 0
                less = out.pop()
                at -= sizes[less]
            token = less

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode_piece(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self) > MEMORY:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def forget(self) -> None:
        """Give up the memory of pieces and neighbours."""
        self.clear()
        self.fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def _encoding(ranks_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, pattern)
        for batch in batches:
            all_ids = [enc.encode(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(all_ids, pa.list_(pa.int32()))], [*batch.schema.names[1:], "ids"])

    return run


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs without text_col, with ids (array of int): the whole text's tokens, no special ones.

    A null or empty text gives an empty array. Rows are independent, so repeats, ties and empty
    tables need no rule; an input column named ids is dropped. ranks_file must be readable on the
    executors (an installed vocabulary file).
    """
    rest = without(docs, {"ids", text_col})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias(own_name(rest, "__encoded")), *[F.col(f"`{c}`") for c in rest.columns])
    return given.mapInArrow(_encoding(ranks_file, pattern), f"{fields}ids array<int>")


def _decoding(ranks_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, pattern)
        for batch in batches:
            data = [enc.decode(ids or []) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(data, pa.binary())], [*batch.schema.names[1:], "data"])

    return run


def decode_ids(encoded: DataFrame, ranks_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded without ids_col, with data (binary): the bytes of the tokens; null ids give none."""
    rest = without(encoded, {"data", ids_col})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)
    return encoded.select(ids_col, *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(_decoding(ranks_file, pattern), f"{fields}data binary")


def _digests(ranks_file: str, pattern: str, with_ids: bool):
    """Encode and decode in one pass, so that ids need not travel to be hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file, pattern)
        digits = {i: str(i) for i in enc.bytes_of}
        for batch in batches:
            n, a, b, every = [], [], [], []
            for t in batch.column(0):
                ids = enc.encode(t.as_py() or "")
                if with_ids:
                    every.append(pa.array(ids, pa.int32()))
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            own, names = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                at = pa.array(list(accumulate(map(len, every), initial=0)), pa.int32())
                own.insert(0, pa.ListArray.from_arrays(at, pa.concat_arrays(every) if every else pa.array([], pa.int32())))
                names.insert(0, "ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], *names])
        if with_ids:  # in the pipeline the same processes go on to other work
            enc.forget()

    return run


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The kept columns, with with_ids the ids, then n_tokens, ids_sha256 and decoded_sha256 of encode and decode."""
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias(own_name(docs, "__encoded")), *[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[1:])
    ids = "ids array<int>, " if with_ids else ""
    return given.mapInArrow(_digests(ranks_file, pattern, with_ids), f"{fields}{ids}n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: all columns but the text, the token ids and the digests of the round trip."""
    import public_tokenizers

    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rest = without(docs, {"text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"})
    return round_trip(docs, file, pattern, keep=tuple(rest.columns), with_ids=True)
