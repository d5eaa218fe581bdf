"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.labelled import held_out, labelled_sample
from veritrail.llm.wordarrays import text_buffer

#: Bounds of the training sample.
SAMPLE_EACH = 1500
#: Bytes that one step of training sees of a text, from a place drawn anew each time; scoring sees whole texts.
STEP_BYTES = 30_000
THRESHOLD = 0.7
#: Byte windows of WIDTH bytes every STRIDE bytes; chunks of 2 * HALF windows every HALF windows.
WIDTH, STRIDE, HALF = 16, 4, 64
OVER = WIDTH // STRIDE - 1
DIM, FILTERS, HIDDEN = 8, 32, 16
PAD = 256


@dataclass
class Net:
    embed: np.ndarray  # 257 x DIM
    conv: np.ndarray  # WIDTH * DIM x FILTERS
    conv_b: np.ndarray
    mid: np.ndarray  # FILTERS x HIDDEN
    mid_b: np.ndarray
    out: np.ndarray  # HIDDEN
    out_b: np.ndarray  # 1

    @classmethod
    def start(cls, rng: np.random.Generator) -> Net:
        f = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        net = cls(f(257, DIM, by=0.7), f(WIDTH * DIM, FILTERS, by=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, by=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, by=0.3), np.zeros(1, np.float32))
        net.embed[PAD] = 0
        return net

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.mid, self.mid_b, self.out, self.out_b]


@dataclass
class Laid:
    """Texts laid out in whole half-chunks of windows, padded; first: each text's first half-chunk."""

    codes: np.ndarray
    first: np.ndarray


def lay_out(raw: np.ndarray, at: np.ndarray) -> Laid:
    """Every byte of every text lies in some window; a text has one half-chunk at least, and at its
    end OVER windows that begin beyond its bytes."""
    sizes = np.diff(at)
    halves = -(-(sizes + STRIDE * OVER) // (STRIDE * HALF))
    first = np.concatenate(([0], np.cumsum(halves)))
    codes = np.full(first[-1] * STRIDE * HALF + WIDTH, PAD, np.int16)
    where = np.arange(len(raw)) + np.repeat(first[:-1] * STRIDE * HALF - at[:-1], sizes)
    codes[where] = raw
    return Laid(codes, first)


def windows(net: Net, laid: Laid, a: int, b: int) -> np.ndarray:
    """Inputs of the filters for half-chunks a to b."""
    codes = laid.codes[a * STRIDE * HALF : b * STRIDE * HALF + WIDTH]
    x = net.embed[codes]
    n = (b - a) * HALF
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4))


def hide_ends(z: np.ndarray, ends: np.ndarray) -> None:
    """Take out the last OVER windows of texts' last half-chunks: they look into the next text."""
    z[ends, HALF - OVER :] = -np.inf


def scores(net: Net, raw: np.ndarray, at: np.ndarray, block: int = 512) -> np.ndarray:
    """One probability per text, over all its bytes."""
    laid = lay_out(raw, at)
    tops = np.empty((laid.first[-1], FILTERS), np.float32)
    ends = laid.first[1:] - 1
    for a in range(0, len(tops), block):
        b = min(a + block, len(tops))
        z = (windows(net, laid, a, b) @ net.conv).reshape(b - a, HALF, FILTERS)
        hide_ends(z, ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a)
        tops[a:b] = z.max(axis=1)
    pooled = np.maximum(tops + net.conv_b, 0)
    chunk = pooled.copy()
    joined = np.ones(len(pooled), bool)
    joined[laid.first[1:] - 1] = False
    at_ = np.flatnonzero(joined)
    chunk[at_] = np.maximum(pooled[at_], pooled[at_ + 1])
    hidden = np.maximum(chunk @ net.mid + net.mid_b, 0)
    best = np.maximum.reduceat(hidden, laid.first[:-1], axis=0)
    return 1 / (1 + np.exp(-(best @ net.out + net.out_b[0]).astype(np.float64)))


def _gradients(net: Net, raw: np.ndarray, at: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    laid = lay_out(raw, at)
    n_half = int(laid.first[-1])
    x = windows(net, laid, 0, n_half)
    z = (x @ net.conv).reshape(n_half, HALF, FILTERS)
    hide_ends(z, laid.first[1:] - 1)
    arg = z.argmax(axis=1)
    top = np.take_along_axis(z, arg[:, None], 1)[:, 0] + net.conv_b
    pooled = np.maximum(top, 0)
    last = np.zeros(n_half, bool)
    last[laid.first[1:] - 1] = True
    nxt = np.where(last, np.arange(n_half), np.minimum(np.arange(n_half) + 1, n_half - 1))
    second = pooled[nxt] > pooled
    chunk = np.where(second, pooled[nxt], pooled)
    pre = chunk @ net.mid + net.mid_b
    hidden = np.maximum(pre, 0)
    doc_of = np.repeat(np.arange(len(at) - 1), np.diff(laid.first))
    best = np.maximum.reduceat(hidden, laid.first[:-1], axis=0)
    logit = best @ net.out + net.out_b[0]
    p = 1 / (1 + np.exp(-logit))
    loss = float(-(weight * np.where(want == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())
    d_logit = (weight * (p - want)).astype(np.float32)
    g_out, g_out_b = best.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_hidden = (hidden == best[doc_of]) * (pre > 0) * (d_logit[doc_of][:, None] * net.out)
    g_mid, g_mid_b = chunk.T @ d_hidden, d_hidden.sum(axis=0)
    d_chunk = d_hidden @ net.mid.T
    d_pool = np.where(second, 0, d_chunk)
    np.add.at(d_pool, nxt, np.where(second, d_chunk, 0))
    d_top = (d_pool * (top > 0)).astype(np.float32)
    g_conv_b = d_top.sum(axis=0)
    half, filt = np.nonzero(d_top)
    row = half * HALF + arg[half, filt]
    g = d_top[half, filt]
    taken = x[row]
    g_conv = np.zeros_like(net.conv)
    order = np.argsort(filt, kind="stable")
    edge = np.searchsorted(filt[order], np.arange(FILTERS + 1))
    for f in range(FILTERS):
        k = order[edge[f] : edge[f + 1]]
        g_conv[:, f] = g[k] @ taken[k]
    d_x = (g[:, None] * net.conv.T[filt]).reshape(-1, DIM)
    codes = laid.codes[(row * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
    g_embed = np.stack([np.bincount(codes, weights=d_x[:, d], minlength=257) for d in range(DIM)], axis=1).astype(np.float32)
    g_embed[PAD] = 0
    return loss, [g_embed, g_conv, g_conv_b, g_mid, g_mid_b, g_out, g_out_b]


def _piece(raw: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    if len(raw) <= STEP_BYTES:
        return raw
    at = int(rng.integers(0, len(raw) - STEP_BYTES + 1))
    return raw[at : at + STEP_BYTES]


def train(texts: list[str], want: list[int], epochs: int = 10, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> Net:
    """Adam over shuffled batches; the classes weigh alike in all, so scores are not tilted to one.

    Without examples of both classes the network can't learn and scores every text by its start.
    """
    rng = np.random.default_rng(seed)
    net = Net.start(rng)
    want_ = np.array(want, np.float32)
    share = want_.mean() if len(want_) else 0.5
    if not 0 < share < 1:
        net.out[:] = 0
        net.out_b[:] = 4.0 if share == 1 else -4.0 if len(want_) else 0.0
        return net
    weight = np.where(want_ == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    m = [np.zeros_like(p) for p in net.params()]
    v = [np.zeros_like(p) for p in net.params()]
    steps, total = 0, epochs * -(-len(raws) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            seen = [_piece(raws[k], rng) for k in pick]
            raw = np.concatenate(seen)
            at = np.concatenate(([0], np.cumsum([len(x) for x in seen])))
            _, grads = _gradients(net, raw, at, want_[pick], weight[pick] / len(pick))
            steps += 1
            now = rate * (1 - 0.9 * steps / total)
            for p, g, a, b in zip(net.params(), grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= now * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)
    return net


def _score(net: Net, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(0))
            out, i = np.empty(len(at) - 1), 0
            while i < len(out):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
                out[i:j] = scores(net, raw[at[i] : at[j]], at[i : j + 1] - at[i])
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    return run


def score_quality(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score (0 to 1, higher: label 1 likelier) and predicted, a row for each row, no shuffle.

    Null texts score as empty ones: all padding, the network's answer to no bytes. Repeated rows
    score alike; an empty table gives an empty result; other columns are neither read nor kept.
    """
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias(id_col))
    return given.mapInArrow(_score(net, threshold), f"`{id_col}` long, score double, predicted int")


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(4, 2), SAMPLE_EACH)
    net = train(sample["text"].tolist(), sample["label"].tolist())
    return score_quality(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
