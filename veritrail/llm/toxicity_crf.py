"""Toxicity: a linear-chain conditional random field over tokens, two states, numpy.

Tokens are runs of ASCII letters and digits and of bytes from 0x80 on. The labels at hand mark
whole documents, so the labelled tokens the field learns from are made of them: a token of a
toxic document is toxic if its kind is met in toxic documents significantly more often than in
others. A document's score comes from its tokens' marginals by a logistic curve, fitted on the
labelled documents, that knows how many tokens there were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.labelled import held_out, labelled_sample
from veritrail.llm.wordarrays import Words, blocks, mix, text_buffer

SAMPLE_EACH = 1500
#: Tokens of one chain; longer texts are several chains, so that a long one takes no more steps.
CHAIN = 256
THRESHOLD = 0.5
BITS = 18
#: What a token is known by: itself and its first bytes, where it has more (stems of insults).
PREFIXES = [5, 6, 7, 8]
#: A kind of token counts as toxic if its log-likelihood ratio between toxic and other sample
#: documents is that high (a kind of 200,000 would reach 25 by chance in 1 of 10 samples) and it is that many times as frequent.
LEAST_RATIO, LEAST_TIMES = 25.0, 6.0
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SPAN = "struct<start: int, end: int, marginal: double>"


@dataclass
class Field:
    """weight: log-odds of the toxic state by token kind (hashed); step: the transitions' log weights.

    curve: weights of document_features() for the logistic score; None: the likeliest token's marginal.
    """

    weight: np.ndarray
    bias: float
    step: np.ndarray  # [from, to]
    curve: np.ndarray | None = None


@dataclass
class Packed:
    """Sequences laid out by position: all first tokens, all second ones, ..., longest sequence first."""

    order: np.ndarray  # token numbers in that layout
    active: np.ndarray  # sequences that have the position
    edge: np.ndarray  # where each position begins


def pack(counts: np.ndarray) -> Packed:
    by = np.argsort(-counts, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)))[:-1][by]
    sizes = counts[by]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    edge = np.concatenate(([0], np.cumsum(active)))
    rank = np.arange(edge[-1]) - np.repeat(edge[:-1], active)
    order = first[rank] + np.repeat(np.arange(longest), active)
    return Packed(order, active, edge)


def marginals(e: np.ndarray, p: Packed, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for all sequences at once, position by position.

    e: log-odds of the toxic state per packed token. Gives each token's marginal and, summed over
    all neighbours, the expected counts of the four transitions.
    """
    n, longest = len(e), len(p.active)
    odds = np.exp(np.clip(e, -30, 30))
    t = np.exp(step)
    fwd = np.empty((n, 2))
    for k in range(longest):
        a, b, m = p.edge[k], p.edge[k + 1], p.active[k]
        if k == 0:
            x0, x1 = np.ones(m), odds[a:b]
        else:
            q = fwd[p.edge[k - 1] : p.edge[k - 1] + m]
            x0 = q[:, 0] * t[0, 0] + q[:, 1] * t[1, 0]
            x1 = (q[:, 0] * t[0, 1] + q[:, 1] * t[1, 1]) * odds[a:b]
        s = x0 + x1
        fwd[a:b, 0] = x0 / s
        fwd[a:b, 1] = x1 / s
    out = np.empty(n)
    pairs = np.zeros((2, 2))
    back = np.ones((p.active[0] if longest else 0, 2))
    for k in range(longest - 1, -1, -1):
        a, b, m = p.edge[k], p.edge[k + 1], p.active[k]
        post = fwd[a:b] * back[:m]
        out[a:b] = post[:, 1] / post.sum(axis=1)
        if k:
            y1 = odds[a:b] * back[:m, 1]
            y0 = back[:m, 0]
            q = fwd[p.edge[k - 1] : p.edge[k - 1] + m]
            joint = np.stack([q[:, 0] * t[0, 0] * y0, q[:, 0] * t[0, 1] * y1, q[:, 1] * t[1, 0] * y0, q[:, 1] * t[1, 1] * y1])
            pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            x0, x1 = t[0, 0] * y0 + t[0, 1] * y1, t[1, 0] * y0 + t[1, 1] * y1
            s = x0 + x1
            back[:m, 0] = x0 / s
            back[:m, 1] = x1 / s
    return out, pairs


def chains(counts: np.ndarray) -> np.ndarray:
    """Token counts of the chains that texts of counts tokens are cut into, in order."""
    full, rest = counts // CHAIN, counts % CHAIN
    n = full + (rest > 0)
    out = np.full(int(n.sum()), CHAIN, np.int64)
    last = np.cumsum(n) - 1
    some = rest > 0
    out[last[some]] = rest[some]
    return out


def kinds(w: Words) -> np.ndarray:
    """For each token its kinds, hashed to BITS bits; kind 0 is none."""
    hashed = w.prefix_hashes(PREFIXES)
    return np.stack([np.where(h > 0, (h >> np.uint64(64 - BITS)) | np.uint64(1), 0) for h in hashed], axis=1).astype(np.int32)


def log_odds(field: Field, kind: np.ndarray) -> np.ndarray:
    e = np.full(len(kind), field.bias)
    for c in range(kind.shape[1]):
        e += field.weight[kind[:, c]]
    return e


def token_labels(kind: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents are of a kind that marks them.

    Near copies mostly share the least hash of all their runs of three tokens (MinHash), and a kind
    is counted once for each least hash, so that a copied document doesn't make its words look common.
    """
    least = np.full(len(toxic), (1 << 62), np.int64)
    k = mix(kind[:, 0].astype(np.uint64))
    if len(k) > 2:
        runs = mix(k[:-2] ^ mix(k[1:-1] ^ mix(k[2:])))
        inside = doc[2:] == doc[:-2]
        np.minimum.at(least, doc[2:][inside], runs[inside].view(np.int64) >> 1)
    group = np.unique(least, return_inverse=True)[1][doc]
    bad_token = toxic[doc] == 1
    out = np.zeros(len(kind), bool)
    n_bad, n_good = max(len(np.unique(least[toxic == 1])), 1), max(len(np.unique(least[toxic == 0])), 1)
    for c in range(kind.shape[1]):
        # kind, group and class in one number
        own = np.unique((kind[:, c].astype(np.int64) * len(toxic) + group) * 2 + bad_token)
        bad, of = own % 2 == 1, own // 2 // len(toxic)
        in_bad, in_good = np.bincount(of[bad], minlength=1 << BITS), np.bincount(of[~bad], minlength=1 << BITS)
        marks = (likelihood_ratio(in_bad, in_good, n_bad, n_good) >= LEAST_RATIO) & (in_bad / n_bad > LEAST_TIMES * (in_good + 0.5) / n_good)
        marks[0] = False
        out |= marks[kind[:, c]]
    return out & bad_token


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Twice the log-likelihood ratio (G) of a of n_a against b of n_b: 0 where the shares are equal."""
    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * p)), 0) + np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - p))), 0)

    p = (a + b) / (n_a + n_b)
    return 2 * (part(np.minimum(a, n_a), n_a, p) + part(np.minimum(b, n_b), n_b, p))


def document_features(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, from its tokens' marginals m: 1, the expected toxic tokens, their share, the likeliest one."""
    n = len(first) - 1
    sums = np.concatenate(([0], np.cumsum(m)))
    total, counts = sums[first[1:]] - sums[first[:-1]], np.diff(first)
    top = np.zeros(n)
    full = np.flatnonzero(counts)
    if len(full):
        top[full] = np.maximum.reduceat(m, first[:-1][full])
    return np.stack([np.ones(n), np.log1p(total), np.log1p(1000 * total / np.maximum(counts, 1)), top], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's steps; the penalty spares the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def token_marginals(field: Field, kind: np.ndarray, counts: np.ndarray) -> np.ndarray:
    p = pack(chains(counts))
    got, _ = marginals(log_odds(field, kind)[p.order], p, field.step)
    m = np.empty(len(got))
    m[p.order] = got
    return m


def train(texts: list[str], toxic: list[int], rounds: int = 8, rate: float = 1.5, penalty: float = 1e-3) -> Field:
    """Maximum likelihood of the token labels by AdaGrad over whole sequences in a few large batches.

    The gradient is observed minus expected counts, the latter from forward-backward. Without
    labelled toxic tokens the field is all clean.
    """
    field = Field(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)))
    if not texts or not any(toxic):
        field.bias = -12.0
        return field
    # by blocks, since hashing takes several numbers for each byte
    read = [Words.of(raw, at, BREAK) for _, _, raw, at in blocks(pa.array(texts, pa.string()), 1 << 20)]
    kind, sizes = np.concatenate([kinds(w) for w in read]), np.concatenate([w.counts for w in read])
    del read
    tag = token_labels(kind, np.repeat(np.arange(len(sizes)), sizes), np.array(toxic)).astype(np.int8)
    counts = chains(sizes)
    first = np.concatenate(([0], np.cumsum(counts)))
    groups = np.array_split(np.random.default_rng(3).permutation(len(counts)), max(1, len(counts) // 2000))
    parts = []
    for g in groups:
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in g] or [np.zeros(0, np.int64)])
        p = pack(counts[g])
        y = tag[rows]
        same = np.ones(len(rows), bool)
        same[np.concatenate(([0], np.cumsum(counts[g])))[:-1]] = False
        inner = np.flatnonzero(same)
        seen = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
        parts.append((kind[rows][p.order], y[p.order], p, seen))
    g_w, g_b, g_s = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(rounds):
        for k, y, p, seen in parts:
            m, pairs = marginals(log_odds(field, k), p, field.step)
            d = -penalty * field.weight
            for c in range(k.shape[1]):
                d += np.bincount(k[:, c], weights=y - m, minlength=1 << BITS)
            d[0] = 0
            db, ds = (y - m).sum(), seen - pairs
            g_w += d * d
            g_b += db * db
            g_s += ds * ds
            field.weight += rate * d / np.sqrt(g_w)
            field.bias += 0.5 * db / np.sqrt(g_b)
            field.step += 0.3 * ds / np.sqrt(g_s)
    m = token_marginals(field, kind, sizes)
    field.curve = fit_curve(document_features(m, np.concatenate(([0], np.cumsum(sizes)))), np.array(toxic, float))
    return field


def _tag(field: Field, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            score, spans = [], []
            raw_all, at_all = text_buffer(texts)
            i, n = 0, len(texts)
            while i < n:
                # many texts at once: a position is one step for all of them
                j = max(i + 1, int(np.searchsorted(at_all, at_all[i] + (2 << 20), "right")) - 1)
                raw, at = raw_all[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                w = Words.of(raw, at, BREAK)
                m = token_marginals(field, kinds(w), w.counts)
                tagged = m >= threshold
                x = document_features(m, w.first)
                some = x[:, 1] > 0
                score += np.where(some, 1 / (1 + np.exp(-np.clip(x @ field.curve, -30, 30))) if field.curve is not None else x[:, 3], 0.0).tolist()
                leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                of = w.doc()
                found: list[list] = [[] for _ in range(j - i)]
                for t in np.flatnonzero(tagged):
                    d, base = of[t], leads[at[of[t]]]
                    found[d].append({"start": int(leads[w.start[t]] - base), "end": int(leads[w.end[t]] - base), "marginal": float(m[t])})
                spans += found
                i = j
            form = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(spans, form)], [*batch.schema.names[1:], "score", "predicted", "spans"])

    return run


def tag_toxic(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score (0 to 1), predicted and spans (start, end in characters, marginal) of toxic tokens.

    A row for each row, whole texts, no shuffle; texts of more than CHAIN tokens are several chains.
    Null texts, and texts without tokens, score 0 and have no spans. Repeated rows score alike; an empty table gives an empty result; other columns
    are neither read nor kept.
    """
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias(id_col))
    return given.mapInArrow(_tag(field, threshold), f"`{id_col}` long, score double, predicted int, spans array<{SPAN}>")


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(5, 0), SAMPLE_EACH)
    field = train(sample["text"].tolist(), sample["label"].tolist())
    done = tag_toxic(docs, field)
    flat = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", flat.alias("spans"))
