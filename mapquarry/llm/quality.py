"""Quality scores by positive-unlabelled learning.

A linear scorer over surface statistics and hashed character shapes minimises the non-negative
unbiased risk ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: trusted positives, unlabelled texts
and a class prior ``pi`` estimated from these two alone by best bin estimation: above some score held-out
unlabelled rows are nearly all positive, so the ratio of the shares of both kinds there is the prior.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import sized

#: Rows of each kind that training uses, about; they are chosen by a hash of the id.
POSITIVES, UNLABELLED = 3000, 6000
SHAPES = 1024
PIECE = 1 << 18
#: Splits over which the class prior is averaged, rounds in which it is refined, and the error allowed to a bin.
SPLITS, ROUNDS, ERROR = 3, 2, 0.1
#: With fewer rows of a kind a held-out half says too little, and the labelled share of positives is the prior.
HALVED = 40
#: A score of at least this predicts a good text.
THRESHOLD = 0.3

_CLASS: list[np.ndarray] = []
STATS = 24


def _classes() -> np.ndarray:
    """Code point -> 0 space, 1 newline, 2 lower, 3 upper, 4 digit, 5 other letter, else its own shape."""
    if not _CLASS:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(len(table)):
            ch = chr(i)
            table[i] = (
                1 if ch == "\n" else 0 if ch.isspace() else 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isdigit()
                else 5 if ch.isalpha() else 6 + i % 250
            )
        _CLASS.append(table)
    return _CLASS[0]


def features(text: str | None) -> np.ndarray:
    """``STATS`` surface statistics followed by ``SHAPES`` scaled counts of shape trigrams."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table, shapes, kinds = _classes(), np.zeros(SHAPES), np.zeros(256)
    for lo in range(0, len(points), PIECE):
        k = table[points[max(0, lo - 4) : lo + PIECE]]
        # runs of one class count once: word lengths are a statistic of their own
        k = k[np.concatenate([[True], (k[1:] != k[:-1]) | (k[1:] > 5)])]
        if len(k) >= 3:
            h = ((k[:-2] * np.uint32(31) + k[1:-1]) * np.uint32(1009) + k[2:]) * np.uint32(2654435761)
            shapes += np.bincount(h >> np.uint32(22), minlength=SHAPES)
        kinds += np.bincount(table[points[lo : lo + PIECE]], minlength=256)[:256]
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    n, w, chars = len(text) or 1, len(words) or 1, sum(map(len, words)) or 1
    same = [sum(1 for _ in g) for _, g in itertools.groupby(words)]
    repeats = len(words) - len(same)
    line_counts = Counter(line for line in lines if line.strip())
    used = sum(line_counts.values()) or 1
    top = [c for _, c in counts.most_common(5)] + [0] * 5
    other = kinds[6:].sum()
    marks = kinds[6 + ord(".") % 250] + kinds[6 + ord(",") % 250]
    stats = [
        np.log1p(len(words)) / 10, np.log1p(used) / 5, chars / w / 10, kinds[3] / n, kinds[4] / n, other / n, (other - marks) / n,
        kinds[3] / (kinds[2] + kinds[3] + 1), len(counts) / w, repeats / w, top[0] / w, sum(top[:5]) / w, len(line_counts) / used,
        (max(line_counts.values(), default=0) - 1) / used, np.log1p(w / used) / 5, marks / w, kinds[6 + ord("|") % 250] / w,
        sum(x.isupper() for x in words) / w, sum(not x[-1:].isalnum() for x in words) / w, sum(x[:1].isupper() for x in words) / w,
        np.log1p(max(map(len, words), default=0)) / 5, float(not words),
        np.sqrt(repeats / w), np.log1p(max(same, default=0)) / 5,
    ]
    total = shapes.sum() or 1
    return np.concatenate([stats, np.sqrt(shapes / total)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """Of the risk by weights and bias; where the negative risk is below zero, that which ascends it alone."""
    zp, zu = xp @ w + b, xu @ w + b
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    d_neg = np.append(xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp), su.mean() - prior * sp.mean())
    d_pos = prior * np.append(xp.T @ (sp - 1) / len(xp), (sp - 1).mean())
    return d_pos + d_neg if negative >= 0 else -d_neg


def fit(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = 100, seed: int = 5) -> Model:
    """Mini-batch Adam on the non-negative risk with the logistic loss.

    When a batch's negative risk falls below zero, the step ascends it instead (as the published
    estimator does), which keeps the scorer from fitting single unlabelled rows.
    """
    n = len(p) + len(u)
    mean = ((p.sum(0, dtype=float) + u.sum(0, dtype=float)) / n).astype(np.float32)
    scale = (np.sqrt((((p - mean) ** 2).sum(0, dtype=float) + ((u - mean) ** 2).sum(0, dtype=float)) / n) + 0.02).astype(np.float32)
    p, u = (p - mean) / scale, (u - mean) / scale
    rng, w, b = np.random.default_rng(seed), np.zeros(p.shape[1], np.float32), 0.0
    mw = vw = np.zeros(p.shape[1] + 1, np.float32)
    step = 0
    for epoch in range(epochs):
        up = rng.permutation(len(u))
        for k in range(0, len(u), 512):
            xu = u[up[k : k + 512]]
            xp = p[rng.integers(len(p), size=max(1, min(len(p), 512)))]
            g = gradient(xp, xu, w, b, prior)
            g[:-1] += 1e-5 * w
            step += 1
            mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g * g
            move = 0.05 * (1 - epoch / epochs) * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Model(mean, scale, w, float(b), prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Prior from the scores of held-out rows: the ratio of shares above the score where its upper bound is least."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = np.unique(positive)
    p, u = 1 - np.searchsorted(positive, at) / len(positive), 1 - np.searchsorted(unlabelled, at) / len(unlabelled)
    slack = np.sqrt(np.log(4 / ERROR) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.95))


def estimate_prior(p: np.ndarray, u: np.ndarray, first: float = 0.5, epochs: int = 40) -> float:
    """Class prior of ``u``: scorers fitted to one half of the rows judge the other half.

    Each round's prior is that of the next round's risk; the last round's, averaged over splits, counts.
    """
    found = []
    for seed in range(SPLITS):
        rng, prior = np.random.default_rng(seed), first
        for _ in range(ROUNDS):
            a, b = rng.permutation(len(p)), rng.permutation(len(u))
            model = fit(p[a[: len(p) // 2]], u[b[: len(u) // 2]], prior, epochs)
            prior = best_bin(model.score(p[a[len(p) // 2 :]]), model.score(u[b[len(u) // 2 :]]))
        found.append(prior)
    return float(np.mean(found))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["kind", "x"])


def train(docs: DataFrame, labels: DataFrame, eligible: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)`` rows where ``eligible``.

    The prior is estimated from both kinds of rows (``estimate_prior``); under ``HALVED`` rows of a kind it is
    the share of positives among labelled eligible rows. Either is kept within [0.05, 0.95]. None when
    there is no trusted positive.
    """
    sized(docs.sparkSession)
    known = labels.where(eligible & F.col("quality").isNotNull())
    n, good = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not good:
        return None
    coin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    trusted = known.where((F.col("quality") == 1) & (coin < min(1.0, positives / good))).select("doc_id").distinct()
    base = docs.select("doc_id", "text").where(eligible)
    web = base.where(coin < min(1.0, unlabelled / max(1, base.count())))
    rows = (
        base.where(coin < min(1.0, positives / good)).join(trusted, "doc_id", "left_semi").select(F.lit(1).alias("kind"), "text")
        .unionByName(web.select(F.lit(0).alias("kind"), "text"))
    )
    got = sorted((r[0], r[1]) for r in rows.mapInArrow(_vectors, "kind int, x binary").collect())
    x = np.frombuffer(b"".join(v for _, v in got), dtype=np.float32).reshape(len(got), STATS + SHAPES)
    kind = np.array([k for k, _ in got])
    if not (kind == 1).any():
        return None
    p, u = x[kind == 1], x[kind == 0] if (kind == 0).any() else x
    prior = estimate_prior(p, u) if min(len(p), len(u)) >= HALVED else float(np.clip(good / n, 0.05, 0.95))
    return fit(p, u, prior)


def scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [np.zeros(0)]
            for k in range(0, len(texts), 256):
                x = np.stack([features(t) for t in texts[k : k + 256]])
                out.append(model.score(x) if model else np.full(len(x), 0.5))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return score


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, score in [0, 1], predicted.

    Whole texts are read; null counts as empty and empty texts are scored like others. Without
    a model every score is 0.5. Repeated rows are scored each; other columns are ignored.
    """
    sized(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scorer(model), "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
