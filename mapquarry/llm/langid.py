"""Language identification with error-correcting output codes.

Every language gets a codeword. One binary classifier over hashed letter n-grams learns each bit;
decoding sums, over the bits of a codeword, the logistic loss of the bit's margin weighted by how
well that classifier separates its two sides, and takes the codeword of least loss. A text whose
best two codewords are close is flagged ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import sized

#: Labelled rows a language contributes to training, about; they are chosen by a hash of the id.
ROWS_PER_LANGUAGE = 400
#: Languages that are learned, the most frequent ones, and rows of all of them together (16 KB each).
LANGUAGES, ROWS = 1000, 16_000
DIM, ORDERS, UNKNOWN = 4096, (1, 2, 3), "und"
#: A text is ambiguous when its best codeword's share of the top two is under this.
AMBIGUOUS = 0.6
PIECE = 1 << 18

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool))
    return _LETTER[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed n-gram counts, scaled to length 1; None for a text without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table, total, seen = _letters(), np.zeros(DIM), False
    for lo in range(0, len(points), PIECE):
        c = points[max(0, lo - max(ORDERS) + 1) : lo + PIECE]
        inside = table[c]
        seen = seen or bool(inside.any())
        c = np.where(inside, c, 32).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                x = h * np.uint32(2654435761)
                total += np.bincount(x >> np.uint32(20), minlength=DIM)
    if not seen:
        return None
    x = np.sqrt(total)
    return (x / np.linalg.norm(x)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """``k`` words of +-1. Up to 5 classes use every split once; more use far-apart seeded words."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=k - 1) if -1 in s]
        return np.array(splits, dtype=float).T
    bits, rng = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7)
    best = None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(k, bits))
        agree = code @ code.T
        worst = (agree - np.diag(np.diag(agree))).max()
        if (best is None or worst < best[0]) and (np.abs(code.sum(0)) < k).all():
            best = (worst, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index, and its share against the others by softmin of the losses."""
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, margin) * self.trust) @ (self.code < 0).T
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        return loss.argmin(1), share.max(1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 300) -> Model:
    """All bit classifiers at once: logistic loss with a small L2 penalty, Nesterov gradient steps."""
    code = codewords(len(languages))
    bits, n = code[y], len(y)
    # languages weigh alike in every bit
    balance = (1 / np.bincount(y, minlength=len(languages))[y])[:, None] / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    pw, pb, at_w, at_b = w, b, w, b
    rate = 12.0
    for k in range(rounds):
        g = -bits / (1 + np.exp(np.clip(bits * (x @ at_w + at_b), -50, 50))) * balance
        w = at_w - rate * (x.T @ g.astype(np.float32) + 1e-5 * at_w)
        b = at_b - rate * g.sum(0)
        m = k / (k + 3)
        at_w, at_b, pw, pb = w + m * (w - pw), b + m * (b - pb), w, b
    right = ((bits * (x @ w + b) > 0) * balance).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(languages, code, w, b, trust * len(trust) / trust.sum() if n else trust)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], ["lang", "x"])


def train(docs: DataFrame, eligible: Column, per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from ``docs(doc_id, text, lang)`` where ``eligible``; None when there is no such row.

    Rows with a null lang or text teach nothing, nor does a language beyond the LANGUAGES most frequent
    ones (ties by name). Repeated rows and a null doc_id are drawn like others.
    """
    sized(docs.sparkSession)
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    per_language = min(per_language, ROWS // len(counts))
    rates = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    coin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(coin < rates[F.col("lang")]).select("lang", "text").mapInArrow(_vectors, "lang string, x binary")
    got = [(r[0], r[1]) for r in sample.where("x is not null").collect()]
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    got.sort()
    x = np.frombuffer(b"".join(v for _, v in got), dtype=np.float32).reshape(len(got), DIM)
    return fit(x, np.array([languages.index(lang) for lang, _ in got]), languages)


def predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, ambiguous = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, dtype=bool)
            found = [(i, x) for i, t in enumerate(b.column("text").to_pylist()) if model and (x := features(t)) is not None]
            for k in range(0, len(found), 256):
                at = [i for i, _ in found[k : k + 256]]
                best, share = model.decode(np.stack([x for _, x in found[k : k + 256]]))
                for i, j in zip(at, best.tolist(), strict=True):
                    lang[i] = model.languages[j]
                score[at], ambiguous[at] = share, share < AMBIGUOUS
            keep = [b.column(i) for i, name in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(lang), pa.array(score), pa.array(ambiguous)], [*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"]
            )

    return predict


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` columns ``keep`` (all by default) plus lang_pred, lang_score, lang_ambiguous.

    Whole texts are read. A null text, or one without a letter, is ``und`` with score 0 and
    ambiguous; so is every text when there was nothing to learn from. Columns of ``docs`` that
    clash with the three new names, in any case, are dropped. An empty table gives none.
    """
    sized(docs.sparkSession)
    new = ("lang_pred", "lang_score", "lang_ambiguous")
    base = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns) if c.lower() not in new])
    kinds = zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, k) for n, k in kinds]])
    return base.mapInArrow(predictor(model), schema)
