"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

With x the tf-weighted hashed words, statistics and metadata of a text, the
machine reads w0 + w.x + sum over pairs <v_i, v_j> x_i x_j; the pair sum is
computed in linear time as half of (sum v x)^2 - sum (v x)^2 per factor.  It is
trained by AdaGrad on at most ``MAX_ROWS`` labelled rows of at most
``MAX_CHARS`` characters.  Metadata is the column ``n_chars`` (absent, null or
negative: the text's own length).

Defined cases: a text that is null or has no character but white space scores
0; rows with a null label are not learned from; without rows of both labels
every other text scores the share of label 1 (0 without rows); rows are scored
one by one, so repeated ids and texts repeat; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from rankaudit.llm.labelled import in_fold, labelled_sample
from rankaudit.llm.scoring import scored
from rankaudit.llm.subwords import REMEMBER, platt

MAX_ROWS = 8_000
MAX_CHARS = 20_000
THRESHOLD = 0.7
BUCKETS = 1 << 16
TOKEN = re.compile(r"\w+|[^\w\s]+")
STATISTICS = 11


class TokenBuckets(dict):
    """token -> hash bucket, remembered."""

    def __missing__(self, token: str) -> int:
        bucket = self[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        return bucket


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 mark, 5 blank, 6 line end
    for b in range(128):
        c = chr(b)
        kind[b] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 6 if c == "\n" else 5 if c.isspace() else 4
    return kind


KINDS = _kinds()


def statistics(text: str, buckets: np.ndarray, n_chars: int | None) -> list[float]:
    """Structure statistics and metadata of one text, each about 0 to 1."""
    n = np.bincount(KINDS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
    total, tokens = max(1, int(n.sum())), max(1, len(buckets))
    sizes = np.unique(buckets, return_counts=True)[1] if len(buckets) else np.array([0])
    lines = text.split("\n")
    return [
        n[1] / max(1, n[1] + n[2]), n[3] / total, n[4] / total, (n[5] + n[6]) / total, n[0] / total,
        len(sizes) / tokens, sizes.max() / tokens,
        1 - len(set(lines)) / len(lines), min(1.0, total / tokens / 20),
        np.log1p(total / len(lines)) / 10, np.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text)) / 15,
    ]


def features(texts: list[str], n_chars: list[int | None], memo: TokenBuckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the texts, each feature of a row once."""
    found = [np.fromiter((memo[t] for t in TOKEN.findall(text.lower())), np.int64) for text in texts]
    counts = np.array([len(b) for b in found])
    key = np.repeat(np.arange(len(texts)), counts) * BUCKETS + (np.concatenate(found) if found else np.zeros(0, np.int64))
    key, times = np.unique(key, return_counts=True)
    row = key // BUCKETS
    value = np.sqrt(times / counts[row])
    stats = np.array([statistics(t, b, c) for t, b, c in zip(texts, found, n_chars, strict=True)]).reshape(len(texts), STATISTICS)
    return (
        np.concatenate([row, np.repeat(np.arange(len(texts)), STATISTICS)]),
        np.concatenate([key % BUCKETS, np.tile(BUCKETS + np.arange(STATISTICS), len(texts))]),
        np.concatenate([value, stats.ravel()]),
    )


class FactorisationMachine:
    def __init__(self, size: int, factors: int = 6, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.zeros(1), np.zeros(size), rng.normal(0, 0.05, (size, factors))
        self.slope, self.offset = 1.0, 0.0
        self.rng = rng

    def _sums(self, row, feature, value, rows):
        vx = self.v[feature] * value[:, None]
        return vx, np.stack([np.bincount(row, c, minlength=rows) for c in vx.T], 1)

    def margin(self, row, feature, value, rows) -> np.ndarray:
        vx, s = self._sums(row, feature, value, rows)
        own = np.bincount(row, (vx * vx).sum(1), minlength=rows)
        return self.w0[0] + np.bincount(row, self.w[feature] * value, minlength=rows) + ((s * s).sum(1) - own) / 2

    def fit(self, row, feature, value, y, steps: int = 600, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> "FactorisationMachine":
        ends = np.searchsorted(row, np.arange(len(y) + 1))
        squares = [np.full_like(p, 1e-6) for p in (self.w0, self.w, self.v)]
        for _ in range(max(1, steps * batch // len(y))):
            for part in np.array_split(self.rng.permutation(len(y)), max(1, len(y) // batch)):
                at = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in part])
                r = np.repeat(np.arange(len(part)), ends[part + 1] - ends[part])
                f, x = feature[at], value[at]
                p = 1 / (1 + np.exp(-np.clip(self.margin(r, f, x, len(part)), -30, 30)))
                g = (p - y[part]) / len(part)
                vx, s = self._sums(r, f, x, len(part))
                used, to = np.unique(f, return_inverse=True)
                g_w = np.bincount(to, g[r] * x) + decay * self.w[used]
                pair = (g[r] * x)[:, None] * (s[r] - vx)
                g_v = np.stack([np.bincount(to, c) for c in pair.T], 1) + decay * self.v[used]
                for param, sq, grad, i in zip((self.w0, self.w, self.v), squares, (g.sum(), g_w, g_v), (slice(None), used, used), strict=True):
                    sq[i] += grad * grad
                    param[i] -= rate * grad / np.sqrt(sq[i])
        return self


def _sorted(row, feature, value):
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


def train(texts: list[str], labels: list[int]) -> FactorisationMachine | float:
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.0
    back = np.arange(len(y)) % 7 == 6
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), bool)
    memo = TokenBuckets()
    part = [t for t, b in zip(texts, back, strict=True) if not b]
    model = FactorisationMachine(BUCKETS + STATISTICS).fit(*_sorted(*features(part, [None] * len(part), memo)), y[~back])
    held = back if back.any() else ~back
    part = [t for t, b in zip(texts, held, strict=True) if b]
    model.slope, model.offset = platt(model.margin(*features(part, [None] * len(part), memo), len(part)), y[held], ridge=0.1)
    return model


def scorer(model: FactorisationMachine | float, text_col: str, meta_col: str | None):
    memo = TokenBuckets()

    def score(rows: pa.RecordBatch) -> dict[str, list]:
        texts = [t or "" for t in rows.column(text_col).to_pylist()]
        if len(memo) > REMEMBER:
            memo.clear()
        if isinstance(model, float):
            p = np.full(len(texts), model)
        else:
            meta = rows.column(meta_col).to_pylist() if meta_col else [None] * len(texts)
            margin = model.slope * model.margin(*features(texts, meta, memo), len(texts)) + model.offset
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return {"score": [float(v) if t.strip() else 0.0 for v, t in zip(p, texts, strict=True)]}

    return score


def quality_model(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | float:
    """Learned from the rows of ``labels`` (doc_id, quality) outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "quality", in_fold("doc_id", 4, 2), MAX_ROWS, MAX_CHARS))


def score_quality(docs: DataFrame, model: FactorisationMachine | float, text_col: str = "text", meta_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, and ``score``."""
    return scored(docs, text_col, partial(scorer, model, text_col, meta_col), [StructField("score", DoubleType())])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    meta = "n_chars" if "n_chars" in docs.columns else None
    rows = docs.select("doc_id", "text", *([F.col(meta).cast("long").alias(meta)] if meta else []))
    out = score_quality(rows, quality_model(docs, labels), meta_col=meta)
    return out.select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
