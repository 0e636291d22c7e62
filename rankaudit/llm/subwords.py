"""Hashed subword embeddings averaged into a linear softmax, in numpy.

A word's vector is the mean of the embeddings of its character n-grams and of
the whole word; a segment's vector is the mean of its words' vectors; a linear
softmax reads the segment.  Embeddings and softmax are trained jointly by
AdaGrad.  Because every step up to the softmax is a mean, a trained model folds
into one row of logits per n-gram bucket.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"\w+")
#: Words a scoring task remembers before it starts afresh.
REMEMBER = 200_000


def ngram_buckets(words: list[str], buckets: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every byte n-gram of ``<word>`` and of the whole word."""
    coded = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    room = ends[owner] - np.arange(len(data))  # bytes left in the word, this one included
    found, owners = [], []
    prime = np.uint64(0x100000001B3)

    def bucket(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        return (h % np.uint64(buckets)).astype(np.int32)

    for n in sizes:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * prime + data[k : len(data) - n + 1 + k]
        fits = room[: len(h)] >= n
        found.append(bucket(h[fits]))
        owners.append(owner[: len(h)][fits])
    place = (np.arange(len(data)) - (ends - lengths)[owner]).astype(np.uint64)
    whole = np.zeros(len(coded), np.uint64)
    if len(data):
        whole = np.add.reduceat((data + 1) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3), ends - lengths)
    return np.concatenate([*found, bucket(whole)]), np.concatenate([*owners, np.arange(len(coded), dtype=np.int32)])


class WordIndex:
    """Numbers words; ``fresh`` yields those added since the last call."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.seen = 0

    def number(self, text: str | None) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in WORD.findall((text or "").lower())), np.int32)

    def fresh(self) -> list[str]:
        new = list(self.ids)[self.seen :]
        self.seen = len(self.ids)
        return new


def segments(counts: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(segment of every word, document of every segment) for documents of
    ``counts`` words: windows of ``window`` words, or one segment per document."""
    if window is None:
        return np.repeat(np.arange(len(counts)), counts), np.arange(len(counts))
    per_doc = np.maximum(1, -(-counts // window))
    first = np.cumsum(per_doc) - per_doc
    start = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(start, counts)
    return np.repeat(first, counts) + place // window, np.repeat(np.arange(len(counts)), per_doc)


def _mean_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(group, minlength=n), 1)
    return np.stack([np.bincount(group, v, minlength=n) for v in values.T], axis=1) / size[:, None]


class SubwordSoftmax:
    """The model.  ``logits[bucket]`` and ``bias`` score; ``fit`` learns them."""

    def __init__(self, classes: int, buckets: int = 1 << 17, dim: int = 8, window: int | None = None, seed: int = 7) -> None:
        self.classes, self.buckets, self.window = classes, buckets, window
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (buckets, dim))
        self.out = rng.normal(0, 0.1, (dim, classes))
        self.bias = np.zeros(classes)
        self.logits = np.zeros((buckets, classes))
        self.slope, self.offset = 1.0, 0.0
        self.rng = rng

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 250, refine: int = 0, batch: int = 64, rate: float = 0.1) -> "SubwordSoftmax":
        """About ``steps`` gradient steps on every segment, then ``refine`` steps that
        train, of each document, only the segment its score rests on (two classes:
        the one with the highest class-1 margin)."""
        per_epoch = max(1, -(-len(texts) // batch))
        epochs, refine = -(-steps // per_epoch), -(-refine // per_epoch)
        index = WordIndex()
        docs = [index.number(t) for t in texts]
        bucket, per_word = self._by_word(index)
        at = np.cumsum(per_word) - per_word
        sums = [np.full_like(p, 1e-8) for p in (self.embed, self.out, self.bias)]
        for epoch in range(epochs + refine):
            shuffled = self.rng.permutation(len(docs))
            for lo in range(0, len(docs), batch):
                chosen = [d for d in shuffled[lo : lo + batch] if len(docs[d])]
                if not chosen:
                    continue
                words, word_at = np.unique(np.concatenate([docs[d] for d in chosen]), return_inverse=True)
                grams = per_word[words]
                take = np.repeat(at[words] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
                of_word = np.repeat(np.arange(len(words)), grams)
                seg, doc = segments(np.array([len(docs[d]) for d in chosen]), self.window)
                rows, row_at = np.unique(bucket[take], return_inverse=True)
                vecs = self.embed[rows]
                word_logit = _mean_by(of_word, (vecs @ self.out)[row_at], len(words))
                z = _mean_by(seg, word_logit[word_at], len(doc)) + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                grad = p - np.eye(self.classes)[labels[chosen][doc]]
                if epoch >= epochs:
                    margin = z[:, 1] - z[:, 0]
                    best = np.lexsort((margin, doc))
                    keep = best[np.append(np.flatnonzero(np.diff(doc[best])), len(best) - 1)]
                    kept = np.zeros(len(doc), bool)
                    kept[keep] = True
                    grad[~kept] = 0
                    grad /= len(chosen)
                else:
                    grad /= np.bincount(doc)[doc][:, None] * len(chosen)
                seg_size = np.maximum(np.bincount(seg, minlength=len(doc)), 1)
                g_word = (grad / seg_size[:, None])[seg]
                g_word = np.stack([np.bincount(word_at, g, minlength=len(words)) for g in g_word.T], 1) / grams[:, None]
                g_row = np.stack([np.bincount(row_at, g, minlength=len(rows)) for g in g_word[of_word].T], 1)
                steps = (g_row @ self.out.T, vecs.T @ g_row, grad.sum(0))
                for p_, s, g, i in zip((self.embed, self.out, self.bias), sums, steps, (rows, slice(None), slice(None)), strict=True):
                    s[i] += g * g
                    p_[i] -= rate * g / np.sqrt(s[i])
        self.logits = self.embed @ self.out
        return self

    def _by_word(self, index: WordIndex, part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all words' n-grams, word after word; their number per word), some words at a time."""
        words = index.fresh()
        found, sizes = [], []
        for lo in range(0, len(words), part):
            bucket, owner = ngram_buckets(words[lo : lo + part], self.buckets)
            found.append(bucket[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner))
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *found]), np.concatenate([none, *sizes])

    def document_logits(self, texts: list[str | None], index: WordIndex, memory: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logits of each document's deciding segment, its word count).  ``index``
        and ``memory`` carry word logits from call to call within a task."""
        docs = [index.number(t) for t in texts]
        fresh = index.fresh()
        if fresh:
            bucket, owner = ngram_buckets(fresh, self.buckets)
            new = _mean_by(owner, self.logits[bucket], len(fresh))
            memory[:] = [np.concatenate([*memory, new])]
        counts = np.array([len(d) for d in docs], np.int64)
        if not counts.sum():
            return np.tile(self.bias, (len(docs), 1)), counts
        seg, doc = segments(counts, self.window)
        z = _mean_by(seg, memory[0][np.concatenate(docs)], len(doc)) + self.bias
        if self.window is not None:
            best = np.lexsort((z[:, 1] - z[:, 0], doc))
            z = z[best[np.append(np.flatnonzero(np.diff(doc[best])), len(best) - 1)]]
        return z, counts



def platt(margin: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of ``label`` on ``margin``, by Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - label) + ridge * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])
