"""Hashed word shingles of texts, vectorised over bytes.

Words are the runs of bytes other than blank and 0x09-0x0D of the text with A-Z
lower-cased.  A shingle is the hash of ``size`` consecutive words; a text with
fewer words has its whole sequence as the only one.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # bytes hashed at once
PRIME = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))  # a random number for every byte
FORWARD = _powers(PRIME, 4096)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``."""
    a = np.frombuffer(data, np.uint8)
    blank = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    # sum of byte * PRIME^(place in the word)
    longest = int((end - start).max())
    forward = FORWARD if longest <= len(FORWARD) else _powers(PRIME, longest)
    spans = np.diff(np.append(start, len(a)))  # each word with the white space after it
    offset = np.arange(start[0], len(a)) - np.repeat(start, spans)
    value = np.zeros(len(a), np.uint64)
    value[start[0] :] = BYTES[a[start[0] :]] * forward[np.minimum(offset, longest - 1)]
    value[blank] = 0
    total = np.add.reduceat(value, start)
    return mixed(total + (end - start).astype(np.uint64) * np.uint64(PRIME)), start


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts end to end, number of words of each text)."""
    coded = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    if sum(map(len, coded)) <= PIECE:
        joined = b"\n".join(coded)
        h, start = word_hashes(joined)
        ends = np.cumsum([len(c) + 1 for c in coded])
        return h, np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(coded))
    hashes, counts = [], []
    for c in coded:
        n = 0
        lo = 0
        while lo < len(c):  # a long text in pieces that end at white space
            hi = lo + PIECE
            while hi < len(c) and c[hi] not in b" \t\n\x0b\x0c\r":
                hi += 1
            h = word_hashes(c[lo:hi])[0]
            hashes.append(h)
            n += len(h)
            lo = hi
        counts.append(n)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; empty without words."""
    h, counts = words_of(texts)
    ends = np.cumsum(counts)
    odd = np.array([pow(PRIME, k + 2, 1 << 64) for k in range(size)], np.uint64)
    n = len(h) - size + 1
    every = np.zeros(0, np.uint64)
    if n > 0:
        every = h[:n] * odd[0]
        for k in range(1, size):
            every += h[k : n + k] * odd[k]
        every = mixed(every)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        lo = end - count
        if count >= size:
            out.append(np.unique(every[lo : end - size + 1]))
        elif count:
            short = (h[lo:end] * odd[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
