"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pieces of an Arrow slice of many texts are numbered once, and all that were not
seen before are merged together.

Both kinds of pieces are merged over an inverted index from the rank of a token pair to
the positions where it stands, lowest ranks first.  A merge updates its position and
the two neighbours it touches and enters the pairs that these now form; what it
outdates is passed over when its turn comes.  A pair that opens below the present rank
takes the replay back there, so every piece is merged exactly as if alone.
Pieces up to ``SHORT`` bytes (nearly all) are merged side by side in numpy: the index has
one entry for 2**``RANGE_BITS`` ranks, and a turn at the lowest range that holds anything
applies to every piece with a pair in it that piece's lowest, leftmost one.  A long piece
would make turns of one merge each, so long pieces go rank by rank through an index of
Python lists; the cost does not grow with the square of the length.  A piece that
is itself a token is not merged.

Ids are ranks.  The rank file is read once by the driver and travels with the
tasks (its size is the vocabulary's); a task remembers at most ``REMEMBER``
pieces.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
are encoded one by one, so repeated ids and texts repeat; an empty table gives
an empty result; all other columns are kept as they are.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from rankaudit.llm.scoring import scored

REMEMBER = 120_000
SHORT = 48
RANGE_BITS = 10  # the index of short pieces has one entry for so many ranks (a power of two)
#: Below it, letters and numbers have long been settled.
LOWEST_EXCEPTION = "\u0500"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


NONE = np.iinfo(np.int64).max
POSITION = 0xFFFFFFFF


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: (left token, right token) -> rank of the token they merge into
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.key_ranks = np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[order], -1)

    def _index_keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of the pairs as one number each, NONE where no token results."""
        key = (a << 32) | b
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, (self.key_ranks[i] << 32) | at, NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of every piece, all ids end to end)."""
        whole = [(n, self.ranks[p]) for n, p in enumerate(pieces) if p in self.ranks]
        rest = [n for n, p in enumerate(pieces) if p not in self.ranks]
        short = [n for n in rest if len(pieces[n]) <= SHORT]
        long = [n for n in rest if len(pieces[n]) > SHORT]
        sizes, ids = self.replay([pieces[n] for n in short])
        lists = self.heap([pieces[n] for n in long])
        owner = np.concatenate([
            np.array([n for n, _ in whole], np.int64), np.repeat(np.array(short, np.int64), sizes),
            np.repeat(np.array(long, np.int64), [len(x) for x in lists]),
        ])
        flat = np.concatenate([np.array([r for _, r in whole], np.int64), ids, *[np.array(x, np.int64) for x in lists]])
        return np.bincount(owner, minlength=len(pieces)), flat[np.argsort(owner, kind="stable")].astype(np.int32)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of every piece, all ids end to end), by an inverted index from
        ranges of ranks to the positions where such pairs stand."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = np.append(self.singles[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        n = len(symbol) - 1  # stands for "no neighbour"
        ends = np.cumsum(sizes)
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[ends - 1] = n
        left[ends - sizes] = n
        alive = np.ones(n, bool)
        piece_of = np.repeat(np.arange(len(pieces)), sizes)
        lowest = np.full(len(pieces), NONE)
        standing = np.full(n + 1, NONE)  # the pair at a position, as in the index; an entry that differs is out of date
        index: list[list[np.ndarray]] = [[] for _ in range((int(self.key_ranks.max()) >> RANGE_BITS) + 1)]

        def stand(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            standing[i] = self._index_keys(symbol[i], symbol[j], i)
            return standing[i][standing[i] < NONE]

        def enter(keys: np.ndarray, ranges: np.ndarray) -> None:
            order = np.argsort(ranges.astype(np.int16), kind="stable")
            keys, ranges = keys[order], ranges[order]
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for part in np.split(keys, cuts) if len(keys) else []:
                index[int(part[0]) >> (32 + RANGE_BITS)].append(part)

        at = np.flatnonzero(right[:n] < n)
        keys = stand(at, at + 1)
        enter(keys, keys >> (32 + RANGE_BITS))
        now = 0
        while now < len(index):
            if not index[now]:
                now += 1
                continue
            keys = np.concatenate(index[now])
            index[now] = []
            keys = keys[standing[keys & POSITION] == keys]
            piece = piece_of[keys & POSITION]
            np.minimum.at(lowest, piece, keys)
            first = lowest[piece] == keys  # a piece's lowest rank, leftmost place
            lowest[piece] = NONE
            if not first.all():
                index[now].append(keys[~first])
            keys = keys[first]
            i = keys & POSITION
            j = right[i]
            k, h = right[j], left[i]
            symbol[i] = keys >> 32
            alive[j] = False
            right[i], left[k] = k, i
            standing[j] = standing[i] = NONE
            before, after = h < n, k < n
            keys = np.concatenate([stand(h[before], i[before]), stand(i[after], k[after])])
            ranges = keys >> (32 + RANGE_BITS)
            enter(keys, ranges)
            now = min(now, int(ranges.min(initial=now)))
        return np.add.reduceat(alive.astype(np.int64), ends - sizes), symbol[:n][alive]

    def heap(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        pairs, singles = self.pairs, self.singles.tolist()
        symbol: list[int] = []
        starts: list[tuple[int, int]] = []  # (piece, first symbol)
        index: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            at = len(symbol)
            starts.append((n, at))
            last = -1
            for i, byte in enumerate(piece, at):
                s = singles[byte]
                if last >= 0:
                    r = pairs.get((last, s))
                    if r is not None:
                        index.setdefault(r, []).append(i - 1)
                symbol.append(s)
                last = s
            symbol.append(-1)  # ends the piece
        right = list(range(1, len(symbol) + 1))
        left = list(range(-1, len(symbol) - 1))
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            back_to = -1  # places up to here wait for a lower rank in their piece
            for i in places:
                if i < back_to:
                    index.setdefault(rank, []).append(i)
                    continue
                a = symbol[i]
                j = right[i]
                b = symbol[j] if a >= 0 else -1
                if b < 0 or pairs.get((a, b)) != rank:
                    continue
                k = right[j]
                symbol[i] = rank
                symbol[j] = -2
                right[i] = k
                left[k] = i
                lower = False
                h = left[i]
                for at, x, y in ((h, symbol[h] if h >= 0 else -1, rank), (i, rank, symbol[k])):
                    r = pairs.get((x, y))
                    if r is not None:
                        if r not in index:
                            index[r] = []
                            heappush(heap, r)
                        index[r].append(at)
                        lower = lower or r < rank
                if lower:
                    end = k
                    while symbol[end] != -1:
                        end = right[end]
                    back_to = end
            if rank in index:
                heappush(heap, rank)
        for n, at in starts:
            ids = []
            i = at
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = right[i]
            out[n] = ids
        return out


class Numbering(dict):
    """Numbers keys as they are first looked up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class PieceTable:
    """Pieces numbered as they come, with their ids laid end to end."""

    def __init__(self) -> None:
        self.number = Numbering()
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        return end_to_end(self.ids, self.start[numbers], self.size[numbers])


def class_exceptions(name: str) -> str:
    """Code points on which the splitter's class ``name`` and tiktoken's differ
    (their Unicode versions do), as the inside of a character class."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one_class = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    theirs = set(bytes(one_class.encode_ordinary(every)).decode("utf-8"))
    ours = set(regex.findall(name, every))
    assert theirs <= ours, "the splitter knows every letter and number that tiktoken knows"
    points = sorted(map(ord, ours - theirs))
    first = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    last = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    assert not points or points[0] >= ord(LOWEST_EXCEPTION)
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(first, last, strict=True))


@lru_cache(maxsize=1)
def splitting(pattern: str) -> tuple[str, str]:
    """(pattern that splits as tiktoken does where a text holds a code point of the
    second pattern, that second pattern)."""
    found = {name: class_exceptions(name) for name in (r"\p{L}", r"\p{N}")}
    exact = pattern
    for name, points in found.items():
        if points:
            exact = exact.replace(name, f"[{name}--[{points}]]")
    return exact, f"[{''.join(found.values())}]" if any(found.values()) else r"(?!)"


@lru_cache(maxsize=1)
def _replay(rank_data: bytes) -> MergeReplay:
    return MergeReplay(parse_ranks(rank_data))


def encoder(rank_data: bytes, pattern: str, exceptions: tuple[str, str], text_col: str):
    replay, usual = _replay(rank_data), regex.compile(pattern)
    exact, odd = regex.compile(exceptions[0], regex.V1), regex.compile(exceptions[1])
    table = PieceTable()

    def split(text: str) -> list[str]:
        plain = text.isascii() or max(text) < LOWEST_EXCEPTION or not odd.search(text)
        return (usual if plain else exact).findall(text)

    def encode(rows: pa.RecordBatch) -> dict[str, pa.Array]:
        nonlocal table
        if len(table.number) > REMEMBER:
            table = PieceTable()
        number, known = table.number, len(table.number)
        docs = [list(map(number.__getitem__, split(text or ""))) for text in rows.column(text_col).to_pylist()]
        table.add(*replay.encode([p.encode("utf-8") for p in list(number)[known:]]))
        numbers = np.fromiter(chain.from_iterable(docs), np.int64, sum(map(len, docs)))
        upto = np.concatenate([[0], np.cumsum(table.size[numbers])])
        offsets = upto[np.cumsum([0, *map(len, docs)])].astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ids_of(numbers)))}

    return encode


def end_to_end(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(start - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decoder(rank_data: bytes, ids_col: str):
    tokens = parse_ranks(rank_data)
    sizes = np.zeros(max(tokens.values()) + 1, np.int64)
    for token, rank in tokens.items():
        sizes[rank] = len(token)
    start = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(sorted(tokens, key=tokens.__getitem__)), np.uint8)

    def decode(rows: pa.RecordBatch) -> dict[str, pa.Array]:
        lists = rows.column(ids_col)
        ids = lists.flatten().to_numpy()
        if not (sizes[ids] > 0).all():
            raise ValueError("an id beyond the vocabulary")
        out = end_to_end(flat, start[ids], sizes[ids])
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])
        rows_end = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        offsets = pa.array(upto[rows_end].astype(np.int32))
        return {"decoded": pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(out)])}

    return decode


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids`` array<int>."""
    make = partial(encoder, read_ranks(rank_path), pattern, splitting(pattern), text_col)
    return scored(docs, text_col, make, [StructField("ids", ArrayType(IntegerType()))])


def decode_ids(rows: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded`` binary; an id beyond the vocabulary is an error."""
    return scored(rows, ids_col, partial(decoder, read_ranks(rank_path), ids_col), [StructField("decoded", BinaryType())], keep=True)


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of the ids and of the text they decode to."""
    out = decode_ids(encode_texts(docs.select("doc_id", "text"), rank_path, pattern), rank_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
