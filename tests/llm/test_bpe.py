import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from rankaudit.llm import bpe
from tests.llm import fixtures

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DATA = bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(4)
    ranges = [(32, 127), (0xA0, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0x1F300, 0x1FAFF), (0x30000, 0x3FFFF)]
    texts = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    return texts + ["a" * 700, "ab" * 400, " " * 50 + "x", "\n\n \n", "", "don't 's 'S", "<|endoftext|>", "é" * 90, "aaab" * 60]


def test_encodes_as_tiktoken_and_round_trips(reference):
    texts = odd_texts() + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    encode = bpe.encoder(DATA, P.PATTERN, bpe.splitting(P.PATTERN), "text")
    for lo in range(0, len(texts), 400):
        part = texts[lo : lo + 400]
        ids = encode(pa.record_batch({"text": part}))["ids"]
        assert ids.to_pylist() == [reference.encode_ordinary(t) for t in part]
        decoded = bpe.decoder(DATA, "ids")(pa.record_batch({"ids": ids}))["decoded"].to_pylist()
        assert [d.decode() for d in decoded] == part


def one_by_one(piece, ranks):
    """Ids of a piece by the rule itself: the lowest pair, its leftmost place, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not found:
            return [ranks[x] for x in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("range_bits", [0, 3, bpe.RANGE_BITS])
def test_any_order_of_ranks(monkeypatch, range_bits):
    """Merges that open lower ranks, runs of one byte, one and many ranks in an entry of the index."""
    monkeypatch.setattr(bpe, "RANGE_BITS", range_bits)
    rnd = random.Random(6)
    tokens = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(300)} | {b"aa", b"aaa", b"aaaa"})
    rnd.shuffle(tokens)
    ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + sorted(tokens, key=lambda t: rnd.random()))}
    replay = bpe.MergeReplay(ranks)
    pieces = [bytes(rnd.choice(b"aabc") for _ in range(rnd.randint(1, 40))) for _ in range(800)] + [b"a" * n for n in range(1, 40)]
    want = [one_by_one(p, ranks) for p in pieces]
    sizes, ids = replay.replay(pieces)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert replay.heap(pieces) == want
    assert replay.replay([])[0].tolist() == []


def test_replay_and_heap_agree():
    replay = bpe._replay(DATA)
    rnd = random.Random(9)
    pieces = [bytes(rnd.choice(b"abethingo \xc3\xa9") for _ in range(rnd.randint(2, 48))) for _ in range(3000)]
    sizes, ids = replay.replay(pieces)
    flat = ids.tolist()
    heap = replay.heap(pieces)
    assert sizes.tolist() == [len(h) for h in heap] and flat == [i for h in heap for i in h]


def test_query_columns(docs, none, reference):
    got = bpe.bpe_digests(docs, PATH, P.PATTERN).collect()
    rows = fixtures.rows()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0] or 0, digest(reference, r[1] or "")) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == want
    assert bpe.bpe_digests(none, PATH, P.PATTERN).collect() == []


def digest(reference, text):
    ids = reference.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_keeps_clashing_columns(docs):
    out = bpe.encode_texts(docs, PATH, P.PATTERN)
    assert set(out.columns) == set(docs.columns) - {"text"} | {"ids"}
    assert out.where("score = 'other'").count() == docs.where("score = 'other'").count()


def test_unknown_id_is_an_error():
    with pytest.raises((ValueError, IndexError)):
        bpe.decoder(DATA, "ids")(pa.record_batch({"ids": pa.array([[99999999]], pa.list_(pa.int32()))}))
