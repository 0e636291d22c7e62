from collections import defaultdict

from rankaudit.llm import mixing as M
from tests.llm import fixtures


def water_fill(sizes, weights, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * w[s] / open_w > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        full |= over


def test_targets_and_takes(docs):
    rows = fixtures.rows()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(fixtures.words(r[1]))
    want = water_fill(sizes, (5, 2, 1))
    got = M.mix_sources(docs, keep=True).collect()
    assert len(got) == len(rows)
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = r.row.source
        assert r["size"] == len(fixtures.words(r.row.text)) and r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        assert r.source_size == sizes[source]
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
        target[source] = r.target
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 2 * largest[s]  # a repeated id counts twice at the edge
    again = M.mix_sources(docs.repartition(3), keep=True).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert [key(r) for r in sorted(again, key=key)] == [key(r) for r in sorted(got, key=key)]


def test_shuffled_join_agrees(docs, monkeypatch):
    a = sorted(map(str, M.mix_sources(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, M.mix_sources(docs).collect())) == a


def test_mixed_documents_repeat_rows_and_keep_columns(docs):
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in M.mix_sources(docs).collect())


def test_empty_table_and_empty_texts(spark, none):
    assert M.mix_sources(none).collect() == []
    got = M.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
