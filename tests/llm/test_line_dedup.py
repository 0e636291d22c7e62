import random
import re

import pytest

from rankaudit.llm import line_dedup as L
from tests.llm import fixtures


def brute(rows, t=0.8):
    """Removed places by (id, text)."""
    earlier, want = [], {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            s = {w for w in re.split("[\x20\x09\x0b-\x0d]", line) if w}
            if not s:
                continue
            if any(len(s & e) >= t * len(s | e) - 1e-9 for e in earlier):
                gone.append(i)
            earlier.append(s)
        want[doc_id, text] = gone
    return want


def template_rows():
    rnd = random.Random(8)
    rows = [(i, f"user {rnd.randrange(10**6)} logged in from host number {i % 7} at night today") for i in range(120)]
    rows += [(200 + i, " ".join(rnd.choice("the of and to in a is it on as".split()) for _ in range(rnd.randint(3, 9)))) for i in range(80)]
    return rows


@pytest.mark.parametrize("busy", [L.BUSY, 2, 10**6])
def test_decisions_equal_brute_force(spark, docs, monkeypatch, busy):
    monkeypatch.setattr(L, "BUSY", busy)
    monkeypatch.setattr(L, "SMALL", L.SMALL if busy == 2 else 0)  # the shuffled joins too
    rows = fixtures.rows()
    want = brute(rows)
    got = L.line_decisions(docs).collect()
    hashes = {(r.id, r.text): r.h for r in docs.selectExpr("doc_id id", "text", "xxhash64(text) h").collect()}
    found = {(r.doc_id, r.doc): r for r in got}
    assert len(got) == len(want)
    for key, gone in want.items():
        row = found[key[0], hashes[key]]
        assert row.removed == gone and row.n_lines == (key[1] or "").count("\n") + 1


@pytest.mark.parametrize("busy", [L.BUSY, 2, 10**6])
def test_templates_and_common_words(spark, monkeypatch, busy):
    monkeypatch.setattr(L, "BUSY", busy)
    rows = template_rows()
    want = brute(rows)
    got = L.line_decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.removed for r in got} == {k[0]: v for k, v in want.items()}
    assert sum(map(len, want.values())) > 80


def test_variants_too_far_apart_are_few_candidates(spark, monkeypatch):
    """Lines that share 50 of 60 words meet in their prefixes, but hardly any pair of them is verified."""
    base = [f"w{k}" for k in range(60)]
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        words = list(base)
        for k in rnd.sample(range(60), 5):
            words[k] = f"v{i}-{k}"
        rows.append((i, " ".join(words)))
    seen, verified = [], L.verified

    def counted(pairs, *rest):
        pairs = L.written(pairs, "test-pairs")
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(L, "verified", counted)
    got = L.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == {k[0]: v for k, v in brute(rows).items()}
    assert len(seen) == 2 and seen[1] <= 60  # of 1,770 pairs


def test_lines_are_counted_without_a_distinct_aggregate(docs):
    plan = L.line_decisions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_repeated_rows_and_white_space(spark):
    """Repeated documents, null ids and texts, and each kind of white space."""
    rows = [(None, "a b c\n\na\tb c"), (None, "a b c\n\na\tb c"), (1, "c\x0bb a\n\r\n"), (1, "c\x0bb a\n\r\n"), (2, None), (2, None), (3, ""), (4, "d\x0ce\r\nd e f")]
    got = L.line_decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id or 0, r.n_lines, r.removed) for r in got), key=str) == sorted((((k[0] or 0), (k[1] or "").count("\n") + 1, v) for k, v in want.items()), key=str)


def test_texts_and_columns(docs):
    want = brute(fixtures.rows())
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    kept = {(i, t): t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) for (i, t), gone in want.items()}
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(str((r[0], kept[r[0], r[1]])) for r in fixtures.rows())
    changed = {i for (i, t), gone in want.items() if gone}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id in changed)


def test_empty_table(none):
    assert L.line_digests(none).collect() == [] and L.dedup_lines(none).collect() == []
