import hashlib
import random
import re

import numpy as np
import pytest

from rankaudit.llm import pii
from rankaudit.llm.boosting import Boosted, threshold_for
from tests.llm import fixtures

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checks_out(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and checks_out(digits(m[0]))]
    return found + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def texts():
    rnd = random.Random(7)
    bits = ["a@b.c", "@", ".", "x%", "-", "12", "255", "0256", "1.2.3.4", "+", "+49", " ", "(30)", "4111111111111111", "4111 1111-1111 1111", "é", "😀", "mail", "0", "\n", "..", "a.b-c@d-e.f", "9" * 18]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    return made + ["", "1.2.3.4.5.6.7.8.9", "a@b@c.d@e.f", "+1 2 3 4 5 6 7 8 ...", "@a.b", "x@y..z", "é@b.c", "000000001.2.3.4", "+1" * 50]


def test_base_spans_equal_the_patterns():
    for t in texts():
        assert pii.base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a." * 150_000 + "@b", "a at b." * 40_000, ":" * 200_000, "AB12 " * 50_000):
        pii.base_spans(t)
        sum(1 for _ in pii.candidates(t))


@pytest.fixture(scope="module")
def learnt():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    return pii.learn([" ".join(rnd.choice(words) for _ in range(60)) for _ in range(200)])


def selected(text, learnt):
    base = pii.base_spans(text)
    return [text[a:b] for _, a, b, _ in pii.added_spans(text, base, *learnt)]


def test_held_out_examples(learnt):
    make, hit, missed, false = pii._Maker(np.random.default_rng(99)), 0, 0, 0
    for _ in range(500):
        text, spans = pii._example(make, ["some plain words of prose that stand around the item " * 3])
        base = pii.base_spans(text)
        added = {(a, b) for _, a, b, _ in pii.added_spans(text, base, *learnt)}
        got = added | {(a, b) for _, a, b in base}
        hit, missed = hit + len(got & set(spans)), missed + len(set(spans) - got)
        false += len(added - set(spans))
    assert hit / (hit + missed) > 0.9 and false / (hit + false) < 0.02


def test_items_side_by_side_and_written_out(learnt):
    text = "call me at +1 (269) 555-3296 4111111111111111 today"
    assert pii.base_spans(text) == [] and sorted(selected(text, learnt)) == ["+1 (269) 555-3296", "4111111111111111"]
    assert selected("please write to jane.doe (at) example [dot] org now", learnt) == ["jane.doe (at) example [dot] org"]
    assert selected("plain x@y.org and 10.1.2.3 are base spans", learnt) == []
    for clean in ("see you at noon. The dot is small", "on 2024-01-31 at 12:30:45", "version 3.11.2 of 1999-2003", "pages 12, 13 and 14", "deadbeef" * 5, "look at example.com"):
        assert selected(clean, learnt) == [], clean


def test_spans_never_meet_base_or_each_other(learnt):
    make = pii._Maker(np.random.default_rng(3))
    for _ in range(300):
        text, _ = pii._example(make, [])
        base = pii.base_spans(text)
        added = sorted((a, b) for _, a, b, _ in pii.added_spans(text, base, *learnt))
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:]))
        assert all(b <= c or d <= a for a, b in added for _, c, d in base)


def test_redacted_text():
    assert pii.redact("ab 12 cd", [(0, 3, 5)]) == "ab [email] cd"
    assert pii.redact("abcdef", [(2, 1, 3), (3, 2, 5)]) == "a[card]f" and pii.redact("é", []) == "é"


def test_query_on_odd_rows(spark, docs, none, monkeypatch):
    monkeypatch.setattr(pii, "EXAMPLES", 800)
    got = pii.personal_digests(docs).collect()
    assert len(got) == len(fixtures.rows()) and pii.personal_digests(none).collect() == []
    rows = [(i, t, "clash") for i, t in enumerate([*texts()[-40:], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    for r in pii.personal_digests(df).collect():
        text = rows[r["doc_id"]][1] or ""
        base = brute(text)
        line = ",".join(f"{pii.BASE[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == i for x in base) for i in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == [s for s in line.split(",") if s]
        assert len(spans) == len(base) + r["n_added"]


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted(trees=30, depth=3).fit(x, y, np.ones(2000))
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    assert np.array_equal(model.score(x), Boosted(trees=30, depth=3).fit(x, y, np.ones(2000)).score(x))
    assert Boosted().fit(np.zeros((5, 2)), np.zeros(5), np.ones(5)).score(np.zeros((1, 2)))[0] < 0.01


def test_threshold():
    scores, labels = np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 1])
    assert threshold_for(scores, labels, 0.9) == 0.9 and threshold_for(scores, labels, 0.6) == 0.1 and threshold_for(scores, labels * 0, 0.5) == 0.99
    assert threshold_for(np.array([]), np.array([]), 0.9) == 0.99
