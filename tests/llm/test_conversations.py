import hashlib
import random

import duckdb
import pytest

from rankaudit.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, copies string, fault int"


def inserted(paths):
    out = list(paths)
    for _ in range(2):
        paths = [("a" if s == "u" else "u", c + 3, t + "I", o + (("assistant" if s == "u" else "user", ""),)) for s, c, t, o in paths]
        out += paths
    return out


def cheapest(rows):
    """Every edit script of ``rows`` (role, text, fault), then the cheapest and ASCII-least."""
    paths = [("0", 0, "", ())]
    for role, text, fault in rows:
        after = []
        for s, c, t, o in inserted(paths):
            after.append((s, c + 4, t + "D", o))
            if fault in (1, 2):
                continue
            more, first = 3 * (fault == 3), role[:1]
            if (first, s) in (("s", "0"), ("u", "0"), ("u", "s"), ("u", "a"), ("a", "u")):
                after.append((first, c + more, t + "K", o + ((role, text),)))
            new = "assistant" if s == "u" else "user"
            after.append((new[0], c + 3 + more, t + "R", o + ((new, text),)))
        paths = after
    cost, audit, wrote = min((c, t, o) for s, c, t, o in inserted(paths) if s in "0a")
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in wrote).encode()).hexdigest()


def repaired(rows, held=cv.HELD):
    letters = []
    done = cv.Repair(1, lambda letter, role: letters.append(letter), held)
    for i, (role, text, fault) in enumerate(rows):
        done.row(i, role, text, fault)
    done.finish()
    return done.cost, "".join(letters), done.out.hash.hexdigest()


def test_against_every_edit_script():
    rnd = random.Random(1)
    for _ in range(150):
        rows = [
            (rnd.choice(["user", "assistant", "system", "", "x"]), rnd.choice(["a.", "b", "cc cc"]), rnd.choice([0, 0, 0, 1, 2, 3]))
            for _ in range(rnd.randint(0, 4))
        ]
        want = cheapest(rows)
        for held in (cv.HELD, 0, 3):
            assert repaired(rows, held) == want


def test_open_rows_are_bounded_and_hashes_agree():
    rnd = random.Random(2)
    rows = [(rnd.choice(["user", "assistant", "user", "system"]), "t" * rnd.randint(1, 50) + ".", rnd.choice([0, 0, 0, 1, 3])) for _ in range(4000)]
    assert repaired(rows) == repaired(rows, 100)
    open_rows = 0
    done = cv.Repair(1, lambda letter, role: None)
    for i, row in enumerate(rows):
        done.row(i, *row)
        deep, node = 0, next(iter(done.live.values()))[2]
        while node is not done.root:
            deep, node = deep + 1, node.parent
        open_rows = max(open_rows, deep)
    assert open_rows < 200
    ties = [("user", f"{i}.", 0) for i in range(3000)]  # nothing is settled before the end
    done = cv.Repair(1, lambda letter, role: None, 1000)
    for i, row in enumerate(ties):
        done.row(i, *row)
        assert done.held <= 1000 + len(row[1])
    assert repaired(ties, 1000) == repaired(ties)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rnd.randint(1, 9)):
            for _ in range(rnd.choice((1, 1, 1, 2))):
                text = rnd.choice(["Yes.", "No", "", None, " \t\n", "a. b! c? ", "é ß\x0b", " ", "long. " * 3000])
                rows.append((conv, rnd.choice((turn, turn, turn + 5, None)), rnd.choice(["user", "assistant", "system", None, ""]), text, "other", 1))
    return spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(5)


def test_odd_rows_against_sql(spark, odd):
    con = duckdb.connect()
    con.register("conversations", odd.toArrow())
    want = con.sql(cv.ORACLE)
    got = cv.repair_conversations(odd)
    assert got.columns == want.columns
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_real_outputs_make_the_digests(spark, odd):
    rows = cv.damage(odd)
    texts = {}
    for r in sorted(cv.repaired(rows).collect(), key=lambda r: (str(r["conv_id"]), r["step"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    edits = {}
    for r in sorted(cv.repair_edits(rows).collect(), key=lambda r: (str(r["conv_id"]), r["step"])):
        edits[r["conv_id"]] = edits.get(r["conv_id"], "") + r["edit"]
    for r in cv.repair_digests(rows).collect():
        assert r["audit"] == edits.get(r["conv_id"], "")
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(texts.get(r["conv_id"], [])).encode()).hexdigest()


def test_clean_rows_stay_and_none_gives_none(spark):
    rows = [(1, t, r, "Fine.", None, None) for t, r in enumerate(("system", "user", "assistant"))]
    got = cv.repair_digests(cv.as_they_are(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["cost"], r["audit"], r["illegal"]) for r in got] == [(0, "KKK", 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_conversations(empty).collect() == [] and cv.repaired(cv.damage(empty)).collect() == []
