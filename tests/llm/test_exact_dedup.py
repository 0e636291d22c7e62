import hashlib
from collections import defaultdict

from rankaudit.llm import exact_dedup as E
from tests.llm import fixtures


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_brute_force(docs):
    rows = fixtures.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = E.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by_digest = defaultdict(list)
    for r in got:
        by_digest[r.text_sha256].append(r)
    assert len(by_digest) == len(groups)
    for text, ids in groups.items():
        found = by_digest[hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(i for i in ids if i is not None)
        assert {r.keep_id for r in found} == {keep} and {r.group_size for r in found} == {len(ids)}
        assert sum(r.kept for r in found) == 1 and [r.doc_id for r in found if r.kept] == [keep]


def test_one_text_in_most_rows(spark):
    rows = [(i, "the same text" if i % 5 else f"text {i}") for i in range(600)] + [(None, "the same text"), (599, "The Same Text")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    same = [r for r in got if r.group_size > 1]
    assert len(got) == len(rows) and {(r.keep_id, r.group_size) for r in same} == {(599, 482)} and len(same) == 482
    assert [r.doc_id for r in same if r.kept] == [599] and sum(r.kept for r in got) == 121


def test_empty_table(none):
    assert E.exact_dedup(none).collect() == []


def test_hash_shared_by_two_digests_gets_ordinals(spark):
    refs = spark.createDataFrame(
        [(1, [(7, "aa"), (8, "cc")]), (2, [(7, "bb"), (8, "cc")]), (3, [(7, "aa"), (8, "cc")]), (4, [])],
        "row long, refs array<struct<id64:long,sha:string>>",
    )
    got = {r.row: tuple(map(tuple, r.recipe)) for r in E.verified_recipes(refs).collect()}
    assert got[1] == got[3] != got[2] and got[4] == ()
    assert got[2][0] == (7, 1) and got[2][1] == (8, 0)


def test_chunks_rebuild_the_text(spark):
    text = ("word " * 700 + ".\n") * 5 + "tail"
    df = spark.createDataFrame([(text,)], "t string")
    from pyspark.sql import functions as F

    chunks = df.select(F.regexp_extract_all("t", F.lit(r"(?s).{1024,8191}?[\n.!?]|.{1,8192}"), F.lit(0)).alias("c")).first().c
    assert "".join(chunks) == text and len(chunks) == len(df.select(E.chunk_refs(F.col("t")).alias("r")).first().r) > 2
