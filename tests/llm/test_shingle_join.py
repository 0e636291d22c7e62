import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankaudit.llm import shingle_join as J
from rankaudit.llm.components import components
from rankaudit.llm.shingles import shingle_sets, words_of
from tests.llm import fixtures


def brute(rows):
    sets = [(r[0], fixtures.shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    name = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            name[find(i)] = min(doc_id, name.get(find(i), doc_id))
    return sorted(((doc_id is None, doc_id or 0), len(s), name.get(find(i)) if s else doc_id) for i, (doc_id, s) in enumerate(sets))


def found(out):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out.collect())


def edited_rows(seed=3, groups=25):
    """Groups of edited copies around the threshold, over a passage that many share."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 5, 8, 15, 40, 70, 90, 200, 700)))]
        base = base + passage if g % 2 else base
        for _ in range(rnd.randint(1, 7)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 1)] = [f"e{rnd.randrange(10**6)}"] * rnd.randint(0, 2)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_edited_copies_and_odd_rows_equal_brute_force(spark):
    rows = edited_rows() + [(None if r[0] is None else 1000 + r[0], r[1]) for r in fixtures.rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert found(J.jaccard_components(df)) == want
    assert 30 < len({c for _, _, c in want}) < len(rows)


def test_single_shingle_pass_links_short_sets(spark):
    rows = edited_rows(seed=5, groups=12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = J._indexed(df, singles=True)
    sets = both.where("key IS NULL")
    classes = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "sketch", "spare_own", "spare_next")])
    met = both.where("key IS NOT NULL").select("key", "unit", "pivot", "cid")
    of = {r.id: r.component for r in components(J.set_links(met, classes, df, singles=True)).collect()}
    name = {r.doc_id: of.get(r.cid, r.cid) for r in sets.collect()}
    want = {k[1]: c for k, _, c in brute(rows)}
    assert len(set(name.values())) == len(set(want.values())) == len({(name[i], want[i]) for i in want})


def test_units_suffice_for_every_linked_pair():
    """Pigeonhole: two linked sets meet under any units of the smaller that it needs."""
    rng = np.random.default_rng(4)
    for n in (3, 6, 20, 63, 64, 80, 127, 128, 200, 500, 800):
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x
            while True:  # as far from x as a link allows
                z = np.delete(y, rng.integers(len(y))) if rng.random() < 0.4 and len(y) > 1 else np.unique(np.append(y, rng.integers(0, 2**63)).astype(np.uint64))
                k = len(np.intersect1d(x, z))
                if 100 * k < 75 * (len(x) + len(z) - k):
                    break
                y = z
            small, large = sorted((x, y), key=len)
            scheme = J.band(len(large))
            ks, ss, ds = J.unit_keys(small, scheme)
            kl, _, dl = J.unit_keys(large, scheme)
            exact, near = set(kl[~dl].tolist()), set(kl[dl].tolist())
            met = set()
            for k, s, d in zip(ks.tolist(), ss.tolist(), ds.tolist(), strict=True):
                if not d and k in exact:
                    met.add((s, 1))
                if (d and k in exact) or (not d and k in near):
                    met.add((s, 2))
            met |= {(s, 2) for s, u in met if u == 1 and s in set(ss[ds].tolist())}
            assert len(met) > J.units(ss, ds) - J.needed(len(small), scheme)


def candidates(spark, rows, spare):
    """What ``allocated`` finds for rows (key, cid, segment, deletion) of sets of 100, a component each."""
    rows = [(k, 7 << 27 | d << 25 | s, c, c, c) for k, c, s, d in rows]
    met = spark.createDataFrame(rows, "key long, unit long, pivot long, cid long, comp long")
    classes = met.select("cid").distinct().select("cid", F.lit(100).cast("long").alias("n"), F.array_repeat(F.lit(0).cast("long"), 16).alias("sketch"), F.lit(spare).alias("spare_own"), F.lit(0).alias("spare_next"))
    return {tuple(sorted((r.a, r.b))) for r in J.allocated(met, classes, False).collect()}


def test_equal_subsets_of_wide_segments_are_looked_up(spark):
    rows = [(1, 10, 16, 0), (1, 20, 16, 0)]  # nobody has a neighbour there
    assert candidates(spark, rows, 0) == {(10, 20)}
    assert candidates(spark, rows, 1) == {(10, 20)}  # one unit left out: the segment counts for two
    assert candidates(spark, rows, 2) == set()
    crowd = [(2, c, 32, 0) for c in (10, 20, 30, 40)]
    assert candidates(spark, rows + crowd, 2) == {(10, 20)}  # the dear segment is left out


def test_repeated_rows_do_not_make_keys_alike(spark):
    rows = [(1, 10, 1, 0), (1, 20, 1, 0), (2, 30, 2, 0), (2, 40, 2, 0)]
    assert candidates(spark, rows + rows, 0) == {(10, 20), (30, 40)}


def test_allocation_loses_no_link_under_a_shared_passage(spark):
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(40):
        tail = [f"t{g}_{i}" for i in range(rnd.randint(20, 60))]
        size = len(passage) + len(tail) - 4
        cut = size - -(-3 * size // 4) - rnd.randint(0, 2)  # shingles that one of the two has alone
        rows += [(2 * g, " ".join(passage + tail)), (2 * g + 1, " ".join(passage + tail[: len(tail) - cut]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = J._indexed(df, singles=False)
    sets = both.where("key IS NULL")
    classes = sets.groupBy("cid").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "sketch", "spare_own", "spare_next", "short")])
    met = both.where("key IS NOT NULL").select("key", "unit", "pivot", "cid", F.col("cid").alias("comp"))
    got = {frozenset((r.a, r.b)) for r in J.allocated(met, classes, False).collect()}
    of = {r.doc_id: (r.cid, r.short) for r in sets.collect()}
    shingles = {i: fixtures.shingles(t) for i, t in rows}
    linked = [(i, j) for i in of for j in of if i < j and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j])]
    want = {frozenset((of[i][0], of[j][0])) for i, j in linked if not (of[i][1] or of[j][1])}
    assert len(want) > 30 and want <= got


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (302, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingle_hashes_follow_the_words(monkeypatch):
    from rankaudit.llm import shingles

    texts = [r[1] for r in fixtures.rows()]
    assert words_of(texts)[1].tolist() == [len(fixtures.words(t)) for t in texts]
    whole = shingle_sets(texts)
    assert [len(s) for s in whole] == [len(fixtures.shingles(t)) for t in texts]
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts), strict=True))


def test_met_units_spill_keeps_all_members(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h tail{i}") for i in range(50)], "doc_id long, text string").repartition(5)

    def met(limit):
        rows = J.met_units(J.indexed(docs, 3), limit).where("key IS NOT NULL").collect()
        return sorted({(r.key, r.cid) for r in rows}), all(r.pivot <= r.cid for r in rows)

    assert met(10**6) == met(20) and met(20)[1] and len(met(20)[0]) == 50 * 4


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    packer, want = J.Packer(5), set()
    for cid in range(-20, 20):
        keys, units = rng.integers(0, 2**63, 30).astype(np.uint64), rng.integers(0, 2**31, 30).astype(np.uint32)
        packer.add(cid, keys, units)
        want |= {(int(k % 5), int(k >> 32), int(u), cid) for k, u in zip(keys.tolist(), units.tolist(), strict=True)}
    got = {(b, *map(int, e)) for b, data in zip(*packer.packs(), strict=True) for e in zip(*J.unpacked(data), strict=True)}
    assert got == want and packer.packs() == ([], [])


def test_stage_keeps_one_of_each_group(docs):
    out = J.one_per_component(docs)
    assert out.columns == docs.columns
    want = {(k, n, c) for k, n, c in brute(fixtures.rows())}
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert ids == sorted(k for k, n, c in want if n == 0 or (c is None if k[0] else c == k[1]))


def test_empty_table(none):
    assert J.jaccard_components(none).collect() == []
