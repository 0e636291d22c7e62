"""Line dedup: an exact set-similarity join over lines.

A line (text between line feeds) is the set of its words.  A line goes when an
earlier line, by document id and place, has a word set of Jaccard similarity
``threshold`` or more; the earlier line need not itself stay, so the result does
not depend on any order of evaluation.

Words are 63-bit codes ordered by rarity.  Rarity is the number of words in one
of 2**BUCKET_BITS hash buckets, counted over the whole table, in quarters of a
power of two; that table of one level per bucket is the only thing the driver
gathers, and its size is fixed.  Equal sets are collapsed to their first line.
Two sets can only be similar if the index prefix of the smaller (by size) meets
the probe prefix of the larger; prefix rows are joined on the word under the
length filter, the positional filter and a parity filter (each word in which two
sets differ flips one bit, so the parities cannot differ in more bits than the sets
do in words): 64 bits, and 192 between sets of more than ``LONG`` words.  What is left is verified on the full sets.

Under busy words (``BUSY`` sets or more, by exact counts), as groups of thousands of
similar lines make them, every set is first compared with the earliest one only.  What that
removes is not compared again; what is left is compared with every earlier set it
meets under any word.

Defined cases: a null text counts as empty and stays null; a line without words
is never removed; rows that agree in id and text are one document and get the
same decisions; a null id is below all others; an empty table gives an empty
result; other columns are kept by ``dedup_lines`` as they are.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankaudit.llm.store import drop_written, written

BUCKET_BITS = 17
BUSY = 16
LONG = 32
#: Sides of a join up to so many narrow rows are broadcast; above it the join is shuffled.
SMALL = 400_000
HASH_BITS = 56  # under the 7 bits of the rarity level
BLANKS = r"[\x09\x0B-\x0D]"


def _words(line: Column) -> Column:
    """Hashes of the distinct words of ``line``."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def _plain() -> Column:
    """The text, with white space other than line feeds made blanks."""
    text = F.coalesce("text", F.lit(""))
    held = reduce(or_, (F.contains(text, F.lit(c)) for c in "\x09\x0B\x0C\x0D"))
    return F.when(held, F.regexp_replace(text, BLANKS, " ")).otherwise(text)


def _lines() -> Column:
    """The lines of the text, with other white space made blanks."""
    return F.split(_plain(), "\n")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def rarity_levels(docs: DataFrame) -> Column:
    """Literal array: the level of every word bucket, 0 (rarest) to 127."""
    words = docs.select(F.explode(F.split(F.replace(_plain(), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count().collect()
    levels = ["0"] * (1 << BUCKET_BITS)
    for b, n in counts:
        levels[b] = str(min(127, int(4 * math.log2(n))))
    return F.split(F.lit(",".join(levels)), ",").cast("array<tinyint>")


def word_set(line: Column, levels: Column) -> Column:
    """Sorted codes of the distinct words of ``line``: rarity level above, hash bits below."""
    def code(h: Column) -> Column:
        return F.shiftleft(F.get(levels, _bucket(h)).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1))

    return F.sort_array(F.transform(_words(line), code))


def _doc_hash() -> Column:
    return F.xxhash64(F.col("text"))


def _parity(codes: Column) -> Column:
    """Which of 64 bits the codes name an odd number of times."""
    zero = F.lit(0).cast("long")
    return F.aggregate(codes, zero, lambda p, c: p.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))))


def _third(code: Column) -> Column:
    return F.shiftright(code, 6).bitwiseAND(0xFFFFFF) % 3


def _apart() -> Column:
    """Bits in which the parities of x and y differ."""
    whole, second, third = (F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}")) for c in ("parity", "second", "third"))
    first = whole.bitwiseXOR(second).bitwiseXOR(third)
    return F.coalesce(F.bit_count(first) + F.bit_count(second) + F.bit_count(third), F.bit_count(whole))


def line_table(docs: DataFrame, levels: Column, threshold: float) -> DataFrame:
    """(doc_id, doc, line, n, sid, parity, second, third, prefix), one row per line; a prefix word is 31 bits of its code."""
    lines = docs.select("doc_id", _doc_hash().alias("doc"), F.posexplode(_lines()).alias("line", "t"))
    sets = lines.select("doc_id", "doc", "line", F.transform(F.array(word_set(F.col("t"), levels)), lambda s: F.struct(
        F.size(s).alias("n"),
        F.xxhash64(s).alias("sid"),
        _parity(s).alias("parity"),
        F.when(F.size(s) > LONG, _parity(F.filter(s, lambda c: _third(c) == 1))).alias("second"),
        F.when(F.size(s) > LONG, _parity(F.filter(s, lambda c: _third(c) == 2))).alias("third"),
        F.transform(F.slice(s, 1, F.size(s) - F.ceil(F.size(s) * threshold - 1e-9).cast("int") + 1), lambda c: c.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    ))[0].alias("s"))
    return sets.select("doc_id", "doc", "line", "s.*")


def _may_match(threshold: float) -> Column:
    """Length, index-prefix, positional and parity filters of rows x and y under one
    word, each with n, i and parity."""
    n, m = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    need = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    index_prefix = n - F.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    smaller_i = F.when(F.col("x_n") < F.col("y_n"), F.col("x_i")).when(F.col("x_n") > F.col("y_n"), F.col("y_i")).otherwise(F.least("x_i", "y_i"))
    left = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    return (n >= m * threshold - 1e-9) & (smaller_i < index_prefix) & (left >= need) & (_apart() <= n + m - 2 * need)


def _as(side: str, rows: DataFrame) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "word"])


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, levels: Column, threshold: float) -> DataFrame:
    """The sets x of ``pairs`` (x, y) whose words are similar to those of some y."""
    pairs = written(pairs, "line-pairs")
    ids = _small(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    places = firsts.select("id", "doc_id", "doc", "line").join(ids, "id")
    held = written(places.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("line", "id")).alias("asked")), "line-places")
    d = docs.select(F.col("doc_id").alias("d_id"), F.col("text"), _doc_hash().alias("d"))
    texts = d.join(_small(held), F.col("d_id").eqNullSafe(F.col("doc_id")) & F.col("d").eqNullSafe(F.col("doc")))
    # the asked lines are taken out before the rows are multiplied, so that no row carries its whole text
    asked = F.transform(F.array(_lines()), lambda t: F.transform("asked", lambda a: F.struct(a["id"].alias("id"), F.get(t, a["line"]).alias("t"))))[0]
    sets = written(texts.select(F.explode(asked).alias("a")).select(F.col("a.id").alias("id"), word_set(F.col("a.t"), levels).alias("s")), "line-sets")
    once = sets
    if sets.count() > sets.select("id").distinct().count():  # rows repeat a document
        once = sets.dropDuplicates(["id"])
    x, y = (once.select(F.col("id").alias(c), F.col("s").alias(f"{c}_s")) for c in "xy")
    both = x.join(_small(pairs), "x").join(y, "y")
    shared = F.size(F.array_intersect("x_s", "y_s"))
    similar = both.where(shared >= threshold * (F.size("x_s") + F.size("y_s") - shared) - 1e-9)
    gone = written(similar.select(F.col("x").alias("id")).distinct(), "line-gone")
    drop_written(pairs, held, sets)
    return gone


def line_decisions(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, doc, n_lines, removed) per document: ``doc`` hashes the text,
    ``removed`` is the sorted array of the 0-based places of removed lines.
    ``docs`` has doc_id and text."""
    docs = docs.select("doc_id", "text")
    levels = rarity_levels(docs)
    lines = written(line_table(docs, levels, threshold), "lines")
    first = lines.where("n > 0").groupBy("sid").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "doc", "line", "n", "parity", "second", "third", "prefix")).alias("f"))
    # ids in the order of the first places: a smaller id is an earlier line
    ordered = first.select("sid", "copies", "f.*").orderBy("doc_id", "doc", "line").withColumn("id", F.monotonically_increasing_id())
    firsts = written(ordered, "line-firsts")
    rows = firsts.select("id", "n", "parity", "second", "third", F.posexplode("prefix").alias("i", "word"))
    words = rows.groupBy("word").agg(F.count("*").alias("sets"), F.min("id").alias("id")).where(F.col("sets") >= BUSY).select("word", "id")
    earliest = firsts.join(_small(written(words, "line-words")), "id").select(
        "word", "id", "n", (F.array_position("prefix", F.col("word")) - 1).cast("int").alias("i"), "parity", "second", "third")
    starred = _as("x", rows).join(_small(written(_as("y", earliest), "line-pivots")), "word").where("y_id < x_id").where(_may_match(threshold))
    nearest = starred.groupBy("x_id").agg(F.min(F.struct(_apart().alias("apart"), "y_id")).alias("p"))
    gone = verified(nearest.select(F.col("x_id").alias("x"), F.col("p.y_id").alias("y")), firsts, docs, levels, threshold)

    open_rows = rows.join(_small(gone.withColumn("gone", F.lit(1))), "id", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    # x still there; stated over both sides so that they read the same shuffled rows
    still = (F.col("x_gone") + F.least("y_gone", F.lit(0))) == 0
    met = _as("x", open_rows).join(_as("y", open_rows), "word").where((F.col("y_id") < F.col("x_id")) & still & _may_match(threshold))
    gone = gone.union(verified(met.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct(), firsts, docs, levels, threshold))

    # sets with a line to drop: those that go, and those that have further lines
    fate = firsts.select("sid", "id", "copies", F.struct("doc_id", "doc", "line").alias("at")).join(gone.withColumn("gone", F.lit(True)), "id", "left")
    fate = fate.where("gone OR copies > 1").select("sid", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    dropped = lines.where("n > 0").select("doc_id", "doc", "line", "sid").join(fate, "sid").where(F.col("gone") | ~_same_place())
    places = dropped.groupBy(F.col("doc_id").alias("p_id"), F.col("doc").alias("p")).agg(F.sort_array(F.collect_set("line")).alias("places"))
    told = lines.groupBy("doc_id", "doc").agg((F.max("line") + 1).cast("long").alias("n_lines"))
    return told.join(places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("doc") == F.col("p")), "left").select(
        "doc_id", "doc", "n_lines", F.coalesce("places", F.array().cast("array<int>")).alias("removed"))


def _same_place() -> Column:
    """Null-safe equality of a line's place with its set's first place."""
    return F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & F.col("at.doc").eqNullSafe(F.col("doc")) & (F.col("at.line") == F.col("line"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; a column n_chars, if
    there is one, is the length of the new text."""
    fate = line_decisions(docs, threshold).where(F.size("removed") > 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), _doc_hash().alias("hash"))
    out = rows.join(_small(fate), F.col("id").eqNullSafe(F.col("doc_id")) & F.col("hash").eqNullSafe(F.col("doc")), "left")
    changed = F.col("removed").isNotNull()
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda t, i: ~F.array_contains("removed", i)), "\n")
    new = {"text": kept}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places, comma-joined)."""
    out = line_decisions(docs, threshold)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line
  FROM documents),
w AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(t, '[\x20\x09\x0B-\x0D]'), lambda x: x <> ''))) AS s FROM l),
f AS (SELECT s, row_number() OVER () AS id, len(s) AS n, min({'d': doc_id, 'l': line}) AS at FROM w WHERE len(s) > 0 GROUP BY s),
u AS (SELECT id, n, unnest(s) AS x FROM f),
c AS (SELECT x, count(*) AS df FROM u GROUP BY x),
p AS (SELECT id, x FROM u JOIN c USING (x) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, x) <= n - ceil(n * 0.8 - 1e-9) + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (x) WHERE a.id <> b.id),
g AS (SELECT DISTINCT k.a AS id FROM k JOIN f y ON y.id = k.a JOIN f e ON e.id = k.b
  WHERE e.at < y.at AND len(list_intersect(y.s, e.s)) >= 0.8 * (y.n + e.n - len(list_intersect(y.s, e.s))) - 1e-9),
r AS (SELECT w.doc_id, w.line FROM w JOIN f ON w.s = f.s
  WHERE f.id IN (SELECT id FROM g) OR f.at <> {'d': w.doc_id, 'l': w.line})
SELECT doc_id, count(*) AS n_lines, count(r.line) AS n_removed,
  coalesce(string_agg(r.line, ',' ORDER BY r.line), '') AS removed
FROM l LEFT JOIN r USING (doc_id, line) GROUP BY doc_id
"""
