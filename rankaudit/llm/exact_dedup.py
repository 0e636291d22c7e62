"""Exact document dedup by content-defined chunk recipes.

Each text is cut where its own content says so (after a line end or sentence
mark once a chunk has ``min_chunk`` characters, at ``max_chunk`` at the
latest).  A chunk is named by a 64-bit hash that is *verified* against the
chunk's SHA-256: where one hash stands for several digests, an ordinal tells
them apart.  Two documents are equal when their ordered identifier lists are.
Only identifiers are shuffled; chunk texts never leave the task that read
them, however long the document.  The copies of one text meet in up to ``SALTS``
tasks, whose at most that many results per text are then put together and joined
back to the rows by list and salt.

Defined cases: a null text counts as empty; an empty text has an empty recipe
and all such rows form one group; of rows with equal text the one with the
largest id stays (a null id is below all others; of rows that also share the
id exactly one stays); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankaudit.llm.store import written

SALTS = 64  # tasks over which the copies of one text are spread
LOWER = string.ascii_lowercase
UPPER = string.ascii_uppercase


def normalised(text) -> F.Column:
    """Null as empty, A-Z lower-cased, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunk_refs(text, min_chunk: int = 1024, max_chunk: int = 8192) -> F.Column:
    """array<struct<id64, sha>> of the content-defined chunks of ``text``, in order."""
    pattern = rf"(?s).{{{min_chunk},{max_chunk - 1}}}?[\n.!?]|.{{1,{max_chunk}}}"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("id64"), F.sha2(c, 256).alias("sha")),
    )


def verified_recipes(refs: DataFrame) -> DataFrame:
    """``refs`` (row, refs, ...) with ``recipe``: the ordered list of verified
    identifiers.  A hash shared by several digests gets an ordinal per digest."""
    chunks = refs.select("row", F.posexplode("refs").alias("pos", "ref")).select("row", "pos", "ref.id64", "ref.sha")
    shared = (
        chunks.select("id64", "sha").distinct()
        .groupBy("id64").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("sha")).alias("digests"))
        .where("n > 1")
    )
    if shared.isEmpty():
        return refs.withColumn("recipe", F.transform("refs", lambda r: F.struct(r["id64"].alias("id64"), F.lit(0).alias("nth"))))
    named = chunks.join(shared.drop("n"), "id64", "left").select(
        "row", "pos", "id64", F.coalesce(F.array_position("digests", F.col("sha")).cast("int") - 1, F.lit(0)).alias("nth")
    )
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id64", "nth"))).alias("l"))
    lists = lists.select("row", F.transform("l", lambda x: F.struct(x["id64"].alias("id64"), x["nth"].alias("nth"))).alias("recipe"))
    empty = F.array().cast("array<struct<id64:bigint,nth:int>>")
    return refs.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", empty))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    refs = written(
        norm.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2("norm", 256).alias("text_sha256"),
            chunk_refs(F.col("norm")).alias("refs"),
        ),
        "chunk-refs",
    )
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    recipes = verified_recipes(refs).select("doc_id", "row", "text_sha256", "recipe", salt)
    parts = recipes.groupBy("recipe", "salt").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    groups = groups.select("recipe", "keep", "group_size", F.explode("salts").alias("salt"))
    return recipes.join(groups, ["recipe", "salt"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
