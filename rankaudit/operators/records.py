"""Record combination (D1–D6): lookups become joins over whole tables.

The reference looks up one document at a time with full-table masks; here the
same rules are applied to a table of requests at once:

* ``paper_by_idx``  — by ordinal; unknown ordinals produce no row.
* ``paper_by_sha``  — only when exactly one paper carries the key.
* ``paper_with_corpus`` — paper ⋈ corpus; a paper without exactly one corpus
  record keeps null metadata (``strict=True`` raises instead).
* ``paper_author_set`` — the set of numeric author ids of a paper that exist
  in the author table.
* ``article_record`` — paper + metadata + author rows, long form.
* ``sha_to_idx`` — first ordinal per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paper_by_idx(requests: DataFrame, papers: DataFrame, idx: str = "doc_idx", req: str = "doc_idx") -> DataFrame:
    """Requested ordinals joined to papers (inner)."""
    return requests.select(F.col(req).alias(idx)).join(papers, idx)


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs exactly once (an aggregation, so a
    hot duplicated key is reduced map-side)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).select(key)
    return df.join(counts, key, "left_semi")


def paper_by_sha(requests: DataFrame, papers: DataFrame, key: str = "paper_sha", req: str = "paper_sha") -> DataFrame:
    """Requested keys that match exactly one paper."""
    return requests.select(F.col(req).alias(key)).join(unique_by(papers, key), key)


def paper_with_corpus(papers: DataFrame, corpus: DataFrame, key: str = "paper_sha", strict: bool = False) -> DataFrame:
    """D3: papers LEFT JOIN corpus records with exactly one match on
    ``key = corpus.id``; other papers keep null metadata."""
    meta = unique_by(corpus.withColumnRenamed("id", key), key)
    if strict:
        bad = papers.join(meta, key, "left_anti").limit(1).count()
        if bad:
            raise ValueError("a paper has no unique corpus record")
    return papers.join(meta, key, "left")


def paper_author_set(corpus: DataFrame, authors: DataFrame, ragged_ids: str = "keep") -> DataFrame:
    """``paper_sha, corpus_author_id`` + author metadata.

    All ids of all authors of the paper, nulls dropped, parsed as BIGINT,
    de-duplicated per paper, kept when present in ``authors``.  With
    ``ragged_ids='drop'`` a paper whose authors have id lists of different
    lengths contributes no author (the reference's quirk).
    """
    ids_of = lambda a: F.coalesce(a["ids"], F.array().cast("array<string>"))  # noqa: E731  a null list is an empty one
    c = corpus
    if ragged_ids == "drop":
        sizes = F.transform("authors", lambda a: F.size(ids_of(a)))
        c = c.filter((F.size("authors") == 0) | (F.array_min(sizes) == F.array_max(sizes)))
    elif ragged_ids != "keep":
        raise ValueError("ragged_ids must be 'keep' or 'drop'")
    ids = c.select(
        F.col("id").alias("paper_sha"),
        F.explode(F.flatten(F.transform("authors", ids_of))).alias("raw"),
    )
    s = (
        ids.filter(F.col("raw").isNotNull())
        .select("paper_sha", F.col("raw").try_cast("bigint").alias("corpus_author_id"))
        .filter(F.col("corpus_author_id").isNotNull())
        .distinct()
    )
    return s.join(authors, "corpus_author_id")


def article_record(papers: DataFrame, corpus: DataFrame, authors: DataFrame, key: str = "paper_sha") -> DataFrame:
    """One row per (paper, author) with paper, corpus and author columns;
    papers without (known) authors keep one row with null author columns."""
    pm = paper_with_corpus(papers, corpus.select("id", "authors"), key)
    pas = paper_author_set(corpus.select("id", "authors"), authors).withColumnRenamed("paper_sha", key)
    return pm.drop("authors").join(pas, key, "left")


def sha_to_idx(requests: DataFrame, papers: DataFrame, key: str = "paper_sha", idx: str = "doc_idx", req: str = "doc_id") -> DataFrame:
    """``req, idx`` = first ordinal carrying the requested key; unknown
    keys are skipped."""
    first = papers.groupBy(F.col(key).alias("_key")).agg(F.min(idx).alias(idx))
    return requests.join(first, requests[req] == first["_key"]).drop("_key")
