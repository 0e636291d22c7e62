"""Bibliometric extraction.

corpus (nested records) -> papers, paper–author links, author profiles with
citation count, paper count, i10, h-index and h-class.

Skew: an author may own a large share of all links.  Every per-author number
is an aggregation (map-side partial aggregation absorbs hot authors).  The
h-index is computed from the per-author *citation histogram*:
``N(c) = #papers with citations >= c`` and ``h = max_c min(c, N(c))`` over the
author's distinct citation values, so the only window spans distinct citation
values of one author, never one author's papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference.
H_CLASS_THRESHOLD = 10
I10_THRESHOLD = 10


def papers(corpus: DataFrame) -> DataFrame:
    """``paper_sha, paper_title, paper_year, paper_venue, n_key_citations,
    n_citations``; n_citations counts outgoing references, n_key_citations
    incoming citations (as the reference does)."""
    return corpus.select(
        F.col("id").alias("paper_sha"),
        F.col("title").alias("paper_title"),
        F.col("year").cast("int").alias("paper_year"),
        F.col("venue").alias("paper_venue"),
        F.coalesce(F.size("inCitations"), F.lit(0)).cast("int").alias("n_key_citations"),
        F.coalesce(F.size("outCitations"), F.lit(0)).cast("int").alias("n_citations"),
    )


def paper_authors(corpus: DataFrame, keep_raw: bool = False, ord_col: str | None = None) -> DataFrame:
    """One row per (paper, author position, id); position from 1.

    Authors with an empty or null id list yield no row; duplicate ids are kept.
    ``corpus_author_id`` is the id parsed as BIGINT (null when not numeric).
    ``keep_raw`` adds what the author tables need: the name, the paper's incoming
    citations, the place of first sight (``ord_col`` of the corpus, else its id) and
    the raw id where it is not numeric.
    """
    seen = F.col(ord_col if ord_col else "doc_idx" if "doc_idx" in corpus.columns else "id")
    a = corpus.select(
        F.col("id").alias("paper_sha"),
        seen.alias("seen"),
        F.coalesce(F.size("inCitations"), F.lit(0)).cast("int").alias("n_key_citations") if "inCitations" in corpus.columns else F.lit(0).alias("n_key_citations"),
        F.posexplode("authors").alias("apos", "author"),
    )
    b = a.select(
        "paper_sha",
        "seen",
        "n_key_citations",
        (F.col("apos") + 1).cast("int").alias("position"),
        F.col("author.name").alias("name"),
        F.posexplode("author.ids").alias("id_pos", "raw"),
    )
    out = b.withColumn("corpus_author_id", F.col("raw").try_cast("bigint"))
    if not keep_raw:
        return out.select("paper_sha", "corpus_author_id", "position")
    return out.select(
        "paper_sha", "corpus_author_id", "position", "name", "n_key_citations", F.struct("seen", "position", "id_pos").alias("at"),
        F.when(F.col("corpus_author_id").isNull(), F.col("raw")).alias("raw_id"),
    )


AUTHOR = ["corpus_author_id", "raw_id"]  # ids that are not numbers stay apart by their text


def _author_histogram(links: DataFrame) -> DataFrame:
    """Per author and citation count: ``n`` links, ``at_least`` links with as many
    citations or more, the name of the first link and its place.  Its size is an
    author's distinct citation counts, so the window spans no papers."""
    hist = links.groupBy(*AUTHOR, "n_key_citations").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.min_by("name", "at").alias("name")
    )
    w = Window.partitionBy(*AUTHOR).orderBy(F.col("n_key_citations").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("at_least", F.sum("n").over(w))


def _author_aggregate(corpus: DataFrame, ord_col: str | None = None) -> DataFrame:
    cites = F.col("n_key_citations").cast("bigint")
    return _author_histogram(paper_authors(corpus, keep_raw=True, ord_col=ord_col)).groupBy(*AUTHOR).agg(
        F.min_by("name", "at").alias("name"),
        F.sum(cites * F.col("n")).cast("bigint").alias("num_citations"),
        F.sum("n").cast("bigint").alias("num_papers"),
        F.coalesce(F.sum(F.when(cites >= I10_THRESHOLD, F.col("n"))), F.lit(0)).cast("bigint").alias("i10"),
        F.max(F.least(cites, F.col("at_least"))).cast("int").alias("h_index"),
    )


def author_profile(corpus: DataFrame, ord_col: str | None = None) -> DataFrame:
    """``corpus_author_id, name, num_citations, num_papers, i10``.

    name = first seen (lowest paper ordinal, then position, then id position);
    an id repeated within a paper counts twice; a null id is one author, every id
    that is no number one of its own (with a null ``corpus_author_id``).
    """
    return _author_aggregate(corpus, ord_col).select("corpus_author_id", "name", "num_citations", "num_papers", "i10")


def h_index_from(links: DataFrame, author: str = "corpus_author_id", cites: str = "n_key_citations") -> DataFrame:
    """C4 on any (author, citations) table: ``author, h_index`` (INT)."""
    hist = links.groupBy(author, cites).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(author).orderBy(F.col(cites).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("at_least", F.sum("n").over(w))
    return cum.groupBy(author).agg(
        F.max(F.least(F.col(cites).cast("bigint"), F.col("at_least"))).cast("int").alias("h_index")
    ).select(author, F.greatest(F.col("h_index"), F.lit(0)).alias("h_index"))


def author_h_index(corpus: DataFrame) -> DataFrame:
    """C4: ``corpus_author_id, h_index``."""
    return _author_aggregate(corpus).select("corpus_author_id", "h_index")


def h_class(h: str = "h_index", threshold: int = H_CLASS_THRESHOLD):
    """C5: 'H' if h >= threshold else 'L'."""
    return F.when(F.col(h) >= threshold, F.lit("H")).otherwise(F.lit("L"))


def authors_table(corpus: DataFrame, threshold: int = H_CLASS_THRESHOLD, ord_col: str | None = None) -> DataFrame:
    """The authors table: profile + h_index + h_class (one row per author id), from
    one aggregate."""
    return _author_aggregate(corpus, ord_col).withColumn("h_class", h_class(threshold=threshold)).select(
        "corpus_author_id", "name", "num_citations", "num_papers", "i10", "h_index", "h_class"
    )


def derive_groups(authors: DataFrame, cuts: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Group authors by how many papers they have with >= 10 citations.

    ``cuts`` are the lower bounds of the buckets above 0; an author with i10
    below cuts[0] is group ``i10_0``, between cuts[0] and cuts[1]-1 is
    ``i10_<cuts[0]>``, and so on.
    """
    gid = F.lit("i10_0")
    for c in cuts:
        gid = F.when(F.col("i10") >= c, F.lit(f"i10_{c}")).otherwise(gid)
    return authors.select(F.col("corpus_author_id").alias("author_id"), gid.alias("gid"))
