"""Term statistics of one text field.

The corpus is tokenised once per index: the postings are written to the shared
folder and every statistic is read from them.  Everything is a long table keyed by ``(doc_id, term)`` or ``term``; no matrix
or dense vocabulary is ever built.  Corpus-wide scalars (``N``, total tokens,
mean length) are computed once, in one aggregate, and enter the plans as literals.

Shuffles: postings are a ``groupBy(doc_id, term)`` whose map-side partial
aggregate already reduces each document's tokens (all tokens of a document
come from one row), so only distinct postings cross the network; term
statistics are a ``groupBy(term)`` after partial aggregation, which absorbs
very frequent terms.  Postings meet their terms' weights in ``with_terms``: frequent
terms are sent to the postings, only postings of rare terms are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_tokens, tokens
from ..session import SMALL, sized_table, written_table


def tokenize(corpus: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """``doc_id, term`` one row per token occurrence."""
    return corpus.select(F.col(id_col).alias("doc_id"), F.explode(tokens(field)).alias("term"))


def term_counts(corpus: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """Postings ``doc_id, term, tf`` (raw counts)."""
    return tokenize(corpus, field, id_col).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_length(corpus: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """``doc_id, d`` token count per document, 0 for empty ones (no join)."""
    return corpus.select(F.col(id_col).alias("doc_id"), n_tokens(field).alias("d"))


class FieldIndex:
    """Statistics of one field over the whole corpus.

    ``postings``  doc_id, term, tf
    ``terms``     term, df, cf, idf, p, avgd   (the vocabulary, E3/E4/E7)
    ``n_docs``    N (empty documents included; parquet footers, no scan)

    ``total``     the field's number of tokens (one number, from the vocabulary)
    """

    def __init__(self, field: str, corpus: DataFrame, id_col: str):
        self.field, self.corpus, self.id_col = field, corpus, id_col
        n = corpus.count()
        self.n_docs, self.size = F.lit(n).cast("bigint"), n
        self.postings = written_table(term_counts(corpus, field, id_col), "postings")
        stats = written_table(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "vocabulary")
        tokens_in_field = stats.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
        self.total = F.lit(tokens_in_field).cast("bigint")
        self.avg_len = F.lit(tokens_in_field / n if n else 0.0)
        self.terms = stats.select("term", "df", "cf", *term_weights(n, tokens_in_field))

    def doc_length(self) -> DataFrame:
        return doc_length(self.corpus, self.field, self.id_col)


def term_weights(n_docs: int, total) -> list[Column]:
    """``idf, p, avgd`` of a vocabulary row (df, cf); ``total``: tokens of the field (a number or a column)."""
    total = total if isinstance(total, Column) else F.lit(float(total))
    return [
        # Smooth idf ln((1+N)/(1+df)) + 1
        (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
        # Collection probability cf / total tokens
        (F.col("cf") / total).alias("p"),
        (total / F.lit(float(max(n_docs, 1)))).alias("avgd"),
    ]


def field_index(corpus: DataFrame, field: str, id_col: str = "id") -> FieldIndex:
    return FieldIndex(field, corpus, id_col)


def vocabulary(index: FieldIndex) -> DataFrame:
    """Distinct terms of the field."""
    return index.terms.select("term")


def idf(index: FieldIndex) -> DataFrame:
    """``term, df, idf``."""
    return index.terms.select("term", "df", "idf")


def collection_stats(index: FieldIndex) -> DataFrame:
    """``term, cf, p`` plus the corpus total as a column."""
    return index.terms.select("term", "cf", index.total.alias("total_tokens"), "p")


def with_terms(postings: DataFrame, terms: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``postings`` with ``columns`` of their ``terms``.  Terms that make up at least a
    ``SMALL``-th of all postings each (there are at most ``SMALL``) are sent to every task, which
    takes most postings out of the shuffle and with them every hot key; the others are
    joined by term.  A small vocabulary is sent whole."""
    n, held = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    weights = terms.select(*on, "df", *[c for c in columns if c != "df"])
    if n <= SMALL:
        return postings.join(F.broadcast(weights.select(*on, *columns)), on)
    frequent = F.col("df") >= held // SMALL + 1
    hot = weights.where(frequent).select(*on, *columns)
    cold = postings.join(F.broadcast(hot.select(*on)), on, "left_anti").join(weights.where(~frequent).select(*on, *columns), on)
    return postings.join(F.broadcast(hot), on).unionByName(cold)


def doc_norms(index: FieldIndex, postings: DataFrame | None = None) -> DataFrame:
    """``doc_id, norm`` = sqrt(Σ_t (tf·idf)²) for the given postings."""
    p = index.postings if postings is None else postings
    return (
        with_terms(p, index.terms, ["term"], ["idf"])
        .groupBy("doc_id")
        .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    )


def tfidf(index: FieldIndex, postings: DataFrame | None = None) -> DataFrame:
    """E5: ``doc_id, term, tf, idf, tfidf`` with L2-normalised tf·idf per document."""
    p = index.postings if postings is None else postings
    norms = doc_norms(index, p)
    return (
        with_terms(p, index.terms, ["term"], ["idf"])
        .join(norms, "doc_id")
        .select("doc_id", "term", "tf", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("tfidf"))
    )


def query_terms(queries: DataFrame, index: FieldIndex, qid: str = "qid", text: str = "query") -> DataFrame:
    """Distinct in-vocabulary query terms ``qid, term, df, idf, p``.

    Query term frequency is ignored (a repeated term counts once).
    """
    qt = queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    qt = sized_table(qt, "query-words")
    return qt.join(index.terms.select("term", "df", "idf", "p", "avgd"), "term").select("qid", "term", "df", "idf", "p", "avgd")
