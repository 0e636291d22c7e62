"""Query–document features.

Per field the text features are sums over the query's distinct
in-vocabulary terms ``t`` (terms a document lacks have ``tf = 0``):

    TF     Σ tf(d,t)
    IDF    Σ idf(t)
    TFIDF  Σ tf·idf / ‖tf·idf‖₂(d)
    BM25   Σ idf(t)·tf(k1+1) / (tf + k1(1 − b + b·d/avgdl))        (smooth idf)
    ABS    −Σ ln(max(tf − δ, 0)/d + δ·u/d·p(t))     u = df(t) (default) or #unique terms of d
    DIR    −Σ ln((tf + μ·p(t)) / (d + μ))
    JM     −Σ ln((1 − λ)·tf/d + λ·p(t))
with the three LM scores 0 when the document is empty.

A text feature is a :class:`TextFeature`: a name and a function from the columns of one
query term (:class:`TermColumns`) to its summand; the built-in seven are written that way,
and any other can be given in a :class:`FeatureSpec`.  All features of all fields are
compiled into one aggregate.  A :class:`DocFeature` is a function of a document's column.

The plan for judged pairs is "query terms × judged docs LEFT JOIN postings".
All fields share one postings table ``f, doc_id, term, tf``, tokenised once and
written to the shared folder; it is reduced to the judged documents for norms
and lengths, and further to the queries' words for the join.  A pair is
(qid, query text, doc): repeated judgements of a pair share one computation, and
two texts under one qid are two queries.  Of corpus rows that repeat an id the first
is the document; all of them count for the statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_length, int_value, tokens
from ..session import SMALL, sized_table, written_table
from .index import TextIndex, counted, numbered_copies, postings_of, top_ranks, vocabulary_of
from .termstats import FieldIndex, doc_norms, query_terms, term_weights, with_terms

# The reference's feature parameters.
BM25_K1 = 1.2
BM25_B = 0.75
JM_LAMBDA = 0.1
DIR_MU = 2000.0
ABS_DELTA = 0.7
#: Documents whose scores one task sums.
DOCS_A_TASK = 4096


class TermColumns(NamedTuple):
    """What is known of one query term for one document and field.  ``unique`` is what ABS takes
    as the number of unique terms (``df``, or the document's own with ``unique='doc'``)."""

    tf: Column  # occurrences in the document (0 without)
    d: Column  # the document's length in tokens
    idf: Column
    p: Column  # share of all tokens of the field
    df: Column
    cf: Column
    norm: Column  # length of the document's tf·idf vector
    avgd: Column  # mean length
    unique: Column


@dataclass(frozen=True)
class TextFeature:
    """A feature that is a sum over the query's terms; ``name`` may hold ``{field}``."""

    key: str
    name: str
    summand: Callable[[TermColumns], Column]

    def title(self, field: str) -> str:
        return self.name.format(field=field)


@dataclass(frozen=True)
class DocFeature:
    """A feature of the document alone: a function of its column, as a double."""

    name: str
    value: Callable[[Column], Column]

    def title(self, field: str) -> str:
        return self.name.format(field=field)


def _nonempty(t: TermColumns, x: Column) -> Column:
    return F.when(t.d > 0, x).otherwise(F.lit(0.0))


def built_in(k1: float = BM25_K1, b: float = BM25_B, lam: float = JM_LAMBDA, mu: float = DIR_MU, delta: float = ABS_DELTA) -> tuple[TextFeature, ...]:
    """F1–F7 in the layout's order.  The names are the reference's (fixed values)."""
    zero = F.lit(0.0)
    return (
        TextFeature("tf", "TF(q, d) in {field}", lambda t: t.tf),
        TextFeature("idf", "IDF(q) in {field}", lambda t: t.idf),
        TextFeature("tfidf", "TF_IDF(q, d) in {field}", lambda t: F.when(t.tf > 0, t.tf * t.idf / t.norm).otherwise(zero)),
        TextFeature("bm25", "BM25 of {field}", lambda t: t.idf * (t.tf * (k1 + 1.0)) / (t.tf + k1 * (1.0 - b + b * t.d / t.avgd))),
        TextFeature("lmir_abs", "LMIR_ABS(q, d) in {field}", lambda t: _nonempty(t, -F.log(F.greatest(t.tf - delta, zero) / t.d + F.lit(delta) * t.unique / t.d * t.p))),
        TextFeature("lmir_dir", "LMIR_DIR(q, d) in {field}", lambda t: _nonempty(t, -F.log((t.tf + mu * t.p) / (t.d + mu)))),
        TextFeature("lmir_jm", "LMIR_JM(q, d) in {field}", lambda t: _nonempty(t, -F.log((1.0 - lam) * t.tf / t.d + lam * t.p))),
    )


TEXT_FEATURES = ("tf", "idf", "tfidf", "bm25", "lmir_abs", "lmir_dir", "lmir_jm")
_LEN_NAME, _NUM_NAME = "LEN(d) of {field}", "num of {field}"  # fixed values: the reference's names


@dataclass(frozen=True)
class FeatureSpec:
    """One feature family over ``field``: ``kind`` is ``text`` (the built-in seven, or the
    given :class:`TextFeature` s), ``len``, ``num``, or ``doc`` (the given :class:`DocFeature` s).

    ``num`` reads ``field`` from the corpus (or from a papers table passed to
    :func:`judged_features`) and parses it as an integer.
    """

    kind: str
    field: str
    features: tuple = ()

    def text(self, **params) -> tuple[TextFeature, ...]:
        return self.features or built_in(**params)

    def names(self) -> list[str]:
        if self.kind == "text":
            return [f.title(self.field) for f in self.features or _built_in_names()]
        if self.kind == "doc":
            return [f.title(self.field) for f in self.features]
        if self.kind in ("len", "num"):
            return [(_LEN_NAME if self.kind == "len" else _NUM_NAME).format(field=self.field)]
        raise ValueError(f"unknown feature kind {self.kind!r}")


def _built_in_names() -> tuple[TextFeature, ...]:
    return built_in()


def default_specs(num_field: str = "n_chars") -> list[FeatureSpec]:
    """The reference's 25-feature layout: 7 text features × (abstract, title,
    venue), then LEN × 3, then one NUM."""
    fields = ("paperAbstract", "title", "venue")
    return (
        [FeatureSpec("text", f) for f in fields]
        + [FeatureSpec("len", f) for f in fields]
        + [FeatureSpec("num", num_field)]
    )


def feature_names(spark, specs: Sequence[FeatureSpec]) -> DataFrame:
    """``index, name``."""
    names = [n for s in specs for n in s.names()]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "index int, name string")


PAIR = ["qid", "query", "doc_id"]


def _contributions(
    pairs: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    wanted_features: Sequence[tuple[str, int, TextFeature]],
    unique: str = "df",
) -> DataFrame:
    """One row per pair with the sum of every (column, field number, feature)."""
    if unique not in ("df", "doc"):
        raise ValueError("unique must be 'df' or 'doc'")
    # a query's text is carried by its rows in ``asked`` alone; pairs and words go by its number ``q``
    asked = sized_table(pairs.select("qid", "query").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    words = sized_table(asked.select("q", F.explode(F.array_distinct(tokens("query"))).alias("term")), "asked-words")
    wanted = words.join(terms, "term").select("q", "f", "term", "df", "cf", "idf", "p", "avgd")
    known = written_table(wanted.drop("q").distinct().withColumn("t", F.monotonically_increasing_id()), "asked-terms")
    known = F.broadcast(known) if known.count() <= SMALL else known
    wanted = sized_table(words.join(known, "term").drop("term"), "asked-weights")
    numbered = pairs.join(asked, ["qid", "query"]).select("q", "doc_id")

    judged = postings.join(sized_table(pairs.select("doc_id").distinct(), "judged-ids"), "doc_id", "left_semi")
    judged = written_table(judged.select("f", "doc_id", "term", "tf"), "judged-postings")
    per_field = (
        with_terms(judged, terms, ["f", "term"], ["idf"])
        .groupBy("f", "doc_id")
        .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"), F.sum("tf").alias("d"), F.count(F.lit(1)).alias("terms_in_doc"))
    )
    per_doc = per_field.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("norm", "d", "terms_in_doc")))).alias("fields"))
    matched = judged.join(known.select("f", "term", "t"), ["f", "term"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "tf"))).alias("tfs"))
    # a pair's words stand together, so its sums are complete before they are shuffled
    cand = numbered.join(per_doc, "doc_id", "left").join(matched, "doc_id", "left").join(wanted, "q").withColumn("in_field", F.col("fields")[F.col("f")])
    cand = cand.select(
        "*", F.col("tfs")[F.col("t")].alias("tf"), F.col("in_field.norm").alias("norm"), F.coalesce("in_field.d", F.lit(0)).alias("d"),
        (F.col("df") if unique == "df" else F.coalesce("in_field.terms_in_doc", F.lit(0))).alias("u"),
    )
    double = lambda c: F.col(c).cast("double")
    t = TermColumns(
        F.coalesce(F.col("tf"), F.lit(0)).cast("double"), double("d"), F.col("idf"), F.col("p"), double("df"), double("cf"), F.col("norm"), F.col("avgd"), double("u")
    )
    sums = cand.groupBy("q", "doc_id").agg(*[F.sum(F.when(F.col("f") == f, feature.summand(t))).alias(c) for c, f, feature in wanted_features])
    return sums.join(asked, "q").drop("q")


def text_features(pairs: DataFrame, queries: DataFrame, index: FieldIndex, features: Sequence[TextFeature] | None = None, *, unique: str = "df", **params) -> DataFrame:
    """F1–F7 for one field: ``qid, doc_id, tf, idf, tfidf, bm25, lmir_abs,
    lmir_dir, lmir_jm`` (or the given ``features`` by key) for every distinct (qid, doc_id)
    of ``pairs`` and text of the query; 0 when the query has no in-vocabulary term."""
    features = list(features or built_in(**params))
    keys = pairs.select("qid", "doc_id").distinct().join(queries.select("qid", F.coalesce("query", F.lit("")).alias("query")).distinct(), "qid")
    keys = keys.select(*PAIR)
    wanted = [(f.key, 0, f) for f in features]
    agg = _contributions(keys, index.postings.withColumn("f", F.lit(0)), index.terms.withColumn("f", F.lit(0)), wanted, unique)
    return keys.join(agg, PAIR, "left").select(
        "qid", "doc_id", *[F.coalesce(F.col(f.key), F.lit(0.0)).alias(f.key) for f in features]
    )


def field_postings(corpus: DataFrame, fields: Sequence[str], id_col: str = "id", ord_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings ``f, doc_id, term, tf`` of the first row of each id, vocabulary ``f, term, df, cf,
    idf, p, avgd`` over all rows) of several fields: the corpus is tokenised once and the
    postings are written."""
    rows = numbered_copies(corpus, id_col, ord_col)
    documents = written_table(counted(rows, fields, id_col), "field-documents")
    postings = postings_of(documents, len(fields))
    stats = written_table(vocabulary_of(documents, len(fields)), "field-vocabulary")
    totals = {r["f"]: r["total"] for r in stats.groupBy("f").agg(F.sum("cf").alias("total")).collect()}  # one row per field
    total = F.lit(0.0)
    for f, n in totals.items():
        total = F.when(F.col("f") == f, F.lit(float(n))).otherwise(total)
    return postings.where("copy = 0").drop("copy"), stats.select("f", "term", "df", "cf", *term_weights(rows.count(), total))


def judged_features(
    judged: DataFrame,
    corpus: DataFrame,
    specs: Sequence[FeatureSpec] | None = None,
    *,
    papers: DataFrame | None = None,
    id_col: str = "id",
    ord_col: str | None = None,
    paper_key: str = "paper_sha",
    paper_ord: str | None = None,
    index: TextIndex | None = None,
    unique: str = "df",
    **params,
) -> DataFrame:
    """``qid, doc_id, relevance, features ARRAY<DOUBLE>`` for every
    judged (qid, doc) whose document exists; unknown documents are skipped.

    ``judged`` has ``qid, query, doc_id, relevance``; a pair judged twice gives two
    rows with the same features.  Of corpus rows that repeat an id the first counts
    (least ``ord_col``, else least row).  With ``papers`` (keyed by ``paper_key``) numbers
    are read from it, documents without a paper are skipped as well, and of
    papers that repeat a key the one with the least ``paper_ord`` (else the least
    value) counts.  With an ``index`` of the specs' text fields nothing is tokenised
    but the queries.
    """
    specs = list(specs or default_specs())
    known = judged.join(corpus.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = known.select("qid", F.coalesce("query", F.lit("")).alias("query"), "doc_id", "relevance")
    num_specs = [s for s in specs if s.kind == "num"]
    if papers is not None:
        types = dict(papers.dtypes)
        numbers = papers.select(
            F.col(paper_key).alias("doc_id"),
            F.struct(*([F.col(paper_ord).alias("_ord")] if paper_ord else []), *[int_value(s.field, types[s.field]).cast("double").alias(f"num_{s.field}") for s in num_specs]).alias("n"),
        ).groupBy("doc_id").agg(F.min("n").alias("n"))
        known = known.join(numbers.select("doc_id"), "doc_id", "left_semi")
    pairs = known.select(*PAIR).distinct()

    out, columns = known, {}
    text_specs = [(i, s) for i, s in enumerate(specs) if s.kind == "text"]
    if text_specs:
        if index is None:
            fields = list(dict.fromkeys(s.field for _, s in text_specs))
            postings, terms = field_postings(corpus, fields, id_col, ord_col)
        else:
            fields, postings, terms = index.fields, index.postings.where("copy = 0").drop("copy"), index.terms
        wanted = [(f"t{i}_{j}", fields.index(s.field), f) for i, s in text_specs for j, f in enumerate(s.text(**params))]
        used = sorted({f for _, f, _ in wanted})
        if len(used) < len(fields):
            postings, terms = postings.where(F.col("f").isin(used)), terms.where(F.col("f").isin(used))
        out = out.join(_contributions(pairs, postings, terms, wanted, unique), PAIR, "left")
        for i, _ in text_specs:
            columns[i] = [F.coalesce(F.col(c), F.lit(0.0)) for c, _, _ in wanted if c.startswith(f"t{i}_")]

    types, doc_cols = dict(corpus.dtypes), []
    for i, s in enumerate(specs):
        if s.kind == "text":
            continue
        if s.kind == "num" and papers is not None:
            columns[i] = [F.col(f"n.num_{s.field}")]
            continue
        made = [char_length(s.field)] if s.kind == "len" else [int_value(s.field, types[s.field])] if s.kind == "num" else [f.value(F.col(s.field)) for f in s.features]
        names = [f"d{i}_{j}" for j in range(len(made))]
        doc_cols += [c.cast("double").alias(n) for c, n in zip(made, names)]
        columns[i] = [F.col(f"doc.{n}") for n in names]
    if doc_cols:  # of the judged documents only, and of those the first row
        ids = corpus.join(pairs.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")
        first = ids.select(F.col(id_col).alias("doc_id"), F.struct(*([F.col(ord_col).alias("_ord")] if ord_col else []), F.struct(*doc_cols).alias("v")).alias("o"))
        out = out.join(first.groupBy("doc_id").agg(F.min("o").alias("o")).select("doc_id", F.col("o.v").alias("doc")), "doc_id", "left")
    if papers is not None:
        out = out.join(numbers, "doc_id", "left")
    return out.select("qid", "doc_id", "relevance", F.array(*[c for i in range(len(specs)) for c in columns[i]]).alias("features"))


def score_corpus(queries: DataFrame, index: FieldIndex, every: bool = False) -> DataFrame:
    """``qid, doc_id, score`` = Σ normalised tf·idf of the query's terms.

    With ``every`` each query has a row for each document, with score 0 where they share no
    term (the reference's vector over all articles, |Q|×N rows); without, only documents
    sharing a term with the query appear, which is all that a search needs.
    """
    qt = sized_table(query_terms(queries, index).select("qid", "term", "idf"), "query-terms")
    wanted = sized_table(qt.select("term", "idf").distinct(), "wanted-terms")
    matched = index.postings.join(wanted, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked, parts, score = qt.select("qid", "term"), index.size // DOCS_A_TASK + 1, F.sum(F.col("w") / F.col("norm"))
    if every:
        # One more row of each document adds 0 and meets every query.  Its key is no word (those have no space); there
        # is one key a part of the documents where the queries are shuffled, so no task gets all pairs.
        qids = written_table(queries.select("qid").distinct(), "asked-queries")
        small = asked.count() + qids.count() <= SMALL
        keys = 1 if small else parts
        key = lambda i: F.concat(F.lit(" "), i.cast("string"))
        asked = asked.unionByName(qids.select("qid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(keys - 1)), key)).alias("term")))
        asked = F.broadcast(asked) if small else asked
        docs = index.corpus.select(F.col(index.id_col).alias("doc_id"))
        matched = matched.unionByName(docs.select("doc_id", key(F.pmod(F.xxhash64("doc_id"), F.lit(keys))).alias("term"), F.lit(0.0).alias("w")))
        matched, score = matched.where("doc_id IS NOT NULL"), F.coalesce(score, F.lit(0.0))  # a document without words has no norm
    # queries meet a document's words in the task that holds them all
    by_doc = matched.repartition(parts, "doc_id").join(doc_norms(index), "doc_id", "left" if every else "inner")
    return by_doc.join(asked, "term").groupBy("qid", "doc_id").agg(score.alias("score"))


def search_top_k(queries: DataFrame, index: FieldIndex, k: int = 1, tie_decimals: int = 9) -> DataFrame:
    """best ``k`` documents per query by F12 score, ties to the lowest id.

    When fewer than ``k`` documents match, the lowest-id documents fill up
    with score 0 (the reference's argmax over a zero vector returns the first
    document).  Scores equal to ``tie_decimals`` decimals tie (exact copies of a
    document must tie whatever order their terms were summed in).  Those ``k`` fallback
    ids are the only thing brought to the driver.  ``row_number() <= k`` is planned as a
    per-partition group limit before the shuffle.  Every match is scored here;
    ``index.Search`` skips what cannot win.
    """
    docs = index.corpus.select(F.col(index.id_col).alias("doc_id"))
    return top_ranks(score_corpus(queries, index), queries, docs, k, tie_decimals)
