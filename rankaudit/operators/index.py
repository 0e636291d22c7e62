"""A kept text index (E2–E7) and pruned search over it.

An index is a folder of *segments*.  A segment holds what one batch of documents adds:
documents ``doc_id, copy, lengths, w0, w1, …`` and vocabulary ``f, term, df, cf``; ``f`` numbers the
fields, and ``wf`` holds a document's words ``term, tf`` in field ``f``.  A document is counted in
its own row, so neither writing a segment nor ``compact`` shuffles words; postings
``f, doc_id, copy, term, tf`` are these rows taken apart.  Everything in it adds up: the document
frequency, the collection frequency and the number of documents of an index are sums over its
segments, so a batch is tokenised once and never again; idf and all that follows from it
are computed from the sums when they are asked for.  A segment counts once its row is in
the manifest table, which is written last; a failed append leaves nothing behind that
is read.  ``compact`` writes all segments as one, as a new generation.

Appending is keyed: documents whose id the index has are left out, so a replayed batch adds
nothing.  Of rows that repeat an id within a batch all count for the statistics
(they are rows of the corpus), and the first (``copy`` 0: least ``ord_col``, else least row)
is the document that scores.  Rows without an id are no documents.

Search reads *blocks*: postings of one term with impacts (normalised tf·idf) of about the
same size, as arrays in one row with their largest impact.  What a set of n terms can add to
a document's score is at most the sum of their largest impacts and at most √n (a document's
impacts have length 1; √(n(1 − s)) where others of its impacts have squares that sum to s).
A query first scores documents from the postings of its rarest terms, which bounds
its k-th score from below.  The most frequent terms that together cannot reach that bound
are not searched for documents (one that has nothing else cannot win), and neither are
blocks whose largest impact with all other terms cannot.  What remains gives
candidates, which are dropped by the same bound on what they lack, the best of them
scored first to raise the bound; the rest are scored exactly, from their own words (``words``,
one row per document) or, where that is less, from the other terms' postings.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, word_counts
from ..session import sized_table, written_table
from .termstats import doc_norms, term_weights, with_terms

#: Postings that a block holds about (blocks of a term split by impact, four levels an octave).
BLOCK = 4096
#: Rarest terms whose postings bound a query's scores, and documents scored for the first and the
#: second bound, per result.
RAREST, FIRST, SECOND = 8, 8, 16
#: Scores nearer than this are not told apart by a bound (ties are judged on rounded scores).
SLACK = 1e-8

_MANIFEST = "generation int, segment int, path string, id_col string, fields array<string>, n_docs long, totals array<long>"
_SEARCHES = "field string, state string, path string"


def numbered_copies(corpus: DataFrame, id_col: str, ord_col: str | None = None) -> DataFrame:
    """``corpus`` plus ``copy``: 0 for the first row of each id, 1, 2, … for further ones.  Only
    rows of repeated ids are shuffled; rows without an id are dropped."""
    rows = corpus.where(F.col(id_col).isNotNull())
    repeated = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col)
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    order = [F.col(ord_col)] if ord_col else [F.col(c) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    more = rows.join(repeated, id_col, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1)
    return rows.join(repeated, id_col, "left_anti").withColumn("copy", F.lit(0)).unionByName(more)


def counted(rows: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    """``doc_id, copy, lengths, w0, w1, …`` of ``rows`` (with copy), each field tokenised once."""
    split = rows.select(F.col(id_col).alias("doc_id"), "copy", *[tokens(c).alias(f"t{i}") for i, c in enumerate(fields)])
    lengths = F.array(*[F.size(f"t{i}").cast("long") for i in range(len(fields))])
    return split.select("doc_id", "copy", lengths.alias("lengths"), *[word_counts(F.col(f"t{i}")).alias(f"w{i}") for i in range(len(fields))])


def postings_of(documents: DataFrame, n_fields: int) -> DataFrame:
    """``f, doc_id, copy, term, tf`` of ``counted`` documents; who asks for some fields reads theirs."""
    each = [documents.select(F.lit(f).alias("f"), "doc_id", "copy", F.explode(f"w{f}").alias("x")).select("f", "doc_id", "copy", "x.term", "x.tf") for f in range(n_fields)]
    return reduce(DataFrame.unionByName, each)


def vocabulary_of(documents: DataFrame, n_fields: int) -> DataFrame:
    """``f, term, df, cf`` of ``counted`` documents."""
    return postings_of(documents, n_fields).groupBy("f", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


class FieldView:
    """One field of an index, with the attributes of ``termstats.FieldIndex``."""

    def __init__(self, index: TextIndex, f: int):
        self.index, self.f, self.field, self.id_col = index, f, index.fields[f], "doc_id"
        total = index.totals[f]
        self.n_docs, self.total = F.lit(index.n_docs).cast("bigint"), F.lit(total).cast("bigint")
        self.avg_len, self.size = F.lit(total / index.n_docs if index.n_docs else 0.0), index.n_docs
        self.corpus = index.documents.where("copy = 0").select("doc_id")

    @property
    def postings(self) -> DataFrame:
        return self.index.postings.where((F.col("f") == self.f) & (F.col("copy") == 0)).select("doc_id", "term", "tf")

    @property
    def terms(self) -> DataFrame:
        return self.index.terms.where(F.col("f") == self.f).drop("f")

    def doc_length(self) -> DataFrame:
        return self.index.documents.select("doc_id", F.col("lengths")[self.f].alias("d"))


class TextIndex:
    """An index as its manifest says it is; ``append`` and ``compact`` return the new state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()  # one row a segment
        self.generation = max(r["generation"] for r in rows)
        segments = sorted((r for r in rows if r["generation"] == self.generation), key=lambda r: r["segment"])
        self.segments, self.id_col, self.fields = [r["path"] for r in segments], segments[0]["id_col"], list(segments[0]["fields"])
        self.n_docs = sum(r["n_docs"] for r in segments)
        self.totals = [sum(r["totals"][f] for r in segments) for f in range(len(self.fields))]
        self.state = f"{self.generation}-{len(segments)}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{s}/{name}" for s in self.segments])

    @property
    def postings(self) -> DataFrame:
        return postings_of(self.documents, len(self.fields))

    @property
    def documents(self) -> DataFrame:
        return self._read("documents")

    @property
    def vocabulary(self) -> DataFrame:
        """``f, term, df, cf`` summed over the segments."""
        each = self._read("vocabulary")
        return each if len(self.segments) == 1 else each.groupBy("f", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    @property
    def terms(self) -> DataFrame:
        """``f, term, df, cf, idf, p, avgd``."""
        total = F.lit(0.0)
        for f, n in enumerate(self.totals):
            total = F.when(F.col("f") == f, F.lit(float(n))).otherwise(total)
        return self.vocabulary.select("f", "term", "df", "cf", *term_weights(self.n_docs, total))

    def field(self, name: str) -> FieldView:
        return FieldView(self, self.fields.index(name))

    # ------------------------------------------------------------ writing
    def append(self, corpus: DataFrame, ord_col: str | None = None) -> TextIndex:
        """Add the documents whose ids the index does not have."""
        fresh = corpus.join(self.documents.select(F.col("doc_id").alias(self.id_col)), self.id_col, "left_anti")
        _write_segment(fresh, self.fields, self.path, self.id_col, ord_col, self.generation, len(self.segments))
        return TextIndex(self.spark, self.path)

    def compact(self) -> TextIndex:
        """All segments as one."""
        if len(self.segments) == 1:
            return self
        to = f"{self.path}/segment-{uuid.uuid4().hex}"
        self.vocabulary.write.parquet(f"{to}/vocabulary")
        self.documents.write.parquet(f"{to}/documents")
        _commit(self.spark, self.path, (self.generation + 1, 0, to, self.id_col, self.fields, self.n_docs, self.totals))
        return TextIndex(self.spark, self.path)

    # ------------------------------------------------------------ search
    def searchable(self, field: str) -> Search:
        """The search tables of ``field``, written when this state of the index has none."""
        state, at = self.state, f"{self.path}/searches"
        try:
            known = self.spark.read.schema(_SEARCHES).parquet(at).where((F.col("field") == field) & (F.col("state") == state)).collect()
        except Exception as e:  # no search was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = []
        if known:
            return Search(self.field(field), known[0]["path"])
        to = f"{self.path}/search-{uuid.uuid4().hex}"
        _write_search(self.field(field), to)
        self.spark.createDataFrame([(field, state, to)], _SEARCHES).coalesce(1).write.mode("append").parquet(at)
        return Search(self.field(field), to)


def build_index(corpus: DataFrame, fields: Sequence[str], path: str, id_col: str = "id", ord_col: str | None = None) -> TextIndex:
    """A new index of ``corpus`` at ``path``."""
    _write_segment(corpus, list(fields), path, id_col, ord_col, 0, 0)
    return TextIndex(corpus.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark, path)


save_index = build_index


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _write_segment(corpus: DataFrame, fields: list[str], path: str, id_col: str, ord_col: str | None, generation: int, segment: int) -> None:
    spark, to = corpus.sparkSession, f"{path}/segment-{uuid.uuid4().hex}"
    rows = numbered_copies(corpus, id_col, ord_col)
    counted(rows, fields, id_col).write.parquet(f"{to}/documents")
    documents = spark.read.parquet(f"{to}/documents")
    vocabulary_of(documents, len(fields)).write.parquet(f"{to}/vocabulary")
    n, *totals = documents.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("lengths")[f]), F.lit(0)) for f in range(len(fields))]).first()
    if n or segment == 0:
        _commit(spark, path, (generation, segment, to, id_col, fields, n, totals))


def _write_search(view: FieldView, to: str) -> None:
    """``words`` (doc_id, norm, words array<term, tf>), ``blocks`` (term, n, top, docs array<doc_id,
    impact>) and ``tops`` (term, df, top)."""
    spark = view.index.spark
    words = view.index.documents.where("copy = 0").select("doc_id", F.col(f"w{view.f}").alias("words")).join(doc_norms(view), "doc_id")
    words.write.parquet(f"{to}/words")
    each = spark.read.parquet(f"{to}/words").select("doc_id", "norm", F.explode("words").alias("x")).select("doc_id", "norm", "x.term", "x.tf")
    each = with_terms(each, view.terms, ["term"], ["df", "idf"]).select("doc_id", "term", "df", (F.col("tf") * F.col("idf") / F.col("norm")).alias("impact"))
    level = F.floor(F.log2("impact") * -4)
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / BLOCK))
    blocks = each.groupBy("term", "df", level.alias("level"), part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"), F.collect_list(F.struct("doc_id", "impact")).alias("docs")
    )
    blocks.write.parquet(f"{to}/blocks")
    spark.read.parquet(f"{to}/blocks").groupBy("term", "df").agg(F.max("top").alias("top"), F.min("level").alias("level")).write.parquet(f"{to}/tops")


class Search:
    """Top-k search over the written tables of one field."""

    def __init__(self, view: FieldView, path: str):
        read = view.index.spark.read
        self.view, self.path = view, path
        self.words, self.blocks, self.tops = (read.parquet(f"{path}/{t}") for t in ("words", "blocks", "tops"))

    def _terms(self, queries: DataFrame) -> DataFrame:
        asked = sized_table(queries.select("qid", F.explode(F.array_distinct(tokens("query"))).alias("term")).distinct(), "search-words")
        return asked.join(self.tops, "term").select("qid", "term", "df", "top", "level")

    def exact(self, candidates: DataFrame, terms: DataFrame) -> DataFrame:
        """``qid, doc_id, score`` of the given pairs, from the documents' own words."""
        few = sized_table(candidates.select("qid", "doc_id"), "search-exact")
        each = few.join(self.words, "doc_id").select("qid", "doc_id", "norm", F.explode("words").alias("x")).select("qid", "doc_id", "norm", "x.*")
        weights = terms.select("qid", "term", term_weights(self.view.index.n_docs, 1)[0])
        return each.join(weights, ["qid", "term"]).groupBy("qid", "doc_id").agg(F.sum(F.col("tf") * F.col("idf") / F.col("norm")).alias("score"))

    def completed(self, candidates: DataFrame, plan: DataFrame) -> DataFrame:
        """``qid, doc_id, score`` of candidates ``qid, doc_id, part`` (their sum over the searched terms):
        a query's few candidates are looked up in their own words; where these are more
        than the postings of the other terms, those are read instead and added."""
        held = self.view.index.totals[self.view.f] / max(1, self.view.index.n_docs)  # words of a document, at most
        costs = candidates.groupBy("qid").agg((F.count(F.lit(1)) * held).alias("look")).join(
            plan.groupBy("qid").agg(F.sum(F.when(~F.col("needed"), F.col("df")).otherwise(0)).alias("read")), "qid"
        )
        way = costs.select("qid", (F.col("look") > F.col("read")).alias("read"))
        chosen = written_table(candidates.join(way, "qid"), "search-chosen")
        few, many = chosen.where("NOT read").select("qid", "doc_id"), chosen.where("read")
        rest = sized_table(plan.where("NOT needed").select("qid", "term").join(many.select("qid").distinct(), "qid", "left_semi"), "search-rest")
        rest = rest.join(self.blocks, "term").select("qid", F.explode("docs").alias("d")).select("qid", "d.doc_id", F.col("d.impact").alias("part")).join(many.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
        summed = many.select("qid", "doc_id", "part").unionByName(rest).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))
        return self.exact(few, plan).unionByName(summed)

    def _first_blocks(self, terms: DataFrame) -> DataFrame:
        """``qid, term, n, docs``: all blocks of a query's rarest terms, the best ones only where a
        term has many."""
        rare = Window.partitionBy("qid").orderBy("df", "term")
        best = terms.withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= RAREST).select("qid", "term", F.col("level").alias("best"))
        return best.join(self.blocks, "term").where((F.col("df") <= BLOCK) | (F.col("level") == F.col("best"))).select("qid", "term", "n", "docs")

    def bounds(self, terms: DataFrame, k: int) -> DataFrame:
        """``qid, least``: a score that at least k documents of the query reach."""
        seen = self._first_blocks(terms).select("qid", F.explode("docs").alias("d")).groupBy("qid", "d.doc_id").agg(F.sum("d.impact").alias("part"))
        return self._kth(seen, terms, k, FIRST).select("qid", F.col("kth").alias("least"))

    def plan(self, terms: DataFrame, bounds: DataFrame) -> DataFrame:
        """``qid, term, df, needed, rest, others, tops, least``: whether documents are searched by the
        term, what all other terms can add to it, and number and largest impacts of the
        terms that are not searched."""
        up, all_of = Window.partitionBy("qid").orderBy(F.col("df").desc(), "term"), Window.partitionBy("qid")
        t = terms.join(bounds, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
        t = t.withColumn("reach", F.least(F.sum("top").over(up), F.sqrt(F.row_number().over(up)))).withColumn("needed", F.col("reach") >= F.col("least"))
        rest = F.least(F.sum("top").over(all_of) - F.col("top"), F.sqrt(F.count(F.lit(1)).over(all_of) - 1))
        return t.select(
            "qid", "term", "df", "needed", rest.alias("rest"), F.count_if(~F.col("needed")).over(all_of).alias("others"),
            F.coalesce(F.sum(F.when(~F.col("needed"), F.col("top"))).over(all_of), F.lit(0.0)).alias("tops"), "least",
        )

    def kept_blocks(self, plan: DataFrame) -> DataFrame:
        """The blocks that documents are searched by: ``qid, n, docs, others, tops, least``."""
        searched = plan.where("needed").drop("df", "needed")
        return searched.join(self.blocks, "term").where(F.col("top") + F.col("rest") >= F.col("least")).select("qid", "n", "docs", "others", "tops", "least")

    def top_k(self, queries: DataFrame, k: int = 1, tie_decimals: int = 9) -> DataFrame:
        """``qid, rank, doc_id, score``; the same rows as ``features.search_top_k``."""
        terms = sized_table(self._terms(queries), "search-terms")
        plan = sized_table(self.plan(terms, self.bounds(terms, k)), "search-plan")
        part = self.kept_blocks(plan).select("qid", "others", "tops", "least", F.explode("docs").alias("d")).groupBy("qid", "d.doc_id").agg(
            F.sum("d.impact").alias("part"), F.sum(F.pow("d.impact", 2)).alias("squares"), *[F.max(c).alias(c) for c in ("others", "tops", "least")]
        )
        lacks = F.least(F.col("tops"), F.sqrt(F.col("others") * F.greatest(F.lit(1.0) - F.col("squares"), F.lit(0.0))))
        reach = part.select("qid", "doc_id", "part", (F.col("part") + lacks).alias("most"), "least").where(F.col("most") >= F.col("least"))
        reach = written_table(reach, "search-candidates")
        # the best of these, scored, give a better bound for the rest
        least = self._kth(reach.select("qid", "doc_id", "part"), terms, k, SECOND)
        better = reach.join(least, "qid", "left").where(F.col("most") >= F.coalesce(F.col("kth") - SLACK, F.lit(0.0)))
        return top_ranks(self.completed(better.select("qid", "doc_id", "part"), plan), queries, self.view.corpus, k, tie_decimals)

    def _kth(self, parts: DataFrame, terms: DataFrame, k: int, some: int) -> DataFrame:
        """``qid, kth``: the k-th score among the ``k * some`` documents with the largest parts."""
        first = Window.partitionBy("qid").orderBy(F.col("part").desc(), "doc_id")
        best = parts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k * some).select("qid", "doc_id")
        score = Window.partitionBy("qid").orderBy(F.col("score").desc())
        kth = self.exact(best, terms).withColumn("_r", F.row_number().over(score)).where(F.col("_r") == k)
        return kth.select("qid", F.col("score").alias("kth"))

    def scanned(self, queries: DataFrame, k: int = 1) -> DataFrame:
        """``qid, postings, scanned``: postings of the query's terms, and those read, for the
        bound as well as for candidates."""
        terms = sized_table(self._terms(queries), "search-terms")
        read = self.kept_blocks(self.plan(terms, self.bounds(terms, k))).select("qid", "n").unionByName(self._first_blocks(terms).select("qid", "n"))
        every = terms.groupBy("qid").agg(F.sum("df").alias("postings"))
        return every.join(read.groupBy("qid").agg(F.sum("n").alias("scanned")), "qid", "left")


def top_ranks(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int, tie_decimals: int) -> DataFrame:
    """The best ``k`` of ``scores`` (qid, doc_id, score) per query, ties to the lowest id; the
    ``k`` lowest ids of ``docs`` fill up with score 0."""
    w = Window.partitionBy("qid").orderBy(_rounded("score", tie_decimals).desc(), F.col("doc_id").asc())

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    # cut first, by tasks: a lowest id that matched but is cut here has k better ones, with score 0 as well
    scores = best(scores).drop("rank")
    ids = [r[0] for r in docs.select("doc_id").orderBy("doc_id").limit(k).collect()]
    fallback = queries.select("qid", F.explode(F.array(*[F.lit(v) for v in ids])).alias("doc_id")).withColumn("score", F.lit(0.0)) if ids else None
    cand = scores if fallback is None else scores.unionByName(fallback)
    cand = cand.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))  # a fallback id that matched has its own score
    return best(cand).select("qid", "rank", "doc_id", "score")


def _rounded(c: str, decimals: int) -> Column:
    return F.round(c, decimals)
