"""Explicit schemas (no inference) for every model table."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
ARR_S = T.ArrayType(S)

AUTHOR = T.StructType([T.StructField("name", S), T.StructField("ids", ARR_S)])

CORPUS = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("title", S),
        T.StructField("paperAbstract", S),
        T.StructField("venue", S),
        T.StructField("journalName", S),
        T.StructField("journalVolume", S),
        T.StructField("journalPages", S),
        T.StructField("year", I),
        T.StructField("magId", S),
        T.StructField("pmid", S),
        T.StructField("s2id", S),
        T.StructField("doi", S),
        T.StructField("doiUrl", S),
        T.StructField("s2Url", S),
        T.StructField("s2PdfUrl", S),
        T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("inCitations", ARR_S),
        T.StructField("outCitations", ARR_S),
        T.StructField("fieldsOfStudy", ARR_S),
        T.StructField("pdfUrls", ARR_S),
        T.StructField("sources", ARR_S),
        T.StructField("entities", ARR_S),
    ]
)

CORPUS_STRING_FIELDS = [f.name for f in CORPUS.fields if isinstance(f.dataType, T.StringType)]

PAPERS = T.StructType(
    [
        T.StructField("paper_sha", S),
        T.StructField("paper_title", S),
        T.StructField("paper_year", I),
        T.StructField("paper_venue", S),
        T.StructField("n_key_citations", I),
        T.StructField("n_citations", I),
    ]
)

AUTHORS = T.StructType(
    [
        T.StructField("corpus_author_id", L),
        T.StructField("name", S),
        T.StructField("num_citations", L),
        T.StructField("num_papers", L),
        T.StructField("i10", L),
        T.StructField("h_index", I),
        T.StructField("h_class", S),
    ]
)

PAPER_AUTHORS = T.StructType(
    [T.StructField("paper_sha", S), T.StructField("corpus_author_id", L), T.StructField("position", I)]
)

GROUPS = T.StructType([T.StructField("author_id", L), T.StructField("gid", S)])

JUDGEMENTS = T.StructType(
    [
        T.StructField("qid", L),
        T.StructField("query", S),
        T.StructField(
            "documents",
            T.ArrayType(T.StructType([T.StructField("doc_id", S), T.StructField("relevance", D)])),
        ),
    ]
)

LINKER = T.StructType([T.StructField("libsvm_id", L), T.StructField("document_id", L)])

API_PAPER = T.StructType(
    [
        T.StructField("paperId", S),
        T.StructField("title", S),
        T.StructField("abstract", S),
        T.StructField("year", I),
        T.StructField("venue", S),
        T.StructField("doi", S),
        T.StructField("url", S),
        T.StructField("fieldsOfStudy", ARR_S),
        T.StructField("references", T.ArrayType(T.StructType([T.StructField("paperId", S)]))),
        T.StructField("citations", T.ArrayType(T.StructType([T.StructField("paperId", S)]))),
        T.StructField(
            "authors", T.ArrayType(T.StructType([T.StructField("name", S), T.StructField("authorId", S)]))
        ),
    ]
)

LANDED = T.StructType([T.StructField("doc_id", S), T.StructField("status_code", I), T.StructField("body", S)])

SCHEMAS = {
    "corpus": CORPUS,
    "papers": PAPERS,
    "authors": AUTHORS,
    "paper_authors": PAPER_AUTHORS,
    "groups": GROUPS,
    "judgements": JUDGEMENTS,
    "linker": LINKER,
    "landed": LANDED,
}
