"""Corpus selection and ingest.

The reference fetches missing judged documents from a web API one by one.
Fetching is not a data job; here the work starts from a table of *landed*
responses ``doc_id, status_code, body`` (written by any fetcher), and the
selection, reshaping and routing are DataFrame jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import API_PAPER, CORPUS

RETRY_CODES = (403, 429)


def judged_doc_ids(judgements: DataFrame) -> DataFrame:
    """B1: distinct judged ``doc_id`` over all queries."""
    return judgements.select(F.explode("documents").alias("d")).select(F.col("d.doc_id").alias("doc_id")).distinct()


def corpus_ids(corpus: DataFrame) -> DataFrame:
    """B2: ids already in the corpus (an empty corpus gives none)."""
    return corpus.select(F.col("id").alias("doc_id"))


def missing_doc_ids(judgements: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged ids not yet in the corpus."""
    return judged_doc_ids(judgements).join(corpus_ids(corpus), "doc_id", "left_anti")


def selection_counts(judgements: DataFrame, corpus: DataFrame) -> DataFrame:
    """``total, missing`` in one aggregate over a left join."""
    ids = judged_doc_ids(judgements)
    have = corpus_ids(corpus).distinct().withColumn("_have", F.lit(True))
    return ids.join(have, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_have").isNull()).alias("missing")
    )


def route_responses(landed: DataFrame) -> DataFrame:
    """Add ``route``: 'corpus' (200 with a record in the body), 'retry' (403/429) or
    'error' (also a 200 whose body is no record)."""
    usable = F.from_json("body", API_PAPER)["paperId"].isNotNull()
    return landed.withColumn(
        "route",
        F.when((F.col("status_code") == 200) & usable, F.lit("corpus"))
        .when(F.col("status_code").isin(*RETRY_CODES), F.lit("retry"))
        .otherwise(F.lit("error")),
    )


def reshape_api_records(landed: DataFrame, citations_to: str = "in") -> DataFrame:
    """Successful API responses -> corpus records (``CORPUS`` schema).

    ``references[].paperId`` -> outCitations, ``citations[].paperId`` ->
    inCitations (``citations_to='out'`` appends them to outCitations as the
    reference does), ``authors[]`` -> ``{name, ids: [authorId]}``, venue to
    both venue and journalName, ``id`` = requested id, ``paperId`` -> s2id.
    """
    ok = landed.filter(F.col("status_code") == 200).select(
        F.col("doc_id").cast("string").alias("req_id"), F.from_json("body", API_PAPER).alias("r")
    ).where(F.col("r.paperId").isNotNull())
    refs = F.transform(F.coalesce(F.col("r.references"), F.array()), lambda x: x["paperId"])
    cits = F.transform(F.coalesce(F.col("r.citations"), F.array()), lambda x: x["paperId"])
    empty = F.array().cast("array<string>")
    if citations_to == "in":
        out_c, in_c = refs, cits
    elif citations_to == "out":
        out_c, in_c = F.concat(refs, cits), empty
    else:
        raise ValueError("citations_to must be 'in' or 'out'")
    authors = F.transform(
        F.coalesce(F.col("r.authors"), F.array()),
        lambda a: F.struct(a["name"].alias("name"), F.array(a["authorId"]).alias("ids")),
    )
    s = lambda c: F.coalesce(c, F.lit(""))
    cols = {
        "id": F.col("req_id"),
        "title": s(F.col("r.title")),
        "paperAbstract": s(F.col("r.abstract")),
        "venue": s(F.col("r.venue")),
        "journalName": s(F.col("r.venue")),
        "journalVolume": F.lit(""),
        "journalPages": F.lit(""),
        "year": F.col("r.year").cast("int"),
        "magId": F.lit(""),
        "pmid": F.lit(""),
        "s2id": s(F.col("r.paperId")),
        "doi": s(F.col("r.doi")),
        "doiUrl": F.lit(""),
        "s2Url": s(F.col("r.url")),
        "s2PdfUrl": F.lit(""),
        "authors": authors,
        "inCitations": in_c,
        "outCitations": out_c,
        "fieldsOfStudy": F.col("r.fieldsOfStudy"),
        "pdfUrls": empty,
        "sources": empty,
        "entities": empty,
    }
    return ok.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in CORPUS.fields])
