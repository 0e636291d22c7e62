"""Sources and sinks.

Model tables are read with explicit schemas.  The ranking text format is the
svmlight variant the reference writes: ``"{rel} qid:{qid} 0:v 1:v …"`` with
0-based feature indices and a null feature omitted (leaving a double space).
Spark's ``libsvm`` source is 1-based and has no ``qid``, so the format is
parsed with SQL string functions.  Row order matters for this format (the
linker matches feature rows to documents by line number): writers sort by the
ordinal, the reader numbers lines by file, block of the file and place in the
block.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .idstore import IdStore
from .schemas import CORPUS, CORPUS_STRING_FIELDS, GROUPS, JUDGEMENTS, LINKER, SCHEMAS


# A1
def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS) -> DataFrame:
    """jsonl corpus; string nulls become ''."""
    df = spark.read.schema(schema).json(path).select(*schema.fieldNames())  # without the folders of batches
    strings = [c for c in CORPUS_STRING_FIELDS if c in df.columns]
    return df.na.fill("", subset=strings)


# A2
def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """csv with a header line (pandas-style quoting).  ``multi_line`` allows line ends
    inside quotes, at the price of one task per file; ``strict`` makes a value that
    does not parse an error instead of null."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if strict:
        r = r.option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


# A3
def load_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """``{name: path}`` -> ``{name: DataFrame}`` dispatching on the suffix
    (.csv, .jsonl/.json, .parquet); any other suffix raises."""
    out: dict[str, DataFrame] = {}
    for name, p in paths.items():
        schema = SCHEMAS.get(name)
        if p.endswith(".csv"):
            out[name] = read_table_csv(spark, p, schema)
        elif p.endswith(".jsonl") or p.endswith(".json"):
            out[name] = read_corpus(spark, p) if name in ("corpus", "corpus_file") else spark.read.schema(schema).json(p) if schema else spark.read.json(p)
        elif p.endswith(".parquet"):
            out[name] = spark.read.parquet(p)
        else:
            raise ValueError(f"unsupported input {name}: {p}")
    return out


# A4
def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGEMENTS).json(path)


def explode_judgements(judgements: DataFrame) -> DataFrame:
    """Nested judgements -> ``qid, query, pos, doc_id, relevance``."""
    return judgements.select("qid", "query", F.posexplode("documents").alias("pos", "d")).select(
        "qid", "query", "pos", F.col("d.doc_id").alias("doc_id"), F.col("d.relevance").alias("relevance")
    )


# A5
def write_trec_tables(papers: DataFrame, authors: DataFrame, links: DataFrame, out_dir: str, fmt: str = "csv") -> None:
    for name, df in (("papers", papers), ("authors", authors), ("paper_authors", links)):
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("escape", '"').csv(os.path.join(out_dir, name))
        else:
            w.parquet(os.path.join(out_dir, name))


# A8 (ordinals)
def assign_ordinals(df: DataFrame, qid: str = "qid", within: str = "doc_id", col: str = "ord") -> DataFrame:
    """0-based file ordinal: queries in ``qid`` order, rows in ``within``
    order.  A query's offset is a running sum over the per-query count table inside
    its range partition plus the partition's own offset, so no task sees more than
    a range of queries and only one row per partition is ordered globally."""
    counts = df.groupBy(qid).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(qid)
    counts = written_table(counts.withColumn("_p", F.spark_partition_id()), "query-counts")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_p").agg(F.sum("_n").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_p").orderBy(qid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(ranges, "_p").select(qid, (F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_off"))
    inner = Window.partitionBy(qid).orderBy(within)
    return (
        df.join(offsets, qid)
        .withColumn(col, (F.col("_off") + F.row_number().over(inner) - 1).cast("bigint"))
        .drop("_off")
    )


def _fmt(c):
    return c.cast("string")


# A6
def ranking_lines(rows: DataFrame, *, rel: str = "relevance", qid: str = "qid", features: str = "features") -> DataFrame:
    """``ord, line`` with ``line = "{rel} qid:{qid} 0:v 1:v …"``; a null
    feature becomes an empty token (double space), as the reference writes."""
    toks = F.transform(features, lambda v, i: F.when(v.isNull(), F.lit("")).otherwise(F.concat(i.cast("string"), F.lit(":"), _fmt(v))))
    line = F.concat_ws(" ", _fmt(F.col(rel)), F.concat(F.lit("qid:"), F.col(qid).cast("string")), F.array_join(toks, " "))
    return rows.select("ord", line.alias("line"))


def write_ranking_text(rows: DataFrame, path: str, **kw) -> None:
    """Text file(s) in ordinal order (range-partitioned sort; part files are
    in order)."""
    ranking_lines(rows, **kw).orderBy("ord").select("line").write.mode("overwrite").text(path)


def write_linker(rows: DataFrame, path: str, doc: str = "doc_id") -> None:
    """``libsvm_id,document_id`` csv, ordinal order."""
    rows.select(F.col("ord").alias("libsvm_id"), F.col(doc).alias("document_id")).orderBy("libsvm_id").write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def read_linker(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """``libsvm_id, document_id`` with document ids of ``doc_type``; an id of another type is an error."""
    schema = T.StructType([LINKER["libsvm_id"], T.StructField("document_id", T.StructType.fromDDL(f"x {doc_type}")["x"].dataType)])
    return read_table_csv(spark, path, schema, strict=True)


# A7
def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, ord``: the lines of text files by file name, block and place.  Rows of a
    block are read in order by one task, so a line's place is its distance from the
    block's first; only one row per block is ordered."""
    at = ["file", "block"]
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
    )
    blocks = lines.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*at, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(blocks, at).select("line", (F.col("offset") + F.col("seen") - F.col("first")).alias("ord"))


def read_ranking_text(spark: SparkSession, path: str, n_features: int | None = None, zero_based: bool | None = None) -> DataFrame:
    """``ord, rel, qid, features ARRAY<DOUBLE>`` (absent index -> 0.0).

    ``zero_based=None``: indices are 0-based when any index 0 occurs, else 1-based
    (the svmlight reader's "auto" rule); files of ``write_ranking_text`` are 0-based
    even if feature 0 is null everywhere.  The width is max index + 1 unless given."""
    lines = numbered_lines(spark, path)
    parts = lines.select("ord", F.split("line", " ").alias("t"))
    kv = F.filter(F.slice("t", 3, 1 << 30), lambda x: x != "")
    parsed = parts.select(
        "ord",
        F.col("t")[0].cast("double").alias("rel"),
        F.regexp_extract(F.col("t")[1], r"^qid:(.*)$", 1).cast("bigint").alias("qid"),
        F.transform(
            kv,
            lambda x: F.struct(
                F.substring_index(x, ":", 1).cast("int").alias("k"), F.substring_index(x, ":", -1).cast("double").alias("v")
            ),
        ).alias("kv"),
    )
    lo, hi = 0, -1
    if zero_based is None or n_features is None:  # else the text is parsed once
        idx = parsed.select(F.explode("kv.k").alias("k")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
        lo = 0 if idx["lo"] is None else int(idx["lo"])
        hi = -1 if idx["hi"] is None else int(idx["hi"])
    base = (0 if lo == 0 else 1) if zero_based is None else 0 if zero_based else 1
    width = n_features if n_features is not None else hi - base + 1
    m = F.map_from_entries(F.transform("kv", lambda e: F.struct((e["k"] - base).alias("k"), e["v"].alias("v"))))
    return parsed.select(
        "ord",
        "rel",
        "qid",
        F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.coalesce(m[i], F.lit(0.0))).alias(
            "features"
        )
        if width > 0
        else F.array().cast("array<double>").alias("features"),
    )


# A9
def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return read_table_csv(spark, path, GROUPS)


# A10
def append_corpus(records: DataFrame, path: str, key: str = "id", batch: str | None = None) -> None:
    """Add the records whose ``key`` the corpus at ``path`` does not have, one for each key.  A
    batch has a folder of its own: one that is appended again under its name (after a
    failure, say) is written anew and changes nothing.  The ids lie beside the corpus."""
    spark, batch = records.sparkSession, batch or uuid.uuid4().hex
    store = IdStore(spark, f"{path.rstrip('/')}.ids")
    new = store.missing(records.where(F.col(key).isNotNull()).dropDuplicates([key]), key, batch)
    folder = f"{path.rstrip('/')}/batch={batch}"
    new.write.mode("overwrite").json(folder)
    store.add(spark.read.schema(new.schema).json(folder), key, batch)


# A11
def save_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(spark: SparkSession, model, path: str) -> None:
    """One row ``weights, intercept, iterations, grad_norm, objective, converged, means, stds``."""
    schema = (
        "weights array<double>, intercept double, iterations int, grad_norm double, objective double, converged boolean, "
        "means array<double>, stds array<double>"
    )
    row = (model.weights, model.intercept, model.iterations, model.grad_norm, model.objective, model.converged, model.means, model.stds)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    from ..operators.ranksvm import RankModel

    r = spark.read.parquet(path).first()
    return RankModel(
        list(r["weights"]), r["intercept"], r["iterations"], r["grad_norm"], r["objective"], r["converged"], means=r["means"], stds=r["stds"]
    )


# A12
def preview(tables: dict[str, DataFrame], max_rows: int = 10) -> dict[str, DataFrame]:
    return {k: v.limit(max_rows) for k, v in tables.items()}
