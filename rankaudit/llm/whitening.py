"""Embedding whitening on MLlib's distributed block matrices.

The centred vectors become an IndexedRowMatrix and its BlockMatrix.  Transpose times
matrix, with the rows split over many partial products, gives the scatter; the driver
takes the eigenvectors of that one dimension x dimension matrix; a second block
multiplication, by the whitening matrix, projects all rows, and a third measures how far
the covariance of what came out is from the identity.  Rows pass from DataFrame to blocks
and back inside the JVM.  Only the per-dimension sums, one row count for each written
partition and matrices of the width of a vector reach the driver.

An entry c counts as the integer ``floor(64 * c)``.  The contract's offset of 1,000,000
is left out of the arithmetic, as every result is free of it: centred values, and the
deviations ``sum of (n*x - S)^2`` as well, which are computed in whole numbers (decimals
where the sums could pass a long; null where the result itself does).

Defined cases: rows whose vector is null or holds null or non-finite entries are left out;
a vector shorter than the longest counts as followed by zeros; entries beyond
``LARGEST`` count as that; a component without variance (fewer rows than dimensions,
constant columns) has whitened 0 and explained 0 and is not part of identity_error;
repeated rows are rows; a null id stays; extra columns are ignored; no vectors, or only
empty ones, give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankaudit.llm.store import written

SCALE = 64
#: Largest size of an entry after scaling.
LARGEST = 2**40
#: Entries of a block (4 MB of doubles), and columns of a block.
BLOCK, WIDE = 2**19, 1024
#: Share of the largest eigenvalue below which a component has no variance.
NO_VARIANCE = 1e-12
#: Partial products that a scatter is summed from, for each of the cluster's cores.
PARTS = 2


def _usable(vec: str) -> Column:
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vec).isNotNull() & ~bad


def _whole(c: Column) -> Column:
    """The scaled entry as a whole number."""
    low, high = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    return F.greatest(low, F.least(high, F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` plus index, without gaps from 0: a written partition's offset plus the place in it."""
    mask = F.lit((1 << 33) - 1)
    rows = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(mask).alias("place"))
    rows = written(rows, "whiten-rows")
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row a partition
    starts = np.cumsum([0] + [c for _, c in counts]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "part int, start long")
    return rows.join(offsets, "part").select(*[c for c in rows.columns if c not in ("part", "place")], (F.col("start") + F.col("place")).alias("index"))


def _product(left: BlockMatrix, right: BlockMatrix, parts: int) -> np.ndarray:
    """left times right on the driver (both of a vector's width), summed from ``parts`` partial products."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()


def _blocks(spark, matrix: np.ndarray, rows_a_block: int) -> BlockMatrix:
    n, k = matrix.shape
    cut = [(i, matrix[i : i + rows_a_block]) for i in range(0, n, rows_a_block)]
    made = [((i // rows_a_block, 0), DenseMatrix(*b.shape, b.ravel(order="F").tolist())) for i, b in cut]
    return BlockMatrix(spark.sparkContext.parallelize(made, 1), rows_a_block, k, n, k)


def _deviation(x: Column, sums: list[int], n: int, largest: int) -> Column:
    """sum over dimensions of (n * x - S)^2 = n^2 A - 2 n B + C, exact; null beyond a long."""
    most = largest * max(largest, *map(abs, sums), 1) * len(sums)
    kind = "long" if most < 2**62 else "decimal(38,0)"
    s = F.array(*[F.lit(v) for v in sums])
    add = lambda acc, v: acc + v
    zero = F.lit(0).cast(kind)
    if kind == "long":
        a, b = F.aggregate(F.transform(x, lambda v: v * v), zero, add), F.aggregate(F.zip_with(x, s, lambda v, t: v * t), zero, add)
    else:
        add = lambda acc, v: (acc + v).cast(kind)
        wide = lambda v: v.cast("decimal(19,0)")
        a = F.aggregate(F.transform(x, lambda v: wide(v) * wide(v)), zero, add)
        b = F.aggregate(F.zip_with(x, s, lambda v, t: wide(v) * wide(t)), zero, add)
    c = sum(v * v for v in sums)
    if c >= 10**38 or n * n >= 10**38:
        return F.lit(None).cast("long")
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    total = F.try_add(F.try_subtract(F.try_multiply(a.cast("decimal(38,0)"), big(n * n)), F.try_multiply(b.cast("decimal(38,0)"), big(2 * n))), big(c))
    return total.try_cast("long")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector: id_col, n, deviation, whitened (array of its first
    ``components`` whitened values), explained (array, the same for all) and identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(_usable("vec"))
    x = _numbered(rows.select("id", F.transform("vec", _whole).alias("x")))
    shape = ["id", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    per = x.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.max(F.abs("v")).alias("m"))
    found = sorted((r["dim"], int(r["s"]), r["m"]) for r in per.collect())  # one row a dimension
    if not found:
        return x.select("id", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in schema.split(", ")]).limit(0).withColumnRenamed("id", id_col)
    n, d = x.count(), len(found)
    sums, largest = [s for _, s, _ in found], max(m for _, _, m in found)
    x = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))

    means = F.lit(np.array([s / n for s in sums]))
    centred = x.select("index", array_to_vector(F.zip_with("x", means, lambda v, m: v.cast("double") - m)).alias("vector"))
    cores = max(1, spark.sparkContext.defaultParallelism)
    width = min(d, WIDE)
    tall = max(1, min(BLOCK // width, -(-n // (4 * cores))))
    parts = min(-(-n // tall), PARTS * cores)
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d).toBlockMatrix(tall, width)
    covariance = _product(blocks.transpose(), blocks, parts) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]

    k = min(components, d)
    varies = values[:k] > NO_VARIANCE * values[0]
    whitening = axes[:, :k] * np.where(varies, 1 / np.sqrt(np.where(varies, values[:k], 1.0)), 0.0)
    projected = blocks.multiply(_blocks(spark, whitening, width))
    error = np.abs(_product(projected.transpose(), projected, parts) / n - np.diag(varies.astype(float))).max()
    trace = values.sum()
    explained = np.where(varies, values[:k] / (trace or 1.0), 0.0)

    lines = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    lines = MLUtils.convertVectorColumnsToML(lines, "vector").select("index", vector_to_array("vector").alias("whitened"))
    return (
        x.select("id", "index", _deviation(F.col("x"), sums, n, largest).alias("deviation")).join(lines, "index")
        .select("*", F.lit(n).cast("long").alias("n"), F.lit(explained).alias("explained"), F.lit(float(error)).alias("identity_error"))
        .select(*shape).withColumnRenamed("id", id_col)
    )


def whitened_components(embeddings: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = whiten(embeddings)
    each = rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error"
    )
