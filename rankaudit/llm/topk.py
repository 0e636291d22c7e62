"""Exact top-k search by inner product over a pivot-distance index.

Components are quantised to floor(256 x).  A vector gets one more coordinate,
sqrt(M^2 - |x|^2) with M at least the largest norm, and a query one of 0, so that
the largest inner product is the smallest Euclidean distance.  Every vector is keyed by its nearest
pivot and its distance from it; a pivot's vectors are cut at distance quantiles
into annuli.  A query visits annuli by the score they could hold at best, which
the triangle inequality bounds by |d(q, p) - d(x, p)|: first its own annulus, then
the most promising, then every other one whose bound still reaches the k-th score
found.  The last round leaves nothing out, so the answer is exact.

Pivots are fitted on at most ``SAMPLE`` rows; every row is indexed.  The table of
annuli has at most ``MAX_PIVOTS`` * ``RINGS`` rows and is all that the driver
gathers.  Neighbouring annuli of a pivot share a shard while they hold about ``CHUNK``
vectors together; a larger annulus is a shard of its own, cut into parts of that size
(hashed by row, so that thousands of equal vectors spread).  A query's vector travels
once to a shard, with one bit for every annulus that it visits there, and a part of
the index travels only to the blocks of queries that visit it.  Vectors are packed as
the narrowest integers that hold the largest norm.

Defined cases: a null vector, one with a null or non-finite component and a row
without id take no part; a shorter vector counts as padded with zeros; of rows
that repeat an id each is a candidate and, if the id qualifies, a query of its
own; ties go to the smaller id; an empty table gives an empty result; extra
columns are ignored.  Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankaudit.llm.store import drop_written, written

SAMPLE = 4_096
MAX_PIVOTS = 512
RINGS = 16
CHUNK = 1_000
QUERY_BLOCK = 16_384  # queries that share a copy of the parts they visit
QUERY_SLICE = 2_048  # queries scored at a time
NEXT = 8  # annuli visited in the second round
#: Shards and blocks up to so many narrow rows are broadcast; above it the join is shuffled.
SMALL = 400_000


def matrix(cells: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows, quantised and padded."""
    sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros((len(cells), dim))
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    out[np.repeat(np.arange(len(cells)), sizes), place] = np.floor(256.0 * cells.flatten().to_numpy(zero_copy_only=False))
    return out


def packing(m2: float) -> np.dtype:
    """The narrowest type that holds every component of vectors up to the squared norm ``m2``."""
    return np.dtype(next((t for t in (np.int16, np.int32) if np.sqrt(m2) < np.iinfo(t).max), np.float64))


def unpacked(cells: list[bytes], kind: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(-1, dim).astype(np.float64)


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def fit_pivots(x: np.ndarray, pivots: int, steps: int = 6, seed: int = 5) -> np.ndarray:
    """k-means centres of the augmented sample ``x``."""
    rng = np.random.default_rng(seed)
    centres = np.unique(x, axis=0)
    centres = centres[rng.permutation(len(centres))[:pivots]]
    for _ in range(steps):
        near = distances(x, centres).argmin(1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, c, minlength=len(centres)) for c in x.T], 1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows."""
    largest = (np.abs(q).max(initial=0) or 1) * (np.abs(x).max(initial=0) or 1) * max(1, q.shape[1])
    if largest < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def sharded(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, bit in its shard, parts of the shard) of every annulus, given in the order of ``cell``."""
    shard, bit = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
    held = np.zeros(len(cell), np.int64)
    at = -1
    for i, (c, size) in enumerate(zip(cell, n, strict=True)):
        joins = i > 0 and c // RINGS == cell[i - 1] // RINGS and held[at] + size <= CHUNK
        at += not joins
        shard[i], bit[i] = at, bit[i - 1] + 1 if joins else 0
        held[at] += size
    return shard, bit, -(-held[shard] // CHUNK)


class Annuli:
    """Where the annuli are, and which of them a query has to visit."""

    def __init__(self, pivots: np.ndarray, m2: float, rows: list) -> None:
        self.pivots, self.m2 = pivots, m2
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.low = np.array([r["low"] for r in rows])
        self.high = np.array([r["high"] for r in rows])
        self.shard, self.bit, self.parts = sharded(self.cell, np.array([r["n"] for r in rows], np.int64))
        self.slack = 1e-5 * np.sqrt(max(m2, 1.0))  # far above the rounding of a distance

    def best_scores(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the score in every annulus, one row per query.

        With extra coordinate 0 in the query, |q - x|^2 = |q|^2 + M^2 - 2 q.x for every
        augmented x, which is what the bound turns around."""
        d = distances(np.column_stack([q, np.zeros(len(q))]), self.pivots)[:, self.cell // RINGS]
        gap = np.maximum(0.0, np.maximum(self.low - d, d - self.high) - self.slack)
        return ((q * q).sum(1)[:, None] + self.m2 - gap * gap) / 2 + 1e-9 * self.m2 + 1e-3

    def visits(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, stage: int) -> np.ndarray:
        """Mask (query, annulus) of the visits of stage 0, 1 or 2; ``floor``: the k-th score known before stage 1."""
        home = self.cell[None, :] == own[:, None]
        if stage == 0:
            return home
        best = np.where(home, -np.inf, self.best_scores(q))
        place = best.argsort(1, kind="stable")[:, ::-1].argsort(1, kind="stable")
        first = place < NEXT
        return (first if stage == 1 else ~first) & ~home & (best >= floor[:, None])


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def build_index(vectors: DataFrame, id_col: str, vec_col: str):
    """(table of row, id, packed vector, cell, shard, bit, part; Annuli; dimensions), or None without vectors."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(_finite(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) * 256 + 1) * (F.abs(x) * 256 + 1))
    n, dim, m2 = v.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    drawn = matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), dim)
    pivots = fit_pivots(augmented(drawn, m2), int(np.clip(np.sqrt(n) / 4, 4, MAX_PIVOTS)))
    kind = packing(m2)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            d = distances(augmented(x, m2), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                 pa.array(near.astype(np.int64)), pa.array(d[np.arange(len(x)), near])],
                names=["row", "id", "x", "pivot", "dist"],
            )

    keyed = written(
        v.withColumn("row", F.monotonically_increasing_id()).mapInArrow(key, "row long, id long, x binary, pivot long, dist double"), "pivot-keys"
    )
    cuts = [i / RINGS for i in range(1, RINGS)]
    edges = keyed.groupBy("pivot").agg(F.percentile_approx("dist", cuts, 1000).alias("edges"))
    ring = F.size(F.filter("edges", lambda e: e < F.col("dist")))
    placed = written(  # edges: at most MAX_PIVOTS rows
        keyed.join(F.broadcast(edges), "pivot").select("row", "id", "x", "dist", (F.col("pivot") * RINGS + ring).alias("cell")), "pivot-index"
    )
    drop_written(keyed)
    cells = placed.groupBy("cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n"))
    annuli = Annuli(pivots, m2, cells.orderBy("cell").collect())
    shards = vectors.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in zip(annuli.cell, annuli.shard, annuli.bit, annuli.parts, strict=True)], "cell long, shard long, bit int, parts long"
    )
    index = placed.join(F.broadcast(shards), "cell")  # at most MAX_PIVOTS * RINGS rows
    return index.select("row", "id", "x", "cell", "shard", "bit", F.pmod(F.xxhash64("row"), "parts").alias("part")), annuli, dim


def _probes(queries: DataFrame, annuli: Annuli, dim: int, blocks: int, stage: int) -> DataFrame:
    """One row per part of a shard and batch of queries that visit it: their rows, vectors and visited annuli, packed."""
    kind = packing(annuli.m2)
    first = np.flatnonzero(annuli.bit == 0)  # annuli of a shard stand together

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_SLICE):
                batch = whole.slice(lo, QUERY_SLICE)
                rows = batch.column("row").to_numpy(zero_copy_only=False)
                x = unpacked(batch.column("x").to_pylist(), kind, dim)
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                mask = annuli.visits(x, batch.column("cell").to_numpy(zero_copy_only=False), floor, stage)
                bits = np.add.reduceat(mask.astype(np.int32) << annuli.bit, first, axis=1)  # RINGS bits at most
                packed = x.astype(kind)
                hit = np.flatnonzero(bits.any(0))
                asked = [bits[:, c] > 0 for c in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit), pa.array(annuli.parts[first[hit]]), pa.array(np.full(len(hit), int(rows[0]) % blocks)),
                     pa.array([rows[a].tobytes() for a in asked], pa.binary()), pa.array([packed[a].tobytes() for a in asked], pa.binary()),
                     pa.array([bits[a, c].astype(np.int32).tobytes() for a, c in zip(asked, hit, strict=True)], pa.binary())],
                    names=["shard", "parts", "block", "query_rows", "query_x", "query_bits"],
                )

    found = queries.select("row", "x", "cell", "floor").mapInArrow(
        visit, "shard long, parts long, block long, query_rows binary, query_x binary, query_bits binary"
    )
    return written(found, "probes")


def _scan(index: DataFrame, probes: DataFrame, annuli: Annuli, dim: int, k: int) -> DataFrame:
    """(query_row, row, id, score): the k best of every annulus in a part for every query that visits it."""
    kind = packing(annuli.m2)
    right = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    visits = probes.select(F.col("shard").alias("visited"), F.col("block").alias("visitor")).distinct()
    left = index.join(F.broadcast(visits) if visits.count() <= SMALL else visits, F.col("shard") == F.col("visited"))

    def best(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            rows, ids, bit = (vectors.column(c).to_numpy() for c in ("row", "id", "bit"))
            order = np.lexsort((rows, ids, bit))
            x = unpacked(vectors.column("x").to_pylist(), kind, dim)[order]
            rows, ids, bit = rows[order], ids[order], bit[order]
            spans = [(b, *np.searchsorted(bit, [b, b + 1])) for b in np.unique(bit)]
            for q_rows, q_x, q_bits in zip(*(queries.column(c).to_pylist() for c in ("query_rows", "query_x", "query_bits")), strict=True):
                every, wanted = np.frombuffer(q_rows, np.int64), np.frombuffer(q_bits, np.int32)
                packed = unpacked([q_x], kind, dim)
                for b, lo, hi in spans:
                    asks = np.flatnonzero(wanted >> b & 1)
                    scores = inner_products(packed[asks], x[lo:hi])
                    own = every[asks][:, None] == rows[lo:hi]
                    top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]  # one more: the query's own row is left out
                    take = ~np.take_along_axis(own, top, 1)
                    take &= take.cumsum(1) <= k
                    q, c = np.nonzero(take)
                    at = top[q, c]
                    found.append((every[asks][q], rows[lo:hi][at], ids[lo:hi][at], scores[q, at]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("query_row", "row", "id", "score"), columns, strict=True)))

    on = ["shard", "part", "block"]
    vectors = left.select("shard", "part", F.col("visitor").alias("block"), "row", "id", "x", "bit").groupBy(*on)
    return vectors.cogroup(right.select(*on, "query_rows", "query_x", "query_bits").groupBy(*on)).applyInArrow(
        best, "query_row long, row long, id long, score long"
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id satisfies ``is_query`` (over the column ``id``)."""
    built = build_index(vectors, id_col, vec_col)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, annuli, dim = built
    queries = index.where(is_query).select("row", F.col("id").alias("query_id"), "x", "cell")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    unknown = F.lit(float("-inf"))
    probes = _probes(queries.withColumn("floor", unknown), annuli, dim, blocks, 0)
    hits = written(_best(_scan(index, probes, annuli, dim, k), k).drop("rank"), "top-hits")
    drop_written(probes)
    for stage in (1, 2):
        floors = hits.groupBy(F.col("query_row").alias("row")).agg(
            F.when(F.count("*") >= k, F.min("score")).otherwise(unknown).cast("double").alias("floor")
        )
        with_floor = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", unknown))
        probes = _probes(with_floor, annuli, dim, blocks, stage)
        better = written(_best(hits.unionByName(_scan(index, probes, annuli, dim, k)), k).drop("rank"), "top-hits")
        drop_written(probes, hits)
        hits = better
    return (
        _best(hits, k).join(queries.select(F.col("row").alias("query_row"), "query_id"), "query_row")
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
