"""Operator 6, exact top-k search: norm-bucketed retrieval of integer inner products.

1. Vectors become whole numbers and are dealt by length into buckets of equal size, split
   again by a hash where a bucket is large; equal lengths are dealt by id.
2. Each query's score with the 4,096 longest vectors (a bounded broadcast) gives a lower
   bound of its k-th best score, and so, against a bucket's longest vector, a cosine that
   a row there must reach. Buckets that can't reach it are left out before the shuffle.
3. In a bucket, a query with a high threshold prunes rows by its three largest
   coordinates (the range that the cosine leaves each), another by length alone. What is
   left is verified by exact products.
4. A window takes the k best of what the buckets found. Equal rows travel as one, with
   their number, and are told apart again here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import NO_ID, stored, table

#: Rows of a bucket, buckets at most, rows of a bucket's part, queries of a block, and rows that give the first bounds.
BUCKET_ROWS, BUCKETS, PART_ROWS, BLOCK_QUERIES, HEADS = 512, 4096, 16_384, 16_384, 4096
#: From this cosine on, coordinates prune better than lengths.
COORDINATES_FROM = 0.5


def whole_numbers(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q: floor(scale * x) as long, n, norm, dim) of the rows whose components are all finite; n equal rows as one."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    q = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q")).groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("n"))
    return q.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).withColumn("dim", F.size("q"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def id_array(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as whole numbers, a null as the greatest."""
    return pa.compute.fill_null(column.cast(pa.int64()), NO_ID).to_numpy()


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point while it holds them exactly, else in 64-bit integers."""
    bound = np.abs(rows).max(initial=0) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    return (rows.astype(float) @ query.astype(float).T).astype(np.int64) if bound < 2**53 else rows @ query.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_bucket(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, query_id, query: np.ndarray, norm: float, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of a bucket's rows that may be among a query's k best: those that reach ``floor``. norms fall."""
    if norm == 0 or floor <= 0:
        left = np.arange(len(rows))
    else:
        need = floor / norm * (1 - 1e-9)  # the length of a projection on the query
        left = np.arange(np.searchsorted(-norms, -need, "right"))
        if len(left) and need / norms[0] >= COORDINATES_FROM:
            cosine, unit = min(1.0, need / norms[0]), query / norm
            for f in np.argsort(-np.abs(unit))[:3]:
                # a unit vector within the angle of the query has this coordinate near the query's
                spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] * unit[f])))
                low = unit[f] * cosine - spread if unit[f] > -cosine else -1.0
                high = unit[f] * cosine + spread if unit[f] < cosine else 1.0
                at = rows[left, f] / norms[left]
                left = left[(at >= low - 1e-9) & (at <= high + 1e-9)]
    left = left[ids[left] != query_id]
    scores = products(rows[left], query)
    good = scores >= floor
    left, scores = left[good], scores[good]
    top = best(scores, ids[left], k)
    return left[top], scores[top]


def top_k(df: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``; a query's candidates are the rows of
    other ids with as many components. Rows with a null vector, or null or non-finite
    components, take no part. Equal rows are as many candidates, but one query. A null id is
    a candidate, after all others in ties, and no query. Two vectors of one query id are two
    queries, both returned. Products are exact while they fit 64 bits, and wrap beyond, as
    whole numbers in Spark without ANSI checks do. An empty vector has score 0 with another.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType
    vectors = stored(whole_numbers(df, scale, id_col, vec_col), "vectors")
    n = vectors.count()
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    split = -(-n // (buckets * PART_ROWS)) or 1
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(split)).cast("int")
    vectors = stored(vectors.repartitionByRange(buckets, F.desc("norm"), "vec_id").select("*", F.spark_partition_id().alias("bucket")).withColumn("part", part), "buckets")
    heads = vectors.orderBy(F.desc("norm"), "vec_id").limit(HEADS).select("vec_id", "q", "dim").toArrow()
    longest = {(r["dim"], r["bucket"]): r["norm"] for r in vectors.groupBy("dim", "bucket").agg(F.max("norm").alias("norm")).collect()}  # 4,096 a dimension at most
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("q").alias("query"), "q", "norm", "dim")
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    by_dim = {d: heads.filter(pa.compute.equal(heads.column("dim"), d)) for d in set(heads.column("dim").to_pylist())}
    first = {d: (id_array(h.column("vec_id")), matrix(h.column("q"), d)) for d, h in by_dim.items()}

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's lower bound, and the buckets that may hold better rows."""
        for batch in batches:
            floors, reach = [], []
            for i, q, norm, dim in zip(*(batch.column(c).to_pylist() for c in ("query_id", "q", "norm", "dim")), strict=True):
                ids, rows = first.get(dim, (np.empty(0), np.empty((0, dim), np.int64)))
                scores = products(rows[ids != i], np.array(q, np.int64))
                floor = float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf
                floors.append(floor)
                reach.append([b for (d, b), most in longest.items() if d == dim and most * norm * (1 + 1e-9) >= floor])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64()), pa.array(reach, pa.list_(pa.int32()))], [*batch.schema.names, "floor", "reach"])

    name = kind.simpleString()
    asked = queries.mapInArrow(bounds, f"query_id {name}, query long, q array<long>, norm double, dim int, floor double, reach array<int>")
    asked = asked.withColumn("block", F.pmod("query", F.lit(blocks)).cast("int")).withColumn("bucket", F.explode("reach")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))).drop("reach")
    rows = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "bucket", "part", "block"]

    def search(own: pa.Table, questions: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(questions):
            dim = own.column("dim")[0].as_py()
            ids = id_array(own.column("vec_id"))
            norms = own.column("norm").to_numpy()
            order = np.argsort(-norms, kind="stable")
            ids, norms, q, n = ids[order], norms[order], matrix(own.column("q"), dim)[order], own.column("n").to_numpy()[order]
            asking = matrix(questions.column("q"), dim)
            for j, (i, h, norm, floor) in enumerate(zip(*(questions.column(c).to_pylist() for c in ("query_id", "query", "norm", "floor")), strict=True)):
                found, scores = search_bucket(ids, q, norms, i, asking[j], norm, floor, k)
                out += [(i, h, None if x == NO_ID else x, s, m) for x, s, m in zip(ids[found].tolist(), scores.tolist(), n[found].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        id_type = own.schema.field("vec_id").type
        return pa.table([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], id_type), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["query_id", "query", "vec_id", "score", "n"])

    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, f"query_id {name}, query long, vec_id {name}, score long, n long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    near = found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    near = near.withColumn("_before", upto).filter(F.col("_before") < k)
    ranks = F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("n"), F.lit(k).cast("long")))
    return near.select("query_id", F.explode(ranks.cast("array<int>")).alias("rank"), "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.q AS query, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
