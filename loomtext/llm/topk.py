"""Exact top-k inner products by branch and bound over vertical blocks of dimensions.

Vectors are stored dimension by dimension. Scores of a block of queries against a block of candidates are accumulated
a few dimensions at a time. What the dimensions to come can still add or take is at most the product of the norms of
the two rests; candidates that cannot reach the k-th best score that is already certain are dropped, and the survivors
are compacted before the next dimensions. A block of candidates meets the blocks of queries one after another in a task;
the best k of each are merged. Blocks are bounded in bytes, however many dimensions there are, and rows are dealt to them
by a number of their own, so that equal rows spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import saved, table

#: Bytes of a block of candidates and of queries, at 8 for each component: 65,536 and 16,384 rows of 64 dimensions, 1,024
#: and 256 of 4,096. Least rows of a block where tasks are few; tasks to aim at; dimensions that are added at a time.
CANDIDATE_BYTES, QUERY_BYTES, LEAST, SPREAD, STEP = 1 << 25, 1 << 23, 1024, 16, 16


def quantized(vectors: DataFrame, vector: str) -> Column:
    """floor(256 x) of each component, null for a vector that is null or holds a null or a value that isn't finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (rows of q) its k best candidates (columns of c) but those of its own id: id, their ids and scores."""
    dims = len(c)
    order = np.argsort(-(np.abs(c).sum(1, dtype=float) * np.abs(q).sum(0, dtype=float)), kind="stable")
    largest = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if dims * largest * largest < 1 << 53 else np.int64  # sums in doubles are exact up to there
    q, c = q[:, order].astype(kind), c[order].astype(kind)
    steps = [slice(a, min(a + STEP, dims)) for a in range(0, dims, STEP)]
    # Norms of what is left after each step, rounded up.
    up = lambda x: np.sqrt(x) * (1 + 1e-9)
    c_left = [up((c[s.stop :].astype(float) ** 2).sum(0)) for s in steps]
    q_left = [up((q[:, s.stop :].astype(float) ** 2).sum(1)) for s in steps]
    group = max(1, (1 << 22) // max(1, c.shape[1]))
    for a in range(0, len(q), group):
        first = q[a : a + group, steps[0]] @ c[steps[0]] if steps else np.zeros((len(q[a : a + group]), c.shape[1]), kind)
        for i in range(len(first)):
            alive = np.flatnonzero(c_ids != q_ids[a + i])
            score = first[i, alive]
            for n in range(len(steps)):
                if n:
                    score = score + q[a + i, steps[n]] @ c[steps[n]][:, alive]
                if len(alive) > k and n < len(steps) - 1:
                    rest = q_left[n][a + i] * c_left[n][alive]
                    sure = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                    keep = score + rest >= sure - 1e-9 * abs(sure)
                    alive, score = alive[keep], score[keep]
            top = np.lexsort((c_ids[alive], -score))[:k]
            yield int(q_ids[a + i]), c_ids[alive[top]], score[top].astype(np.int64)


def _blocks(dims: int):
    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        flat = rows["v"].combine_chunks()
        at, size = flat.offsets.to_numpy(), flat.value_lengths().to_numpy()
        values = flat.values.to_numpy()
        matrix = np.zeros((dims, len(ids)), np.int64)
        for i in range(dims):
            has = size > i
            matrix[i, has] = values[at[:-1][has] + i]
        small = np.abs(matrix).max(initial=0) < 1 << 31
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "data": [matrix.astype("<i4" if small else "<i8").tobytes()], "width": pa.array([4 if small else 8], pa.int32())})

    return gather


def _searched(dims: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                matrix = lambda side, r=r: np.frombuffer(r[f"{side}_data"], f"<i{r[f'{side}_width']}").reshape(dims, -1)
                q_ids, c_ids = (np.frombuffer(r[f"{side}_ids"], "<i8") for side in "qc")
                found = list(best(q_ids, np.ascontiguousarray(matrix("q").T), c_ids, matrix("c"), k))
                if found:
                    n = [len(ids) for _, ids, _ in found]
                    columns = [np.repeat([f[0] for f in found], n), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return search


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """vectors(vec_id, vector), other columns ignored; is_query: a condition on them. Returns (query_id, rank, vec_id, score):
    for each query the k largest inner products of quantized vectors with those of other ids, ties by smaller vec_id.

    Rows with a null id or a vector that is null or holds a null or a value that isn't finite take no part. A shorter
    vector counts as zero in the dimensions that it lacks. Repeated rows are candidates each on their own, and a repeated
    query is asked once, with its smallest vector. No rows or no queries give no result. Inner products past 64 bits wrap around."""
    vectors = vectors.select("vec_id", is_query.alias("is_query"), quantized(vectors, vector).alias("v"))
    rows = saved(vectors.where("vec_id is not null and v is not null").withColumn("nth", F.monotonically_increasing_id()))
    n, asked, dims = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v"))).first()
    dims = max(1, dims or 1)
    most = lambda size: max(1, size // (8 * dims))
    n_c, n_q = max(-(-n // most(CANDIDATE_BYTES)), min(SPREAD, n // LEAST), 1), max(1, -(-asked // most(QUERY_BYTES)))
    schema = "block int, ids binary, data binary, width int"

    def packed(rows: DataFrame, number: str, many: int, side: str) -> DataFrame:
        blocks = rows.select(F.pmod(F.xxhash64(number), F.lit(many)).cast("int").alias("block"), "vec_id", "v").groupBy("block").applyInArrow(_blocks(dims), schema)
        return blocks.select(*[F.col(x).alias(f"{side}_{x}") for x in ("block", "ids", "data", "width")])

    # Blocks of queries are the smaller ones: they are repeated for each block of candidates, which moves once.
    once = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = packed(once, "vec_id", n_q, "q").withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c, q = packed(rows, "nth", n_c, "c").repartition(2 * n_c, "c_block"), queries.repartition(2 * n_c, "meets")
    pairs = c.join(q, F.col("c_block") == F.col("meets"))
    found = pairs.select("q_ids", "q_data", "q_width", "c_ids", "c_data", "c_width").mapInArrow(_searched(dims, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
with v as (select vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
