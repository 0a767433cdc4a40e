"""Search by vectors, exact and approximate, and rules over rankings of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import scoring
from loomtext.operators.shared import is_small, saved, small

#: Numbers of query vectors that go to every task; vectors that one matrix product takes.
MOST_NUMBERS, ROWS, DIGITS = 4_000_000, 4096, 6


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list array whose lists all have `dims` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def similarity(metric: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of all queries with all rows; larger is nearer."""
    if metric == "ip":
        return q @ m.T
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * (q @ m.T), 0))
    nq, nm = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
    return (q @ m.T) / np.maximum(nq[:, None] * nm[None], 1e-300)


def whole(vectors: DataFrame, dims: int, id_: str = "vec_id") -> DataFrame:
    """(id, embedding) of the rows whose vector has `dims` numbers, none of them null; rows without an id are left out."""
    v = vectors.select(F.col(id_).cast("long").alias(id_), "embedding")
    return v.where(F.col(id_).isNotNull() & (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull()))


#: Of all queries with all rows, which are compared: a function of the queries' and the rows' vectors.
Among = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _nearest(ids: np.ndarray, q: np.ndarray, of: np.ndarray, m: np.ndarray, metric: str, least: float | None, among: Among | None) -> np.ndarray:
    """Similarities; -inf for a query's own id, for what is not compared and for what is below least when rounded."""
    s = similarity(metric, q, m)
    s[ids[:, None] == of[None]] = -np.inf
    if among is not None:
        s[~among(q, m)] = -np.inf
    if least is not None:
        s[np.round(s, DIGITS) < least] = -np.inf
    return s


def _best_rows(ids: np.ndarray, best: scoring.Best) -> pa.RecordBatch:
    question, (of,), value = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[question], of, value)], ["query_id", "vec_id", "score"])


#: What meets a slice of rows: of a new state for these queries, and of a row's ids and vectors what comes out at once and at the end.
Meet = Callable[[np.ndarray, np.ndarray], tuple[Callable[[np.ndarray, np.ndarray], None], Callable[[], pa.RecordBatch]]]


def _common(queries: DataFrame) -> tuple[int, int]:
    """The dimensions that most queries have, and how many."""
    sizes = queries.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    return (common.d, common.n) if common else (1, 0)


def _all_met(vectors: DataFrame, queries: DataFrame, dims: int, n: int, meet: Meet, schema: str, most: int) -> DataFrame:
    """All rows with all queries, of which about `n` have `dims` numbers. Queries of up to `most` numbers go to all tasks, and what
    a task has of its rows is a row batch of `schema`; more of them are blocks of rows that meet the vectors' blocks in a join."""
    data, asked = whole(vectors, dims), whole(queries, dims, "query_id").dropDuplicates(["query_id"])
    if n * dims > most:
        return _joined_blocks(data, asked, dims, meet, schema)
    rows = asked.orderBy("query_id").toArrow()
    q = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, dims)
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        add, out = meet(ids, q)
        step = max(1, min(ROWS, scoring.CELLS // max(1, len(ids))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                add(part.column(0).to_numpy(), _matrix(part.column(1), dims))
        yield out()

    return data.mapInArrow(run, schema)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", least: float | None = None, most: int = MOST_NUMBERS, dims: int | None = None, among: Among | None = None) -> DataFrame:
    """vectors(vec_id, embedding), queries(query_id, embedding): query_id, rank, vec_id, score; a query's own id takes no
    part. Vectors with a null, without an id or of other dimensions than `dims`, or than most of the queries, take none either. Each
    task keeps its best k of each query, and those are merged. Queries of up to `most` numbers go to all tasks; more of them are
    blocks of rows that meet the vectors' blocks in a join. least: scores below it are left out, which may leave none. among: only
    pairs that it names are looked at."""
    common, n = _common(queries)

    def meet(ids: np.ndarray, q: np.ndarray):
        best = scoring.Best(len(ids), k, 1)
        return lambda of, m: best.add(_nearest(ids, q, of, m, metric, least, among), [of], DIGITS), lambda: _best_rows(ids, best)

    return scoring.ranked(_all_met(vectors, queries, dims or common, n, meet, "query_id long, vec_id long, score double", most), k, ["vec_id"])


def compared(vectors: DataFrame, queries: DataFrame, dims: int, among: Among, most: int = MOST_NUMBERS) -> DataFrame:
    """One row `n`: how many pairs of a query and another row `among` names. Counted where the rows are; no pair becomes a row."""

    def meet(ids: np.ndarray, q: np.ndarray):
        total = [0]

        def add(of: np.ndarray, m: np.ndarray) -> None:
            total[0] += int((among(q, m) & (ids[:, None] != of[None])).sum())

        return add, lambda: pa.RecordBatch.from_arrays([pa.array(total, pa.int64())], ["n"])

    return _all_met(vectors, queries, dims, _common(queries)[1], meet, "n long", most).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _joined_blocks(data: DataFrame, asked: DataFrame, dims: int, meet: Meet, schema: str, spread: int = 64) -> DataFrame:
    def blocks(rows: int, key: str):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    held = part.column(0).to_numpy().astype("<i8").tobytes(), _matrix(part.column(1), dims).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], [f"{key}_ids", f"{key}_data"])

        return pack

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                add, out = meet(np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_data"]).reshape(-1, dims))
                add(np.frombuffer(r["c_ids"], "<i8"), np.frombuffer(r["c_data"]).reshape(-1, dims))
                yield out()

    rows = max(1, min(ROWS, (1 << 22) // dims))
    c = data.mapInArrow(blocks(rows, "c"), "c_ids binary, c_data binary").withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(spread)))
    q = asked.mapInArrow(blocks(rows // 4 or 1, "q"), "q_ids binary, q_data binary").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    # Spark sizes the repeated blocks as one of each and could send them all: the join is stated.
    return c.join(q.hint("merge"), "part").select("q_ids", "q_data", "c_ids", "c_data").mapInArrow(search, schema)


def group_means(vectors: DataFrame, group: str) -> DataFrame:
    """Mean cosine of pairs within and between groups, and the gap. From sums of unit vectors: the sum of a group's cosines
    is (|s|^2 - n) / 2, so no pairs are made."""
    from loomtext.functions.vector import unit

    parts = vectors.select(group, F.posexplode(unit("embedding")).alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"))
    sizes = vectors.groupBy(group).agg(F.count("*").alias("n"))
    own = parts.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("sq")).join(sizes, group)
    within = own.agg(F.sum((F.col("sq") - F.col("n")) / 2).alias("ws"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wn"), F.sum("n").alias("n"))
    whole = parts.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    both = within.crossJoin(F.broadcast(whole))  # a row each
    bn, bs = F.col("n") * (F.col("n") - 1) / 2 - F.col("wn"), (F.col("sq") - F.col("n")) / 2 - F.col("ws")
    w, b = F.col("ws") / F.col("wn"), bs / bn
    return both.select(F.round(w, 6).alias("within"), F.round(b, 6).alias("between"), F.round(w - b, 6).alias("gap"))


def mmr(pool: DataFrame, vectors: DataFrame, k: int = 3, weight: float = 0.5) -> DataFrame:
    """pool(query_id, vec_id, score), a bounded number of candidates for each query: k of them by maximal marginal
    relevance, weight * relevance - (1 - weight) * largest cosine with those chosen; ties by relevance, then id."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id").reset_index(drop=True)
        m = np.array(rows["embedding"].tolist(), float)
        cos = np.round(similarity("cosine", m, m), 6)
        rel, left, chosen, values = rows["score"].to_numpy(), list(range(len(rows))), [], []
        while left and len(chosen) < k:
            value = [round(weight * rel[i] - (1 - weight) * (max(cos[i, j] for j in chosen) if chosen else 0.0), 6) for i in left]
            best = max(range(len(left)), key=lambda x: (value[x], rel[left[x]], -rows["vec_id"][left[x]]))
            values.append(value[best])
            chosen.append(left.pop(best))
        return pd.DataFrame({"query_id": rows["query_id"][chosen], "rank": range(1, len(chosen) + 1), "vec_id": rows["vec_id"][chosen], "mmr": values})

    with_vectors = pool.join(vectors.select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", "score", "embedding")
    return with_vectors.groupBy("query_id").applyInPandas(choose, "query_id long, rank long, vec_id long, mmr double")


def _sign_bits(m: np.ndarray, normals: np.ndarray, tables: int, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by table, and how far each projection is from its plane."""
    far = (m @ normals.T).reshape(-1, tables, planes)
    return ((far > 0) * (1 << np.arange(planes))).sum(2), np.abs(far)


@dataclass
class Buckets:
    """Pairs of a query and a row that share a bucket in some table: signs of random projections, a bucket in each of several
    tables; queries look into the buckets across their nearest planes too, one plane each."""

    dims: int
    planes: int = 8
    tables: int = 32
    probes: int = 6
    seed: int = 7

    def _of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The planes' normals, and for each table and bucket the queries that look into it, a bit each."""
        if getattr(self, "_last", (None,))[0] is not q:
            normals = np.random.default_rng(self.seed).standard_normal((self.tables * self.planes, self.dims))
            bucket, far = _sign_bits(q, normals, self.tables, self.planes)
            near = np.argsort(far, axis=2)[:, :, : self.probes]
            every = np.concatenate([bucket[:, :, None], bucket[:, :, None] ^ (1 << near)], axis=2)
            looks = []
            for t in range(self.tables):
                held = np.zeros((1 << self.planes, len(q)), bool)
                held[every[:, t].ravel(), np.repeat(np.arange(len(q)), every.shape[2])] = True
                looks.append(np.packbits(held, axis=1))
            self._last = q, normals, np.stack(looks)
        return self._last[1:]

    def __call__(self, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        normals, looks = self._of(q)
        bucket, _ = _sign_bits(m, normals, self.tables, self.planes)
        found = np.zeros((len(m), looks.shape[2]), np.uint8)
        for t in range(self.tables):
            found |= looks[t][bucket[:, t]]
        return np.unpackbits(found, axis=1, count=len(q)).T.astype(bool)


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int, dims: int, planes: int = 8, tables: int = 32, probes: int = 6, most: int = MOST_NUMBERS) -> DataFrame:
    """Approximate nearest neighbours by cosine among the pairs of Buckets."""
    return knn(vectors, queries, k, most=most, dims=dims, among=Buckets(dims, planes, tables, probes))


def trained_cells(vectors: DataFrame, dims: int, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of a coarse quantizer: k-means of unit vectors on a sample of about `sample` rows, chosen by a hash of the id.
    Only the sample reaches the driver; every row is indexed."""
    rows = whole(vectors, dims)
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    m = np.array([r.embedding for r in chosen.orderBy("vec_id").collect()], float).reshape(-1, dims)
    m /= np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        of = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


@dataclass
class Cells:
    """Pairs of a query and a row that lies in one of the query's `probes` nearest cells; a row's cell is that of its nearest centre."""

    centres: np.ndarray
    probes: int

    def __call__(self, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        if getattr(self, "_last", (None,))[0] is not q:
            near = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.probes]
            looks = np.zeros((len(self.centres), len(q)), bool)
            looks[near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])] = True
            self._last = q, np.packbits(looks, axis=1)
        if not len(self.centres):
            return np.zeros((len(q), len(m)), bool)
        found = self._last[1][(m @ self.centres.T).argmax(1)]
        return np.unpackbits(found, axis=1, count=len(q)).T.astype(bool)


def cell_knn(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int, most: int = MOST_NUMBERS) -> tuple[DataFrame, DataFrame]:
    """Approximate nearest neighbours by cosine among the rows of each query's nearest cells; and one row `n`, how many pairs were
    compared."""
    among, dims = Cells(centres, probes), centres.shape[1]
    return knn(vectors, queries, k, most=most, dims=dims, among=among), compared(vectors, queries, dims, among, most)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean share of the exact neighbours that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def hash_vectors(docs: DataFrame, key: str, tokens: Column, dims: int = 256) -> DataFrame:
    """A sparse unit vector of token counts by bucket: key, bucket, w."""
    from loomtext.functions.text import hash_bucket

    counts = docs.select(key, F.explode(tokens).alias("t")).groupBy(key, hash_bucket(F.col("t"), dims).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, key).select(key, "bucket", (F.col("n") / F.col("length")).alias("w"))


@dataclass
class Hashed:
    """Cosine of hashed token counts: one product of matrices for a slice of documents and all questions."""

    questions: np.ndarray

    def __call__(self, lists) -> np.ndarray:
        dims = self.questions.shape[1]
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([int.from_bytes(md5(t.encode()).digest()[:4]) % dims for t in coded.dictionary.to_pylist()], np.int64)
        at = np.repeat(np.arange(len(length)), length) * dims
        if len(at):
            at += bucket[coded.indices.to_numpy(zero_copy_only=False)]
        m = np.bincount(at, minlength=len(length) * dims).reshape(-1, dims).astype(float)
        s = self.questions @ (m / np.maximum(np.sqrt((m**2).sum(1)), 1e-300)[:, None]).T
        return np.where(s > 0, s, -np.inf)


def hashed_top(docs: DataFrame, questions: DataFrame, k: int, tokens: Callable[[str], Column], dims: int = 256, most: int = scoring.MOST_WEIGHTS) -> DataFrame:
    """docs(doc_id, text), questions(query_id, query): the k documents of largest cosine of hashed token counts, a stand-in
    for a model's vectors: query_id, rank, doc_id, score. The questions' vectors go to the tasks up to `most` numbers."""
    asked = saved(hash_vectors(questions, "query_id", tokens("query"), dims))
    if not is_small(asked, most):
        both = hash_vectors(docs, "doc_id", tokens("text"), dims).join(asked.withColumnRenamed("w", "q"), "bucket")
        found = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("score"))
        return scoring.ranked(found, k, ["doc_id"])
    return scoring.search(docs, tokens("text"), *_dense_questions(asked.collect(), dims), k, ["doc_id"])


def _dense_questions(rows: list, dims: int) -> tuple[Hashed, np.ndarray]:
    ids = np.unique(np.array([r.query_id for r in rows], np.int64))
    matrix = np.zeros((len(ids), dims))
    for r in rows:
        matrix[np.searchsorted(ids, r.query_id), r.bucket] = r.w
    return Hashed(matrix), ids


def hashed_questions(questions: DataFrame, tokens: Callable[[str], Column], dims: int = 256) -> tuple[Hashed, np.ndarray]:
    """What scores documents by the cosine of hashed counts with these questions, and the questions with any token."""
    return _dense_questions(hash_vectors(questions, "query_id", tokens("query"), dims).collect(), dims)


def principal(vectors: DataFrame, dims: int, k: int = 2) -> DataFrame:
    """vec_id and k coordinates on the principal axes. The means and the d x d moments are aggregated by Spark; only they,
    whose size depends on the dimensions alone, reach the driver."""
    vectors = whole(vectors, dims)
    spread = vectors.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = np.zeros(dims)
    for r in spread.groupBy("i").agg(F.avg("x").alias("m")).collect():
        mean[r.i] = r.m

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims) - mean
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total.tolist())], ["i", "row"])

    rows = vectors.select("embedding").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    cov = np.zeros((dims, dims))
    for r in rows.collect():
        cov[r.i, r.j] = r.x
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:k]]
    axes *= np.sign(axes[np.abs(axes).argmax(0), range(k)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.round((_matrix(batch.column(1), dims) - mean) @ axes, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(xy[:, i]) for i in range(k))], ["vec_id", *(f"pc{i + 1}" for i in range(k))])

    return vectors.select("vec_id", "embedding").mapInArrow(place, "vec_id long, " + ", ".join(f"pc{i + 1} double" for i in range(k)))


def filtered_by_value(docs: DataFrame, spec: str, k: int, text: str = "text", dims: int = 256) -> DataFrame:
    """spec: `field=value`. docs(doc_id, text, the field): field, value, rank, doc_id, score, the k rows whose field, as text, is
    the value and whose hashed counts are most like those of the value. A spec of another form, or of a field that isn't there,
    gives no rows; a value without tokens ranks by doc_id."""
    import re

    from loomtext.functions.text import tokens

    found = re.fullmatch(r"\s*([A-Za-z_][\w-]*)\s*=\s*(.+?)\s*", spec or "", re.DOTALL)
    field, value = found.groups() if found else ("", "")
    spark = docs.sparkSession
    if field not in docs.columns:
        return spark.createDataFrame([], "field string, value string, rank long, doc_id long, score double")
    some = docs.where(F.col(f"`{field}`").cast("string") == value)
    asked = spark.createDataFrame([(0, value)], "query_id long, query string")
    hashed, ids = hashed_questions(asked, tokens, dims)
    rows = scoring.everywhere(some, tokens(text), {"score": (hashed, ids)}, np.zeros(1, np.int64), "doc_id")
    return scoring.ranked(rows, k, ["doc_id"]).select(F.lit(field).alias("field"), F.lit(value).alias("value"), "rank", "doc_id", "score")
