"""Approximate nearest neighbours by proximity graphs: rows are dealt to shards of bounded size, each shard's rows are joined to
neighbours that lie in different directions, and a query walks the graphs from row to row towards itself. What shards find is
merged. A query is compared with some hundreds of rows of a shard, however many that holds."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import scoring
from loomtext.operators.dense import _matrix, whole
from loomtext.operators.shared import saved

#: Rows of a shard on average; neighbours of a row; candidates that they are chosen from; rows that a walk keeps; queries of a
#: block.
SHARD_ROWS, NEIGHBOURS, CANDIDATES, KEPT, BLOCK = 16_384, 16, 64, 24, 512
_INDEX = "shard int, ids binary, vectors binary, links binary, starts binary"


def _unit(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]).astype(np.float32)


def linked(x: np.ndarray, neighbours: int = NEIGHBOURS, candidates: int = CANDIDATES) -> np.ndarray:
    """Unit vectors to a row of numbers for each: up to 2 * neighbours rows that it is linked to, -1 beyond. Of its nearest
    candidates a row takes, the nearest first, those that are nearer to it than to any it has taken, then the nearest others;
    links go both ways as long as there is room."""
    n = len(x)
    near = np.full((n, min(candidates, max(0, n - 1))), -1, np.int64)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        some = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[at : at + 1024]
        near[at : at + 1024] = np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable"), 1)
    out = np.full((n, 2 * neighbours), -1, np.int64)
    size = np.zeros(n, np.int64)
    back: list[tuple[int, int]] = []
    for i in range(n):
        c = near[i]
        own, between = x[c] @ x[i], x[c] @ x[c].T
        taken: list[int] = []
        for k in range(len(c)):
            if len(taken) < neighbours and (not taken or own[k] > between[k, taken].max()):
                taken.append(k)
        chosen = set(taken)
        taken += [k for k in range(len(c)) if k not in chosen][: neighbours - len(taken)]
        out[i, : len(taken)], size[i] = c[taken], len(taken)
        back += [(int(j), i) for j in c[taken]]
    for j, i in back:
        if size[j] < out.shape[1] and i not in out[j, : size[j]]:
            out[j, size[j]] = i
            size[j] += 1
    return out


def walked(x: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows that a walk towards the unit vector q found, by falling cosine, and how many it was compared with: it goes on
    from the nearest row that it hasn't left yet, as long as that is nearer than the farthest of the `kept` nearest so far."""
    seen = np.zeros(len(x), bool)
    seen[starts] = True
    s = x[starts] @ q
    open_ = [(-v, int(i)) for v, i in zip(s, starts, strict=True)]
    open_.sort()
    best = [(float(v), int(i)) for v, i in zip(s, starts, strict=True)]
    best.sort()
    best, compared = best[-kept:], len(starts)
    while open_:
        v, i = heappop(open_)
        if len(best) == kept and -v < best[0][0]:
            break
        new = links[i]
        new = new[new >= 0]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        compared += len(new)
        for w, j in zip((x[new] @ q).tolist(), new.tolist(), strict=True):
            if len(best) < kept:
                heappush(best, (w, j))
                heappush(open_, (-w, j))
            elif w > best[0][0]:
                heappop(best)
                heappush(best, (w, j))
                heappush(open_, (-w, j))
    best.sort(key=lambda b: (-b[0], b[1]))
    return np.array([j for _, j in best], np.int64), np.array([w for w, _ in best]), compared


def indexed(vectors: DataFrame, dims: int, neighbours: int = NEIGHBOURS, candidates: int = CANDIDATES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(vec_id, embedding) of `dims` numbers, others left out, to a row for each shard, kept in the shared folder: ids, unit
    vectors, links and where walks begin. Every row is in the index."""
    rows = whole(vectors, dims).withColumn("place", F.monotonically_increasing_id())
    rows = saved(rows)
    shards = max(1, -(-rows.count() // shard_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []

        def made() -> pa.RecordBatch:
            x, of = _unit(np.concatenate(parts)), np.concatenate(ids)
            # Walks begin at rows that are spread over the shard.
            starts = np.unique(np.linspace(0, len(x) - 1, min(len(x), 8)).astype(np.int64))
            packed = of.astype("<i8"), x.astype("<f4"), linked(x, neighbours, candidates).astype("<i4"), starts.astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in packed)], [c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    yield made()
                    ids, parts = [], []
                now = int(shard[a])
                part = batch.slice(a, b - a)
                ids.append(part.column(1).to_numpy().astype(np.int64))
                parts.append(_matrix(part.column(2), dims))
        if parts:
            yield made()

    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard")
    dealt = rows.select(shard, "vec_id", "embedding", "place").repartition(shards, "shard").sortWithinPartitions("shard", "place").drop("place")
    return saved(dealt.mapInArrow(build, _INDEX))


def graph_knn(index: DataFrame, queries: DataFrame, k: int, dims: int, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """index: of indexed(); queries(query_id, embedding), a stated set. (query_id, rank, vec_id, score), approximate neighbours by
    cosine, a query's own id left out; and (query_id, compared), with how many rows each query was compared. Queries travel in
    blocks to the shards; each walks a shard's graph and keeps its best k, and those are merged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held = part.column(0).to_numpy().astype("<i8").tobytes(), _unit(_matrix(part.column(1), dims)).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in held], ["of", "q"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, q, ids, vectors, links, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of, ids, starts = np.frombuffer(of, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8")
                q, x = np.frombuffer(q, "<f4").reshape(-1, dims), np.frombuffer(vectors, "<f4").reshape(-1, dims)
                links = np.frombuffer(links, "<i4").reshape(len(ids), -1).astype(np.int64)
                out: list[list] = [[], [], [], []]
                for name, v in zip(of.tolist(), q, strict=True):
                    found, score, compared = walked(x, links, starts, v, max(kept, k + 1))
                    other = ids[found] != name
                    found, score = found[other][:k], score[other][:k]
                    out[0] += [name] * (len(found) + 1)
                    out[1] += [*ids[found].tolist(), None]
                    out[2] += [*np.round(score.astype(float), 6).tolist(), None]
                    out[3] += [*[0] * len(found), compared]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "vec_id", "score", "compared"])

    blocks = whole(queries, dims, "query_id").mapInArrow(pack, "of binary, q binary")
    shards = F.array(*[F.lit(r.shard) for r in index.select("shard").collect()]) if not index.isEmpty() else F.array().cast("array<int>")
    both = blocks.withColumn("shard", F.explode(shards)).join(index, "shard").select("of", "q", "ids", "vectors", "links", "starts")
    found = saved(both.mapInArrow(search, "query_id long, vec_id long, score double, compared long"))
    near = scoring.ranked(found.where("vec_id is not null").select("query_id", "vec_id", "score"), k, ["vec_id"])
    return near, found.where("vec_id is null").groupBy("query_id").agg(F.sum("compared").alias("compared"))
