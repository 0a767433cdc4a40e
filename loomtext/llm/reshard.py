"""Resharding by minimum-cost flow.

From the bytes that each old shard holds and the bytes that each new shard is to hold, a minimum-cost flow decides how
much goes from where to where, at a cost of one a byte moved and nothing for a byte that stays. The flow depends on the
shards only, never on the rows. It is then laid out over the rows: an old shard's rows, in order of blocks, form a line
of bytes; the flows out of that shard cut the line into stretches; a row goes where its first byte lies. Sums over blocks
give each block its place, so that no task ever orders more than a block of rows. Then the files of the shards whose rows
change are written anew.

Rows are told apart by a key of their own, not by what they hold: repeated rows, equal texts and null ids are dealt over
blocks, shards and files like any others, also where a third of all rows is one text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import file_row, saved, shared_folder, small, table, utf8

#: Shards before and after, for the query; rows and bytes of a block on average; least blocks of
#: an old shard; bytes that each row takes beside its text.
OLD, NEW, BLOCK_ROWS, BLOCK_BYTES, LEAST_BLOCKS, ROW_BYTES = 32, 40, 4000, 64 << 20, 8, 16


@dataclass
class Edge:
    to: int
    left: int
    cost: int
    back: int


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest way to send all of supply to demand (equal sums), as amounts by source and sink. Successive cheapest
    paths with node potentials; the network has one node for each shard, however many rows there are."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[Edge]] = [[] for _ in range(n + m + 2)]

    def connect(a: int, b: int, capacity: int, price: int) -> None:
        graph[a].append(Edge(b, capacity, price, len(graph[b])))
        graph[b].append(Edge(a, 0, -price, len(graph[a]) - 1))

    for i, s in enumerate(supply):
        connect(source, i, s, 0)
        for j in range(m):
            connect(i, n + j, s, cost[i][j])
    for j, d in enumerate(demand):
        connect(n + j, sink, d, 0)
    potential, need = [0] * len(graph), sum(supply)
    while need:
        far = [None] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for k, e in enumerate(graph[a]):
                if e.left:
                    new = d + e.cost + potential[a] - potential[e.to]
                    if far[e.to] is None or new < far[e.to]:
                        far[e.to], came[e.to] = new, (a, k)
                        heappush(heap, (new, e.to))
        if far[sink] is None:
            raise ValueError("supply and demand differ")
        potential = [p + (f if f is not None else far[sink]) for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = came[at][0]
        amount = min(need, *(graph[a][k].left for a, k in path))
        for a, k in path:
            e = graph[a][k]
            e.left -= amount
            graph[e.to][e.back].left += amount
        need -= amount
    return [[next((graph[n + j][e.back].left for e in graph[i] if e.to == n + j), 0) for j in range(m)] for i in range(n)]


def capacities(total: int, shards: int) -> list[int]:
    """Of equal size, to a byte."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _renamed(columns: list[str], taken: tuple[str, ...]) -> list[str]:
    """The columns' names; those that are taken get underscores behind them until they are free."""
    out: list[str] = []
    for c in columns:
        name = c
        while name in taken or name in out or (name != c and name in columns):
            name += "_"
        out.append(name)
    return out


def assigned(rows: DataFrame, new_shards: int, block_rows: int = BLOCK_ROWS, key: str | None = None) -> DataFrame:
    """rows(size, old_shard, any more columns). The same rows with `shard`, from 0 to new_shards - 1, and `slot`, gapless
    from 0 in each shard. Shards differ from equal size by less than two rows for each old shard that feeds them; what moves
    is least in bytes, to the same precision.

    key: a column that no two rows share and that a second reading gives again; without one, the rows are saved with a key
    first. An old shard's number that is also a new one's keeps its bytes for nothing; a row without an old shard moves.
    Null ids and repeated rows are placed like any other, rows of no size as if of one byte. More columns, of any name and type, come out as they are, but for
    those called `shard` or `slot`: an underscore is added to their names. No rows, no result. On the driver are the old and
    new shards' sizes only."""
    names = _renamed(rows.columns, ("shard", "slot"))
    held = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)]).alias("row")
    rows = rows.select(held, _weight(F.col("size")), _shard_of("old_shard"), (F.col(f"`{key}`") if key else F.monotonically_increasing_id()).alias("key"))
    if not key:
        rows = saved(rows)
    return _layout(rows, new_shards, block_rows).placed(rows).select("row.*", "shard", "slot")


def _shard_of(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("int"), F.lit(-1)).alias("old_shard")


def _weight(size: Column) -> Column:
    """Rows without a size or of less than one byte take one, so that each has a place on its shard's line."""
    return F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(1)).alias("size")


@dataclass
class Layout:
    """Where the rows of each old shard's blocks go. cuts(old_shard, cut_from, cut_to, shard): stretches of old shards, one at
    most for each pair of shards. begins(old_shard, block, begins): where a block begins in its shard's line of bytes.
    slots(shard, old_shard, block, base, n): a row's slot, less its number in its block, and how many there are."""

    per_shard: int
    cuts: DataFrame
    begins: DataFrame
    slots: DataFrame | None = None

    def at(self, rows: DataFrame) -> DataFrame:
        """rows(key, old_shard, size, ...) dealt by blocks, with their number there, first byte and new shard."""
        order = W.partitionBy("old_shard", "block").orderBy("key")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(self.per_shard)).cast("int"))
        rows = rows.withColumns({"number": F.row_number().over(order), "at": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
        rows = rows.join(small(self.begins), ["old_shard", "block"]).withColumn("at", F.col("at") + F.col("begins"))
        return rows.join(F.broadcast(self.cuts), "old_shard").where("at >= cut_from and at < cut_to").drop("begins", "cut_from", "cut_to")

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows with shard and slot; each moves once, to its block."""
        found = self.at(rows).join(small(self.slots.drop("n")), ["shard", "old_shard", "block"])
        return found.withColumn("slot", (F.col("base") + F.col("number")).cast("long")).drop("block", "number", "at", "base")


def _layout(rows: DataFrame, new_shards: int, block_rows: int) -> Layout:
    """rows(key, old_shard, size), of which only these columns are read."""
    rows = rows.select("key", "old_shard", "size")
    by_shard = rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    old = sorted((r.old_shard, r.bytes, r.n) for r in by_shard)
    total = sum(b for _, b, _ in old)
    supply, demand = [b for _, b, _ in old], capacities(total, new_shards)
    flow = min_cost_flow(supply, demand, [[int(s != j) for j in range(new_shards)] for s, _, _ in old])
    cuts = []
    for (s, _, _), out in zip(old, flow, strict=True):
        at = 0
        for j in sorted(range(new_shards), key=lambda j, s=s: (j != s, j)):  # what stays comes first
            if out[j]:
                cuts.append((s, at, at + out[j], j))
                at += out[j]
    blocks = max(1, -(-sum(n for _, _, n in old) // block_rows), -(-total // BLOCK_BYTES))
    per_shard = max(LEAST_BLOCKS, -(-blocks // max(1, len(old))))
    # At most one cut for each pair of shards: its size is bound by their numbers.
    cut = rows.sparkSession.createDataFrame(cuts, "old_shard int, cut_from long, cut_to long, shard int")
    block = F.pmod(F.xxhash64("key"), F.lit(per_shard)).cast("int").alias("block")
    sums = saved(rows.groupBy("old_shard", block).agg(F.sum("size").alias("bytes")))
    begins = saved(sums.select("old_shard", "block", (F.sum("bytes").over(W.partitionBy("old_shard").orderBy("block")) - F.col("bytes")).alias("begins")))
    layout = Layout(per_shard, cut, begins)
    counts = saved(layout.at(rows).groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.min("number").alias("least")))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("old_shard", "block")) - F.col("n")
    layout.slots = saved(counts.select("shard", "old_shard", "block", (before - F.col("least")).alias("base"), "n"))
    return layout


def size_of() -> Column:
    """Bytes that a row of docs(text) takes."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")


def sizes(docs: DataFrame, old_shard: Column) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard) of docs(doc_id, text): what is needed to place rows, without the texts."""
    return docs.select("doc_id", size_of().alias("size"), F.crc32(utf8("text")).alias("text_crc32"), old_shard.alias("old_shard"))


def hashed(doc_id: str, shards: int) -> Column:
    """The old layout: by crc32 of the id."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def resharded(docs: DataFrame, old_shard: Column, new_shards: int, folder: str, key: Column | None = None, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Places the rows of docs(text, any more columns) in new shards and writes the shards whose rows change to `folder`, as
    Parquet by shard, in slot order. Rows of shards that stay as they are aren't written.

    key: as for assigned(), an expression over docs, such as file_row(); without it, docs are saved with a key first. size: of
    a row, by default size_of(). Returns (written, untouched): docs' columns, old_shard, slot and shard of the rows that were
    written, read from the files, and of those that stay. Null ids, repeated rows and columns of any name are written as they
    are; columns of docs called old_shard, shard or slot get an underscore behind their names."""
    spark = docs.sparkSession
    names = _renamed(docs.columns, ("old_shard", "shard", "slot"))
    held = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("held")
    keyed = docs.select((F.monotonically_increasing_id() if key is None else key).alias("key"), held, _weight(size_of() if size is None else size), _shard_of(old_shard), old_shard.cast("int").alias("given"))
    if key is None:
        keyed = saved(keyed)
    layout = _layout(keyed, new_shards, BLOCK_ROWS)
    pairs = [(r.old_shard, r.shard) for r in layout.slots.select("old_shard", "shard").distinct().collect()]  # numbers of shards
    changed = {s for pair in pairs if pair[0] != pair[1] for s in pair}
    # Texts move once, to the block that says their places.
    rows = layout.placed(keyed).select("held.*", F.col("given").alias("old_shard"), "slot", "shard")
    rows.where(F.col("shard").isin(sorted(changed))).sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    untouched = rows.where(~F.col("shard").isin(sorted(changed))) if set(range(new_shards)) - changed else rows.limit(0)
    return spark.read.schema(rows.schema).parquet(folder), untouched


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the rows as they stand in the new shards' files, and of those that didn't move."""
    folder = f"{shared_folder(spark)}/reshard-{uuid.uuid4().hex}"
    written, untouched = resharded(table(spark, sf_dir, "documents"), hashed("doc_id", OLD), NEW, folder, file_row())
    return written.unionByName(untouched).select(
        "doc_id", size_of().alias("size"), F.crc32(utf8("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
