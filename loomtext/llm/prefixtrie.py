"""The prefix trie of conversations by digests of fixed-length blocks of turns.

A sequence of turns has a 128-bit digest, the sum over its turns of a turn's hash times a power for its place, so prefixes'
digests are running sums. Conversations are grouped by the digests at the ends of blocks of BLOCK turns first: a block that
many conversations share becomes one row with their number and smallest id. Only where several blocks follow the same
beginning are turns inside them grouped too; elsewhere each turn of the one block is a node with the block's numbers.

Sums over subtrees need no walk. Each node belongs to the member whose hash is smallest, so a conversation owns a chain of
nodes down to its last turn. Inside a chain, sums are running sums from below; to the nodes above its chain a conversation
adds its chain's whole sum, once for each block and, where the chain begins inside one, for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import pieces, saved, table
from loomtext.operators.running import numbered, running

#: Turns of a block; characters of a text that order turns of the same number and role; bytes of ids in a row.
BLOCK, HEAD, PACK = 4, 64, 1 << 20
#: Odd factors whose powers weigh the turns of a sequence, a lane each (fixed values).
FACTORS = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
_LOW = 1 << 16


class _Powers:
    """Powers of the factors modulo 2^64, for places up to 2^48."""

    def __init__(self):
        self.low = [self._table(f, _LOW) for f in FACTORS]
        self.high = [self._table(pow(f, _LOW, 1 << 64), 256) for f in FACTORS]

    @staticmethod
    def _table(factor: int, n: int) -> np.ndarray:
        out = np.full(n, factor, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, lane: int, at: np.ndarray) -> np.ndarray:
        high = at >> 16
        if len(at) and high.max() >= len(self.high[lane]):
            self.high = [self._table(pow(f, _LOW, 1 << 64), 2 * int(high.max())) for f in FACTORS]
        return self.low[lane][at & (_LOW - 1)] * self.high[lane][high]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, role, head, role and text as bytes) to hashes and words in place of the text."""
    for batch in pieces(batches, 5):
        roles, texts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        digests = [xxhash.xxh3_128_intdigest(b"%d:%b%b" % (len(r), r, t)) for r, t in zip(roles, texts, strict=True)]
        hashes = [pa.array(np.array([d >> 64 * k & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)) for k in (0, 1)]
        words = pa.array([len(t.split()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *hashes, words], ["conv", "turn", "role", "head", "t1", "t2", "words"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, i, t1, t2, words): hashes times the powers of their places."""
    powers = _Powers()
    for batch in batches:
        at = batch.column(1).to_numpy()
        x = [pa.array((batch.column(2 + k).to_numpy().view(np.uint64) * powers.of(k, at)).view(np.int64)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *x, batch.column(4)], ["conv", "i", "x1", "x2", "words"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, i, t1, t2, words): a row for each turn with a conversation id; i from 1 in the order of turn, null first, then
    role, then text (its first HEAD characters, then its hash). Hashes are of role and text, null ones empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"), role.cast("binary").alias("role_bytes"), text.cast("binary").alias("text"),
    ).mapInArrow(_turns, "conv long, turn long, role string, head string, t1 long, t2 long, words long")
    # Rows that agree in all of this are the same turn said again; their number in the task spreads them.
    spread = rows.withColumn("again", F.monotonically_increasing_id())
    return numbered(spread, ["conv"], ["turn", "role", "head", "t1", "t2", "again"], "i").select("conv", "i", "t1", "t2", "words")


def rebuilt(turns: DataFrame, every: int, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """turns(conv, i, t1, t2, words). Each conversation c with its first h turns replaced by the first h of conversation
    c - c % every (all if it has fewer, none if there is no such conversation). borrowed: h, from 0 to most, an expression
    over conv. Returns (conv) of all conversations, and turns as before."""
    sizes = saved(turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", borrowed.cast("long")).withColumn("base", F.col("conv") - F.col("conv") % every))
    first = saved(turns.where(F.col("i") <= most).withColumnRenamed("conv", "base"))
    lent = sizes.where("h > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), "h")).alias("i")).join(first, ["base", "i"])
    # Where the base is short, own turns move up.
    has = first.groupBy("base").agg(F.count("*").alias("has"))
    short = sizes.join(has, "base", "left").select("conv", (F.col("h") - F.least("h", F.coalesce("has", F.lit(0)))).alias("up")).where("up > 0")
    own = turns.where(F.col("i") > borrowed).join(short, "conv", "left").select("conv", (F.col("i") - F.coalesce("up", F.lit(0))).alias("i"), "t1", "t2", "words")
    return sizes.select("conv"), lent.select("conv", "i", "t1", "t2", "words").unionByName(own)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, conv) in order to (d1, d2, first, ids): ids joined by commas, in rows of about PACK bytes."""
    key, ids, size = None, [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0])] + [pa.array([",".join(map(str, ids)).encode()], pa.binary())], ["d1", "d2", "first", "ids"])
    for batch in batches:
        for d1, d2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (d1, d2) or size > PACK:
                if ids:
                    yield row()
                key, ids, size = (d1, d2), [], 0
            ids.append(conv)
            size += 12
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, first, ids) in order to (d1, d2, ends_sha256)."""
    key, state, out = None, None, []
    for batch in batches:
        for d1, d2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == (d1, d2):
                state.update(b"," + ids)
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = (d1, d2), hashlib.sha256(ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["d1", "d2", "ends_sha256"])
            out = []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["d1", "d2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends(d1, d2, conv). (d1, d2, ends_sha256): of the ids in order, joined by commas. Ids are sorted in ranges over all
    tasks and packed there; what one task hashes of a node are packed rows."""
    order = ["d1", "d2", "conv"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, "d1 long, d2 long, first long, ids binary")
    return packed.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string")


def _blocks(digests: DataFrame) -> DataFrame:
    """digests(conv, i, d1, d2, b1, b2, words). A row for each conversation and block of BLOCK turns: the beginning it follows
    (b1, b2), its end (e1, e2, depth), its turns."""
    turn = F.struct("i", "d1", "d2", "b1", "b2", "words")
    rows = digests.groupBy("conv", F.floor((F.col("i") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    return rows.select("conv", "turns", first["b1"].alias("b1"), first["b2"].alias("b2"), last["d1"].alias("e1"), last["d2"].alias("e2"), last["i"].alias("depth"))


def _nodes(blocks: DataFrame) -> DataFrame:
    """(d1, d2, depth, p1, p2, words, n_convs, conv, owner) of every node but the root."""
    numbers = [F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.min("owner").alias("owner")]
    one = blocks.select("e1", "e2", "b1", "b2", "turns", F.lit(1).cast("long").alias("n_convs"), "conv", F.xxhash64("conv").alias("owner"))
    distinct = saved(one.groupBy("e1", "e2").agg(*numbers, F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("turns").alias("turns")))
    # Beginnings that several blocks follow: their blocks' turns are grouped, those of other blocks are nodes as they are.
    forks = distinct.groupBy("b1", "b2").agg(F.count("*").alias("blocks")).where("blocks > 1").select("b1", "b2", F.lit(True).alias("fork"))
    marked = saved(distinct.join(forks, ["b1", "b2"], "left"))
    turn = ["t.d1", "t.d2", F.col("t.i").alias("depth"), F.col("t.b1").alias("p1"), F.col("t.b2").alias("p2"), "t.words", "n_convs", "conv", "owner"]
    spread = lambda rows: rows.withColumn("t", F.explode("turns")).select(*turn)
    same = [F.first(c).alias(c) for c in ("depth", "p1", "p2", "words")]
    refined = spread(marked.where("fork")).groupBy("d1", "d2").agg(*same, *numbers)
    return spread(marked.where("fork is null")).unionByName(refined.select(*spread(marked).columns))


def _below(blocks: DataFrame, chains: DataFrame) -> DataFrame:
    """chains(owner, top, total, leaves): a conversation's sums, and the depth at which its chain begins. (d1, d2, total,
    leaves): what chains that begin below a node add up to, for each node with any but the root."""
    sums = [F.sum("total").alias("total"), F.sum("leaves").alias("leaves")]
    path = blocks.withColumn("owner", F.xxhash64("conv")).join(chains.where("top > 1"), "owner").where(F.element_at("turns", 1)["i"] < F.col("top"))
    whole = path.where("depth < top").groupBy("e1", "e2").agg(*sums, F.first("turns").alias("turns"))
    part = path.where("depth >= top").select("total", "leaves", F.filter("turns", lambda t: t["i"] < F.col("top")).alias("turns"))
    spread = whole.select("total", "leaves", "turns").unionByName(part).withColumn("t", F.explode("turns"))
    return spread.select("t.d1", "t.d2", "total", "leaves").groupBy("d1", "d2").agg(*sums)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs(conv), all conversations; turns(conv, i, t1, t2, words), their turns, gapless from 1. A row for each distinct
    beginning: conv_id (the smallest conversation that begins so), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Conversations without turns are members of the root. No conversations, no rows."""
    weighed = turns.select("conv", "i", "t1", "t2", "words").mapInArrow(_weighed, "conv long, i long, x1 long, x2 long, words long")
    sums = running(weighed, ["conv"], ["i"], {"d1": "x1", "d2": "x2"}, {"b1": "x1", "b2": "x2"})
    blocks = saved(_blocks(sums.select("conv", "i", "d1", "d2", "b1", "b2", "words")))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min(F.xxhash64("conv")).alias("owner")).where("n_convs > 0")
    root = root.select(zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"), "n_convs", "conv", "owner")
    nodes = saved(_nodes(blocks).unionByName(root).withColumn("tokens", (F.col("n_convs") - 1) * F.col("words")))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    linked = nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    chained = saved(running(linked, ["owner"], [F.desc("depth")], {"own": "tokens"}))
    chains = saved(chained.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("tokens").alias("total"), F.max_by((F.col("n_children") == 0).cast("long"), "depth").alias("leaves")))
    below = _below(blocks, chains)
    # Every chain but its own lies below the root.
    other = chains.where("top > 0").agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves")).where("total is not null")
    below = below.unionByName(other.select(zero.alias("d1"), zero.alias("d2"), "total", "leaves"))
    last = blocks.groupBy("conv").agg(F.max_by(F.struct("e1", "e2"), "depth").alias("e"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("e.e1", zero).alias("d1"), F.coalesce("e.e2", zero).alias("d2"), "conv")
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    bottoms = chains.select("owner", F.col("leaves").alias("own_leaves"))
    rows = chained.join(bottoms, "owner").join(parents, ["p1", "p2"], "left").join(below, ["d1", "d2"], "left").join(ends_digests(ends), ["d1", "d2"], "left")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("own_leaves") + F.coalesce("leaves", zero)).alias("n_leaves"), (F.col("own") + F.coalesce("total", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, every: int = 20, borrowed: Column | None = None, most: int = 3) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text, any more columns), rebuilt with the beginnings of others as
    rebuilt() says; by default with the first crc32(id) % 4 turns.

    Rows with a null conv_id belong to no conversation and are left out. Null turns come first, rows of one turn in the order of
    role and text, null roles and texts are empty; repeated rows are turns said again. A conversation may hold any part of
    the rows. c % every takes the sign of c. An empty table gives no rows."""
    h = F.crc32(F.col("conv").cast("string")) % 4 if borrowed is None else borrowed
    convs, turns = rebuilt(turns_of(conversations), every, h, most)
    return prefix_trie(convs, saved(turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: crc32 of the id's decimal digits, bit by bit, before its last inversion.
_CRC = (
    "list_reduce(list_concat([4294967295::UBIGINT], list_transform(str_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x // 2, (x % 2) * 3988292384)))"
)
SQL = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(said ORDER BY i) AS turns FROM own GROUP BY conv_id),
sizes AS (SELECT *, (xor({_CRC}, 4294967295) % 4)::BIGINT AS h FROM whole),
built AS (SELECT s.conv_id, coalesce(list_slice(b.turns, 1, s.h), []) || list_slice(s.turns, s.h + 1, len(s.turns)) AS turns
  FROM sizes s LEFT JOIN whole b ON b.conv_id = s.conv_id - s.conv_id % 20),
members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
prefixes AS (SELECT conv_id, depth, turns, list_slice(turns, 1, depth) AS prefix, CASE WHEN depth > 0 THEN list_slice(turns, 1, depth - 1) END AS above FROM members),
nodes AS (SELECT prefix, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)), '') AS ends FROM prefixes GROUP BY prefix, depth),
kids AS (SELECT above AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
  CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.prefix[depth].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS tokens FROM nodes n LEFT JOIN kids k USING (prefix)),
spread AS (SELECT prefix, tokens, n_children, unnest(range(0, depth + 1)) AS d FROM full_nodes),
trees AS (SELECT list_slice(prefix, 1, d) AS prefix, sum(tokens)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM spread GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN trees t ON t.prefix = n.prefix LEFT JOIN full_nodes p ON p.prefix = n.above
"""
