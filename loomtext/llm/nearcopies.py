"""Near copies by the overlap of word shingles: the corpus pipeline's form of operator 1, where fingerprints can't decide.

Operator 1 proposes pairs first: texts whose fingerprints differ in two bits or fewer, which meet at anchors.
Two texts whose shingle sets overlap by 0.8 differ in about 10 of 64 fingerprint bits, far beyond what anchors reach. So a
second key proposes more: MinHash bands. The shingle sets themselves decide on the pairs of either. Texts with equal shingle
sets are one node, with the fingerprints of all of them. A node has BANDS values, each of ROWS least hashes; two sets of
Jaccard similarity s share one with chance 1 - (1 - s^5)^24, 0.99993 at 0.8. Of the nodes that share a value, each is first compared with the smallest, at the cost of a comparison for
each member of a group. Only where that leaves several components are pairs across components looked at, inside the join: a
sketch of 2,048 bits, each the parity of one more least hash, decides which pairs have their sets compared. A pair at 0.8 is
missed by it with chance 0.000003. A pair is made once, where it first shares a value. So the components are those of all pairs that share a value, while of a large group whose
members have drifted apart only the pairs near the limit are made. Nor are pairs made that can't reach the limit because too
many of their shingles stand in no other such set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import simhash
from loomtext.llm.common import connected_components, pieces, saved, shuffles_deleted, small, utf8

WIDTH, LEAST = 5, 0.8
BANDS, ROWS, SEED = 24, 5, 42
_RNG = np.random.default_rng(SEED)
FLIPS, FACTORS = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
#: Bits of a sketch, and how many standard deviations more than expected two may differ in.
BITS, DEVIATIONS = 2048, 4.5
_BIT_FLIPS, _BIT_FACTORS = (_RNG.integers(0, 1 << 64, BITS, np.uint64) for _ in range(2))
_BIT_FACTORS |= np.uint64(1)
#: Hashes of sets that go to every task; where pairs have more, the sets are joined to them.
SENT = 2_000_000
#: Odd multipliers that mix words into shingles and hashes into bands (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Shingles that one step hashes, words and bytes of one step's texts, words whose hashes a worker remembers.
STEP, SLICE, STEP_BYTES, WORDS = 1 << 13, 1 << 17, 1 << 20, 1 << 17


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    h = (h ^ other) * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    return h ^ h >> np.uint64(32)


class Shingles:
    """Hashes of the runs of `width` words of texts; of all words where there are fewer, of none without words."""

    def __init__(self, width: int):
        self.width, self.number = width, {}
        self.hashes = np.zeros(1024, np.uint64)

    def _of_words(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > WORDS:
            self.number = {}
        number, known = self.number, len(self.number)
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > known:
            last = islice(reversed(number), len(number) - known)
            new = np.fromiter(map(xxhash.xxh64_intdigest, last), np.uint64, len(number) - known)[::-1]
            if len(number) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:known], np.zeros(2 * len(number) - known, np.uint64)])
            self.hashes[known : len(number)] = new
        return self.hashes[at]

    def _hashed(self, words: list[bytes], many: list[int]) -> Iterator[np.ndarray]:
        h = self._of_words(words)
        runs = np.zeros(max(0, len(h) - self.width + 1), np.uint64)
        for i in range(self.width):
            runs = _mixed(runs, h[i : len(runs) + i])
        at = 0
        for n in many:
            if n >= self.width:
                yield np.unique(runs[at : at + n - self.width + 1])
            elif n:
                few = np.full(1, n, np.uint64)
                for i in range(n):
                    few = _mixed(few, h[at + i : at + i + 1])
                yield few
            else:
                yield np.zeros(0, np.uint64)
            at += n

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct hashes of each text, in order."""
        out: list[np.ndarray] = []
        words: list[bytes] = []
        many: list[int] = []
        with np.errstate(over="ignore"):
            for t in texts:
                here = t.lower().split()
                words += here
                many.append(len(here))
                if len(words) > SLICE:
                    out += self._hashed(words, many)
                    words, many = [], []
            return out + list(self._hashed(words, many))


def _least(sets: list[np.ndarray], flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function (rows) over each set (columns). Steps run over the sets' hashes one after
    another, wherever sets begin."""
    size = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(flips), len(sets)), np.iinfo(np.uint64).max, np.uint64)
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    ends = np.cumsum(size)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP]
        a, b = np.searchsorted(ends, [at, at + len(part) - 1], "right")  # the sets of its first and last hash
        here = np.flatnonzero(size[a : b + 1]) + a
        starts = np.maximum(ends[here] - size[here] - at, 0)
        for i in range(len(flips)):
            low = np.minimum.reduceat((part ^ flips[i]) * factors[i], starts)
            least[i, here] = np.minimum(least[i, here], low)
    return least


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of values, one for each band, of each set; zeros for an empty set."""
    least = _least(sets, FLIPS, FACTORS)
    value = np.zeros((BANDS, len(sets)), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
    for i in range(ROWS):
        value = _mixed(value, least[i::ROWS])
    return np.ascontiguousarray(np.where([len(s) > 0 for s in sets], value, np.uint64(0)).T).view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words of each set: parities of least hashes."""
    least = _least(sets, _BIT_FLIPS, _BIT_FACTORS)
    bit = (_mixed(_mixed(least, _BIT_FLIPS[:, None]), np.uint64(BITS)) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bit.T, axis=1, bitorder="little")).view("<i8")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.int64)))


def _signed(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in pieces(batches, 2, STEP_BYTES):
            texts = batch.column(2).to_pylist()
            sets, fps = shingles.sets(texts), np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts))
            prints = pa.array((xxhash.xxh3_128_digest(s.tobytes()) for s in sets), pa.binary())
            values = [v if len(s) else v[:0] for v, s in zip(bands(sets), sets, strict=True)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, sizes, _lists(values), pa.array(fps.view(np.int64))], ["doc_id", "key", "print", "size", "bands", "fp"])

    return scan


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in pieces(batches, 1, STEP_BYTES):
            held = _lists([s.view(np.int64) for s in shingles.sets(batch.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), held], ["node", "held"])

    return scan


_WORDS = [f"s{i}" for i in range(BITS // 64)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            words = sketches(np.split(flat, ends[:-1]))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(words[:, i]) for i in range(len(_WORDS)))], ["node", *_WORDS])


def _similar(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets (node, held) overlap by `least` or more."""
    asked = pairs.select(F.col("u").alias("node")).distinct().unionByName(pairs.select(F.col("v").alias("node")).distinct()).distinct()
    held = saved(held.join(asked, "node", "left_semi"))
    if (held.agg(F.sum(F.size("held"))).first()[0] or 0) <= SENT:
        sets = held.orderBy("node").toArrow()
        lists = sets["held"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        shared = pairs.sparkSession.sparkContext.broadcast((sets["node"].to_numpy(), np.append(0, ends), flat))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, ends, flat = shared.value
            for batch in batches:
                keep = []
                for u, v in zip(*(np.searchsorted(node, batch.column(i).to_numpy()).tolist() for i in (0, 1)), strict=True):
                    a, b = flat[ends[u] : ends[u + 1]], flat[ends[v] : ends[v + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(common >= least * (len(a) + len(b) - common) - 1e-9)
                yield batch.filter(pa.array(keep, pa.bool_()))

        return saved(pairs.mapInArrow(compare, "u long, v long"))
    # Spark takes a list for one number and could send the sets: the joins are stated.
    held = held.hint("merge")
    both = pairs.join(held.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return saved(both.where(common >= F.lit(least) * (F.size("a") + F.size("b") - common) - 1e-9).select("u", "v"))


def _hooked(links: DataFrame) -> DataFrame:
    """(of, c): for each node that is linked to a smaller one, a node that it is connected to, four links further at most.
    Nodes with the same c are connected; those of other c may be too, which only makes them be compared again."""
    hooked = saved(links.groupBy(F.col("v").alias("of")).agg(F.min("u").alias("c")))
    for _ in range(2):
        further = hooked.select(F.col("of").alias("c"), F.col("c").alias("next"))
        hooked = saved(hooked.join(further, "c", "left").select("of", F.coalesce("next", "c").alias("c")))
    return hooked


def _anchored(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, band, value): operator 1's links as values of one more band. A fingerprint is the value of the nodes that
    have it and of those that have one linked to it."""
    held = saved(prints.select("print", "fp").distinct())
    links = simhash.links(held.select("fp").distinct())
    linked = held.join(links, F.col("fp") == F.col("v")).select("print", F.col("u").alias("value"))
    of = held.withColumnRenamed("fp", "value").unionByName(linked).distinct()
    return saved(nodes.join(of, "print").select("node", "size", F.lit(BANDS).alias("band"), "value").distinct())


def _grouped(texts: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """texts(doc_id, key, text). Returns (doc_id, key, print) of each and (print, first, c) of each print whose component c has
    several rows; first: the smallest doc_id and key of the print. Both are saved."""
    key = texts.schema["key"].dataType.simpleString()
    prints = saved(texts.mapInArrow(_signed(width), f"doc_id long, key {key}, print binary, size long, bands array<long>, fp long"))
    rows = prints.groupBy("print").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("rows"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    nodes = saved(rows.withColumn("node", F.monotonically_increasing_id()))
    values = _anchored(prints, nodes).unionByName(nodes.select("node", "size", F.posexplode("bands").alias("band", "value")))
    span = values.groupBy("value").agg(F.min(F.struct("node", "size")).alias("m"), F.max("node").alias("most")).where("m.node < most").select("value", "m")
    # Spark sizes rows made of lists as the lists' rows and could send all values to every task: the join is stated.
    shared = saved(values.hint("merge").join(span, "value"))
    # The sets of the nodes that share a value, made again from one text of each.
    wanted = saved(nodes.join(shared.select("node").distinct(), "node").select("node", F.col("first.key").alias("first")))
    again = texts.join(small(wanted), F.col("key") == F.col("first")).select("node", "text")
    held = saved(again.mapInArrow(_sets(width), "node long, held array<long>"))
    alike = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9  # noqa: E731  Jaccard similarity is at most that
    with_least = shared.where("m.node < node").where(alike(F.col("m.size"), F.col("size"))).select(F.col("m.node").alias("u"), F.col("node").alias("v")).distinct()
    links = _similar(saved(with_least), held, least)
    marked = shared.join(_hooked(links), F.col("node") == F.col("of"), "left").select("value", "band", "node", "size", F.coalesce("c", "node").alias("c"))
    several = marked.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("value")
    rest = saved(marked.join(several, "value"))
    again = saved(held.join(rest.select("node").distinct(), "node", "left_semi"))
    sketched = saved(again.mapInArrow(_sketched, f"node long, {', '.join(f'{w} long' for w in _WORDS)}"))
    once = again.select("node", F.explode("held").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    own = saved(once.groupBy("node").agg(F.count("*").alias("own")))
    # A band's value in 31 bits tells whether two nodes share it: with chance 0.00000002 a pair seems to share an earlier one.
    short = nodes.select("node", *[F.get("bands", F.lit(i)).bitwiseAND(0x7FFFFFFF).cast("int").alias(f"b{i}") for i in range(BANDS)])
    rest = rest.join(sketched, "node").join(short, "node").join(own, "node", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0)))
    f, g = rest.alias("f"), rest.alias("g")
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"f.{w}").bitwiseXOR(F.col(f"g.{w}"))) for w in _WORDS))
    p = (1 - least) / 2  # the chance that a bit of two sets at the limit differs
    near = apart <= int(np.ceil(BITS * p + DEVIATIONS * np.sqrt(BITS * p * (1 - p))))
    most = F.least("f.common", "g.common")  # shingles that two sets can share
    reach = most >= F.lit(least) * (F.col("f.size") + F.col("g.size") - most) - 1e-9
    differ = (F.col("f.node") < F.col("g.node")) & (F.col("f.c") != F.col("g.c")) & reach
    earlier = reduce(Column.__or__, ((F.col("f.band") > i) & (F.col(f"f.b{i}") == F.col(f"g.b{i}")) for i in range(BANDS)))
    across = f.join(g, (F.col("f.value") == F.col("g.value")) & differ & ~earlier & near).select(F.col("f.node").alias("u"), F.col("g.node").alias("v")).distinct()
    more = _similar(saved(across), held, least)
    found = connected_components(links.unionByName(more)).withColumnRenamed("node", "of")
    grouped = saved(nodes.join(found, F.col("node") == F.col("of"), "left").where("rows > 1 or component is not null").select("print", "first", F.coalesce("component", "node").alias("c")))
    return prints, grouped


def _groups(texts: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """texts(doc_id, key, text). Returns (doc_id, key, print) of each and (print, best) of each print whose component has
    several rows: the smallest doc_id and key in it."""
    with shuffles_deleted(texts.sparkSession):
        prints, grouped = _grouped(texts, width, least)
    best = grouped.groupBy("c").agg(F.min("first").alias("best"))
    return prints.select("doc_id", "key", "print"), grouped.join(best, "c").select("print", "best")


def _texts(docs: DataFrame, key: Column) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), utf8("text").alias("text"))


def components(docs: DataFrame, width: int = WIDTH, least: float = LEAST, key: Column | None = None) -> DataFrame:
    """docs(doc_id, text), rows with a null doc_id left out. Returns (doc_id, component_id), a row for each row left:
    the smallest id that chains of texts with shingle sets of similarity `least` or more lead to.

    key: an expression over docs that no two rows share and that a second reading gives again (common.file_row() for a table
    read from files); without it, docs are saved with a key first. Null texts and texts without words have the same, empty,
    set. An empty table gives no rows."""
    if key is None:
        docs, key = saved(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key"))), F.col("key")
    rows, groups = _groups(_texts(docs, key), width, least)
    return rows.join(groups, "print", "left").select("doc_id", F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = WIDTH, least: float = LEAST, key: Column | None = None) -> DataFrame:
    """One row of each component of components(): of the rows of its smallest doc_id, the one with the smallest key, also
    where rows share that id. Rows with a null doc_id, which no id can name, stay. Columns of any name stay as they are."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, (F.monotonically_increasing_id() if key is None else key).alias(name))
    keyed = saved(keyed) if key is None else keyed
    rows, groups = _groups(_texts(keyed, F.col(name)), width, least)
    gone = saved(rows.join(groups, "print").where("key <> best.key").select(F.col("key").alias("gone_key")))
    return keyed.join(small(gone.toDF(f"{name}_gone")), F.col(name) == F.col(f"{name}_gone"), "left_anti").select(*columns)
