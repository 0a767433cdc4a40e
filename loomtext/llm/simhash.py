"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the binary Golay code on bits 0-22, again on bits 23-45, the other
18 bits free. That code is perfect with radius 3 in each block, so each fingerprint has exactly one anchor
within radius 3 in both blocks, its home. If f and g differ in at most t bits, g lies within radius 3 plus the
part of t that falls in each block of f's home. Each fingerprint is therefore stored at its home and looked up
at every anchor within covering radius plus threshold (61 on average for t = 2); comparing per anchor finds
every pair. A fingerprint has at most 2,080 others within two bits, so links grow as the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import connected_components, pieces, saved, table, utf8

SHINGLE, SEED, BLOCK, RADIUS = 3, 42, 23, 3
#: The generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011


def fingerprint(text: bytes) -> int:
    """Of 3-word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


@lru_cache(1)
def _coset_patterns(most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each value of the low and high 12 bits, and for each weight limit from RADIUS to `most`
    the error patterns by syndrome: (start of each syndrome's patterns, patterns)."""

    def syndrome(x: int) -> int:
        for bit in range(BLOCK, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << bit - 11
        return x

    halves = np.array([[syndrome(x) for x in range(4096)], [syndrome(x << 12 & (1 << BLOCK) - 1) for x in range(4096)]])
    unit = [syndrome(1 << b) for b in range(BLOCK)]
    by_weight, out = [], []
    for w in range(most + 1):
        sets = list(combinations(range(BLOCK), w))
        pattern = np.array([sum(1 << b for b in s) for s in sets], np.int64)
        of = np.zeros(len(sets), np.int64)
        for i, s in enumerate(sets):
            for b in s:
                of[i] ^= unit[b]
        by_weight.append((pattern, of))
        if w >= RADIUS:
            pattern, of = (np.concatenate(x) for x in zip(*by_weight, strict=True))
            order = np.argsort(of, kind="stable")  # the leader, of weight 3 or less, comes first
            out.append((np.searchsorted(of[order], np.arange(2049)), pattern[order]))
    return halves, out


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: for each fingerprint every anchor within covering radius plus threshold, home first."""
    halves, lists = _coset_patterns(RADIUS + threshold)
    mask = (1 << BLOCK) - 1
    blocks = [fp & mask, fp >> BLOCK & mask]
    syn = [halves[0][b & 4095] ^ halves[1][b >> 12] for b in blocks]
    rows, found = [], []
    for t in range(threshold + 1):
        (start_a, a), (start_b, b) = lists[t], lists[threshold - t]
        na, nb = start_a[syn[0] + 1] - start_a[syn[0]], start_b[syn[1] + 1] - start_b[syn[1]]
        many = na * nb
        row = np.repeat(np.arange(len(fp)), many)
        i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        pa_, pb_ = a[start_a[syn[0][row]] + i // nb[row]], b[start_b[syn[1][row]] + i % nb[row]]
        rows.append(row)
        found.append((blocks[0][row] ^ pa_) << BLOCK | (blocks[1][row] ^ pb_))
    row, anchor = np.concatenate(rows), np.concatenate(found)
    # The sets of the splits of the threshold overlap: keep each (row, anchor) once.
    order = np.lexsort((anchor, row))
    row, anchor = row[order], anchor[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    return row[new], anchor[new]


def _anchored(threshold: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
                row, anchor = anchors(fp, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["anchor", "fp"])

    return emit


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """fps(fp), distinct fingerprints. Returns (u, v): those that differ in at most threshold bits. Spark sizes the anchors as the
    fingerprints that they are made from, 61 times too low, and would send them all to the driver and to each task: the join is
    stated."""
    schema = "anchor long, fp long"
    home = fps.select("fp").mapInArrow(_anchored(0), schema)
    looked_up = fps.select("fp").mapInArrow(_anchored(threshold), schema)
    f, g = home.alias("f"), looked_up.hint("merge").alias("g")
    near = F.bit_count(F.col("f.fp").bitwiseXOR(F.col("g.fp"))) <= threshold
    return f.join(g, (F.col("f.anchor") == F.col("g.anchor")) & (F.col("f.fp") < F.col("g.fp")) & near).select(
        F.col("f.fp").alias("u"), F.col("g.fp").alias("v")
    )


def simhash_components(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """docs(doc_id, text), other columns ignored. Returns (doc_id, fingerprint, component_id), a row for each row.

    A null or empty text, or one of white space only, has fingerprint zero and is linked like any other. A repeated
    row keeps its repeats. A row with a null doc_id gets a fingerprint and links others like any row; ids name components,
    so component_id is null only where no row of the component has an id. An empty table gives no rows."""
    prints = saved(docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    # Links are between fingerprints, whoever holds them; ids come in when components are known.
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(fps, threshold))
    rooted = saved(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = rooted.join(named, "root").select("fp", "component_id")
    return (
        prints.join(component, "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
