"""Passages of benchmark items in documents, by the q-gram lemma and banded alignment.

Items are cut into overlapping windows. If a stretch of a document is within k edits of a window of m characters,
it shares at least m - q + 1 - k q of the window's q-grams, on diagonals that differ by k at most. The shared q-grams
are counted in overlapping bands of diagonals, so that one band holds all of them; bands with too few cannot hold
such a stretch. The rest is verified by an alignment confined to the band. Nothing within the budget is missed.
Items longer than a window have shorter windows close to each other too, so that a passage of 83 characters of such an item
holds one wherever it was cut. Items too short for q-grams are found as they are, between word borders.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import pieces, table

Q = 8
#: Characters of a window and from one to the next; edits allowed for each character; least characters of an item that is
#: found by q-grams.
WINDOW, STRIDE, RATE, LEAST = 96, 48, 0.08, 20
#: The same of the shorter windows of items longer than WINDOW.
PART, PART_STRIDE = 72, 12
#: Odd multipliers that mix q-grams (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Code points and shared q-grams that one step handles.
SLICE, PAIRS = 250_000, 250_000
#: Bytes of an index that goes to the executors whole, and that it takes for each character of the items.
INDEX_BYTES, BYTES_A_CHARACTER = 128_000_000, 32


def plain(text: str | None) -> str:
    """Lower case, with single blanks for white space."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def qgrams(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place, by doubling."""
    with np.errstate(over="ignore"):
        h = (code.astype(np.uint64) + np.uint64(1)) * MIX[0]
        for step, mix in ((1, MIX[1]), (2, MIX[2]), (4, MIX[3])):
            h = h[:-step] * mix + h[step:] if len(h) > step else h[:0]
            h ^= h >> np.uint64(31)
    return h * MIX[0] if len(h) else h


def edits_of(size):
    """Edits allowed in a window of that many characters: RATE of them, and few enough that it must share q-grams."""
    return np.minimum((size * RATE).astype(np.int64), (size - Q) // Q)


#: Diagonals of one step; a band has two.
STEP = int(WINDOW * RATE) + 1


@dataclass
class Index:
    """Items that are found by q-grams, one after another, and where each of their q-grams stands; and the items that are
    too short for it, by text. Windows are not stored: which ones a place lies in follows from their sizes and strides.
    An item of n characters takes about 30 n bytes."""

    items: list
    short: dict[str, list]
    code: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, items: Iterable[tuple[object, str]]) -> Index:
        ids, texts, short = [], [], {}
        for item_id, text in items:
            p = codes(t := plain(text))
            if len(p) >= LEAST:
                ids.append(item_id)
                texts.append(p)
            elif t:
                short.setdefault(t, []).append(item_id)
        begin = np.cumsum([0, *map(len, texts)])
        code = np.concatenate([*texts, np.zeros(0, np.uint32)])
        h = np.concatenate([*map(qgrams, texts), np.zeros(0, np.uint64)])
        place = np.concatenate([*(np.arange(a, z - Q + 1, dtype=np.int32) for a, z in zip(begin, begin[1:], strict=False)), np.zeros(0, np.int32)])
        order = np.argsort(h, kind="stable")
        hashes, starts = np.unique(h[order], return_index=True)
        bits = max(16, int(len(hashes) * 16).bit_length())
        present = np.zeros(1 << bits - 3, np.uint8)
        cell = hashes >> np.uint64(64 - bits)
        np.bitwise_or.at(present, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
        return cls(ids, short, code, begin, hashes, np.append(starts, len(h)).astype(np.int32), place[order], present)

    def __post_init__(self):
        length = np.diff(self.begin)
        self.kinds = []  # windows of a kind begin every stride, but for the last one, which ends with the item
        many = np.zeros(len(length), np.int64)
        for size, stride in ((np.minimum(WINDOW, length), STRIDE), (np.full(len(length), PART), PART_STRIDE)):
            used = size <= length if stride == STRIDE else length > WINDOW
            last = length - size
            regular = np.where(used, -(-last // stride), 0)
            self.kinds.append((used, size, stride, last, regular, many.copy()))
            many += np.where(used, regular + 1, 0)
        self.of_windows = many
        self.base = np.cumsum(many) - many
        sizes = np.array(sorted({*np.minimum(WINDOW, length).tolist(), *([PART] if (length > WINDOW).any() else [])}), np.int64)
        self.least_shared = int((sizes - Q + 1 - edits_of(sizes) * Q).min()) if len(sizes) else 0
        self.span = int(sizes.max() + edits_of(sizes).max() - Q) if len(sizes) else 0

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.code, self.begin, self.hashes, self.starts, self.place, self.filter))

    @property
    def of_item(self) -> np.ndarray:
        """Of each window, its item."""
        return np.repeat(np.arange(len(self.of_windows)), self.of_windows)

    def window(self, w: int) -> tuple[int, int, int]:
        """Its item, its place there, its size."""
        item = int(np.searchsorted(self.base, w, "right")) - 1
        n = w - int(self.base[item])
        for used, size, stride, last, regular, before in self.kinds[::-1]:
            if used[item] and n >= before[item]:
                return item, min((n - int(before[item])) * stride, int(last[item])), int(size[item])
        raise IndexError(w)

    def pattern(self, w: int) -> np.ndarray:
        item, at, size = self.window(w)
        return self.code[self.begin[item] + at : self.begin[item] + at + size]

    def _windows(self, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For shared q-grams, at their places in the text and in the items: windows and diagonals."""
        item = np.searchsorted(self.begin, place, "right") - 1
        p = place - self.begin[item]
        for used, size, stride, last, regular, before in self.kinds:
            first = self.base[item] + before[item]
            for j in range(int((size.max(initial=Q) - Q) // stride) + 1):
                n = p // stride - j
                ok = used[item] & (n >= 0) & (n < regular[item]) & (n * stride + size[item] >= p + Q)
                yield (first + n)[ok], (at - p + n * stride)[ok]
            ok = used[item] & (p >= last[item])
            yield (first + regular[item])[ok], (at - p + last[item])[ok]

    def bands(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(window, lowest diagonal) of each band that shares enough q-grams. Bands are two steps wide and one step apart."""
        if not len(self.hashes):
            return []
        h = qgrams(code)
        cell = h >> np.uint64(64 - (len(self.filter).bit_length() + 2))
        held = self.filter[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1
        at = self._dense(np.flatnonzero(held))
        if not len(at):
            return []
        j = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[j] == h[at]
        at, j = at[same], j[same]
        many = (self.starts[j + 1] - self.starts[j]).astype(np.int64)
        keys, counts = [], []
        ends = np.cumsum(many)
        base = 0
        while base < len(at):
            stop = max(base + 1, int(np.searchsorted(ends, (ends[base - 1] if base else 0) + PAIRS, "right")))
            m = many[base:stop]
            posting = np.repeat(self.starts[j[base:stop]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            found = [w << 40 | (d + WINDOW) // STEP for w, d in self._windows(np.repeat(at[base:stop], m), self.place[posting].astype(np.int64))]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            keys.append(key)
            counts.append(n)
            base = stop
        if not keys:
            return []
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        if not len(key):
            return []
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        window, low = key >> 40, key & (1 << 40) - 1
        item = np.searchsorted(self.base, window, "right") - 1
        (_, whole, *_), (used, _, _, _, _, before) = self.kinds
        size = np.where(used[item] & (window - self.base[item] >= before[item]), PART, whole[item])
        least = size - Q + 1 - edits_of(size) * Q
        both = n.copy()  # of the band that begins at this step: this and the next
        next_ = key[1:] == key[:-1] + 1
        both[:-1][next_] += n[1:][next_]
        found = list(zip(window[both >= least].tolist(), low[both >= least].tolist(), strict=True))
        first = np.append(True, ~next_)  # bands that end at this step, where the one before has no q-gram
        alone = first & (n >= least)
        found += list(zip(window[alone].tolist(), (low[alone] - 1).tolist(), strict=True))
        return [(w, b * STEP - WINDOW) for w, b in set(found)]

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Those of the places that lie, with as many others as the least demanding window asks for, within the longest
        stretch that any window can match. The shared q-grams of a match stand at different places of such a stretch."""
        t = self.least_shared
        if t <= 1 or len(at) < t:
            return at if t <= 1 else at[:0]
        first = np.flatnonzero(at[t - 1 :] - at[: len(at) - t + 1] <= self.span)
        change = np.zeros(len(at) + 1, np.int64)
        change[first] += 1
        change[first + t] -= 1
        return at[np.cumsum(change[:-1]) > 0]


def banded(pattern: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits between the pattern and a stretch of the text on diagonals low to low + width - 1 (place in the
    text less place in the pattern), and the stretch; None if more than `most`."""
    low, width = low - most, width + 2 * most
    far = len(pattern) + len(text) + 1
    d = np.arange(width)
    cost = np.zeros(width, np.int64)  # pattern's row 0: begin anywhere
    begin = low + d
    cost[(begin < 0) | (begin > len(text))] = far
    for i, c in enumerate(pattern):
        at = low + d + i  # the text's place that the diagonal meets in this row
        inside = (at >= 0) & (at < len(text))
        here = np.full(width, -1, np.int64)
        here[inside] = text[at[inside]]
        new, start = np.where(inside, cost + (here != c), far), begin
        up = np.append(cost[1:], far) + 1  # a character of the pattern more
        up[(at + 1 < 0) | (at + 1 > len(text))] = far
        better = up < new
        new, start = np.where(better, up, new), np.where(better, np.append(begin[1:], 0), start)
        run = np.minimum.accumulate(new - d)  # characters of the text more
        origin = np.maximum.accumulate(np.where(new - d == run, d, 0))
        cost, begin = run + d, start[origin]
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(begin[best]), int(low + best + len(pattern))


def _borders(text: str, a: int, end: int) -> bool:
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def _short(index: Index) -> ahocorasick.Automaton | None:
    if not index.short:
        return None
    automaton = ahocorasick.Automaton()
    for t in index.short:
        automaton.add_word(t, t)
    automaton.make_automaton()
    return automaton


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


#: Zero characters between texts, at least: no stretch, band or diagonal reaches from one text into the next.
GAP = 2 * WINDOW


@dataclass
class Finding:
    """An item in a text: its windows that were found, the fewest edits of the longest of them, and the stretch."""

    item: object
    windows: int
    of_windows: int
    edits: int
    begin: int
    end: int


class Finder:
    def __init__(self, index: Index):
        self.index, self.automaton = index, _short(index)

    def findings(self, texts: list[str]) -> Iterator[list[Finding]]:
        """Of each of the texts, which are plain(). Each begins at a multiple of STEP, behind a gap, so that what is found
        in a text doesn't depend on those around it. A window that stands in a text without edits counts at its first and
        last such place; one that doesn't, wherever a band holds it within its edits."""
        for a, b in _slices(texts):
            part, joined, begins = texts[a:b], [], []
            at = 0
            for t in part:
                begins.append(at)
                size = -(-(len(t) + GAP) // STEP) * STEP
                joined += [t, "\0" * (size - len(t))]
                at += size
            yield from self._in_slice(part, "".join(joined), np.array(begins))

    def _in_slice(self, part: list[str], joined: str, begins: np.ndarray) -> Iterator[list[Finding]]:
        index = self.index
        code = codes(joined)
        exact: dict[tuple[int, int], tuple[int, int]] = {}
        other: list[tuple[int, int, int, int, int]] = []
        cached: dict[int, tuple] = {}
        for w, low in index.bands(code):
            if w not in cached:
                item, _, size = index.window(w)
                pattern = index.pattern(w)
                cached[w] = item, size, int(edits_of(np.int64(size))), pattern, pattern.tobytes().decode("utf-32-le")
            _, size, edits, _, as_text = cached[w]
            k = int(np.searchsorted(begins, low + WINDOW - Q + 2 * STEP, "right")) - 1
            start = int(begins[k])
            x, y = max(start, low - STEP), min(start + len(part[k]), low + 3 * STEP + size)
            if y - x < size - edits:
                continue
            if (first := joined.find(as_text, x, y)) >= 0:
                last = joined.rfind(as_text, x, y) + size
                least, most = exact.get((k, w), (first, last))
                exact[k, w] = min(first, least), max(last, most)
            else:
                other.append((k, w, low, x, y))
        hits: dict = defaultdict(list)
        for (k, w), (first, end) in exact.items():
            hits[k, cached[w][0]].append((0, first, end, w))
        for k, w, low, x, y in other:
            item, _, edits, pattern, _ = cached[w]
            if (k, w) not in exact and (got := banded(pattern, code[x:y], low - x, 2 * STEP, edits)):
                hits[k, item].append((got[0], x + got[1], x + got[2], w))
        by_text: dict = defaultdict(list)
        for (k, item), found in sorted(hits.items()):
            start, longest = int(begins[k]), max(cached[w][1] for *_, w in found)
            fewest = min(e for e, _, _, w in found if cached[w][1] == longest)
            by_text[k].append(Finding(index.items[item], len({w for *_, w in found}), int(index.of_windows[item]), fewest, min(f[1] for f in found) - start, max(f[2] for f in found) - start))
        for k, t in enumerate(part):
            yield by_text[k] + (self._short_ones(t) if self.automaton else [])

    def _short_ones(self, t: str) -> list[Finding]:
        places: dict[str, int] = {}
        for last, p in self.automaton.iter(t):
            if p not in places and _borders(t, last + 1 - len(p), last + 1):
                places[p] = last + 1 - len(p)
        return [Finding(item, 1, 1, 0, a, a + len(p)) for p, a in sorted(places.items()) for item in self.index.short[p]]


_SCHEMA = "doc_id long, item_id long, windows long, of_windows long, edits long, first_word long, end_word long"


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in pieces(batches, 1):
            texts = [plain(t.as_py()) for t in batch.column(1)]
            rows: list[tuple] = []
            for doc_id, t, found in zip(batch.column(0).to_pylist(), texts, finder.findings(texts), strict=True):
                blanks = np.flatnonzero(codes(t) == 32) if found else ()
                word = lambda at, blanks=blanks: int(np.searchsorted(blanks, at))
                rows += [(doc_id, f.item, f.windows, f.of_windows, f.edits, word(f.begin), word(max(f.end - 1, 0)) + 1) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return scan


def _indexes(benchmark: DataFrame, most_bytes: int) -> Iterator:
    """Broadcast indexes that hold all items together, each of about most_bytes at most: the items are dealt by a hash to as
    many parts as their text asks for at BYTES_A_CHARACTER, and one part at a time is built."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total * BYTES_A_CHARACTER // most_bytes))
    for i in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast(Index.of(tuple(r) for r in chosen.toLocalIterator()))


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text), other columns ignored. A row for each document and item of which it
    holds a window within 8 % edits: how many windows of the item's, the fewest edits of the longest of these windows, and
    the words that they span (by white space, end exclusive). An item of up to 96 characters is one window; a longer one has
    windows of 96 characters every 48 and of 72 every 12.

    Case and white space don't matter. Null or empty texts match nothing; items of fewer than 20 characters are found
    without edits, between word borders. Repeated rows give repeated findings; items with equal ids are taken one by one. Either
    table may be empty. The index of the benchmark goes to the executors whole only up to most_bytes; a larger one is taken
    in parts of about that size, one pass over the documents each."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return reduce(DataFrame.unionByName, (texts.mapInArrow(_scan(shared), _SCHEMA) for shared in _indexes(benchmark, most_bytes)))


def _without(shared, doc_id: int, text: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in pieces(batches, text):
            found = finder.findings([plain(t.as_py()) for t in batch.column(text)])
            yield batch.filter(pa.array([not f or i is None for i, f in zip(batch.column(doc_id).to_pylist(), found, strict=True)], pa.bool_()))

    return scan


def clean(docs: DataFrame, benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark, as leaks() finds it; rows with a null id or text
    stay. The decision is a function of the row and is made where the text is: nothing is joined or shuffled."""
    doc_id, text = (docs.columns.index(c) for c in ("doc_id", "text"))
    return reduce(lambda left, shared: left.mapInArrow(_without(shared, doc_id, text), docs.schema), _indexes(benchmark, most_bytes), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
