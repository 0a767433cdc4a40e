"""Removal of repeated passages by difference-cover anchors.

A difference cover D modulo a period v has, for any two residues, a shift below v that moves both into D. So of two equal runs
of w words, wherever they begin, two places at the same shift from their beginnings are both cover places, and the
w - v + 1 words that begin there lie inside the runs. Only runs of w - v + 1 words at cover places, 5 of 21, are hashed as
anchors and looked for elsewhere; around the anchors that occur again the windows of w words are hashed and looked for in the
same way.

What occurs again is found in buckets of hashes. A task first settles what repeats inside itself: of each hash it sends one
witness, so that a passage that a third of all documents share is as many rows of its bucket as there are tasks. Hashes,
places and texts travel in packed and compressed rows: hashes by task and bucket, places by pages of rows of a file, texts as
parts of such pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import file_row, pieces, saved, table, utf8

WINDOW = 35
#: A perfect difference set: each shift but 0 modulo 21 is the difference of one pair of its members (fixed values).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Odd multipliers of the two lanes of hashes (fixed values); 1 less has few factors of two.
LANES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
#: Bytes of text that a step looks at, entries that a task holds before it sends them, entries of a bucket on average, words
#: whose hashes a worker remembers, bytes that a word takes on average, tasks that buckets are dealt to at most, bits of a
#: row's number in its page.
STEP_BYTES, HELD, BUCKET, WORDS, WORD_BYTES, MOST_TASKS, PAGE = 1 << 20, 1 << 20, 1 << 19, 1 << 17, 6, 100_000, 10

_BLANK = re.compile(rb"[ \t-\r]")
_KEY = "file long, check int, page long"
#: Of a task and a bucket: files, by two hashes of each; of each witness its hashes (48 bits of the first, beside those that
#: say the bucket), file (a number in this list), row and place, and whether the task holds its hashes twice; of each other
#: entry its file, row and place.
_PACKED = "bucket int, files binary, checks binary, first binary, second binary, witnesses binary, twice binary, others binary"


def _tight(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers of one length, compressed by planes of bytes."""
    planes = np.stack([x.astype("<u4", copy=False) for x in arrays]).view(np.uint8).reshape(len(arrays), -1, 4)
    return zstandard.ZstdCompressor(level=1).compress(planes.transpose(0, 2, 1).tobytes()) if planes.size else b""


def _loose(packed: bytes, arrays: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed) if packed else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(arrays, 4, -1).transpose(0, 2, 1)).view("<u4").reshape(arrays, -1)


class WordHashes:
    """64-bit hashes of words; a bounded number is remembered."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > WORDS:
            self.number = {}
        number, known = self.number, len(self.number)
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > known:
            new = np.fromiter(map(xxhash.xxh3_64_intdigest, islice(number, known, None)), np.uint64, len(number) - known)
            if len(number) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:known], np.zeros(2 * len(number) - known, np.uint64)])
            self.hashes[known : len(number)] = new
        return self.hashes[at]


class Runs:
    """Hashes of runs of words from sums of hashes times powers, so that the length of a run costs nothing."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64) for _ in LANES]
        self.inverse = [np.ones(1, np.uint64) for _ in LANES]

    def _grown(self, n: int) -> None:
        if len(self.powers[0]) < n:
            n = max(n, 1 << 17)
            for lane, factor in enumerate(LANES):
                for out, f in ((self.powers, factor), (self.inverse, pow(factor, -1, 1 << 64))):
                    power = np.full(n, f, np.uint64)
                    power[0] = 1
                    out[lane] = np.multiply.accumulate(power)

    def of(self, words: np.ndarray, starts: np.ndarray, length: int, lane: int) -> np.ndarray:
        """The hash of the `length` words from each of `starts` on."""
        self._grown(len(words) + 1)
        if lane:
            words = words ^ words >> np.uint64(31)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.powers[lane][: len(words)], out=sums[1:])
        h = (sums[starts + length] - sums[starts]) * self.inverse[lane][starts]
        h ^= h >> np.uint64(32)  # the best bits of a product are its high ones; a bijection
        h *= np.uint64(LANES[1 - lane])
        return h ^ h >> np.uint64(29)


def anchors(n: int, window: int = WINDOW) -> np.ndarray:
    """The cover places of a document of n words at which an anchor of window - PERIOD + 1 words fits."""
    length = window - PERIOD + 1
    at = np.arange(max(0, n - length + 1)) if n >= window else np.zeros(0, np.int64)
    return at[np.isin(at % PERIOD, COVER)]


def windows(at: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """The beginnings of the windows of a document of n words that hold an anchor at one of `at`."""
    marks = np.zeros(n + 2, np.int32)
    np.add.at(marks, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(marks, at + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: n - window + 1])


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about STEP_BYTES."""
    at = 0
    while len(text) - at > STEP_BYTES:
        blank = _BLANK.search(text, at + STEP_BYTES)
        stop = blank.start() if blank else len(text)
        yield text[at:stop].split()
        at = stop
    yield (text[at:] if at else text).split()


class _Sender:
    """Entries (file, check, row, hashes, place) of one task, sent by buckets of their first hash."""

    def __init__(self, buckets: int):
        self.buckets, self.files, self.entries, self.size = buckets, {}, [], 0

    def add(self, file: tuple[int, int], row: int, hashes: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = self.files.setdefault(file, len(self.files))
        self.entries.append((*hashes, np.full(len(at), number, np.uint32), np.full(len(at), row, np.uint32), at.astype(np.uint32)))
        self.size += len(at)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        *hashes, file, row, at = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        known = np.array(list(self.files), [("file", "<i8"), ("check", "<i4")])
        self.files, self.entries, self.size = {}, [], 0
        order = np.lexsort(hashes[::-1])
        same = _same(hashes, order)
        # The first of equal entries goes as their witness, the others as places that are known to occur again.
        head, twice = np.empty(len(order), bool), np.empty(len(order), bool)
        head[order], twice[order] = np.append(True, ~same), np.append(same, False)
        cell = (hashes[0] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        order = np.argsort(cell, kind="stable")  # rows and places stay in order
        cell, cuts = cell[order], np.flatnonzero(np.diff(cell[order], prepend=np.uint64(1 << 63)))
        rows = []
        for own in np.split(order, cuts[1:]):
            here, number = np.unique(file[own], return_inverse=True)
            number, h = number.astype(np.uint32), head[own]
            w = own[h]
            packed = [hashes[0][w].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), hashes[1][w].tobytes() if len(hashes) > 1 else b""]
            place = [_tight(number[k], np.diff(row[own][k], prepend=np.uint32(0)), at[own][k]) for k in (h, ~h)]
            rows.append((known["file"][here].tobytes(), known["check"][here].tobytes(), *packed, place[0], np.packbits(twice[w]).tobytes(), place[1]))
        buckets, names = cell[cuts].tolist(), [x.split()[0] for x in _PACKED.split(", ")]
        for i in range(0, len(rows), 256):
            columns = zip(*rows[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets[i : i + 256], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names)


def _same(hashes: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each entry but the first, in this order, equals the one before."""
    same = np.ones(max(0, len(order) - 1), bool)
    for h in hashes:
        h = h[order]
        same &= h[1:] == h[:-1]
    return same


def _hashed(window: int, buckets: int, around: bool):
    """Rows (file, check, row, text) to packed entries of anchors; or parts of pages and places of anchors (file, check, blob,
    places) to packed entries of the windows around these."""
    length = window if around else window - PERIOD + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_runs, sender = WordHashes(), Runs(), _Sender(buckets)
        for files, checks, rows, texts, held in (_page_texts if around else _plain_texts)(batches):
            parts, wanted, first = [], [], 0
            several: list[bytes] = []
            for i, text in enumerate(texts):
                n = 0
                for words in _blocks(text):
                    several += words
                    n += len(words)
                    if len(several) > WORDS:
                        parts.append(of_words.of(several))
                        several = []
                at = windows(held[i], n, window) if around else anchors(n, window)
                if len(at):
                    wanted.append((i, first, at))
                first += n
            if not wanted:
                continue
            h = np.concatenate([*parts, of_words.of(several)])
            starts = np.concatenate([begin + at for _, begin, at in wanted])
            lanes = [of_runs.of(h, starts, length, 0)]
            if around:
                lanes.append((of_runs.of(h, starts, length, 1) >> np.uint64(32)).astype(np.uint32))
            begin = 0
            for i, _, at in wanted:
                stop = begin + len(at)
                yield from sender.add((files[i], checks[i]), rows[i], [x[begin:stop] for x in lanes], at)
                begin = stop
        yield from sender.flush()

    return scan


def _plain_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches, 3, STEP_BYTES):
        yield *(batch.column(i).to_pylist() for i in range(4)), None


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for file, check, part, places in _opened(batches):
        has = [i for i, x in enumerate(places) if len(x)]
        if has:
            part = part.take(pa.array(has))
            yield [file] * len(has), [check] * len(has), part.column("row").to_pylist(), part.column("text").to_pylist(), [places[i] for i in has]


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, check, row, text[, held]) to (file, check, page, blob): parts of pages of up to about STEP_BYTES, compressed."""
    how = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in pieces(batches, 3, STEP_BYTES):
        place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (r >> PAGE for r in batch.column(2).to_pylist()), strict=True))
        cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a).select(batch.schema.names[2:])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=how) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([place[a][0]], pa.int64()), pa.array([place[a][1]], pa.int32()), pa.array([place[a][2]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["file", "check", "page", "blob"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, check, blob, places) to file, check, the part of a page (row, text, ...) and the places in each of its texts."""
    for batch in batches:
        for file, check, blob, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            part = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            row, at = np.concatenate([_loose(x, 2) for x in lists or [b""]], axis=1)
            order = np.lexsort((at, row))
            row, at = row[order], at[order].astype(np.int64)
            own = part.column(0).to_numpy() & ((1 << PAGE) - 1)
            yield file, check, part, [at[a:b] for a, b in zip(np.searchsorted(row, own), np.searchsorted(row, own, "right"), strict=True)]


class _Found:
    """Places that occur again, sent by pages."""

    def __init__(self):
        self.entries, self.size = [], 0

    def add(self, file: np.ndarray, check: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            self.entries.append((file, check, row, at))
            self.size += len(at)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        file, check, row, at = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        self.entries, self.size = [], 0
        order = np.lexsort((at, row, check, file))
        file, check, row, at = file[order], check[order], row[order], at[order]
        page, local = (row >> np.uint32(PAGE)).astype(np.int64), row & np.uint32((1 << PAGE) - 1)
        cuts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (check[1:] != check[:-1]) | (page[1:] != page[:-1])))
        packed = [_tight(r, a) for r, a in zip(np.split(local, cuts[1:]), np.split(at, cuts[1:]), strict=True)]
        whole = pa.RecordBatch.from_arrays([pa.array(file[cuts]), pa.array(check[cuts]), pa.array(page[cuts]), pa.array(packed, pa.binary())], ["file", "check", "page", "places"])
        for i in range(0, len(cuts), 1024):
            yield whole.slice(i, 1024)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed entries of whole buckets, one bucket after the other, to (file, check, page, places) of those that occur again."""
    now, held, found = None, [], _Found()

    def settled() -> Iterator[pa.RecordBatch]:
        first, second, file, check, row, at, again = (np.concatenate(x) for x in zip(*held, strict=True))
        hashes = [first, second] if len(second) else [first]
        order = np.lexsort(hashes[::-1])
        same = _same(hashes, order)
        pick = order[again[order] | np.append(False, same) | np.append(same, False)]
        held.clear()
        yield from found.add(file[pick], check[pick], row[pick], at[pick])

    for batch in batches:
        for bucket, files, checks, first, second, witnesses, twice, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield from settled()
            now = bucket
            files, checks = np.frombuffer(files, "<i8"), np.frombuffer(checks, "<i4")
            places = []
            for packed in (witnesses, others):
                file, row, at = _loose(packed, 3)
                places.append((files[file], checks[file], np.cumsum(row, dtype=np.uint32), at))
            hashes = np.zeros((len(first) // 6, 8), np.uint8)
            hashes[:, :6] = np.frombuffer(first, np.uint8).reshape(-1, 6)
            held.append((hashes.view("<u8").ravel(), np.frombuffer(second, "<u4"), *places[0], np.unpackbits(np.frombuffer(twice, np.uint8), count=len(hashes)).astype(bool)))
            yield from found.add(*places[1])
    if held:
        yield from settled()
    yield from found.flush()


def _repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """(file, check, page, places): for each page of rows packed lists of rows and places whose hashes occur at another place too."""
    dealt = packed.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_again, f"{_KEY}, places binary").groupBy("file", "check", "page").agg(F.collect_list("places").alias("places"))


def _kept(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, part, places in _opened(batches):
            out = []
            for text, at in zip(part.column("text").to_pylist(), places, strict=True):
                n, left, kept = 0, 0, []
                marks = np.zeros(int(at.max(initial=-window)) + window + 1, np.int32)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + window, -1)
                gone = np.cumsum(marks) > 0
                for words in _blocks(text):
                    here = gone[n : n + len(words)]
                    n += len(words)
                    if here.any():
                        words = [w for w, g in zip(words, here.tolist(), strict=False) if not g] + words[len(here) :]
                    if words:
                        kept.append(b" ".join(words))
                        left += len(words)
                out.append((n, n - left, b" ".join(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("held"), *columns], ["held", "n_words", "n_removed", "kept"])

    return scan


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows(file, check, row, text as binary), keys that no two rows share and that a second reading gives again. Returns
    (file, check, page, places): for pages of 2^PAGE rows packed lists of rows and numbers of words, of the windows whose words
    begin anywhere else too."""
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    texts = rows.select("file", "check", "row", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Text of one-letter words has three times the usual words, and so three times the usual entries in a bucket.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = lambda share: max(least, int(total * share / WORD_BYTES / BUCKET) + 1)
    few, many = buckets(len(COVER) / PERIOD), buckets(1)
    places = saved(_repeated(texts.mapInArrow(_hashed(window, few, False), _PACKED), few))
    around = _pages(texts).join(places, ["file", "check", "page"]).select("file", "check", "blob", "places")
    return saved(_repeated(around.mapInArrow(_hashed(window, many, True), _PACKED), many))


def _pages(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_paged, f"{_KEY}, blob binary")


def without_repeats(docs: DataFrame, window: int = WINDOW, key: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs(text, any more columns). The same rows and columns, and n_words, n_removed and kept: the text's words without
    those in windows of `window` words that also begin anywhere else, in the same row too, joined by single blanks.

    key: an expression over docs, common.file_row() for a table read from files; without it, docs are saved with a key first.
    columns: those of docs that come out, by default all. A null or empty text has no words and keeps none; rows of fewer
    words than a window keep all. Repeated rows, also of equal or null ids, lose each what the other holds: of a repeated
    passage no copy stays. Where docs have a column called n_words, n_removed or kept, the new one gets an underscore behind
    its name. An empty table gives no rows."""
    columns = docs.columns if columns is None else columns
    held = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("held")
    number = F.monotonically_increasing_id()
    own = F.struct(F.shiftright(number, 33).alias("file"), F.lit(0).alias("check"), number.bitwiseAND((1 << 33) - 1).alias("row"))
    rows = docs.select(held, utf8("text").alias("text"), (own if key is None else key).alias("key"))
    if key is None:
        rows = saved(rows)
    rows = rows.select("key.*", "text", "held")
    places = repeated_windows(rows, window)
    both = _pages(rows.select("file", "check", "row", "text", "held")).join(places, ["file", "check", "page"], "left").select("file", "check", "blob", "places")
    out = both.mapInArrow(_kept(window), f"held {rows.schema['held'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    taken, new = list(columns), []
    for name, column in (("n_words", F.col("n_words")), ("n_removed", F.col("n_removed")), ("kept", F.col("kept").cast("string"))):
        while name in taken:
            name += "_"
        taken.append(name)
        new.append(column.alias(name))
    return out.select("held.*", *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), key=file_row(), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - {WINDOW} + 2)) AS s, w FROM split WHERE len(w) >= {WINDOW}),
runs AS (SELECT r, s, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS run FROM starts),
again AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
gone AS (SELECT r, s FROM runs SEMI JOIN again USING (run)),
covered AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS i FROM gone),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
