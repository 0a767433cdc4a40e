"""Language identification by Bloom filters whose bits are sliced by language.

Each language has a Bloom filter of the character n-grams that many of its documents hold. The filters share
their hash functions and lie side by side: cell p of the one table is a bit mask of the languages whose filter
has bit p, in as many words of 64 bits as the languages ask for. An n-gram's languages are the AND of its cells, all at once. A document's n-grams are counted by
language (a popcount of each language's bits); a filter with a share f of its bits set answers yes to a share
f^k of the n-grams that it does not hold, so counts are corrected to (count - n f^k) / (1 - f^k). The language
with the largest corrected count is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import fold, pieces, table

#: Characters of an n-gram, and odd multipliers that mix them (fixed values).
N = 3
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Code points that one step handles.
SLICE = 250_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each n-gram that holds a letter, in lower-case text with one blank around each run of letters;
    and the number of each n-gram's text."""
    joined = ("  ".join(texts) + "  ").lower()
    sizes = [len(t) if t.isascii() else len(t.lower()) for t in texts]
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.array(sizes) + 2)[: len(code)]
    letter = _is_letter(code)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a run of letters stands for the blank
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    if len(code) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(code) - N + 1
    with np.errstate(over="ignore"):
        h = sum((code[i : m + i] + np.uint64(1)) * MIX[i] for i in range(N))
        h ^= h >> np.uint64(29)
        h *= MIX[0]
        h ^= h >> np.uint64(32)
    whole = (owner[:m] == owner[N - 1 :]) & (letter[:m] | letter[1 : m + 1])
    return h[whole], owner[:m][whole]


_letters: np.ndarray | None = None


def _is_letter(code: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[code]


def cells(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The cells of each n-gram, a row for each hash function."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    return np.array([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(hashes)])


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t) + 2
    if at < len(texts):
        yield at, len(texts)


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return masks[language >> 6] >> np.uint64(language & 63) & np.uint64(1)


class SlicedBloom:
    """languages in order; masks: a row for every 64 languages, and in it for each of 2^bits cells those that have it set;
    prior: the fallback's number."""

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int, prior: int):
        self.languages, self.masks, self.hashes, self.prior = languages, masks, hashes, prior
        self.bits = masks.shape[1].bit_length() - 1
        self.wrong = np.array([_bit(masks, i).mean() for i in range(len(languages))]) ** hashes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of corrected counts) and coverage (share of n-grams held by that language's filter)."""
        out, score, cover = [], np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in _slices(texts):
            h, owner = grams(texts[a:b])
            where = cells(h, self.bits, self.hashes)
            mask = self.masks[:, where[0]]
            for w in where[1:]:
                mask &= self.masks[:, w]
            n = np.bincount(owner, minlength=b - a)
            counts = np.array([np.bincount(owner, _bit(mask, i).astype(float), b - a) for i in range(len(self.languages))])
            right = np.maximum((counts - n * self.wrong[:, None]) / np.maximum(1 - self.wrong[:, None], 1e-9), 0)
            best = np.where(right.max(0) > 0, right.argmax(0), self.prior)
            held = np.take_along_axis(right, best[None], 0)[0]
            score[a:b] = held / np.maximum(right.sum(0), 1e-9)
            cover[a:b] = held / np.maximum(n, 1)
            lettered = [any(map(str.isalpha, t)) for t in texts[a:b]]
            out += [self.languages[i] if x else "und" for i, x in zip(best, lettered, strict=True)]
            score[a:b] *= lettered
        return out, np.clip(score, 0, 1), np.clip(cover, 0, 1)


def train(labelled: DataFrame, bits: int = 18, hashes: int = 3, least_share: float = 0.02, rows_per_language: int = 5000) -> SlicedBloom | None:
    """labelled(doc_id, text, lang). A filter for each language from about rows_per_language of its rows, chosen by a hash
    of doc_id and text (all rows, if fewer; rows that repeat both are chosen or not together); an n-gram is held if at least least_share of them have it. What reaches the driver is
    a row for each language and, for every 64 languages, at most 2^bits cells. None if nothing is labelled. There may be
    any number of languages; the filters take 2^bits / 8 bytes each."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    per = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    languages = sorted(per)
    share = F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(1.0, rows_per_language / n))])
    drawn = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")]
    sample = labelled.where(drawn).select("lang", "text")
    number = {x: i for i, x in enumerate(languages)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            langs, texts = (np.array([number[x] for x in batch.column(0).to_pylist()]), batch.column(1).to_pylist())
            for a, b in _slices(texts):
                h, owner = grams(texts[a:b])
                if not len(owner):
                    continue
                edge = np.flatnonzero(np.diff(owner)) + 1
                once = [np.unique(x) for x in np.split(h, edge)]  # once for each text
                spoken = langs[a:b][owner[np.append(0, edge)]]
                for i in set(spoken.tolist()):
                    key, n = np.unique(np.concatenate([x for x, k in zip(once, spoken, strict=True) if k == i]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["l", "h", "n"])

    counts = sample.mapInArrow(held, "l int, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n"))
    rows = F.create_map(*[F.lit(x) for k, n in per.items() for x in (number[k], min(n, rows_per_language) * least_share)])
    kept = counts.where(F.col("n") >= rows[F.col("l")]).select("l", "h")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            p = cells(h.view(np.uint64), bits, hashes).astype(np.int64)
            word, bit = np.tile(lang >> 6, hashes), np.tile(np.int64(1) << (lang & 63).astype(np.int64), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(p.ravel()), pa.array(word.astype(np.int32)), pa.array(bit)], ["p", "word", "bit"])

    masks = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    for r in kept.mapInArrow(placed, "p long, word int, bit long").groupBy("p", "word").agg(F.bit_or("bit").alias("m")).toLocalIterator():
        masks[r.word, r.p] = np.uint64(r.m & (1 << 64) - 1)
    prior = number[max(languages, key=lambda k: (per[k], k))]
    return SlicedBloom(languages, masks, hashes, prior)


def predicted(docs: DataFrame, model: SlicedBloom | None) -> DataFrame:
    """docs(doc_id, text), other columns ignored. Returns (doc_id, lang_pred, score, coverage), a row for each row.

    lang_pred is `und`, with score 0, if the text is null or has no letter or no model was learned. A text with letters
    of which no filter knows an n-gram gets the most frequent learned language with score 0. Repeated rows are kept; an
    empty table gives no rows."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            lang, score, cover = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], ["doc_id", "lang_pred", "score", "coverage"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(apply, "doc_id long, lang_pred string, score double, coverage double")


def kept(docs: DataFrame, model: SlicedBloom | None, long_enough: int, least_coverage: float) -> DataFrame:
    """The rows of docs whose text has a letter and, from long_enough characters on, at least least_coverage of its n-grams
    in the predicted language's filter. All columns stay; the rows pass through as they are. Without a model, texts with
    a letter stay."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if model:
                lang, _, cover = model.predict(texts)
                keep = [x != "und" and (len(t) < long_enough or c >= least_coverage) for x, t, c in zip(lang, texts, cover, strict=True)]
            else:
                keep = [any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def model_of(docs: DataFrame) -> SlicedBloom | None:
    """Learned from the rows that are not held out."""
    return train(docs.where(fold("doc_id") != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, model_of(docs)).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "coverage")
