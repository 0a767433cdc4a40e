"""Language-model scores by the likelihood of a subword lattice.

A word's lattice holds all of its segmentations into the pieces of an existing vocabulary. A segmentation's weight is
the product of its pieces' probabilities; the word's probability is the sum over all of them, by a forward recursion
in log space. The vocabulary's own scores give the pieces' first probabilities, and with them each text's lattice_score.
Learning, which can be left out, gives its score: expected counts of the pieces over the distinct words of the training
documents (rounds of expectation and maximization) give new probabilities, and a training word is one more segmentation of
itself, by its share in training; the share of words met once is left to the pieces. A text is its words and an end; the
probabilities of all words and the end sum to one, for either score.

Texts are read once and not shuffled: each task writes dictionaries of the words that it meets and, for each document,
counts by the words' numbers in its dictionary. Distinct words are summed and scored once over the whole corpus, and go
back to the dictionaries that hold them; documents are then scored dictionary by dictionary.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import exp, inf, log, log1p

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import deleted, fold, saved, shared_folder, table, utf8

#: What begins a word in the vocabulary's pieces (fixed value); words after which a task begins its next dictionary.
MARK, WORDS = "▁", 250_000
#: Characters of a word beyond which its edges are not kept but looked up again on the way back.
LONG_WORD = 4096
#: Words whose lattices are arrays together, characters beyond which a word goes alone, as do words of a smaller probability.
TOGETHER, SHORT_WORD, LEAST = 4096, 64, 1e-250
#: Added to each piece's expected count; added to ranks where scores are ranks.
SMOOTH, SHIFT, ROUNDS = 0.1, 10.0, 2


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a model's file and the log probabilities that its scores give. Scores that are minus the ranks of
    pieces are taken as Zipf's law has it; scores of a unigram model are log probabilities already."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(len(model)) if not model.is_control(i) and not model.is_unknown(i)]
    score = np.array([model.get_score(i) for i in ids], float)
    if (score == np.round(score)).all():
        score = -np.log(SHIFT - np.minimum(score, 0))
    return [model.id_to_piece(i) for i in ids], score - np.logaddexp.reduce(score)


class Lattice:
    """Pieces and their log probabilities."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        value = dict(zip(pieces, zip(range(len(pieces)), map(float, logs), strict=True), strict=True))
        self.logs = list(map(float, logs))
        self.bytes = [value.pop(f"<0x{b:02X}>", (-1, -inf)) for b in range(256)]
        # The beginnings of pieces, so that a place's pieces end where no longer one can follow.
        self.table: dict[str, tuple[int, float] | None] = {p[:i]: None for p in value for i in range(1, len(p))}
        self.table |= value

    def _fallback(self, c: str) -> float:
        """The log probability of a character that is no piece, by its bytes."""
        return sum(self.bytes[b][1] for b in c.encode())

    def _from(self, s: str, i: int) -> Iterator[tuple[int, float, int]]:
        """The edges from a place: the next place, log probability, piece (-1: the character, by its bytes)."""
        single = False
        for j in range(i + 1, len(s) + 1):
            hit = self.table.get(s[i:j], 0)
            if hit:
                single |= j == i + 1
                yield j, hit[1], hit[0]
            elif hit == 0:
                break
        if not single:
            yield i + 1, self._fallback(s[i]), -1

    def _by_bytes(self, c: str, n: float, into: np.ndarray | list) -> None:
        """Adds n to each byte of a character that no piece is."""
        for b in c.encode():
            if self.bytes[b][0] >= 0:
                into[self.bytes[b][0]] += n

    def _expect_long(self, s: str, count: float, into: np.ndarray | list) -> None:
        """As expect, in 16 bytes a character: two numbers for each place, and edges looked up again on the way back."""
        n = len(s)
        alpha = array("d", [-inf]) * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            here = alpha[i]
            for j, w, _ in self._from(s, i):
                x, y = here + w, alpha[j]
                alpha[j] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        rest = array("d", [0.0]) * n + array("d", [1.0])
        for i in range(n - 1, -1, -1):
            for j, w, piece in self._from(s, i):
                if rest[j] != 0.0:
                    part = rest[j] * exp(alpha[i] + w - alpha[j])
                    rest[i] += part
                    if piece >= 0:
                        into[piece] += count * part
                    else:
                        self._by_bytes(s[i], count * part, into)

    def forward(self, word: str) -> float:
        """The log of the word's probability, over all segmentations."""
        s, get = MARK + word, self.table.get
        n = len(s)
        alpha = [-inf] * (n + 1) if n <= LONG_WORD else array("d", [-inf]) * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            here, single = alpha[i], False
            for j in range(i + 1, n + 1):
                hit = get(s[i:j], 0)
                if hit:
                    x, y = here + hit[1], alpha[j]
                    alpha[j] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
                    if j == i + 1:
                        single = True
                elif hit == 0:
                    break
            if not single:
                x, y = here + self._fallback(s[i]), alpha[i + 1]
                alpha[i + 1] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        return alpha[-1]

    def forward_both(self, word: str, other: Lattice) -> tuple[float, float]:
        """forward() of this and of another lattice of the same pieces, which are looked up once."""
        s, get, logs = MARK + word, self.table.get, other.logs
        n = len(s)
        alpha, beta = ([-inf] * (n + 1) if n <= LONG_WORD else array("d", [-inf]) * (n + 1) for _ in range(2))
        alpha[0] = beta[0] = 0.0
        for i in range(n):
            here, there, single = alpha[i], beta[i], False
            for j in range(i + 1, n + 1):
                hit = get(s[i:j], 0)
                if hit:
                    piece, w = hit
                    x, y = here + w, alpha[j]
                    alpha[j] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
                    x, y = there + logs[piece], beta[j]
                    beta[j] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
                    if j == i + 1:
                        single = True
                elif hit == 0:
                    break
            if not single:
                x, y = here + self._fallback(s[i]), alpha[i + 1]
                alpha[i + 1] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
                x, y = there + other._fallback(s[i]), beta[i + 1]
                beta[i + 1] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        return alpha[-1], beta[-1]

    def expect(self, word: str, count: float, into: np.ndarray | list) -> None:
        """Adds to each piece's place in `into` its expected number in the word, `count` times."""
        s, get = MARK + word, self.table.get
        n = len(s)
        if n > LONG_WORD:
            return self._expect_long(s, count, into)
        edges: list[tuple[int, int, float, int]] = []  # place, next place, log probability, piece (-1: by its bytes)
        alpha = [-inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            here, single = alpha[i], False
            for j in range(i + 1, n + 1):
                hit = get(s[i:j], 0)
                if hit:
                    piece, w = hit
                    edges.append((i, j, w, piece))
                    x, y = here + w, alpha[j]
                    alpha[j] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
                    if j == i + 1:
                        single = True
                elif hit == 0:
                    break
            if not single:
                w = self._fallback(s[i])
                edges.append((i, i + 1, w, -1))
                x, y = here + w, alpha[i + 1]
                alpha[i + 1] = x if y == -inf else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        # Backwards, in shares of the whole: the part of all segmentations that goes on from a place.
        rest = [0.0] * n + [1.0]
        for i, j, w, piece in reversed(edges):
            if rest[j] == 0.0:
                continue
            # Of what reaches j, the share that comes by this edge.
            part = rest[j] * exp(alpha[i] + w - alpha[j])
            rest[i] += part
            if piece >= 0:
                into[piece] += count * part
            else:
                self._by_bytes(s[i], count * part, into)


    @cached_property
    def _tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beginnings of pieces by number, 0 the empty one: (number and next character) in order, the beginning that each
        makes, and the piece that a beginning is, or -1."""
        number = {"": 0} | {x: i + 1 for i, x in enumerate(self.table)}
        key = np.array([number[x[:-1]] << 21 | ord(x[-1]) for x in self.table], np.int64)
        order = np.argsort(key)
        return key[order], order + 1, np.array([-1, *(v[0] if v else -1 for v in self.table.values())], np.int64)

    def _edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the words' lattices: place, next place, piece (-1: by its bytes), character, where they begin and end
        in their word; and each word's first and last place. Places are numbered through all words."""
        keys, made, piece_of = self._tree
        text = [MARK + w for w in words]
        size = np.array([len(t) for t in text], np.int64)
        code = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.int64)
        ends, number = np.cumsum(size), np.arange(len(text))
        left = np.repeat(ends, size) - np.arange(len(code))
        at, state, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        length = 0
        while len(at):
            key = state << 21 | code[at + length]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            length += 1
            piece = np.full(len(at), -1)
            piece[hit] = piece_of[made[i[hit]]]
            edge = piece >= 0 if length > 1 else slice(None)
            found.append((at[edge], np.full(len(at), length)[edge], piece[edge]))
            on = hit & (left[at] > length)
            at, state = at[on], made[i[on]]
        at, many, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        word = np.repeat(number, size)
        begin = at - (ends - size)[word[at]]
        return at + word[at], at + word[at] + many, piece, code[at], begin, begin + many, ends - size + number, ends + number

    def _weights(self, piece: np.ndarray, char: np.ndarray) -> np.ndarray:
        p = np.exp(self.logs)[piece]
        for c in np.unique(char[piece < 0]).tolist():
            p[(piece < 0) & (char == c)] = exp(self._fallback(chr(c)))
        return p

    def forward_many(self, words: list[str], lattices: list[Lattice]) -> list[list[float]]:
        """forward() of each word by each of the lattices, which have this one's pieces. Probabilities are summed as they are,
        for edges of many words at a time; words too long or too improbable for that go alone."""
        out = [[0.0] * len(words) for _ in lattices]
        alone = {i for i, w in enumerate(words) if len(w) > SHORT_WORD}
        short = [i for i in range(len(words)) if i not in alone]
        for n in range(0, len(short), TOGETHER):
            of = short[n : n + TOGETHER]
            a, b, piece, char, begin, _, first, last = self._edges([words[i] for i in of])
            order = np.argsort(begin, kind="stable")
            a, b, piece, char, begin = (x[order] for x in (a, b, piece, char, begin))
            for lattice, logs in zip(lattices, out, strict=True):
                alpha = _summed(a, b, lattice._weights(piece, char), begin, first, int(last[-1]) + 1)[last]
                alone.update(of[i] for i in np.flatnonzero(alpha < LEAST))
                for i, x in zip(of, np.log(np.maximum(alpha, LEAST)).tolist(), strict=True):
                    logs[i] = x
        for i in alone:
            for lattice, logs in zip(lattices, out, strict=True):
                logs[i] = lattice.forward(words[i])
        return out

    def expect_many(self, words: list[str], into: np.ndarray) -> None:
        """expect() of each word, once, as forward_many() goes."""
        alone = [w for w in words if len(w) > SHORT_WORD]
        short = [w for w in words if len(w) <= SHORT_WORD]
        for n in range(0, len(short), TOGETHER):
            of = short[n : n + TOGETHER]
            a, b, piece, char, begin, end, first, last = self._edges(of)
            p, places = self._weights(piece, char), int(last[-1]) + 1
            order = np.argsort(begin, kind="stable")
            alpha = _summed(a[order], b[order], p[order], begin[order], first, places)
            order = np.argsort(-end, kind="stable")
            rest = _summed(b[order], a[order], p[order], end[order], last, places)
            total = alpha[last]
            alone += [of[i] for i in np.flatnonzero(total < LEAST)]
            share = np.where(total < LEAST, 0, 1 / np.maximum(total, LEAST))
            part = alpha[a] * p * rest[b] * np.repeat(share, last - first + 1)[a]
            known = piece >= 0
            into += np.bincount(piece[known], part[known], len(into))
            for c, x in zip(char[~known].tolist(), part[~known].tolist(), strict=True):
                self._by_bytes(chr(c), x, into)
        for w in alone:
            self.expect(w, 1, into)


def _summed(a: np.ndarray, b: np.ndarray, p: np.ndarray, step: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """Sums over all ways from `first` along edges a to b, in order of steps; edges of one step lead to different places."""
    sums = np.zeros(places)
    sums[first] = 1.0
    bounds = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
    for i, j in zip(bounds, bounds[1:], strict=False):
        sums[b[i:j]] += sums[a[i:j]] * p[i:j]
    return sums


_READ = "kind int, grp long, idx int, word binary, c long, doc_id long, held_out boolean, n_words long, vec binary"
_READ_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]


def _rows(n: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in _READ.split(", ")]
    given = {k: pa.array(v, t) for k, t in zip(names, _READ_TYPES, strict=True) if (v := columns.get(k)) is not None}
    return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)) for k, t in zip(names, _READ_TYPES, strict=True)], names)


def _read(most_words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a dictionary's words with their counts in its training documents. Kind 1: documents."""
        group = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        counts = np.zeros(1024, np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                n = len(part)
                yield _rows(n, kind=np.zeros(n, np.int32), grp=np.full(n, group), idx=np.arange(a, a + n, dtype=np.int32), word=part, c=counts[a : a + n])

        for batch in batches:
            docs: list[tuple] = []
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, out, text in zip(ids, held, batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().lower().split()
                idx, n = np.unique(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), return_counts=True)
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(numbers) + len(counts), np.int64)])
                if not out:
                    counts[idx] += n
                docs.append((group, doc_id, out, len(words), pack(np.concatenate([np.diff(idx, prepend=0), n]).astype("<u4").tobytes())))
                if len(numbers) > most_words or len(docs) >= 2000:
                    c = list(zip(*docs, strict=True))
                    yield _rows(len(docs), kind=np.ones(len(docs), np.int32), grp=c[0], doc_id=c[1], held_out=c[2], n_words=c[3], vec=c[4])
                    docs = []
                if len(numbers) > most_words:
                    yield from dictionary()
                    numbers, counts, group = {}, np.zeros(1024, np.int64), group + 1
            if docs:
                c = list(zip(*docs, strict=True))
                yield _rows(len(docs), kind=np.ones(len(docs), np.int32), grp=c[0], doc_id=c[1], held_out=c[2], n_words=c[3], vec=c[4])
        yield from dictionary()

    return read


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lattice-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder), folder


def _expected(path: str, logs: np.ndarray):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)[0]
        lattice, total = Lattice(pieces, logs), np.zeros(len(pieces))
        for batch in batches:
            lattice.expect_many([w.decode() for w in batch.column(0).to_pylist()], total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

    return expect


def _words_scored(path: str, logs: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, given = vocabulary(path)
        own = Lattice(pieces, given)
        learned = own if logs is given or (logs == given).all() else Lattice(pieces, logs)
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            own_p, *others = (pa.array(x, pa.float64()) for x in own.forward_many(words, [own] if learned is own else [own, learned]))
            log_p = others[0] if others else own_p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), log_p, own_p], ["word", "c", "log_p", "own_p"])

    return score


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def mixed(c: np.ndarray, log_p: np.ndarray, words: int, once: int, ends: int, remembered: bool = True) -> tuple[np.ndarray, float]:
    """Log probabilities of words with training counts c and lattice log_p, and of the end; remembered: whether a training
    word is a segmentation of itself."""
    end = (ends + SMOOTH) / (words + ends + 2 * SMOOTH)
    if not remembered:
        return log1p(-end) + log_p, log(end)
    rest = max(once, 1) / (words + 1)
    with np.errstate(divide="ignore"):
        seen = np.log1p(-rest) + np.log(c / max(words, 1)) if words else np.full(len(c), -np.inf)
    return np.log1p(-end) + np.logaddexp(seen, np.log(rest) + log_p), log(end)


def _documents_scored(n: int, v: int, ends: int, once: int, remembered: bool):
    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        many = words.num_rows
        c, log_p, own_p = np.zeros(many, np.int64), np.zeros(many), np.zeros(many)
        at = words["idx"].to_numpy()
        c[at], log_p[at], own_p[at] = (words[x].to_numpy() for x in ("c", "log_p", "own_p"))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        log_p, end_log = mixed(c, log_p, n - ends, once, ends, remembered)
        own_p, _ = mixed(c, own_p, n - ends, once, ends, False)
        base_end = np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for vec in docs["vec"].to_pylist():
            both = np.frombuffer(unpack(vec), "<u4").astype(np.int64).reshape(2, -1)
            idx, times = np.cumsum(both[0]), both[1]
            scores = float(times @ base[idx] + base_end), float(times @ log_p[idx] + end_log) / log(10), float(times @ own_p[idx] + end_log) / log(10)
            out.append((int(times[c[idx] > 0].sum()) + (ends > 0), *scores))
        known, *scores = zip(*out, strict=True) if out else ((),) * 4
        tokens = docs["n_words"].to_numpy() + 1
        columns = [docs["doc_id"], docs["held_out"], tokens, pa.array(known, pa.int64()), np.full(len(tokens), n), *(pa.array(x, pa.float64()) for x in scores)]
        return pa.table(columns, [x.split()[0] for x in _OUT.split(", ")])

    return score


def lattice_scores(docs: DataFrame, path: str, held_out, most_words: int = WORDS, rounds: int = ROUNDS, remembered: bool = True) -> DataFrame:
    """docs(doc_id, text), other columns ignored; held_out: a condition on doc_id, true for rows that are not learned from;
    path: a sentencepiece model's file. Returns, a row for each row, doc_id, held_out, n_tokens (words and the end), n_known
    (tokens that training documents hold), train_tokens, base_score (smoothed counts of words), score, the log10 probability
    of the text under the learned lattice model, and lattice_score, that under the vocabulary's own probabilities alone.

    rounds: of expectation and maximization, 0 to keep the vocabulary's probabilities; remembered: whether training words are
    segmentations of themselves. With 0 and False, score is lattice_score. A null text is empty: its only token is the end. A
    null doc_id is not held out. Repeated rows count each time. Without training rows the vocabulary's own scores stand and
    base_score is 0. An empty table gives no rows. The result is kept in the shared folder; what was written on the way is
    deleted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), utf8("text").alias("text"))
    read, read_folder = _written(rows.mapInArrow(_read(most_words), _READ))
    dictionaries = read.where("kind = 0").select("grp", "idx", "word", "c")
    documents = read.where("kind = 1").select("grp", "doc_id", "held_out", "n_words", "vec")
    words, words_folder = _written(dictionaries.groupBy("word").agg(F.sum("c").alias("c")))
    ends, groups = documents.agg(F.count_if(~F.col("held_out")), F.count_distinct("grp")).first()
    tokens, distinct, once = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n, v = tokens + ends, distinct + (ends > 0)
    # Expected counts: at most a row for each piece of the vocabulary reaches the driver.
    pieces, logs = vocabulary(path)
    for _ in range(rounds if distinct else 0):
        counts = np.zeros(len(pieces))
        expected = words.where("c > 0").select("word").mapInArrow(_expected(path, logs), "piece int, n double")
        for r in expected.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece] = r.n
        logs = np.log((counts + SMOOTH) / (counts.sum() + SMOOTH * len(pieces)))
    scored = words.mapInArrow(_words_scored(path, logs), "word binary, c long, log_p double, own_p double")
    values = dictionaries.select("grp", "idx", "word").join(scored, "word").select(F.col("grp").alias("of"), "idx", "c", "log_p", "own_p")
    # As many tasks as dictionaries, so that a task's share stays the same however many there are.
    documents, values = documents.repartition(max(1, groups), "grp"), values.repartition(max(1, groups), "of")
    out = saved(documents.groupBy("grp").cogroup(values.groupBy("of")).applyInArrow(_documents_scored(n, v, ends, once, remembered), _OUT))
    for folder in (read_folder, words_folder):
        deleted(spark, folder)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fold("doc_id") == 1)
