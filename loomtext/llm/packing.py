"""Packing token sequences by the dot-product heuristic for vector bin packing.

Each piece of a document demands tokens, one segment and its loss-bearing tokens; a sequence has a limit on each.
A sequence is filled from a bounded pool of pieces: of those that fit, the one with the largest weighted dot product
of its demand and what is left goes in. Whole documents come first; only a gap that no piece fits is filled by
cutting one. Packing is local to a partition of the input: no shuffle, and a lost task gives the same rows again.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import table
from loomtext.llm.tokencount import slices
from loomtext.llm.transducer import byte_letters, pretokens

POOL = 1024


class TokenIds:
    """Ids of whole texts, as the tokenizers library gives them for each distinct pretoken; `most` bounds what is remembered."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.letters = byte_letters()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.start = {}, array("I"), array("q", [0])
        for i in self.special.values():
            self.flat.append(i)
            self.start.append(len(self.flat))

    def _learn(self, pieces: set[str]) -> None:
        """Asks the library's model for each piece, in the letters that stand for its bytes: pieces are cut already, and no
        special token is in them."""
        tokenize, letters, flat, start = self.library.model.tokenize, self.letters, self.flat, self.start
        for n, piece in enumerate(pieces, len(start) - 1):
            flat.extend([t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))])
            start.append(len(flat))
            self.known[piece] = n

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the strings of special tokens are those tokens."""
        parts, owner, token = [], [], []  # token: the special token after the part, or -1
        for i, t in enumerate(texts):
            rest = [(t, -1)]
            for n, s in enumerate(self.special):
                if s in t:
                    rest = [(y, n if j < len(cut) - 1 else after) for x, after in rest for cut in [x.split(s)] for j, y in enumerate(cut)]
            for x, after in rest:
                parts.append(x)
                owner.append(i)
                token.append(after)
        pieces, many = pretokens(parts)
        if len(self.known) > self.most:
            self._forget()
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn({pieces[i] for i in missing})
            at[missing] = [self.known[pieces[i]] for i in missing]
        after = np.array(token, np.int64)
        if (after >= 0).any():
            at = np.insert(at, np.cumsum(many)[after >= 0], after[after >= 0])
            many = many + (after >= 0)
        flat, start = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64)
        size = start[at + 1] - start[at]
        ends = np.cumsum(size)
        out = flat[np.repeat(start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        by_part = np.concatenate([[0], ends])[np.cumsum(many)]
        last = np.flatnonzero(np.append(np.diff(owner) != 0, True)) if owner else []
        return np.split(out, by_part[last][:-1]) if texts else []


@lru_cache(1)
def shared_ids(vocabulary: str) -> TokenIds:
    """A Python worker keeps what it has learned for its next tasks."""
    return TokenIds(vocabulary)


class Packer:
    """Fills sequences from a pool of pieces (row, start, ids, loss_from); rows are whatever the caller gives."""

    def __init__(self, capacity: int, segments: int, loss: int):
        self.limits = np.array([capacity, segments, loss], float)
        self.capacity, self.items = capacity, []
        self.need = np.zeros((0, 3))

    @staticmethod
    def demand(start: int, n: int, loss_from: int) -> tuple[int, int, int]:
        return n, 1, start + n - max(start, min(loss_from, start + n))

    def add(self, row, ids: np.ndarray, loss_from: int) -> Iterator[list]:
        """Cuts a document where a limit asks for it, and keeps its last piece for the pool."""
        start, most_loss = 0, int(self.limits[2])
        while len(ids) - start > self.capacity or self.demand(start, len(ids) - start, loss_from)[2] > most_loss:
            n = min(self.capacity, max(loss_from - start, 0) + most_loss)
            if n == self.capacity:
                yield [(row, start, ids[start : start + n], loss_from)]
            else:
                self.items.append((row, start, ids[start : start + n], loss_from))
            start += n
        self.items.append((row, start, ids[start:], loss_from))

    def _fill(self, gap: int) -> list:
        """One sequence from the pool; a gap of more than `gap` tokens is filled by a cut, where the other limits allow one."""
        live = self.live
        left, out = self.limits.copy(), []
        weight = self.need[live].mean(0) / self.limits**2
        tokens, pieces, bearing = self.need.T
        while live.any():
            fits = live & (tokens <= left[0]) & (pieces <= left[1]) & (bearing <= left[2])
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, self.need @ (weight * left), -1)))
            out.append(self.items[best])
            left -= self.need[best]
            live[best] = False
        if left[0] > gap and left[1] >= 1 and live.any():
            best = int(np.argmax(np.where(live, self.need[:, 0], -1)))
            row, start, ids, loss_from = self.items[best]
            n = int(min(left[0], len(ids) - 1, max(loss_from - start, 0) + left[2]))
            if n > 0:
                out.append((row, start, ids[:n], loss_from))
                self.items[best] = row, start + n, ids[n:], loss_from
                self.need[best] = self.demand(start + n, len(ids) - n, loss_from)
        return out

    def take(self, down_to: int) -> Iterator[list]:
        """Sequences, until `down_to` pieces are left in the pool."""
        self.need = np.array([self.demand(s, len(i), f) for _, s, i, f in self.items], float).reshape(-1, 3)
        self.live = np.ones(len(self.items), bool)
        gap = self.capacity // 128
        while self.live.sum() > down_to:
            out = self._fill(gap)
            if self.capacity - sum(len(p[2]) for p in out) <= gap:
                yield out
            else:
                yield from self._powers(out)
        self.items = [x for x, keep in zip(self.items, self.live, strict=True) if keep]

    def _powers(self, pieces: list) -> Iterator[list]:
        """The pieces cut into sequences as long as powers of two, which need no padding."""
        total = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while total:
            want = 1 << total.bit_length() - 1
            total -= want
            out = []
            while want:
                row, start, ids, loss_from = pieces.pop()
                out.append((row, start, ids[:want], loss_from))
                if len(ids) > want:
                    pieces.append((row, start + want, ids[want:], loss_from))
                want -= len(out[-1][2])
            yield out


_SCHEMA = "start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"


def _packed(vocabulary: str, end: int, capacity: int, segments: int, loss: int):
    """Rows (key, prompt, text) to pieces; a key, of any type, comes out as it went in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = shared_ids(vocabulary), Packer(capacity, segments, loss)
        made = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        kind = None

        def write(sequences: Iterator[list]) -> None:
            nonlocal made
            for pieces in sequences:
                offset = 0
                for (key, total), start, ids, loss_from in pieces:
                    rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), packer.demand(start, len(ids), loss_from)[2], total, made, offset))
                    offset += len(ids)
                made += 1

        def out() -> pa.RecordBatch:
            kinds = [kind, *(pa.binary() if i == 2 else pa.int64() for i in range(7))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", *(x.split()[0] for x in _SCHEMA.split(", "))])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, prompts, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts):
                of_prompt = tokens.ids(prompts[a:b]) if any(prompts[a:b]) else [np.zeros(0, np.uint32)] * (b - a)
                for key, p, t in zip(keys[a:b], of_prompt, tokens.ids(texts[a:b]), strict=True):
                    ids = np.concatenate([p, t, np.array([end], np.uint32)])
                    write(packer.add((key, len(ids)), ids, len(p)))
                    if len(packer.items) >= 2 * POOL:
                        write(packer.take(POOL))
                if rows:
                    yield out()
        write(packer.take(0))
        if rows:
            yield out()

    return pack


def packed(docs: DataFrame, vocabulary: str, prompt: str | None = None, end: int = 1, capacity: int = 2048, segments: int = 64, loss: int = 2048, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(key columns, text and, if given, the prompt column), other columns ignored. A row for each piece of a document's
    ids (prompt, text, then `end`): the key columns, start, length, ids (little-endian unsigned 32-bit), loss_tokens, doc_tokens,
    sequence_id and offset. A prompt's tokens bear no loss. No sequence has more than `capacity` tokens, `segments`
    pieces or `loss` loss-bearing tokens.

    A null text or prompt is empty: its document is the end token alone. Repeated rows, null or equal ids are packed
    each on their own. Documents longer than a sequence are cut into full ones first. An empty table gives no rows."""
    of = F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")
    texts = docs.select((F.struct(*key) if len(key) > 1 else F.col(key[0])).alias("key"), of.alias("prompt"), F.coalesce("text", F.lit("")).alias("text"))
    out = f"key {texts.schema['key'].dataType.simpleString()}, {_SCHEMA}"
    columns = [F.col("key").alias(key[0])] if len(key) == 1 else ["key.*"]
    return texts.mapInArrow(_packed(vocabulary, end, capacity, segments, loss), out).select(*columns, *(x.split()[0] for x in _SCHEMA.split(", ")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


#: Limits of the query over conversations: pieces and loss-bearing tokens of a sequence.
TURNS, LOSS = 16, 1024


def examples(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text). Each assistant's turn with the turn before it as its prompt: conv_id, turn,
    prompt, text. A turn without one before it has a null prompt; of repeated turns
    before it, the one with the smallest text is taken; repeated assistant's turns are examples each on their own."""
    before = conversations.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    answers = conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    both = answers.join(before, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", "prompt", "text")


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data under all three limits: prompts bear no loss."""
    docs = examples(table(spark, sf_dir, "conversations"))
    pieces = packed(docs, public_tokenizers.path("byte_bpe_50k.json"), "prompt", segments=TURNS, loss=LOSS, key=("conv_id", "turn"))
    return pieces.select("conv_id", "turn", "start", "length", F.crc32("ids").alias("ids_crc32"), "loss_tokens", "doc_tokens", "sequence_id", "offset")
