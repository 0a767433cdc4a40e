"""Runs of tokens as numbers, compared where the texts are: a slice of rows at a time, in steps that grow with its tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens of a slice of rows; a row of more is a slice of its own.
SLICE = 1 << 18


def _length(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, columns: list[int], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` elements of these columns of lists."""
    ends, at = np.cumsum(sum(_length(batch.column(c)) for c in columns)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _numbers(values: np.ndarray | pa.Array) -> np.ndarray:
    """Equal values as equal numbers from zero on."""
    coded = values if isinstance(values, pa.Array) else pa.array(values)
    return coded.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def runs(lists: list[pa.ListArray], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each array of token lists the row and the number of every run of n tokens of a list; equal runs of any of the arrays,
    and no others, have one number."""
    length = np.concatenate([_length(x) for x in lists])
    row = np.repeat(np.arange(len(length)), length)
    code = _numbers(pa.concat_arrays([x.flatten() for x in lists]))
    many = int(code.max(initial=0)) + 1
    whole = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
    number = code[whole]
    for i in range(1, n):
        number = _numbers(number) * many + code[whole + i]
    row, out, at = row[whole], [], 0
    for x in lists:
        here = slice(*np.searchsorted(row, [at, at + len(x)]))
        out.append((row[here] - at, number[here]))
        at += len(x)
    return out


def _held(of: tuple[np.ndarray, np.ndarray], within: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many runs, repeats included, and how many of them the other list of the row has too."""
    numbers = _numbers(np.concatenate([of[1], within[1]]))
    key, other = (r * (len(numbers) + 1) + x for r, x in ((of[0], numbers[: len(of[0])]), (within[0], numbers[len(of[0]) :])))
    found = pc.is_in(pa.array(key), pa.array(other)).to_numpy(zero_copy_only=False)
    return np.bincount(of[0], minlength=rows), np.bincount(of[0][found], minlength=rows)


def supported(answers: DataFrame, stopwords: list[str], n: int = 3) -> DataFrame:
    """answers(a, q: arrays of tokens; others): the others and `share`: of the runs of n tokens of a, repeats included, those that q
    has; where a has none, of its tokens but stop words; 1 without those."""
    others = [c for c in answers.columns if c not in ("a", "q")]
    stop = pa.array(stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, [0, 1]):
                a, q = part.column(0), part.column(1)
                rows = len(a)
                every, held = _held(*runs([a, q], n), rows)
                # Words of the answers without runs, and the contexts of these.
                few = np.flatnonzero(every == 0)
                a, q = a.take(pa.array(few)), q.take(pa.array(few))
                one, other = runs([a, q], 1)
                topical = ~pc.is_in(a.flatten(), stop).to_numpy(zero_copy_only=False)
                every[few], held[few] = _held((one[0][topical], one[1][topical]), other, len(few))
                share = np.where(every > 0, held / np.maximum(every, 1), 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(share)], [*others, "share"])

    schema = ", ".join(f"`{c}` {answers.schema[c].dataType.simpleString()}" for c in others)
    return answers.select("a", "q", *others).mapInArrow(run, f"{schema}, share double")
