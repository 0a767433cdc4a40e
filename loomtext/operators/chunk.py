"""Chunkers: one row for each chunk of a text. Windows are sequences; packers are folds over the text's parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomtext.functions.text import sentences


_BLANK = " \t\n\x0b\x0c\r"


def exploded(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """keep, chunk_index (from 0), chunk."""
    return df.select(*keep, chunks.alias("_chunks")).select(*keep, F.posexplode("_chunks").alias("chunk_index", "chunk"))


def slices(text: Column, size: int, overlap: int = 0) -> Column:
    """Slices of up to `size` characters, each beginning size - overlap after the one before, to the text's end. One pass of a
    pattern over the text: it looks ahead for a slice and goes on by a step, so that no slice is counted from the beginning."""
    pattern = rf"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}" if overlap else rf"(?s)(.{{1,{size}}})"
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def windows(text: Column, size: int, overlap: int = 0, stop_early: bool = True) -> Column:
    """Slices of `size` characters, each beginning size - overlap after the one before. With stop_early the slice that
    reaches the end is the last; without, the starts go on to the end. Blank slices are dropped, the others trimmed."""
    cut = slices(text, size, overlap)
    if stop_early:
        cut = F.filter(cut, lambda x, i: (i == 0) | (F.length(x) > overlap))  # the others end where the one before them does
        cut = F.transform(cut, lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.filter(cut, lambda x: F.btrim(x) != "")


def _folded(size: int, separator: str, counted: bool, hard: bool):
    """A pandas UDF over arrays of parts: each step depends on the chunk before it, and a fold by built-in functions would copy
    all earlier chunks for every new one."""
    extra = len(separator) if counted else 0

    def pack(parts) -> list[str]:
        out, held, length = [], [], 0
        parts = parts if parts is not None else ()
        for x in (p[i : i + size] for p in parts for i in range(0, max(1, len(p)), size)) if hard else parts:
            if held and length and length + len(x) + extra > size:
                out.append(separator.join(held))
                held, length = [], 0
            if held and not length:  # what was held so far is empty
                held = []
            length += len(x) + (len(separator) if held else 0)
            held.append(x)
        return out + [separator.join(held)] if length else out

    @F.pandas_udf("array<string>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(pack)

    return fold


def packed(parts: Column, size: int, separator: str = " ", counted: bool = True, hard: bool = False) -> Column:
    """Parts joined by the separator as long as the chunk stays within size; counted: the separator's length counts; hard: parts
    of more than size characters are cut first."""
    return _folded(size, separator, counted, hard)(parts)


def sentence_chunks(text: Column, size: int) -> Column:
    return packed(sentences(text), size, counted=False)


def greedy_chunks(text: Column, size: int) -> Column:
    """Sentences and what stands between blank lines, packed within size; what has more than size characters is cut hard
    first."""
    units = F.filter(F.split(text, r"(?<=[.!?])\s+|\n\s*\n"), lambda x: F.trim(x) != "")
    return packed(units, size, hard=True)


def line_sections(text: Column, size: int = 600) -> Column:
    """Lines that aren't blank, packed with a blank line between."""
    return packed(F.filter(F.transform(F.split(text, "\n+"), lambda x: F.btrim(x)), lambda x: x != ""), size, "\n\n")


def recursive_chunks(size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")):
    """A pandas UDF for the splitter that tries coarse separators before fine ones and repeats up to `overlap` characters of
    what came before: each step depends on the chunk before it, so it is a loop over one text at a time."""

    def cut(text: str, level: int) -> list[str]:
        if len(text) <= size:
            return [text] if text else []
        mark = separators[level]
        parts = text.split(mark) if mark else list(text)
        out: list[str] = []
        for i, p in enumerate(parts):
            p = p + mark if mark and i < len(parts) - 1 else p
            out += cut(p, level + 1) if len(p) > size and mark else [p] if p else []
        return out

    def merge(pieces: list[str]) -> list[str]:
        out, cur = [], ""
        for p in pieces:
            if cur and len(cur) + len(p) > size:
                out.append(cur)
                room = min(overlap, size - len(p))
                cur = cur[-room:] if room > 0 else ""
            cur += p
        return [x for x in map(str.strip, [*out, cur]) if x]

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: merge(cut(t or "", 0)))

    return split


def header_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of Markdown under their headers: key, h1, h2, section, lines. Headers are carried down by a window over the text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = W.partitionBy(key).orderBy("pos")
    h1, h2 = (F.regexp_extract("line", rf"^#{{{n}}} +(.*)$", 1) for n in (1, 2))
    is_1, is_2 = F.col("line").rlike("^# "), F.col("line").rlike("^## ")
    marked = (
        lines.withColumn("h1", F.last(F.when(is_1, h1), True).over(w))
        .withColumn("section", F.sum((is_1 | is_2).cast("int")).over(w))
        # A first-level header ends the second-level one above it.
        .withColumn("h2", F.last(F.when(is_2, h2).when(is_1, F.lit("")), True).over(w))
    )
    text_lines = marked.where(~F.col("line").rlike("^##? ") & (F.btrim("line") != ""))
    return text_lines.groupBy(key, "section", "h1", "h2").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("chunk")
    )


def passages(text: Column, size: int = 300, least: int = 20) -> Column:
    """Parts between full stops of more than `least` characters, with their stops again, grouped to about `size`."""
    parts = F.filter(F.transform(F.split(F.replace(F.btrim(text, F.lit(_BLANK)), F.lit("\n"), F.lit(" ")), r"\. "), lambda x: F.btrim(x)), lambda x: F.length(x) > least)
    # A part is counted without its stop and blank when it is tried.
    return F.transform(packed(F.transform(parts, lambda x: F.concat(x, F.lit(". "))), size + 2, ""), lambda x: F.btrim(x))


def paragraph_slices(text: Column, size: int = 500, least: int = 20) -> Column:
    """What stands between blank lines, of `least` characters or more, in slices of `size`."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.btrim(x)), lambda x: F.length(x) >= least)
    return F.flatten(F.transform(parts, lambda p: slices(p, size)))


#: Where a unit of code or markup begins, by language (fixed values).
BOUNDARIES = {
    "python": r"(?m)(?=^(?:def |class |async def ))",
    "javascript": r"(?m)(?=^(?:function |class |const |export ))",
    "html": r"(?=<(?:p|div|h[1-6]|ul|table)\b)",
}


def code_chunks(text: Column, language: str, size: int = 400) -> Column:
    """Units of code or markup packed within size; a longer unit is cut hard."""
    units = F.filter(F.split(text, BOUNDARIES[language]), lambda x: x != "")
    return packed(units, size, "", hard=True)


def _carried(units: Iterator[str], size: int, overlap: int, joiner: str, glue: str) -> Iterator[str]:
    """Units joined within size; a chunk begins with the last `overlap` characters of the one before it, put on by `glue`,
    whatever length that gives. An empty unit ends a chunk without carrying anything on."""
    held = ""
    for unit in units:
        if held and not unit:
            yield held
            held = ""
        elif not held:
            held = unit
        elif len(held) + len(joiner) + len(unit) <= size:
            held += joiner + unit
        else:
            yield held
            tail = held[-overlap:] if overlap else ""
            held = tail + glue + unit if tail else unit
    if held:
        yield held


def boundary_chunks(size: int, overlap: int):
    """A pandas UDF: paragraphs, or sentences of paragraphs that are too long, or words of sentences that are, joined by line
    ends; the overlap is put on without a separator."""

    def units(text: str) -> Iterator[str]:
        for paragraph in filter(str.strip, re.split(r"\n\s*\n", text)):
            if len(paragraph) <= size:
                yield paragraph
                continue
            for sentence in filter(str.strip, re.split(r"(?<=[.!?])\s+", paragraph)):
                yield from [sentence] if len(sentence) <= size else (x.strip() for x in _carried(iter(sentence.split(" ")), size, 0, " ", ""))

    def cut(text: str | None) -> list[str]:
        text = (text or "").strip()
        if len(text) <= size:
            return [text] if text else []
        return [c for c in (c.strip() for c in _carried(units(text), size, overlap, "\n", "")) if c]

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(cut)

    return split


def markdown_chunks(size: int, overlap: int):
    """A pandas UDF: paragraphs of Markdown joined by blank lines, the overlap too; a paragraph that is too long is sliced, each
    slice beginning size - overlap after the one before, and its rest goes on like a paragraph of its own."""

    def units(text: str) -> Iterator[str]:
        for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
            while len(paragraph) > size:
                yield from ("", paragraph[:size], "")
                paragraph = paragraph[size - overlap :]
            yield paragraph

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [c for c in _carried(units(t or ""), size, overlap, "\n\n", "\n\n") if c.strip()])

    return split


@F.pandas_udf(ArrayType(IntegerType()))
def offsets(texts: pd.Series, chunks: pd.Series) -> pd.Series:
    """Where each chunk stands in its text, each looked for behind the one before it; -1 for one that isn't there."""

    def of(text: str | None, parts) -> list[int]:
        out, end = [], 0
        for part in parts if parts is not None else ():
            at = (text or "").find(part, end)
            out.append(at)
            end = at + len(part) if at >= 0 else end
        return out

    return pd.Series([of(t, c) for t, c in zip(texts, chunks, strict=True)])
