"""Secrets in texts: assignments, access keys, long hexadecimal runs, and strings of high local entropy.

Beside the three base patterns, candidate strings (runs of key characters, less base spans) are judged by character class:
each run of a class inside a candidate by that class's threshold. A window slides over the run; the counts of its
characters, and with them the sum of c log2 c, change by two terms a step, so the window's Shannon entropy is known
everywhere in linear time. A stretch of windows above the class's threshold becomes a span, unless the allow-list
explains the run or the stretch. Base spans and candidates are both walked in order, so a text takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import pieces as slices
from loomtext.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")  # each match holds one of them, in either case
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the same match as without the minimum
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes, narrow ones first, with their window's least entropy in bits a character.
WINDOW = 20
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]{20,}"), 3.8),
    ("base64", re.compile(r"[A-Za-z0-9+/=]{20,}"), 3.9),
    ("url-safe", re.compile(r"[A-Za-z0-9_=-]{20,}"), 3.9),
    ("mixed", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 4.0),
)
#: Runs that are no secrets: ids by design, counters, words joined by marks.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[^A-Za-z]*"  # figures alone
    r"|[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{1,4}"  # words and a number
    r"|[-_/=+]*(([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)([-_/=+]+(([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+))*[-_/=+]*"  # plain parts between marks
)
#: Letters alone are words if parts of one case, or such with one capital, hold this share of them; in random letters of both
#: cases they hold about half.
WORDLIKE = 0.8
_WORD_PART, _LETTERS, _SIMPLE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{2,}(?![a-z])"), re.compile(r"[A-Za-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A stretch that holds a placeholder is none; where the placeholder is a part of its own between marks, it only ends a run.
PLACEHOLDER = re.compile(r"EXAMPLE|example|xxxxxx|XXXXXX|placeholder|PLACEHOLDER")
PART = re.compile(r"(?<![A-Za-z0-9])(EXAMPLE|example|x{6,}|X{6,}|placeholder|PLACEHOLDER)(?![A-Za-z0-9])")
_TERM = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def allowed(run: str) -> bool:
    """Whether a run of a class is no secret whatever its entropy."""
    if ALLOWED.fullmatch(run):
        return True
    if any(map(str.isdigit, run)):
        return False
    parts = _LETTERS.findall(run)
    simple = sum(len(p) if _SIMPLE.fullmatch(p) else sum(len(m) for m in _WORD_PART.findall(p)) for p in parts)
    return simple >= WORDLIKE * sum(map(len, parts))


def entropic(text: str, least: float) -> Iterator[tuple[int, int]]:
    """Maximal stretches of the string that windows of entropy `least` or more cover."""
    counts: dict[str, int] = {}
    total, begun, until = 0.0, -1, -1
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i < WINDOW - 1:
            continue
        start = i - WINDOW + 1
        if log2(WINDOW) - total / WINDOW >= least - 1e-9:
            if start > until and begun >= 0:
                yield begun, until
                begun = -1
            if begun < 0:
                begun = start
            until = i + 1
        old = text[start]
        n = counts[old]
        counts[old] = n - 1
        total += _TERM[n - 1] - _TERM[n]
    if begun >= 0:
        yield begun, until


def base_spans(text: str, lower: str) -> list[tuple[str, int, int]]:
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(a: int, end: int, holes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the holes leave of a stretch, where it is long enough for a window."""
    for x, y in [*sorted(holes), (end, end)]:
        if x - a >= WINDOW:
            yield a, x
        a = max(a, y)


def entropy_spans(text: str, covered: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of high entropy outside base spans. A candidate's runs are judged class by class, those of a narrow class
    inside those of wider ones too; what overlaps is one span."""
    found = []
    base, at = merged(covered), 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        holes = [p.span() for p in PART.finditer(text, m.start(), m.end())]
        next_ = at
        while next_ < len(base) and base[next_][0] < m.end():
            holes.append(base[next_])
            next_ += 1
        spans: list[tuple[int, int]] = []
        for a, end in pieces(m.start(), m.end(), holes):
            piece, judged = text[a:end], set()
            for _, shape, least in CLASSES:
                for run in shape.finditer(piece):
                    s, from_ = run.group(), a + run.start()
                    if run.span() in judged:  # a run of a narrower class
                        continue
                    judged.add(run.span())
                    if not allowed(s):
                        spans += [(from_ + x, from_ + y) for x, y in entropic(s, least) if not PLACEHOLDER.search(s, x, y)]
        last = -1
        for x, y in sorted(spans):
            if x < last:
                last = max(last, y)
                found[-1] = ("entropy", found[-1][1], last)
            else:
                found.append(("entropy", x, y))
                last = y
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        found = []
        for t in batch.column(1):
            text = t.as_py()
            base = base_spans(text, text.lower())
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered(base + entropy_spans(text, base))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), other columns ignored. Returns (doc_id, spans array<struct<kind, start, end>>), a row for each
    row: all spans by start, then kind; code points, end exclusive.

    A null text is empty and has no span. Repeated rows are kept; an empty table gives no rows. There is no shuffle."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scan, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text that secrets cover replaced by `mark`; n_chars, if there, follows the new text.
    A null text stays null; all other columns stay as they are."""

    columns = docs.columns
    at = columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text, text.lower())
        out, end = [], 0
        for _, a, b in ordered(base + entropy_spans(text, base)):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )

