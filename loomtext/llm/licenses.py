"""License notices by an ordered list of signature rules over a text's words.

Words are joined by single blanks, so that rules need not know marks, cases or line ends. Each rule is gated by
keywords, one of which each of its matches holds: one Aho-Corasick pass over the text finds the keywords that occur, and
only their rules are tried. Of the
detections, one inside another's interval goes unless it comes from a rule of higher priority and is as long; of two
that overlap in part, the one of lower priority goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import pieces, table

#: Phrases of the base and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    weight: float


def _rule(label: str, keywords: str, pattern: str, weight: float) -> Rule:
    return Rule(label, tuple(keywords.split()), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), weight)


#: Families with versions: label, short names, whether a short name says enough alone (None: with a whole version), keyword of short names, keywords of
#: the long name, long name, identifier, versions (fixed values).
FAMILIES = [
    ("agpl", r"(?:gnu )?agpl", True, "agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "agpl", "1.0 3.0"),
    ("lgpl", r"(?:gnu )?lgpl", True, "lgpl", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl", "2.0 2.1 3.0"),
    ("gpl", r"(?:gnu )?gpl", True, "gpl", "general", r"(?:gnu )?general public licen[sc]e", "gpl", "1.0 2.0 3.0"),
    ("gfdl", r"(?:gnu )?g?fdl", False, "fdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl", "1.1 1.2 1.3"),
    ("apache", r"apache|asl", False, "apache asl", "apache", r"apache(?: software)? licen[sc]e", "apache", "1.0 1.1 2.0"),
    ("mpl", r"mpl", False, "mpl", "mozilla", r"mozilla public licen[sc]e", "mpl", "1.0 1.1 2.0"),
    ("epl", r"epl", False, "epl", "eclipse", r"eclipse public licen[sc]e", "epl", "1.0 2.0"),
    ("cddl", r"cddl", True, "cddl", "distribution", r"common development and distribution licen[sc]e", "cddl", "1.0 1.1"),
    ("eupl", r"eupl", True, "eupl", "european", r"european union public licen[sc]e", "eupl", "1.0 1.1 1.2"),
    ("cecill", r"cecill(?: [abc])?", True, "cecill", "cecill", r"cecill free software licen[sc]e(?: agreement)?", "cecill", "1.0 2.0 2.1"),
    ("artistic", r"(?:the )?artistic", False, "artistic", "artistic", r"(?:the )?artistic licen[sc]e", "artistic", "1.0 2.0"),
    ("osl", r"osl", False, "osl", "open", r"open software licen[sc]e", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", r"afl", False, "afl", "academic", r"academic free licen[sc]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("cpl", r"cpl", False, "cpl", "common", r"common public licen[sc]e", "cpl", "1.0"),
    ("lppl", r"lppl", True, "lppl", "latex", r"latex project public licen[sc]e", "lppl", "1.0 1.1 1.2 1.3"),
    ("ofl", r"(?:sil )?ofl", False, "ofl", "font", r"(?:sil )?open font licen[sc]e", "ofl", "1.0 1.1"),
    ("odbl", r"odbl", True, "odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e", "odbl", "1.0"),
    ("bsl", r"bsl", False, "bsl", "boost", r"boost software licen[sc]e", "bsl", "1.0"),
    ("ncsa", r"ncsa", False, "ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa", ""),
    ("upl", r"upl", False, "upl", "universal", r"universal permissive licen[sc]e", "upl", "1.0"),
    ("zpl", r"zpl", False, "zpl", "zope", r"zope public licen[sc]e", "zpl", "1.1 2.0 2.1"),
    ("php", r"(?:the )?php", False, "php", "php", r"(?:the )?php licen[sc]e", "php", "3.0 3.01"),
    ("python", r"psf", None, "psf", "python", r"python software foundation licen[sc]e", "psf", "2.0"),
]
#: Identifiers of licences outside these families, as words, and their labels (fixed values).
IDENTIFIERS = {
    "mit": "mit", "isc": "isc", "bsd 4 clause": "bsd-4-clause", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause", "0bsd": "0bsd", "zlib": "zlib",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "ms pl": "ms-pl", "ms rl": "ms-rl", "cc0 1 0": "cc0",
}
#: Clauses of Creative Commons licences and their names, and their versions (fixed values).
CLAUSES = {"by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by": "attribution"}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Single notices: label, keywords, pattern, weight (fixed values).
NOTICES = [
    ("mit", "mit", r"(?:the )?mit licen[sc]e|licen[sc]e:? mit|(?:licen[sc]ed|released|distributed|available) under mit", 0.9),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "isc", r"(?:the )?isc licen[sc]e", 0.9),
    ("isc", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 0.9),
    ("gpl", "redistribute", r"(?:you can|may) redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.95),
    ("lgpl", "redistribute", r"(?:you can|may) redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 0.95),
    ("agpl", "redistribute", r"(?:you can|may) redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 0.95),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 0.9),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("bsl", "obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("cc0", "dedicated", r"has dedicated the work to the public domain by waiving", 0.95),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied", 0.9),
    ("wtfpl", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed", 0.9),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd|bsd 4 clause|original bsd licen[sc]e", 0.95),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd|bsd 3 clause|(?:new|modified|revised) bsd(?: licen[sc]e)?", 0.95),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd|bsd 2 clause|simplified bsd(?: licen[sc]e)?|freebsd licen[sc]e", 0.95),
    ("0bsd", "bsd", r"0bsd|(?:0|zero) clause bsd|bsd (?:0|zero) clause", 0.95),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]ed?", 0.8),
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms with or without modification", 0.9),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", 0.9),
    ("unlicense", "unlicense", r"(?:the )?unlicense|unlicense org", 0.9),
    ("wtfpl", "wtfpl", r"wtfpl", 0.9),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", 0.9),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", 0.9),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "zero", r"creative commons zero(?: 1 0)?", 0.9),
    ("public-domain", "domain", r"(?:released |dedicated |placed |is )?(?:in|in to|into|to) the public domain|public domain dedication", 0.8),
    ("cc", "creative", r"creative commons(?: licen[sc]e)?", 0.6),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary|proprietary licen[sc]e", 0.8),
    ("reserved", "reserved droits derechos rechte", r"(?:all |some )rights(?: are)? reserved|tous droits réservés|todos los derechos reservados|alle rechte vorbehalten", 0.7),
    ("no-redistribution", "redistribut", r"(?:may|must|can) not be (?:copied or )?redistributed|redistribution (?:is )?(?:prohibited|forbidden|not permitted)", 0.7),
    ("copyright", "copyright", r"copyright(?: c)?(?: by)?(?: \d{4})+", 0.5),
    ("terms", "licen", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? )?(?:\S+ ){0,5}?licen[sc]e", 0.4),
]


def _version(v: str) -> str:
    a, b = v.split(".")
    return rf"{a}(?: 0)?" if b == "0" else rf"{a} {b}"


@lru_cache(1)
def rules() -> list[Rule]:
    """In order of priority: identifiers, then named licences with a version, then without, then other notices."""
    exact, named, plain = [], [], []
    exact += [_rule(label, "spdx", rf"spdx licen[sc]e identifier {words}", 1.0) for words, label in IDENTIFIERS.items()]
    for label, short, alone, key, keyword, long, words, versions in FAMILIES:
        if not versions:
            exact.append(_rule(label, "spdx", rf"spdx licen[sc]e identifier {words}", 1.0))
        # A short name that is also a word, a name or another thing's acronym needs a word about licences beside it.
        about = rf"(?:licen[sc]ed?|released|distributed|available) (?:(?:under|in|by) )?(?:the )?(?:terms of )?(?:the )?(?:{short})"
        for v in versions.split():
            number, later = _version(v), r" (?:or (?:at your option )?(?:any )?|and )later(?: version)?"
            exact.append(_rule(f"{label}-{v}", "spdx", rf"spdx licen[sc]e identifier {words} {v.replace('.', ' ')}(?: only| or later)?", 1.0))
            stem = rf" ?(?:version|ver|v)? ?{number}"
            certain = rf"(?:{short}){stem}" if alone else rf"(?:{short}) ?v? ?{v.replace('.', ' ')}|(?:{short}){stem} licen[sc]e" if alone is None else rf"{about}{stem}|(?:{short})(?: (?:version|ver|v) ?{number}| v{number}|{stem} licen[sc]e)"
            for keys, name in ((key, rf"(?:{certain})"), (keyword, rf"{long}{stem}")):
                named += [_rule(f"{label}-{v}-or-later", keys, name + later, 0.95), _rule(f"{label}-{v}", keys, name + r"(?: only)?", 0.95)]
        plain += [_rule(label, key, short if alone else rf"{about}|(?:{short}) licen[sc]e", 0.8), _rule(label, keyword, long, 0.8)]
    for clause, name in CLAUSES.items():
        code = clause.replace("-", " ")
        for v in CC_VERSIONS.split():
            number = _version(v)
            exact.append(_rule(f"cc-{clause}-{v}", "creativecommons", rf"creativecommons org licenses {code} {v.replace('.', ' ')}", 1.0))
            named += [_rule(f"cc-{clause}-{v}", "cc", rf"cc {code} {number}", 0.95), _rule(f"cc-{clause}-{v}", "creative", rf"creative commons {name} {number}(?: (?:international|unported|generic))?(?: licen[sc]e)?", 0.95)]
        plain += [_rule(f"cc-{clause}", "cc", rf"cc {code}", 0.8), _rule(f"cc-{clause}", "creative", rf"creative commons {name}(?: licen[sc]e)?", 0.8)]
    return exact + named + plain + [_rule(*x) for x in NOTICES]


def resolved(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of detections (priority, start, end), 0 the highest priority: those that stay, by priority. In one walk by start for
    what lies inside another; what is left has ends in the order of starts, so that a detection overlaps its neighbours
    only, and at most two that stay."""
    outer: list[tuple[int, int, int]] = []
    for p, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if not outer or b > outer[-1][2]:
            outer.append((p, a, b))
    alive, out = [True] * len(outer), []
    for i in sorted(range(len(outer)), key=outer.__getitem__):
        if alive[i]:
            p, a, b = outer[i]
            out.append(outer[i])
            left, right = i - 1, i + 1
            while left >= 0 and outer[left][2] > a:
                alive[left] = False
                left -= 1
            while right < len(outer) and outer[right][1] < b:
                alive[right] = False
                right += 1
    return out


@lru_cache(1)
def _prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            by_keyword.setdefault(k, []).append(i)
    automaton = ahocorasick.Automaton()
    for k in [*by_keyword, *(p.split()[-1] for p in BASE)]:
        automaton.add_word(k, k)
    automaton.make_automaton()
    return automaton, by_keyword


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_PHRASES = [(re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in BASE.items()]


def detections(lower: bytes) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int]]]:
    """Of a text with A-Z lower-cased: the rules' detections (label, first word, word after, weight), and the base's
    places (label, first word)."""
    automaton, by_keyword = _prefilter()
    present = {k for _, k in automaton.iter(lower.decode("latin-1"))}
    if not present:
        return [], []
    joined = b" ".join(_WORD.findall(lower)).decode(errors="replace")
    blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
    word = lambda at: int(np.searchsorted(blanks, at))
    base = [(label, word(m.start())) for p, label in _PHRASES for m in p.finditer(joined)]
    every = rules()
    tried = sorted({i for k in present for i in by_keyword.get(k, ())})
    found = [(i, *m.span()) for i in tried for m in every[i].pattern.finditer(joined)]
    return [(every[i].label, word(a), word(b) + 1, every[i].weight) for i, a, b in resolved(found)], base


_FOUND = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(_FOUND))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        n_words, every = [], []
        for t in batch.column(1):
            lower = t.as_buffer().to_pybytes().lower()
            inside = _IS_WORD[np.frombuffer(lower, np.uint8)]
            n_words.append(int(inside[:1].sum() + np.count_nonzero(inside[1:] & ~inside[:-1])))
            found, base = detections(lower)
            every.append(
                [{"label": k, "first_word": a, "end_word": b, "weight": w, "base": False} for k, a, b, w in found]
                + [{"label": k, "first_word": a, "end_word": None, "weight": BASE_WEIGHT, "base": True} for k, a in base]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(every, _OUT.field(2).type)], schema=_OUT)


def license_notices(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), other columns ignored. Returns (doc_id, n_words, found), a row for each row; found holds label,
    first word, word after the last (null for the base's places), weight and whether it is a place of the base.

    A null text is empty: no words, nothing found. Repeated rows are kept; an empty table gives no rows. No shuffle."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_scan, "doc_id long, n_words long, found array<struct<label string, first_word long, end_word long, weight double, base boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda x: x["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda x: x["first_word"])
    miss = F.aggregate(F.array_distinct(F.transform("found", lambda x: F.struct(x["label"], x["weight"]))), F.lit(1.0), lambda p, x: p * (1 - x["weight"]))
    return license_notices(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), (1 - miss).alias("score"),
    )
