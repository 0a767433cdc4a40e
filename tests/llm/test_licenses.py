import re

from conftest import MIDDLE

from loomtext.llm import licenses


def plain(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = {r.doc_id: r for r in licenses.query(spark, MIDDLE).collect()}
    assert set(got) == set(texts)
    assert sum(r.n_base for r in got.values()) > 0
    for i, t in texts.items():
        n, places = plain(t)
        r = got[i]
        starts, labels = [a for a, _ in places], sorted({k for _, k in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def found(text):
    return [x[0] for x in licenses.detections(text.lower().encode())[0]]


def test_rules():
    assert len(licenses.rules()) > 300
    assert found("licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert found("GNU Lesser General Public License v2.1 or later") == ["lgpl-2.1-or-later"]
    assert found("LGPLv2.1; GPL-2.0") == ["gpl-2.0", "lgpl-2.1"] or found("LGPLv2.1; GPL-2.0") == ["lgpl-2.1", "gpl-2.0"]
    assert found("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert found("CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"]
    assert found("Creative Commons Attribution-ShareAlike 3.0 Unported") == ["cc-by-sa-3.0"]
    assert found("the dog sat with us; mit uns") == []


def test_intervals():
    assert licenses.resolved([(5, 3, 9), (1, 4, 8), (2, 3, 9), (0, 8, 12)]) == [(0, 8, 12)]
    assert licenses.resolved([(5, 3, 9), (2, 3, 9), (7, 20, 22)]) == [(2, 3, 9), (7, 20, 22)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "CC-BY cc by;all\nRIGHTS reserved"), (3, "CC-BY cc by;all\nRIGHTS reserved"), (None, "é ß"), (4, "gpl " * 40000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    got = licenses.license_notices(docs).collect()
    assert [r.n_words for r in got] == [0, 0, 7, 7, 2, 40000]
    assert [sum(x.base for x in r.found) for r in got] == [0, 0, 3, 3, 0, 0] and len(got[5].found) == 40000
    assert licenses.license_notices(docs.limit(0)).count() == 0


def samples(pattern):
    """Matches of a pattern, with each of its alternatives and options."""
    from itertools import product
    from re import _parser

    def of(parsed):
        each = []
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                each.append([chr(arg)])
            elif name == "IN":
                each.append([chr(a) for o, a in arg if str(o) == "LITERAL"] or ["7" if "DIGIT" in str(arg) else "w"])
            elif name == "SUBPATTERN":
                each.append(of(arg[3]))
            elif name == "BRANCH":
                each.append([x for b in arg[1] for x in of(b)])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                each.append([x * n for n in {low, min(low + 1, high)} for x in of(inner)])
            else:
                assert name in ("ASSERT_NOT", "CATEGORY"), name
        return list(dict.fromkeys("".join(x) for x in product(*each)))

    return of(_parser.parse(pattern))


def test_keywords_lose_nothing():
    rules = licenses.rules()
    for r in rules:
        every = samples(r.pattern.pattern)
        for s in every:
            assert r.pattern.fullmatch(s) and any(k in s for k in r.keywords), (r.label, r.keywords, s)
        for s in {every[0], every[len(every) // 2], every[-1]}:
            whole = licenses.resolved([(i, *m.span()) for i, x in enumerate(rules) for m in x.pattern.finditer(s)])
            assert found(s) == [rules[i].label for i, _, _ in whole], s
    assert found("GNU Library General Public License version 2") == ["lgpl-2.0"]
    assert found("PSF 2.0") == ["python-2.0"] and found("a PSF license") == ["python"]


def quadratic(found):
    """What stays of detections, by comparing all of them."""
    kept = []
    for p, a, b in sorted(found, key=lambda x: (x[1] - x[2], x[0], x[1])):
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((p, a, b))
    out = []
    for p, a, b in sorted(kept):
        if not any(x < b and a < y for _, x, y in out):
            out.append((p, a, b))
    return out


def test_intervals_against_all_pairs():
    import random

    rng = random.Random(6)
    for _ in range(2000):
        found = [(rng.randrange(6), a := rng.randrange(40), a + rng.randint(1, 12)) for _ in range(rng.randint(0, 25))]
        assert licenses.resolved(found) == quadratic(found)


def test_long_texts_take_linear_time():
    import time

    text = " ".join(f"item {i} all rights reserved under the mit license, gpl 3.0 or cc by-sa 4.0;" for i in range(100_000)).encode()
    began = time.process_time()
    found, base = licenses.detections(text)
    assert len(base) == 200_000 and len(found) > 300_000 and time.process_time() - began < 60
    assert found[0][1] < found[0][2] and max(b for _, _, b, _ in found) <= len(re.findall(rb"[0-9a-z]+", text))


def test_labels_of_real_documents_against_no_prefilter(spark):
    """All labels of the table's documents, with every rule tried on every text."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    got = {r.doc_id: r.labels for r in licenses.query(spark, MIDDLE).collect()}
    rules = licenses.rules()
    for i, t in docs:
        joined = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
        if not any(k in joined for k in ("licen", "rights", "cc", "public", "copyright", "gpl", "mit", "bsd", "permission", "redistribut", "rechte", "droits")):
            assert not got[i]
            continue
        kept = quadratic([(n, *m.span()) for n, r in enumerate(rules) for m in r.pattern.finditer(joined)])
        assert got[i] == ",".join(sorted({rules[n].label for n, _, _ in kept} | {k for _, k in plain(t)[1]})), i


ORDINARY = """The Apache helicopter landed near the village.
It was an artistic photo of the harbour.
We met under the MIT dome at noon.
The EPL match ended 2-0 after extra time.
She signed in ASL to the audience.
The AFL final draws a large crowd every year.
Our CPL 1 training starts in May.
The BSL interpreter arrived late.
He wrote the parser in PHP 3 years ago.
The MPL 2 bus leaves from gate 4.
An open font was used for the poster.
The library is open to the public.
General public health has improved.
A common development plan was agreed.
The European Union public debate went on.
Python is a software language, and foundations matter.
Zero clause contracts are rare.
The academic year is free of charge.
Permission is hereby given to leave early.
He lost his driving licence in 2019.
The universal remote was permissive about batteries.
Creative people share a common room.
The PSF of the telescope was measured twice.
Boost your software skills.
Eclipse glasses were sold to the public.
The artistic director resigned.
OSL 3 is a town code.
The upper limit, UPL 1, was passed.
Redistribution of wealth was discussed.
Mozilla and Zope are names of things.""".splitlines()


def test_ordinary_sentences_give_nothing():
    assert len(ORDINARY) == 30
    assert {t: f for t in ORDINARY if (f := found(t))} == {}


def test_an_identifier_for_each_label():
    for words, label in licenses.IDENTIFIERS.items():
        assert found(f"# SPDX-License-Identifier: {words.replace(' ', '-')}") == [label], words
    assert found("SPDX-License-Identifier: MIT") == ["mit"] and found("// SPDX-License-Identifier: CC0-1.0") == ["cc0"]
    for label, *_, identifier, versions in licenses.FAMILIES:
        for v in versions.split() or [""]:
            name = f"{identifier}-{v}".rstrip("-")
            assert found(f"SPDX-License-Identifier: {name.upper()}") == [f"{label}-{v}".rstrip("-")], name
    for clause in licenses.CLAUSES:
        assert found(f"SPDX-License-Identifier: CC-{clause.upper()}-4.0") == [f"cc-{clause}-4.0"]


def test_texts_of_licences():
    says = {
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": ["apache-2.0", "apache"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at": ["mpl-2.0", "mpl"],
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published": ["lgpl"],
        "This is free and unencumbered software released into the public domain.": ["unlicense"],
        "Released under the EPL": ["epl"],
        "an Apache 2.0 licence": ["apache-2.0"],
        "Apache License 2.0": ["apache-2.0"],
        "BSL v1.0": ["bsl-1.0"],
        "licensed under MIT": ["mit"],
    }
    for text, labels in says.items():
        assert sorted(found(text)) == sorted(labels), text
