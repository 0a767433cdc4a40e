"""Queries and operators without SQL against plain code."""

import hashlib
import json
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.functions import guard, text
from loomtext.jobs import catalog
from loomtext.jobs.retrieval import docs_and_questions
from loomtext.operators import chunk, dense, graph, lexical, order, predicates, scoring, telemetry
from loomtext.sources import readers


def run(spark, name):
    return catalog.queries()[name](spark, SMALL)


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed([int(x) for x in digits]))) % 10 == 0


CARDS = "pay 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111; 5500000000000004x 9123-45-6789 123-45-6789 +49 (30) 123-4567 a.b@c.org 1234567890123456789012"


def test_personal_data_in_one_pass(spark):
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in guard.ONE_PASS.items()), re.ASCII)
    texts = documents(spark) | {-1: CARDS, -2: "", -3: "4111 1111 1111 1112 " * 3, -4: "id 123-45-6789."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("f", guard.one_pass("text"))
    of = lambda k: F.size(F.filter("f", lambda x: (x["kind"] == k) & ~x["keep"]))
    count = {k: of(k) for k in guard.ONE_PASS}
    got = {r.doc_id: r for r in df.select("doc_id", guard.one_pass_redacted(F.col("text"), F.col("f")).alias("t"), guard.pii_spans("text").alias("s"), *[c.alias(k) for k, c in count.items()]).collect()}
    for i, t in texts.items():
        found = [m for m in pattern.finditer(t) if m.lastgroup != "credit_card" or luhn(re.sub("[^0-9]", "", m[0]))]
        spans = {m.span() for m in found}
        want = pattern.sub(lambda m, spans=spans: guard.PLACEHOLDERS[m.lastgroup] if m.span() in spans else m[0], t)
        assert got[i].t == want and [got[i][k] for k in guard.ONE_PASS] == [sum(m.lastgroup == k for m in found) for k in guard.ONE_PASS]
        assert [(s.kind, s.value, s.start, s.end) for s in got[i].s] == [(m.lastgroup, m[0], *m.span()) for m in found]
    assert got[-1].credit_card >= 2 and "4111-1111-1111-1112" in got[-1].t and got[-4].ssn == 1
    by_query = {r.doc_id: r for r in run(spark, "pii_one_pass").collect()}
    assert all(by_query[i].key == hashlib.md5(got[i].t.encode()).hexdigest() for i in by_query)
    assert sum(len(got[i].s) for i in by_query) == run(spark, "pii_places").count() > 0


def test_boundary_chunks(spark):
    """Chunks in order, each from its units; what a chunk adds to the overlap are whole units."""
    size, overlap = 300, 50
    texts = documents(spark) | {-1: "", -2: "short", -3: "w" * 700 + " end. Next one.\n\n" + "x y " * 200}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", chunk.boundary_chunks(size, overlap)("text").alias("c"))
    for r in rows.collect():
        t = texts[r.doc_id].strip()
        if len(t) <= size:
            assert r.c == ([t] if t else [])
            continue
        units = [p for p in re.split(r"\n\s*\n", t) if p.strip()]
        if any(len(p) > size for p in units):
            units = [u for p in units for u in ([p] if len(p) <= size else [x for x in re.split(r"(?<=[.!?])\s+", p) if x.strip()])]
        fine = []
        for u in units:
            words = u.split(" ") if len(u) > size else None
            while words:
                n = 1
                while n < len(words) and len(" ".join(words[: n + 1])) <= size:
                    n += 1
                fine.append(" ".join(words[:n]).strip())
                words = words[n:]
            if len(u) <= size:
                fine.append(u)
        want, held = [], None
        for u in filter(None, fine):
            if held is None:
                held = u
            elif len(held) + 1 + len(u) <= size:
                held = held + "\n" + u
            else:
                want.append(held)
                held = held[-overlap:] + u
        assert r.c == [x for x in (w.strip() for w in [*want, held or ""]) if x], r.doc_id


def test_markdown_chunks(spark):
    size, overlap = 100, 20
    text_ = "# A\n\nfirst part\n\n" + "b" * 250 + "\n\nlast words here\n \n" + "c" * 90 + "\n\n" + "d" * 30
    got = spark.createDataFrame([(1, text_), (2, ""), (3, None)], "i int, text string").select("i", chunk.markdown_chunks(size, overlap)("text").alias("c")).collect()
    assert got[1].c == got[2].c == []
    c = got[0].c
    # A long paragraph ends the chunk before it and is sliced every 80 characters; its rest goes on.
    assert c[:3] == ["# A\n\nfirst part", "b" * 100, "b" * 100]
    assert c[3] == "b" * 90 and c[4] == "b" * 20 + "\n\nlast words here"
    assert c[5] == (c[4][-20:] + "\n\n" + "c" * 90) and c[6] == "c" * 20 + "\n\n" + "d" * 30 and len(c) == 7


def test_semantic_chunks(spark):
    """Cut where the cosine of neighbouring sentences falls below a limit that each document sets."""
    got = {}
    for r in run(spark, "chunk_semantic").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.sentences))
    for i, t in documents(spark).items():
        s = [x for x in re.split(r"(?<=[.!?])\s+", t) if x.strip(" ")]
        vectors = []
        for x in s:
            v = np.zeros(256)
            for w in re.findall("[a-z0-9]+", x.lower()):
                v[hashlib.md5(w.encode()).digest()[3]] += 1
            vectors.append(v)
        sims = [float(a @ b) / n if (n := float(np.linalg.norm(a) * np.linalg.norm(b))) else 0.0 for a, b in zip(vectors, vectors[1:], strict=False)]
        limit = min(0.95, max(0.2, float(np.mean(sims) - 0.5 * np.std(sims)))) if sims else 0.75
        if sims and min(abs(x - limit) for x in sims) < 1e-9:
            continue
        want, held = [], s[:1]
        for x, sim in zip(s[1:], sims, strict=True):
            if sim < limit:
                want.append((" ".join(held), len(held)))
                held = []
            held.append(x)
        assert got.get(i, []) == (want + [(" ".join(held), len(held))] if held else want), i


def test_header_sections(spark):
    md = "intro\n# One\n## A\na1\na2\n\n## B\nb\n# Two\nt\n### deep\nd"
    rows = chunk.header_sections(spark.createDataFrame([(1, md)], "doc_id int, text string"), "doc_id", "text").collect()
    got = sorted((r.h1 or "", r.h2 or "", r.chunk) for r in rows)
    assert got == sorted([("", "", "intro"), ("One", "A", "a1\na2"), ("One", "B", "b"), ("Two", "", "t\n### deep\nd")])
    lines = {r.doc_id: r.lines for r in run(spark, "chunk_header_sections").groupBy("doc_id").agg(F.sum(F.size(F.split("chunk", "\n"))).alias("lines")).collect()}
    for i, t in documents(spark).items():
        headed = re.sub(r"^([A-ZÀ-Ý][^ .\n]*\.)$", r"## \1", t, flags=re.M)
        assert lines.get(i, 0) == sum(bool(x.strip(" ")) and not re.match("##? ", x) for x in headed.split("\n"))


def cache(rows, least, strict, most, replace):
    """Hits in order, and the entries in the end."""
    hits, held = [], []
    for i, v in rows:
        v = np.array(v, float)
        v /= np.linalg.norm(v) or 1.0
        near = [n for n, (_, h) in enumerate(held) if (h @ v > least if strict else h @ v >= least)]
        hits.append((i, bool(near)))
        if near and replace:
            held[near[0]] = (i, v)
        elif not near:
            held = [*held, (i, v)][-most:]
    return hits, [i for i, _ in held]


def test_semantic_caches(spark):
    by = {}
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect():
        by.setdefault(r.label, []).append((r.vec_id, r.embedding))
    for name, least, strict, most, replace in (("semantic_cache_replay", 0.6, False, 512, False), ("semantic_cache_refreshed", 0.3, False, 8, True)):
        got = {(r.label, r.vec_id): r.hit for r in run(spark, name).collect()}
        want = {(k, i): h for k, rows in by.items() for i, h in cache(rows, least, strict, most, replace)[0]}
        assert got == want and sum(got.values()) < len(got) and (sum(got.values()) > 0 or not replace)
    entries = {(r.label, r.place): (r.vec_id, r.key) for r in run(spark, "semantic_cache_entries").collect()}
    want = {(k, n): (i, hashlib.md5(f"{k}::{i}".encode()).hexdigest()) for k, rows in by.items() for n, i in enumerate(cache(rows, 0.3, True, 8, False)[1])}
    assert entries == want


def test_graph_of_all_lines(spark):
    edges = {(f"s{r.l_suppkey}", f"p{r.l_partkey}"): (r.l_orderkey * 10 + r.l_linenumber, r.l_returnflag) for r in sorted(spark.read.parquet(f"{SMALL}/lineitem.parquet").collect(), key=lambda r: r.l_orderkey * 10 + r.l_linenumber)}
    label = {n: n for e in edges for n in e}
    while True:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    got = {r.component: r.nodes for r in run(spark, "entity_components").collect()}
    assert got == {c: sum(x == c for x in label.values()) for c in set(label.values())}
    found = {(r.component, r.src, r.dst, r.relation) for r in run(spark, "community_edges").collect()}
    want = set()
    for c in set(label.values()):
        inside = sorted((min(e), max(e), edges[e][1]) for e in edges if label[e[0]] == c)
        want |= {(c, *x) for x in inside[:15]}
    assert found == want


def test_components_of_loops_and_stars(spark):
    edges = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "c")] + [("hub", f"n{i}") for i in range(50)], "src string, dst string")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got["a"] == "a" and got["c"] == "b" and {got[f"n{i}"] for i in range(50)} == {"hub"} and len(got) == 54
    assert graph.components(edges.limit(0)).count() == 0


def test_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=700)] + [("b", 1.0)] * 300 + [("c", float(x)) for x in rng.integers(0, 3, 100)] + [(None, 5.0), ("d", None), ("e", 1e300), ("e", -1e300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in order.at_ranks(df, "g", "v", lambda n: {"first": F.lit(1), "mid": F.ceil(n / 2), "last": n}).collect()}
    for g in ("a", "b", "c", None, "e"):
        v = sorted(x for k, x in rows if k == g)
        assert (got[g].n, got[g].first, got[g].mid, got[g].last) == (len(v), v[0], v[-(-len(v) // 2) - 1], v[-1])
    assert "d" not in got
    p = {r.g: r.p for r in order.interpolated(df, "g", "v", {"p": 0.9}).collect()}
    assert abs(p["a"] - np.quantile([x for k, x in rows if k == "a"], 0.9)) < 1e-9


@pytest.mark.parametrize("most", [0])
def test_joins_give_what_tasks_give(spark, most):
    """With more weights than a task should hold, the same results come from joins."""
    docs, questions = docs_and_questions(spark, SMALL)
    pairs = [(f, {"k": 4}) for f in (lexical.bm25_top, lexical.overlap_top, lexical.bow_cosine_top, lexical.tfidf_cosine_top)]
    for f, args in pairs:
        a, b = (sorted(map(tuple, f(docs, questions, **args, **more).collect())) for more in ({}, {"most": most}))
        assert [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b, strict=True)), f
    a, b = (sorted(map(tuple, dense.hashed_top(docs, questions, 4, text.tokens, **more).collect())) for more in ({}, {"most": most}))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    a, b = (sorted(map(tuple, lexical.overlap_top(docs, questions, 2, by="lang", **more).collect())) for more in ({}, {"most": most}))
    assert a == b
    chunks = docs.select("doc_id", F.lit(0).alias("c"), text.tokens("text").alias("t"))
    a, b = (sorted(map(tuple, lexical.token_f1_top(chunks, questions, 3, ["doc_id", "c"], "t", **more).collect())) for more in ({}, {"most": most}))
    assert [x[:4] for x in a] == [x[:4] for x in b]


def test_scores_of_slices(spark, monkeypatch):
    """Few cells at a time and many groups give the same."""
    docs, questions = docs_and_questions(spark, SMALL)
    want = sorted(map(tuple, lexical.overlap_top(docs, questions, 3, by="source").collect()))
    monkeypatch.setattr(scoring, "CELLS", 200)
    monkeypatch.setattr(scoring, "GROUPS", 2)
    assert sorted(map(tuple, lexical.overlap_top(docs, questions, 3, by="source").collect())) == want


def test_nearest_neighbours(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [1.0, 2.0]), (-3, [None] * 64), (None, [1.0] * 64)], v.schema)
    rows = v.unionByName(odd)
    asked = rows.where("vec_id is null or vec_id % 7 = 0 or vec_id < 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "l2", "ip"):
        a = sorted(map(tuple, dense.knn(rows, asked, 5, metric).collect()))
        assert a == sorted(map(tuple, dense.knn(rows, asked, 5, metric, most=0).collect()))
        assert len(a) == 5 * v.where("vec_id % 7 = 0").count() and min(x[0] for x in a) >= 0
    assert dense.knn(rows.limit(0), asked, 5).count() == dense.knn(rows, asked.limit(0), 5).count() == 0


def test_index_sweep(spark):
    rows = run(spark, "index_sweep").collect()
    assert len(rows) == 7 and sum(r.chosen for r in rows) == 1
    best = max(r.recall for r in rows)
    chosen = next(r for r in rows if r.chosen)
    assert chosen.recall >= 0.98 * best and chosen.compared == min(r.compared for r in rows if r.recall >= 0.98 * best)
    assert best >= 0.9


def test_upserts_and_lists(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("b", 5), ("b", 3), ("c", 9), ("c", 7)], "k string, n int")
    assert sorted(map(tuple, predicates.upserted(old, new, "k", "n").collect())) == [("a", 1), ("b", 5), ("c", 9)]
    assert sorted(map(tuple, predicates.appended(old, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 9)]
    tagged = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, None)], "n int, tags array<string>")
    ids = lambda spec: sorted(r.n for r in tagged.where(predicates.where(spec, ("tags",))).collect())
    assert ids({"tags": {"$in": ["x"]}}) == [] and ids({"tags": {"$nin": ["x"]}}) == [1, 2, 3] and ids({"$or": [{"tags": {"$overlaps": ["x"]}}, {"n": 2}]}) == [1, 2]


def test_collections(spark):
    name = "kept_vectors"
    predicates.dropped(spark, name)
    predicates.created(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>"), name, "l2")
    assert name in predicates.collections(spark) and predicates.metric_of(spark, name) == "l2"
    predicates.dropped(spark, name)
    assert name not in predicates.collections(spark)


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"good \xff\xfe text")
    (tmp_path / "q.csv").write_text('a,b\n"x, y","two\nlines"\n,\n1,2\n')
    got = sorted((r.source, r.block, r.text) for r in readers.documents(spark, str(tmp_path)).collect())
    assert got == [("bad.txt", 0, "good  text"), ("q.csv", 0, "x, y,two\nlines"), ("q.csv", 1, "1,2")]
    assert [(r.id, r.source) for r in sorted(readers.numbered(spark, str(tmp_path)).collect())] == [("doc-0", "bad.txt"), ("doc-1", "q.csv"), ("doc-2", "q.csv")]


def test_evaluation_sets_and_reports(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"question": f"q{i}", "ground_truth": "g", "contexts": ["c"]} for i in range(5)]))
    assert readers.eval_set(spark, str(tmp_path / "e.json")).count() == 5 and readers.eval_set(spark, str(tmp_path / "e.json"), 2).count() == 2
    sections = spark.createDataFrame([("a.md", "H", "one"), ("a.md", "I", "two")], "source string, header string, chunk string")
    cases = spark.createDataFrame([("q", "g", [("a.md", "I"), ("a.md", "X"), ("a.md", "H")]), ("r", "g", [])], "question string, ground_truth string, picks array<struct<source: string, header: string>>")
    assert {r.question: r.contexts for r in readers.built_eval_set(sections, cases).collect()} == {"q": ["two", "one"], "r": []}
    calls = []
    build = lambda: calls.append(1) or sections
    assert readers.ensured(spark, str(tmp_path / "set"), build).count() == readers.ensured(spark, str(tmp_path / "set"), build).count() == 2 and calls == [1]
    readers.write_sidecar(sections.withColumn("id", F.col("header")), str(tmp_path / "side"))
    assert readers.sidecar(spark, str(tmp_path / "side"), "id string, chunk string").where("id = 'I'").first().chunk == "two"
    readers.write_markdown(spark.createDataFrame([("m", 0.5), ("m", 0.25), ("a", 1.0)], "metric string, score double"), str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| metric | mean | n |", "|-|-|-|", "| a | 1.0 | 1 |", "| m | 0.375 | 2 |"]


def test_model_replies(spark):
    cases = [('```json\n{"a": 3.5}\n```', 4), ('say {"a": 2.5} now', 2), ('{"a": true}', None), ('{"a": 6}', None), ("none", None), ('{"a": "x"}', None)]
    got = spark.createDataFrame(cases, "t string, want int").select(text.judged("t", "a").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    row = spark.createDataFrame([("[1, 2] tail", "RELEVANT: PASS\nsupported: fail", "a [1] b [4][02] [0]", "Answer:  yes: no")], "j string, v string, c string, l string")
    r = row.select(text.json_inside("j").alias("j"), text.verdict("v", "relevant").alias("a"), text.verdict("v", "supported").alias("b"), text.verdict("v", "useful").alias("n"), text.sanitized("c", 3).alias("c"), text.without_label("l", ["answer"]).alias("l")).first()
    assert (r.j, r.a, r.b, r.n, r.c, r.l) == ("[1, 2]", True, False, None, "a [1] b [02]", "yes: no")


def test_folds_carry_state_over_batches(spark):
    """A key with many more rows than a batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.lit(1).alias("cost"))
        got = {r.k: (r.kept, r.used) for r in telemetry.fitted_history(df, "k", "t", "cost", 30).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: ([i for i in range(100) if i % 2 == k][-30:], 30) for k in (0, 1)}
