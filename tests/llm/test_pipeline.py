"""The pipeline's stages against plain versions of what they decide."""

import uuid
import zlib

import numpy as np
from conftest import MIDDLE, SMALL
from test_nearcopies import kept, plain
from test_packing import all_ids, check

import corpus_pipeline
from loomtext.llm import decontaminate, secrets


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    bench = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, MIDDLE)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        got = out.collect()
        if name == names[0]:
            assert {r.doc_id for r in got} == {i for i, r in rows.items() if any(map(str.isalpha, r.text))}
        elif name == names[1]:
            # Five words and a similarity of 0.8, as no contract says otherwise for this stage: all pairs compared.
            assert {r.doc_id for r in got} == kept(sorted((i, plain(r.text)) for i, r in rows.items())) and len(got) < len(rows)
        elif name == names[2]:
            gone = set(rows) - {r.doc_id for r in got}
            holds = {i for i, r in rows.items() if any(p in decontaminate.plain(r.text) for p in bench)}
            assert holds and holds <= gone and len(gone) <= 1.2 * len(holds)
        elif name == names[3]:
            assert {r.doc_id for r in got} == set(rows)
            changed = 0
            for r in got:
                assert not secrets.base_spans(r.text, r.text.lower()) and r.n_chars == len(r.text)
                before = rows[r.doc_id]
                changed += r.text != before.text
                assert r.text == before.text or "[SECRET]" in r.text
            assert changed
        else:
            ids = all_ids([r.text for r in rows.values()])
            padded, total = check(got, dict(zip(rows, ([*x, 1] for x in ids), strict=True)))
            assert padded < 1.02 * total
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows, docs = {r.doc_id: r for r in got}, out


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    folder, docs = f"/tmp/spark-{uuid.uuid4().hex}", spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.columns == docs.columns and out.count() > 0
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_odd_rows(spark):
    words = np.array(["the", "and", "cat", "dog", "sat", "on", "mat"])
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (30, None, None), (31, "", "en"), (None, texts[0], None), (32, "the cat " * 30000, "en")]
    folder = f"/tmp/spark-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i, t, l, "s", zlib.crc32((t or "").encode())) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {*range(20), None, 32} - {5}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), folder).count() == 0
