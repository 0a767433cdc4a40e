import random
import tracemalloc

import public_tokenizers
import pytest
from conftest import MIDDLE
from tokenizers import Tokenizer

from loomtext.llm import tokencount, transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Parts of odd texts: contractions, white space of several kinds, scripts, special tokens whole and cut.
PARTS = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "ab", "Zé", "1", "23", "²", "!", "??", "<|endoftext|>", "<|endof", "日本", "한", "🙂", "é", "́", "\0", "\x1c", "\u0085", "　", " ", "'ve", "'d", "l", "e", "v"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_odd_texts(library):
    texts = odd_texts(5000, 1)
    assert transducer.TokenCounter(PATH).count(texts).tolist() == library(texts)


def test_every_code_point(library):
    texts = [f"a{chr(c)}1 {chr(c)}b{chr(c)}{chr(c)}  {chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert transducer.TokenCounter(PATH).count(texts).tolist() == library(texts)


def test_long_pretokens_by_maps_of_chunks(library):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9000)), "a" * 20_000, "the" * 3000 + "ab" * 3000, "é" * 5001, "日本語" * 1500, "-" * 9999, "na" * 2048 + "x"]
    assert transducer.TokenCounter(PATH).count(words).tolist() == library(words)
    counter = transducer.TokenCounter(PATH, most=200)  # forgets many times within a word
    for chunk, warm in ((1, 1), (7, 3), (64, 8), (1000, 0)):
        assert [counter.long(w.encode(), chunk, max(1, warm)) for w in words] == library(words)


def test_a_long_pretoken_leaves_little_behind():
    counter = transducer.TokenCounter(PATH, most=8000)
    rng = random.Random(6)
    tracemalloc.start()
    counter.count(["".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))])
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 40e6 and not counter.known and len(counter.go) < 100


def test_forgetting_changes_nothing(library):
    texts = odd_texts(600, 2)
    counter = transducer.TokenCounter(PATH, most=50)
    assert [n for i in range(0, 600, 20) for n in counter.count(texts[i : i + 20]).tolist()] == library(texts)


def test_chunk_maps_give_the_same_cuts():
    import numpy as np

    code = np.frombuffer("".join(odd_texts(50, 3)).encode("utf-32-le"), np.uint32).astype(np.int64)
    whole = transducer.cuts(code, len(code)).tolist()
    assert all(transducer.cuts(code, k).tolist() == whole for k in (1, 2, 3, 5, 64))


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.query(spark, MIDDLE).collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert got == {i: (len(t.encode()), want[i], want[i] > 1024) for i, t in texts.items()}


def test_odd_rows(spark, library):
    long = "word " * 60000 + "x" * 3000
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, long), (4, "\n")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = tokencount.token_counts(docs, PATH).collect()
    assert [r.n_tokens for r in got] == [0, 0, 0, 2, *library([long]), 1]
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0
