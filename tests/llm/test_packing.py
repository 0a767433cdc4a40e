import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
from conftest import MIDDLE
from tokenizers import Tokenizer

from loomtext.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def all_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def check(rows, documents, capacity=2048):
    """Each id in exactly one piece, sequences gapless and in their limit. Returns the padded tokens and all tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for i, ids in documents.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(pieces) <= 64
        padded += at if at & at - 1 == 0 else capacity
    return padded, sum(map(len, documents.values()))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    documents = dict(zip(texts, ([*ids, 1] for ids in all_ids(list(texts.values()))), strict=True))
    padded, total = check(packing.query(spark, MIDDLE).collect(), documents)
    assert padded < 1.01 * total


def test_ids_are_the_librarys():
    parts = ["'s", "'", " ", "  ", "\n", "a", "Zé", "1", "!", "<|endoftext|>", "<|endof", "日本", "🙂", "\0"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    tokens = packing.TokenIds(PATH, most=300)
    got = [x.tolist() for i in range(0, 3000, 100) for x in tokens.ids(texts[i : i + 100])]
    assert got == all_ids(texts)


def test_three_limits(spark):
    rng = random.Random(2)
    rows = [(i, "ask this " * rng.randint(0, 90), "and say so " * rng.randint(0, 200)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, ask string, text string")
    got = packing.packed(df, PATH, prompt="ask", capacity=512, segments=5, loss=300).collect()
    documents = {i: [*p, *t, 1] for (i, _, _), p, t in zip(rows, all_ids([r[1] for r in rows]), all_ids([r[2] for r in rows]), strict=True)}
    check(packing.digest(spark.createDataFrame(got)).collect(), documents, 512)
    sums = defaultdict(lambda: [0, 0, 0])
    for r in got:
        for i, x in enumerate((r.length, 1, r.loss_tokens)):
            sums[r.sequence_id][i] += x
    assert all(a <= 512 and b <= 5 and c <= 300 for a, b, c in sums.values())
    says = {i: len(t) + 1 for (i, _, _), t in zip(rows, all_ids([r[2] for r in rows]), strict=True)}
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id] += r.loss_tokens
    assert by_doc == says


def test_conversations(spark):
    """Each assistant's turn behind the turn before it: every id once, prompts without loss, and the three limits."""
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").collect()}
    says = {k: r.text for k, r in turns.items() if r.role == "assistant"}
    prompts = {(c, t): turns[c, t - 1].text if (c, t - 1) in turns else "" for c, t in says}
    ids = {k: (p, [*a, 1]) for k, p, a in zip(says, all_ids(list(prompts.values())), all_ids(list(says.values())), strict=True)}
    got = packing.conversations_query(spark, MIDDLE).collect()
    by_turn, sums = defaultdict(list), defaultdict(lambda: [0, 0, 0])
    for r in got:
        by_turn[r.conv_id, r.turn].append(r)
        for i, x in enumerate((r.length, 1, r.loss_tokens)):
            sums[r.sequence_id][i] += x
    assert says and set(by_turn) == set(says)
    for k, pieces in by_turn.items():
        prompt, answer = ids[k]
        every, at = [*prompt, *answer], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(every) and r.ids_crc32 == zlib.crc32(np.array(every[at : at + r.length], "<u4").tobytes())
            assert r.loss_tokens == sum(i >= len(prompt) for i in range(at, at + r.length))
            at += r.length
        assert at == len(every)
    assert all(a <= 2048 and b <= packing.TURNS and c <= packing.LOSS for a, b, c in sums.values())
    hot = spark.createDataFrame([(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "x"), (2, 1, "assistant", None), (1, 2, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.turn, r.prompt, r.text) for r in packing.examples(hot).where("conv_id = 1").collect()) == [(1, 2, "a", "x")] * 2
    assert packing.examples(hot).where("conv_id = 2").first().prompt is None and packing.examples(hot.limit(0)).count() == 0


def test_conversations_keep_their_ids(spark):
    rows = [(c, t + i, r, "x y") for c, t in ((1 << 44, 1), (5, 2_000_000), (-3, 1), (None, 4), (6, -9)) for i, r in enumerate(("user", "assistant"))]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = packing.packed(packing.examples(talk), PATH, "prompt", key=("conv_id", "turn")).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, r, _ in rows if r == "assistant"}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A."), (3, "A."), (None, "b"), (4, "word " * 30000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = packing.packed(docs, PATH).collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in all_ids([t or "" for _, t in rows]))
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_new_pieces_are_asked_of_the_model_alone():
    """Not of the whole library, which would cut each piece again."""
    texts = ["\0 a Zé's\n\n  日本 🙂", "", " ÿ­Ā", "word Word  WORD"]
    tokens = packing.TokenIds(PATH)
    tokens.library = SimpleNamespace(model=tokens.library.model)
    assert [x.tolist() for x in tokens.ids(texts)] == all_ids(texts)
