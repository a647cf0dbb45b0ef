"""Merge replay against a public implementation with the same vocabulary."""

import base64
import os
import random

import pytest

from notelode.llm.bpe import TOKENIZER, Encoder, corpus_token_ids, read_ranks, token_counts, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file here")
PUBLIC = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_ranks(TOKENIZER).splitlines())}
    return tiktoken.Encoding("own", pat_str=PUBLIC, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts():
    rng = random.Random(4)
    letters = "ab \n\t\x1c\u2028\u3000éđ1'sาห日本<|>\u0301😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(3000)]
    return [*made, "a" * 4000, " " * 2000, "日本" * 900, "", "<|endoftext|>", "Bệnh nhân không đau ngực, sốt 38,5 °C"]


def test_equal(public):
    t = texts()
    e = Encoder(read_ranks(TOKENIZER))
    want = [public(x) for x in t]
    assert e.encode(t).to_pylist() == want
    assert e.encode(t[::-1]).to_pylist() == want[::-1]
    assert e.counts(t).tolist() == [len(w) for w in want]


def test_pool_starts_over(public, monkeypatch):
    monkeypatch.setattr("notelode.llm.bpe.WORDS", 10)
    e = Encoder(read_ranks(TOKENIZER))
    for x in texts()[:200]:
        assert e.encode([x, x]).to_pylist() == [public(x)] * 2


def test_table(spark, public):
    rows = [(1, None, 0), (2, "", 0), (3, "đau ngực", 0), (3, "đau ngực", 1)]
    df = spark.createDataFrame(rows, "k long, t string, ids int")
    got = sorted((r["k"], r["ids"]) for r in token_ids(df, "k", "t").collect())
    assert got == [(1, []), (2, []), (3, public("đau ngực")), (3, public("đau ngực"))]
    assert sorted(r["n_tokens"] for r in token_counts(df, "k", "t").collect())[:2] == [0, 0]
    assert token_ids(df.limit(0), "k", "t").count() == 0


def test_corpus_at_once(spark):
    rows = [(1, "sốt cao sốt cao"), (1, "sốt cao"), (2, None), (3, ""), (None, " a  b\n\n"), (4, "ho " * 3000)]
    df = spark.createDataFrame(rows, "doc int, note string")
    got = sorted(((r["doc"] or 0, r["ids"]) for r in corpus_token_ids(df, "doc", "note").collect()))
    assert got == sorted(((r["doc"] or 0, r["ids"]) for r in token_ids(df, "doc", "note").collect()))
    assert corpus_token_ids(df.limit(0), "doc", "note").count() == 0
