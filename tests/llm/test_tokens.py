import random

import pytest

from gridloom.llm import tokens

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def path():
    return tokens.tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(1)
    parts = ["the", " The", "'s", "don't", "  ", "\n", "\n\n  x", "\t", "é", "ﬁ", "½", "３", "😀", " ", " ", "\u0085", "​", "\x1c", "日本語", "<|endoftext|>", "12345", "-", "...", "“q”", "\r\n", "ª", "́", "﻿", "'LL", " '"]
    yield from ["", " ", "   ", "\n", "a", "hello world", " lead", "trail ", "a  b   c\n\n\nd \n e", "<|endoftext|>", "x" * 5000, "ab " * 20000]
    for _ in range(150):
        yield "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 30)))


@pytest.mark.parametrize("block_words", [3, 400_000])
def test_ids_equal_those_of_the_whole_text(spark, path, reference, block_words):
    docs = [*enumerate(texts()), (10_000, None)]
    out = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(spark.createDataFrame(docs, SCHEMA), path, block_words).collect()}
    assert out == {i: reference(t) if t else [] for i, t in docs}


def test_counts_decode_and_repeats(spark, path):
    docs = [(1, "one two  two\n"), (2, None), (3, ""), (4, "é😀 ​")]
    df = spark.createDataFrame(docs, SCHEMA)
    ids = tokens.encode_corpus(df, path)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, path).collect()}
    assert counts == {r["doc_id"]: len(r["ids"]) for r in ids.collect()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(ids, tokens.piece_table(spark, path), 3).collect()}
    assert back == {i: t or "" for i, t in docs}
    half = spark.createDataFrame([(1, [36, 8582]), (2, None), (3, [None, 64, 10**6])], "doc_id bigint, ids array<int>")
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(half, tokens.piece_table(spark, path)).collect()}
    assert back[2] == "" and back[3] == "a" and back[1].endswith("\ufffd")
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], SCHEMA)
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in tokens.encode_corpus(twice, path).collect()) == [("1", 2), ("1", 2), ("None", 1)]


def test_empty_clashing_and_unknown_kind(spark, path):
    assert tokens.encode_corpus(spark.createDataFrame([], SCHEMA), path).collect() == []
    df = spark.createDataFrame([(1, "a", "x", 3)], "doc_id bigint, text string, word string, block int")
    assert [(r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df, path).collect()] == [(1, [64])]
    with pytest.raises(ValueError):
        tokens.encode_corpus(df, "pieces.model")
