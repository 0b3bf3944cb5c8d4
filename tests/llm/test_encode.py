import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import encode


@pytest.fixture(scope="module")
def vocab():
    return encode.load_vocabulary()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts, vocab):
    ids, counts = encode.encode_texts(texts, vocab)
    assert (encode.count_texts(texts, vocab) == counts).all()
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_against_the_tokenizer(vocab, reference):
    rng = random.Random(2)
    letters = "abcdefghijklmnop eeett  ''12\n\t-–é漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["aaaa" * n for n in range(40)] + [None, "", " ", "<|endoftext|> is text", "I'll we've don't", "‍👩‍🌾🇨🇭", "\x00\x01"]
    assert ours(texts, vocab) == reference(texts)


def test_very_long_words(vocab, reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (4095, 4096, 4097, 60000)] + ["-" * 50000, " " * 9000 + "x", "ab" * 9000]
    assert ours(texts, vocab) == reference(texts)


def test_column(spark, rows):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "y"), (3, None, "z")], "id bigint, text string, ids string")
    got = rows(df.select("id", encode.token_ids(spark, F.col("text")).alias("t"), encode.token_count(spark, F.col("text")).alias("n")))
    assert got == [(1, [31373, 995], 2), (2, [], 0), (3, [], 0)]
    assert rows(df.where("id > 9").select(encode.token_ids(spark, F.col("text")))) == []
