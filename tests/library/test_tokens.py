"""Prompt tokens as columns against the libraries."""

import base64

import pytest
from pyspark.sql import functions as F

from granary.functions.tokens import PATTERN, PromptTokenizer
from granary.operators import hygiene

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", "a", "Hello, world!", " two  spaces\n\nand lines ", "été 日本 🎉", "<|endoftext|>", "x" * 5000, None, "Hello, world!"]


@pytest.fixture(scope="module")
def ranks():
    return PromptTokenizer.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_ranks_like_tiktoken(spark, ranks):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    assert PATTERN == public_tokenizers.PATTERN
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string").repartition(3)
    got = df.select("i", ranks.ids(F.col("t")).alias("ids"), ranks.count(F.col("t")).alias("n")).orderBy("i").collect()
    want = [None if t is None else plain.encode_ordinary(t) for t in TEXTS]
    assert [r.ids for r in got] == want and [r.n for r in got] == [None if w is None else len(w) for w in want]


def test_json_like_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    got = [r.ids for r in df.select("i", PromptTokenizer.read(path).ids(F.col("t")).alias("ids")).orderBy("i").collect()]
    assert got == [None if t is None else plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_letters(ranks):
    ids = ranks.letter_ids()
    assert len(set(ids)) == 26 and ranks.encode(["A", "Z"]) == [[ids[0]], [ids[25]]]
    content = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"\nA") + b" 256"
    with pytest.raises(ValueError, match="merges"):
        PromptTokenizer(content, pattern=r"[\s\S]+").letter_ids()
    with pytest.raises(ValueError, match="2 tokens"):
        PromptTokenizer(content, letters="Aé").letter_ids()


def test_too_long_counts_tokens(spark, ranks):
    df = spark.createDataFrame([(1, "word " * 50), (2, "x"), (3, None)], "id long, t string")
    got = {r.id: r.long for r in df.select("id", hygiene.too_long("t", 49, ranks.count(F.col("t"))).alias("long")).collect()}
    assert got == {1: True, 2: False, 3: None}
