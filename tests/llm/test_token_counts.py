import random

import public_tokenizers
from tokenizers import Tokenizer

from lintora.llm import token_counts as tc
from lintora.llm.queries import op5_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, n long"
ODD = ["'s", "'S", "a", "É", "é", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "9", "²", "Σ", "<|endoftext|>", "<|end", "-", "ss", "日", "　", "\U0001f600", "٣", "\x00", "½"]


def library_count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


LIBRARY = Tokenizer.from_file(PATH)


def test_frequencies_give_the_library_counts():
    special, pieces = tc.counter(PATH)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 40)))
        found, total = tc.frequencies(text, special)
        assert total + sum(pieces(p) * n for p, n in found.items()) == library_count(text), text


def test_nulls_ties_clashing_columns_and_both_joins(spark):
    rows = [(1, "The cat sat. The end <|endoftext|>\n\n x", "p", 1), (1, "The cat sat. The end <|endoftext|>\n\n x", "p", 1), (None, "naïve 日本", None, None), (2, None, "", 0), (3, "", "", 0), (4, "very " * 40000 + "x" * 3000, "", 0)]
    want = sorted(((d, len((t or "").encode()), library_count(t), library_count(t) > 1024) for d, t, *_ in rows), key=str)
    for most in (0, 3, 1000):
        got = tc.token_counts(spark.createDataFrame(rows, SCHEMA), PATH, most_frequent=most).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(map(tuple, op5_token_counts(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted((d.doc_id, len(d.text.encode()), library_count(d.text), library_count(d.text) > 1024) for d in docs)
