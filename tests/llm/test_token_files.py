import struct
import zlib

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from lintora.llm import common, token_files
from lintora.llm.queries import op1_token_files
from lintora.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, path string"
TEXTS = ["Hello, the world!", None, "", "don't ''s I'LLx", "a <|endoftext|> b", "Σίσυφος ΣΑΣ ﬁ É", "x\x1cy\x85z\xa0w 12²½", "... --a9 ,.", "word " * 30000]


def test_encoder_equals_library():
    library, encoder = Tokenizer.from_file(PATH), WordEncoder(PATH, bound=3)
    for text in TEXTS:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(want)}I", *want)


def _write(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return token_files.write_token_files(docs, common.new_path(spark, "test"), PATH, 2)


def test_round_trip_with_nulls_ties_and_clashing_columns(spark):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", "y")]
    index = _write(spark, rows)
    got = token_files.read_token_files(token_files.file_starts(index)).collect()
    library = Tokenizer.from_file(PATH)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in ordered:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [tuple(w) for w in want]
    some = token_files.read_documents(index, spark.createDataFrame([(4,), (99,)], "doc_id long")).collect()
    assert [(r.doc_id, bytes(r.ids)) for r in some] == [(4, next(w[2] for w in want if w[0] == 4))]


def test_any_reader_decodes_and_damage_is_found(spark):
    path = _write(spark, [(1, "one two", "", ""), (2, "three", "", "")]).first().path
    local = path.removeprefix("file://")
    data = open(local, "rb").read()
    stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert stream.startswith(token_files.FrameReader(path).frame(0))
    at = token_files.FrameReader(path).starts[0] + 9
    open(local, "wb").write(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(path).frame(0)


def test_empty_table(spark):
    index = _write(spark, [])
    assert token_files.read_token_files(token_files.file_starts(index)).collect() == []


def test_query_equals_brute_force(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want.append((d.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, op1_token_files(spark, "/root/testdata/sf0.001").collect())) == want
