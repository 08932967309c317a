"""Token counts of texts without making token ids.

Byte-level tokenizers cut a text into pre-tokens and encode each on its own, so
a text has as many tokens as its pre-tokens have pieces. Here each distinct
pre-token is counted once, in a vocabulary table, and the counts are joined to
the pre-token frequencies of each document.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import rows_of, to_batches, written
from lintora.llm.tokens import byte_letters

#: Most pre-tokens that are sent to every executor, and the most bytes of one:
#: at most 262,144 x 64 bytes of text. The others go through a shuffled join.
MAX_FREQUENT, MAX_FREQUENT_BYTES = 1 << 18, 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x7e\t\n\r{_LATIN}]*")
_PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t\n\r{_LATIN}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


@lru_cache(maxsize=2)
def counter(path: str):
    """(special strings as a pattern or None, pre-token -> number of pieces)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
    letters, tokenize = byte_letters(), library.model.tokenize
    pieces = lambda s: len(tokenize("".join([letters[b] for b in s.encode()])))
    return (re.compile("|".join(map(re.escape, special))) if special else None), pieces


def frequencies(text: str, special: re.Pattern | None) -> tuple[Counter, int]:
    """Frequencies of the text's pre-tokens, and the number of special tokens,
    which cut the text as they do in the library."""
    parts = special.split(text) if special else [text]
    found = Counter()
    for part in parts:
        found.update((_PLAIN_SPLIT if _PLAIN.fullmatch(part) else _SPLIT).findall(part))
    return found, len(parts) - 1


def vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text", flush: int = 150_000) -> DataFrame:
    """Every distinct pre-token of all texts: piece, n_docs, n_pieces. Written."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, _ = counter(tokenizer)

        def rows():
            held = Counter()
            for (text,) in rows_of(batches):
                held.update(frequencies(text or "", special)[0].keys())
                if len(held) >= flush:
                    yield from held.items()
                    held = Counter()
            yield from held.items()

        yield from to_batches(rows(), pa.schema([("piece", pa.string()), ("n_docs", pa.int64())]), size=16384)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = counter(tokenizer)
        for batch in batches:
            yield batch.append_column("n_pieces", pa.array([pieces(s) for s in batch.column(0).to_pylist()], pa.int64()))

    distinct = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "piece string, n_docs long").groupBy("piece").agg(F.sum("n_docs").alias("n_docs"))
    return written(distinct.mapInArrow(count, "piece string, n_docs long, n_pieces long"), "vocabulary")


def frequent(words: DataFrame, most: int = MAX_FREQUENT, most_bytes: int = MAX_FREQUENT_BYTES) -> dict[str, int]:
    """The pre-tokens in most documents with their pieces: as many as fit in the
    bound when those above a common threshold are taken."""
    short = words.filter(F.octet_length("piece") <= most_bytes)
    level = F.floor(8 * F.log2("n_docs")).cast("long")
    histogram = dict(short.groupBy(level.alias("level")).count().collect())
    least, total = None, 0
    for at in sorted(histogram, reverse=True):
        total += histogram[at]
        if total > most:
            break
        least = at
    return {} if least is None else dict(short.filter(level >= least).select("piece", "n_pieces").collect())


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every
    row. Counts are those of the library with its defaults and without added
    begin or end tokens.

    The pieces of frequent pre-tokens (a bounded table) are summed where the
    document is read; the rest of its frequencies, its rare pre-tokens, join
    the vocabulary table.

    Null and empty texts have 0 bytes and tokens; rows with equal or null ids
    are all kept; other columns are ignored; no rows give no rows."""
    spark = docs.sparkSession
    words = vocabulary(docs, tokenizer, text_col)
    known = spark.sparkContext.broadcast(frequent(words, most_frequent))

    def sum_known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, _ = counter(tokenizer)
        pieces = known.value
        row = TaskContext.get().partitionId() << 40

        def rows():
            nonlocal row
            for doc_id, text in rows_of(batches):
                text = text or ""
                found, total = frequencies(text, special)
                rare = []
                for piece, n in found.items():
                    k = pieces.get(piece)
                    if k is None:
                        rare.append((piece, n))
                    else:
                        total += k * n
                yield row, doc_id, len(text.encode()), total, rare
                row += 1

        pair = pa.struct([("piece", pa.string()), ("n", pa.int64())])
        yield from to_batches(rows(), pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rare", pa.list_(pair))]), size=256)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partial = written(texts.mapInArrow(sum_known, "row long, doc_id long, n_bytes long, known long, rare array<struct<piece: string, n: long>>"), "token-sums")
    rare = partial.select("row", F.inline("rare")).join(words.select("piece", "n_pieces"), "piece")
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return partial.drop("rare").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
