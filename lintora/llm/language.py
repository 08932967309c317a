"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A text is
compressed with every dictionary; the one that makes it smallest names the
language. What is compressed is the whole text, its words of letters lower-cased,
in blocks that are compressed on their own, so that a long text can't become its
own dictionary. A narrow relative margin to the second smallest is a rejection.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintora.llm.common import rows_of, to_batches

#: Bytes of a dictionary, of one document's share in it, and of all dictionaries
#: together; languages beyond the bound of their number are not learned. They
#: bound the sample that is drawn and what is broadcast.
DICTIONARY_BYTES, SAMPLE_BYTES, TOTAL_BYTES, MAX_LANGUAGES = 112 << 10, 2000, 16 << 20, 4000
LEVEL, BLOCK_BYTES = 9, 4000
#: Relative margin under which a prediction is rejected.
MIN_MARGIN = 0.01
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def normal(text: str) -> bytes:
    """The text's words of letters, lower-cased, with one space between them."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of the labelled
    rows: documents in the order of a hash, and of each a stretch of SAMPLE_BYTES
    that begins at a place given by a hash. Rows with a null label or no words
    teach nothing.

    A dictionary has `dictionary_bytes`, or less where all of them would have
    over TOTAL_BYTES. Of more than MAX_LANGUAGES labels those with most documents
    are learned."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and length(text) > 0")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    size = min(dictionary_bytes, TOTAL_BYTES // len(counts))
    want = 2 * max(1, size // SAMPLE_BYTES) + 8
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * want / r["count"])) for r in counts], "lang string, share double")
    order = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200)), F.lit(1 << 30))
    chars = F.char_length("text")
    place = F.pmod(F.xxhash64("doc_id", chars), F.greatest(F.lit(1), chars - 2 * SAMPLE_BYTES + 1)).cast("int") + 1
    drawn = labelled.join(F.broadcast(shares), "lang").withColumn("order", order).filter(F.col("order") < F.col("share") * (1 << 30))
    drawn = drawn.select("order", "lang", F.substring("text", place, F.lit(2 * SAMPLE_BYTES)).alias("text"))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dictionaries():
            now, held, n = None, [], 0
            for lang, text in rows_of(batches):
                if lang != now:
                    if held:
                        yield now, b" ".join(held)[:size]
                    now, held, n = lang, [], 0
                text = normal(text)[:SAMPLE_BYTES]
                if text and n < size and text not in held:
                    held.append(text)
                    n += len(text)
            if held:
                yield now, b" ".join(held)[:size]

        yield from to_batches(dictionaries(), pa.schema([("lang", pa.string()), ("content", pa.binary())]), size=16)

    ordered = drawn.repartition("lang").sortWithinPartitions("lang", "order", "text").select("lang", "text")
    filled = ordered.mapInArrow(fill, "lang string, content binary").collect()  # no more than TOTAL_BYTES
    return {r["lang"]: bytes(r["content"]) for r in sorted(filled, key=lambda r: r["lang"])}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = {}
        for lang, content in dictionaries.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False).compress

    def sizes(self, text: str | None) -> dict[str, int]:
        """Compressed bytes by language; empty for a text without letters."""
        data = normal(text or "")
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        return {lang: sum(len(compress(b)) for b in blocks) for lang, compress in self.compressors.items()} if blocks else {}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and relative margin (0 if rejected outright)."""
        sizes = self.sizes(text)
        if not sizes:
            return UNDETERMINED, 0.0, 0.0
        best, *rest = sorted((n, lang) for lang, n in sizes.items())
        margin = (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0
        score = 1 / sum(math.exp(-min(700, (n - best[0]) / best[0] / (2 * MIN_MARGIN))) for n in sizes.values())
        return best[1], score, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The input's columns, then lang_pred, score, margin, rejected, which
    replace columns of these names.

    The prediction reads the text alone. A null text or one without letters is
    `und` with score 0, rejected. Ties of sizes have margin 0 and the first
    language by name. Without any dictionary all is `und`. Repeated rows and
    null ids are kept."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = ("lang_pred", "score", "margin", "rejected")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
    place = kept.columns.index(text_col) if text_col in kept.columns else None
    if place is None:
        raise ValueError(f"no column {text_col}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(known.value)
        for batch in batches:
            rows = []
            for (text,) in rows_of([pa.record_batch([batch.column(place)], names=["t"])]):
                lang, score, margin = classifier.predict(text)
                rows.append((lang, score, margin, margin < min_margin))
            new = next(iter(to_batches(rows, added, size=len(rows) + 1)), None)
            if new is not None:
                yield pa.record_batch([*batch.columns, *new.columns], names=[*batch.schema.names, *names])

    new = T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new.fields]))
