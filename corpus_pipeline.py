"""A training corpus from raw documents: five stages, each a written table.

Every stage works on all that the stage before kept and returns the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintora.llm import common, containment, language, near_copies, packing, personal_data

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER, END_ID = "word_bpe_49k.json", 2

#: Compression, Golay decoding, redaction and packing have no SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; lang becomes the predicted one.
    Dictionaries are learned from the labelled documents that are not held out.
    Null texts and texts without a letter are rejected."""
    known = language.learn(docs.filter(~language.held_out("doc_id")))
    found = language.identify(docs.select(*COLUMNS), known).filter(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the
    smallest id. Documents link where wide SimHash fingerprints of their 5-word
    shingles agree in 0.8 of the bits; Golay-code keys find the candidates. Of rows
    with the same id the first by text stays; a row without an id stays if its
    component has no id."""
    found = near_copies.near_copies(docs).filter("doc_id <=> component_id")
    kept = common.written(found.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n_rows")), "kept-ids")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id"))
    single = docs.select(*COLUMNS).join(kept.filter("n_rows = 1 or kept_id is null").select("kept_id"), same, "left_semi")
    repeated = kept.filter("n_rows > 1 and kept_id is not null").select("kept_id")
    if repeated.isEmpty():
        return single
    first = docs.select(*COLUMNS).join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return single.unionByName(first.select("doc_id", "row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows without an id go if any
    of them contains one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = containment.contained_items(docs, items).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.select(*COLUMNS).join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    return personal_data.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in mixed sequences of 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
