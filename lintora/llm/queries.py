"""The queries op1 to op13: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintora.llm import alignment, bucket_digest, common, containment, language, lexical_search, packing, personal_data, quality, simhash, substrings, token_counts, token_files, url_filter

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as seekable zstandard files and read back."""
    docs = table(spark, sf_dir, "documents")
    index = token_files.write_token_files(docs, common.new_path(spark, "token-files"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.token_digests(token_files.read_token_files(token_files.file_starts(index)))


def op2_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document, of its edited text, and their likeness."""
    return bucket_digest.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences mixed as the corpus is."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.filter(~language.held_out("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without word sequences that occur earlier."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base spans and all spans."""
    found = personal_data.find(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[f"n_{k}" for k in personal_data.KINDS], "base_sha256", spans.alias("spans"), F.size("spans").cast("long").alias("n_spans"), "n_found")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    paths = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.alignment_digests(alignment.align(table(spark, sf_dir, "documents"), *paths), *paths)


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_bucket_digest": op2_bucket_digest,
        "op3_packing": op3_packing,
        "op4_containment": op4_containment,
        "op5_token_counts": op5_token_counts,
        "op6_language": op6_language,
        "op7_url_filter": op7_url_filter,
        "op8_simhash_golay": op8_simhash_golay,
        "op9_substrings": op9_substrings,
        "op10_personal_data": op10_personal_data,
        "op11_lexical_search": op11_lexical_search,
        "op12_quality": op12_quality,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_containment": containment.SQL, "op7_url_filter": url_filter.SQL, "op11_lexical_search": lexical_search.SQL}
