"""Short test items inside long documents: bottom-k MinHash containment search.

Words are runs of letters and digits, lower-cased; shingles are five words (an
item of fewer words is one shingle of that many). An item with q distinct
shingles is contained in a document that holds at least t q of them.

Items are partitioned by size. An item's sketch is its k smallest shingle hashes
in a random order; in the partition of size q, k = q - ceil(t q) + 1. A document
that contains the item lacks at most q - ceil(t q) shingles, so it holds one of
the k at least: looking up the documents' hashes in the sketches, about a fifth
of the items' shingles, loses no pair. Candidates are verified by the shingles
themselves.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintora.llm.common import small, written

WIDTH, THRESHOLD = 5, 0.8
#: A table of sketches, candidates or shingles of no more rows (and of bounded
#: bytes) is broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _bound(array: Column, f) -> Column:
    """f of an array that is computed once: as the variable of a lambda it is
    not computed anew for each element that f looks at."""
    return F.element_at(F.transform(F.array(array), f), 1)


def _hashes(w: Column, width: int) -> Column:
    """Hashes of all shingles of `width` words."""

    def of(h: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *[h[i + j] for j in range(width)]))
        return F.when(F.size(h) >= width, at).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(w, lambda x: F.xxhash64(x)), of)


def _strings(w: Column, width: int) -> Column:
    """All shingles of `width` words."""

    def of(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, at).otherwise(F.array().cast("array<string>"))

    return _bound(w, of)


def item_shingles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, item (a key of the row), width, shingle, n_shingles; distinct."""

    def of(w: Column) -> Column:
        width = F.least(F.lit(WIDTH), F.size(w))
        return F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.struct(width.alias("width"), F.array_join(F.slice(w, i, width), " ").alias("shingle")))

    texts = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item_col, text_col).alias("item"), F.col(text_col).alias("text"))
    distinct = texts.select("item_id", "item", F.inline(_bound(words(F.col("text")), of))).filter("width > 0").distinct()
    return distinct.withColumn("n_shingles", F.count("*").over(Window.partitionBy("item")))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """The bottom-k hashes of every item, k by its size partition: item, h."""
    parts = F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))
    hashed = shingles.select("item", "width", "n_shingles", parts.alias("p"))
    h = F.lit(None).cast("bigint")
    for width in range(1, WIDTH + 1):
        h = F.when(F.col("width") == width, F.xxhash64(F.lit(width), *[F.col("p")[j] for j in range(width)])).otherwise(h)
    order = Window.partitionBy("item", "n_shingles").orderBy(F.xxhash64("h", F.lit(1)), "h")
    kept = F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9) + 1
    return hashed.withColumn("h", h).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= kept).select("item", "h")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every pair whose
    document contains the item.

    Null and empty texts, and texts without a word, contain and are contained in
    nothing. Rows that repeat an id count as one with the largest containment;
    null ids are kept as null. Other columns are ignored; empty tables give no
    rows. The hash table of the sketches is broadcast if it has at most
    MAX_BROADCAST_ROWS rows; beyond that it is joined by shuffle, whose skewed
    keys Spark splits."""
    shingles = written(item_shingles(items, item_col, item_text_col), "item-shingles")
    sketch = written(sketches(shingles, threshold), "sketches")
    widths = [r.width for r in shingles.select("width").distinct().collect()] or [WIDTH]  # 1 to 5
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc"))
    looked = texts.select("doc", F.explode(F.concat(*[_hashes(words(F.col("text")), w) for w in widths])).alias("h"))
    candidates = written(looked.join(small(sketch, MAX_BROADCAST_ROWS), "h").select("doc", "item").distinct(), "candidates")
    suspects = texts.join(small(candidates.select("doc").distinct(), MAX_BROADCAST_ROWS), "doc", "left_semi")
    spelled = F.create_map(*[x for w in widths for x in (F.lit(w), _strings(words(F.col("text")), w))])
    held = suspects.select("doc_id", "doc", F.explode(spelled).alias("width", "all")).select("doc_id", "doc", "width", F.explode("all").alias("shingle")).distinct()
    met = held.join(small(shingles, MAX_BROADCAST_ROWS), ["width", "shingle"])
    shared = met.groupBy("doc_id", "doc", "item_id", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    enough = shared.filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9)).join(candidates, ["doc", "item"], "left_semi")
    pair = enough.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    best = pair.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_shingles", "best.containment")


SQL = r"""
WITH item_words AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, text, least(5, len(w)) AS width, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n_shingles FROM item_shingles
), doc_words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT doc_id, text, width, array_to_string(w[i:i + width - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM item_shingles) WHERE len(w) >= width)
), shared AS (
  SELECT d.doc_id, d.text AS doc_text, s.item_id, s.text AS item_text, s.n_shingles, count(*) AS n_shared
  FROM doc_shingles d JOIN sized s USING (width, shingle) GROUP BY ALL
)
SELECT doc_id, item_id, max(n_shared) AS n_shared, max(n_shingles) AS n_shingles, max(n_shared / n_shingles) AS containment
FROM shared WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9) GROUP BY doc_id, item_id
"""
