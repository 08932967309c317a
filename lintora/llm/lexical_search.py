"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by the share of documents that hold them. A bundle is
an item with a sparse accumulator: documents (of one block) with the scores they
have so far. It visits the owners in turn, from the one of the rarest terms to
the one of the commonest; each stage is a cogroup of the bundles with the owner's
inverted lists, which adds the integer contributions of the terms that the item
asks for. The last stage selects.

The inverted lists are made where documents are read, block by block, without a
shuffle; a list is a row for each term and block, so that a term that all
documents hold is spread over all blocks. A stage works on a block of documents
and a group of items, both of bounded size.

A bundle leaves out documents that can't be among the first any more: those whose
score, with the most that later owners can add, is below the score that the
k-th document of the block has already. Scores only grow, so this loses nothing.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintora.llm.common import discard, rows_of, to_batches, written
from lintora.llm.tokens import Learned

K = 10
#: Shares of documents up to which a term belongs to each owner but the last.
OWNERS = (1 / 1024, 1 / 64, 1 / 8)
#: Most documents and postings of a block, and most items of a group.
BLOCK_DOCS, BLOCK_POSTINGS, GROUP_ITEMS = 8192, 1 << 20, 256
#: Terms of items by their crc32 modulo this, the bounded filter of what is indexed.
FILTER_SLOTS = 1 << 20
#: Document length in the score: m = BASE + (SLOPE * n * N) div L (fixed values).
SLOPE, BASE = 75, 100 - 75

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.string()), ("pos", _INTS), ("tf", _INTS), ("n", _INTS), ("ids", _LONGS), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_INDEX_SQL = "block long, term string, pos array<int>, tf array<int>, n array<int>, ids array<long>, n_docs long, n_terms long"
_BUNDLE = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("item", pa.int64()), ("pos", _INTS), ("score", _LONGS)])
_BUNDLE_SQL = "block long, group long, item long, pos array<int>, score array<long>"
_ITEMS = pa.schema([("item", pa.int64()), ("group", pa.int64()), ("item_id", pa.int64()), ("term", pa.string()), ("q", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text", group: int = GROUP_ITEMS) -> DataFrame:
    """A written table: item (a number for each row), group, item_id, term, q
    (its occurrences in the item)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = ((part << 40 | i, part << 32 | i // group, item_id, t, q) for i, (item_id, text) in enumerate(rows_of(batches)) for t, q in Counter(terms(text)).items())
        yield from to_batches(rows, _ITEMS, size=8192)

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "item long, group long, item_id long, term string, q long"), "item-terms")


class Block:
    """Inverted lists of one block of documents, in the order of their ids."""

    def __init__(self):
        self.docs: list[tuple[int | None, int]] = []
        self.numbers: dict[bytes, int] = {}
        self.doc, self.term, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, n: int, found: list[tuple[bytes, int]]) -> None:
        for term, tf in found:
            self.term.append(self.numbers.setdefault(term, len(self.numbers)))
            self.tf.append(tf)
        self.doc.extend([len(self.docs)] * len(found))
        self.docs.append((doc_id, n))

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one without a term that has the ids."""
        order = sorted(range(len(self.docs)), key=lambda i: (self.docs[i][0] is None, self.docs[i][0] or 0, self.docs[i][1]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array([n for _, n in self.docs], np.int64)
        ids = pa.array([[self.docs[i][0] for i in order]], _LONGS)
        none = pa.array([[]], _INTS)
        yield pa.record_batch([pa.array([block]), pa.array([None], pa.string()), none, none, none, ids, pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], schema=_INDEX)
        if not self.numbers:
            return
        doc, term, tf = (np.frombuffer(x, np.int32) for x in (self.doc, self.term, self.tf))
        by = np.lexsort((place[doc], term))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[by].astype(np.int32))) for x in (place[doc], tf, lengths[doc])]
        rows, zeros = len(self.numbers), pa.array(np.zeros(len(self.numbers), np.int64))
        table = pa.record_batch([pa.array(np.full(rows, block)), pa.array(list(self.numbers), pa.string()), *lists, pa.nulls(rows, _LONGS), zeros, zeros], schema=_INDEX)
        for at in range(0, rows, 512):
            yield table.slice(at, 512)


def index(docs: DataFrame, slots: set[int], id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A written table of inverted lists: block, term, pos (places in the block),
    tf, n (all terms of the document), for the terms whose crc32 is in `slots`;
    and for each block a row without a term: ids, n_docs, n_terms of all its
    documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        wanted = Learned(lambda t: zlib.crc32(t) % FILTER_SLOTS in asked, 250_000)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for doc_id, text in rows_of(batches):
            words = terms(text)
            block.add(doc_id, len(words), [(t, tf) for t, tf in Counter(words).items() if wanted[t]])
            if len(block.docs) >= block_docs or len(block.doc) >= BLOCK_POSTINGS:
                yield from block.batches(number)
                number, block = number + 1, Block()
        if block.docs:
            yield from block.batches(number)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, _INDEX_SQL), "inverted-lists")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, cuts = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def first_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by place, ascending."""
    order = np.argsort(-scores, kind="stable")[:k]
    return np.sort(order[scores[order] > 0])


def visit(key: tuple, bundles: pa.Table, lists: pa.Table, k: int, last: bool) -> pa.Table:
    """One owner's stage for a block of documents and a group of items; either
    table may be empty."""
    pos, impact, held = [], [], {}
    asked: dict[int, list[tuple[int, int]]] = {}
    rest: dict[int, int] = {}
    if lists.num_rows:
        pos, impact = _lists(lists["pos"]), _lists(lists["impact"])
        for row, items in enumerate(lists["asked"].to_pylist()):
            for x in items:
                asked.setdefault(x["item"], []).append((row, x["weight"]))
                rest[x["item"]] = x["rest"]
    if bundles.num_rows:
        held = {item: x for item, *x in zip(bundles["item"].to_pylist(), _lists(bundles["pos"]), _lists(bundles["score"]))}
    block, items_group = (x.as_py() for x in key)
    size = 1 + max([int(p.max()) for p in pos if len(p)] + [int(p.max()) for p, _ in held.values() if len(p)], default=0)
    rows = []
    for item in sorted(held.keys() | asked.keys()):
        scores = np.zeros(size, np.int64)
        if item in held:
            scores[held[item][0]] = held[item][1]
        for row, weight in asked.get(item, ()):
            scores[pos[row]] += weight * impact[row].astype(np.int64)
        if last:
            keep = first_places(scores, k)
        else:
            keep = np.flatnonzero(scores)
            if item in rest and len(keep) > k:
                least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
                keep = keep[scores[keep] + rest[item] >= least]
        if len(keep):
            rows.append((block, items_group, item, keep.astype(np.int32), scores[keep]))
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _BUNDLE)], schema=_BUNDLE) if rows else _BUNDLE.empty_table()


def _stage(k: int, last: bool):
    return lambda key, bundles, lists: visit(key, bundles, lists, k, last)


def search(docs: DataFrame, items: DataFrame, k: int = K, owners: tuple[float, ...] = OWNERS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS, group: int = GROUP_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items the k documents with
    the highest score above 0, equal scores by ascending doc_id.

    Every row of docs is a document and every row of items an item, also where
    ids repeat; null ids come after the others. Null and empty texts have no
    terms: such documents are never found, such items find nothing. Other columns
    are ignored; without documents or items there are no rows."""
    spark = docs.sparkSession
    wanted = item_terms(items, item_col, item_text_col, group)
    slots = {r[0] for r in wanted.select(F.crc32(F.col("term").cast("binary")) % FILTER_SLOTS).distinct().collect()}  # no more than FILTER_SLOTS
    lists = index(docs, slots, id_col, text_col, block_docs)
    total = lists.filter("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 1

    def contribution(tf, n):
        """(1000000000 * tf) div (1000 * tf + 8 * m), below a million."""
        m = F.lit(BASE) + F.call_function("div", n.cast("long") * SLOPE * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))
        return F.call_function("div", tf.cast("long") * 1_000_000_000, tf.cast("long") * 1000 + m * 8).cast("int")

    postings = lists.filter("term is not null").select("block", "term", "pos", F.zip_with("tf", "n", contribution).alias("impact"))
    df, top = F.col("df"), F.col("most")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * df + 1))).cast("long")
    owner = sum(((df > F.lit(share * n_docs)).cast("int") for share in owners), F.lit(0))
    stats = postings.groupBy("term").agg(F.sum(F.size("pos")).alias("df"), F.max(F.array_max("impact")).alias("most"))
    queries = wanted.join(stats.select("term", weight.alias("w"), owner.alias("owner"), top), "term")
    queries = written(queries.select("item", "group", "term", "owner", (F.col("q") * F.col("w")).alias("weight"), (F.col("q") * F.col("w") * top).alias("bound")), "item-weights")
    stages = range(len(owners) + 1)
    rests = queries.groupBy("item").agg(*[F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("bound"))), F.lit(0)).alias(f"rest{s}") for s in stages])
    bundles = spark.createDataFrame([], _BUNDLE_SQL)
    for s in stages:
        own = queries.filter(F.col("owner") == s).join(rests.select("item", F.col(f"rest{s}").alias("rest")), "item")
        asked = own.groupBy("term", "group").agg(F.collect_list(F.struct("item", "weight", "rest")).alias("asked"))
        owned = postings.join(asked, "term").select("block", "group", "pos", "impact", "asked")
        met = bundles.groupBy("block", "group").cogroup(owned.groupBy("block", "group")).applyInArrow(_stage(k, s == stages[-1]), _BUNDLE_SQL)
        before, bundles = bundles, written(met, "bundles")
        discard(before)
    ids = lists.filter("term is null").select("block", "ids")
    named = bundles.join(ids, "block").select("item", F.explode(F.arrays_zip(F.transform("pos", lambda p: F.get("ids", p)).alias("doc_id"), "score")).alias("x"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = named.select("item", "x.doc_id", "x.score").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def brute_force(docs: Iterable[tuple], items: Iterable[tuple], k: int = K) -> list[tuple]:
    """The same of (id, text) pairs, one document after the other; for tests."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, n_terms, out = sum(n > 0 for n in lengths), sum(lengths), []
    df = Counter(t for _, c in held for t in c)
    for item_id, text in items:
        scores = []
        for (d, c), n in zip(held, lengths):
            m = BASE + SLOPE * n * n_docs // max(1, n_terms)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score:
                scores.append((-score, d is None, d))
        out += [(item_id, i, d, -score) for i, (score, _, d) in enumerate(heapq.nsmallest(k, scores), 1)]
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM benchmark),
total AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(t) * nn) // ll AS m FROM d, total WHERE len(t) > 0),
q AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT item, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
