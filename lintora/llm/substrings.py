"""Repeated word sequences across and within documents, by a variation of De
Bruijn compaction: paths are cut at minimizers, not where nodes branch, so that no
node is ever written with its degree.

Edges of the graph are the k-mers, windows of k consecutive words. A document
is a walk over them. Every window has a minimizer, the run of `anchor` words in
it with the smallest hash; consecutive windows with the same minimizer form a
super-k-mer, a stretch of the walk that does not branch inside the document.

- Equal super-k-mers of several documents are one path of the compacted graph:
  a grouped join finds, for all but those of the smallest document, that every
  window occurs earlier, and where.
- Where the graph branches, a minimizer has different super-k-mers. Of each of
  these the one in its smallest document is opened into k-mers, and these are
  joined.
- Windows that repeat inside a document are found where it is read.

What is found has source coordinates (document, first word). Pieces that follow
each other in the document and in the source are joined to long spans. Each
stretch of a source that any span names is read there once, and its words are
compared, as digests of 128 bits, with those of the spans: what differs, because
hashes of 64 bits met by chance, is no repeat. Covered words are then removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import discard, rows_of, small, to_batches, written

K, ANCHOR = 20, 6
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = (1 << 63) - 1


#: Which bytes are white space (that of bytes.split), and a random number for each byte.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], np.uint64)
#: Bytes of a text whose words are hashed at a time; longer words go to the library.
STRIDE = 1 << 16
#: Bits of an anchor's place in a text, below those of its hash by which minimizers are chosen.
_PLACE = np.uint64(24)


@lru_cache(maxsize=16)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data.split() start and end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of its letters' numbers by powers of the base."""
    raw, out, at = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
    powers, inverse = _powers(STRIDE)
    while at < len(starts):
        base = starts[at]
        upto = int(np.searchsorted(ends, base + STRIDE - 1, "right")) if ends[-1] - base >= STRIDE else len(starts)
        if upto == at:
            out[at] = xxhash.xxh64_intdigest(data[base : ends[at]], 42)
            at += 1
            continue
        sums = np.zeros(ends[upto - 1] - base + 1, np.uint64)
        np.cumsum(_LETTERS[raw[base : ends[upto - 1]]] * powers[: len(sums) - 1], out=sums[1:])
        first = starts[at:upto] - base
        out[at:upto] = _mixed((sums[ends[at:upto] - base] - sums[first]) * inverse[first])
        at = upto
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, done = len(x), 1
    out = x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: size - width + 1], out[width - done :]) if done < width else out


class Walk:
    """The windows of one document."""

    def __init__(self, text: str | None, k: int = K, anchor: int = ANCHOR):
        self.data = (text or "").encode()
        starts, ends = _word_places(self.data)
        self.size = size = len(starts)
        self.k, self.anchor, self.n = k, anchor, max(0, size - k + 1)
        if self.n:
            self.powers, self.inverse = _powers(1 << max(10, size.bit_length()))
            self.sums = np.zeros(size + 1, np.uint64)
            np.cumsum(word_hashes(self.data, starts, ends) * self.powers[:size], out=self.sums[1:])

    @classmethod
    def of_words(cls, text: str | None, k: int) -> Walk:
        """The words alone, without hashes."""
        out = cls.__new__(cls)
        out.data, out.k = (text or "").encode(), k
        return out

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    def stretch(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words from first up to last."""
        return _mixed((self.sums[last] - self.sums[first]) * self.inverse[first])

    def _runs(self, length: int) -> np.ndarray:
        """Hashes of all runs of so many words."""
        n = self.size - length + 1
        return _mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def kmers(self) -> np.ndarray:
        return self._runs(self.k)

    def super_kmers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, path, first window, number of windows) of each."""
        anchors, width = self._runs(self.anchor), self.k - self.anchor + 1
        if len(anchors) < 1 << int(_PLACE):  # the leftmost of the smallest, by all but the last bits
            least = _sliding_min(anchors >> _PLACE << _PLACE | np.arange(len(anchors), dtype=np.uint64), width)
            place = (least & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        else:
            place = np.lib.stride_tricks.sliding_window_view(anchors >> _PLACE, width).argmin(1) + np.arange(self.n)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, self.n])
        shape = (place[first] - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)
        path = _mixed(self.stretch(first, first + count + self.k - 1) + _mixed(shape * np.uint64(_BASE)))
        return anchors[place[first]], path, first, count

    def own_repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, first window of the source) of the
        stretches whose windows all start before in this document, the source
        being the nearest such place: what repeats over and over is one stretch."""
        kmers = self.kmers()
        held = np.sort(kmers)
        if not (held[1:] == held[:-1]).any():
            none = np.zeros(0, np.int64)
            return none, none, none
        order = np.argsort(kmers, kind="stable")
        same = kmers[order[1:]] == kmers[order[:-1]]
        before = np.full(self.n, -1)
        before[order[1:][same]] = order[:-1][same]
        again = np.flatnonzero(before >= 0)
        source = before[again]
        starts = np.flatnonzero(np.r_[True, (np.diff(again) != 1) | (np.diff(source) != 1)]) if len(again) else again
        return again[starts], np.diff(np.r_[starts, len(again)]), source[starts]

    def digest(self, first: int, count: int) -> bytes:
        """Of the words that `count` windows from `first` cover."""
        return hashlib.blake2b(b" ".join(self.words[first : first + count + self.k - 1]), digest_size=16).digest()


#: source is -1 for super-k-mers; for what repeats in the document, where it starts before.
_PATHS = pa.schema([("d", pa.int64()), ("text_hash", pa.int64()), ("minimizer", pa.int64()), ("path", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("source", pa.int32())])
_KMERS = pa.schema([("d", pa.int64()), ("text_hash", pa.int64()), ("minimizer", pa.int64()), ("kmer", pa.int64()), ("first", pa.int32())])


def _flat(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One batch of (d, text_hash, arrays...) of several documents."""
    lengths = [len(p[2]) for p in parts]
    columns = [np.repeat(np.array([p[i] for p in parts], np.int64), lengths) for i in (0, 1)]
    columns += [np.concatenate([p[i] for p in parts]) for i in range(2, len(schema))]
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(parts: Iterator[tuple], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for part in parts:
        if len(part[2]):
            held.append(part)
            total += len(part[2])
        if total >= rows:
            yield _flat(held, schema)
            held, total = [], 0
    if held:
        yield _flat(held, schema)


def repeated_windows(texts: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """d, text_hash, first, count, and source d, text_hash and first: stretches
    of windows whose words occur in a text of a smaller d, or before in their
    own. texts: d, text_hash, text."""

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for d, h, text in rows_of(batches):
                walk = Walk(text, k, anchor)
                if walk.n:
                    minimizer, path, first, count = walk.super_kmers()
                    yield d, h, minimizer, path, first, count, np.full(len(first), -1)
                    first, count, source = walk.own_repeats()
                    none = np.zeros(len(first), np.uint64)
                    yield d, h, none, none, first, count, source

        yield from _batched(parts(), _PATHS)

    def kmers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for d, h, text, opened in rows_of(batches):
                walk = Walk(text, k, anchor)
                if not walk.n:
                    continue
                minimizer, path, first, count = walk.super_kmers()
                keep = np.isin(path.view(np.int64), np.array(opened, np.int64))
                at = np.repeat(first[keep] - np.r_[0, np.cumsum(count[keep])[:-1]], count[keep]) + np.arange(count[keep].sum()) if keep.any() else first[:0]
                yield d, h, np.repeat(minimizer[keep], count[keep]), walk.stretch(at, at + k), at

        yield from _batched(parts(), _KMERS)

    walks = written(texts.mapInArrow(paths, "d long, text_hash long, minimizer long, path long, first int, count int, source int"), "super-kmers")
    edges, own = walks.filter("source < 0").drop("source"), walks.filter("source >= 0")
    place = F.min(F.struct("d", "text_hash", "first")).alias("least")
    columns = ["d", "text_hash", "first", "count", F.col("least.d").alias("source_d"), F.col("least.text_hash").alias("source_hash"), F.col("least.first").alias("source_first")]
    key = ["minimizer", "path"]
    shared = written(edges.groupBy(key).agg(place, F.max("d").alias("most")).filter("least.d < most").select(*key, "least"), "shared-paths")
    whole = edges.join(shared, key).filter("d > least.d").select(*columns)

    branching = edges.groupBy("minimizer").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.min("d").alias("least"), F.max("d").alias("most"))
    branching = written(branching.filter("a <> b and least < most").select("minimizer"), "branching")
    opened = edges.join(branching, "minimizer", "left_semi").groupBy(key).agg(F.min(F.struct("d", "text_hash")).alias("x")).select("x.*", "path")
    # of texts that share an id none is the smaller one: all their paths are opened
    ids = written(edges.groupBy("d").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b").select("d"), "repeated-ids")
    if not ids.isEmpty():
        more = edges.join(small(ids), "d", "left_semi").join(branching, "minimizer", "left_semi").select("d", "text_hash", "path")
        opened = opened.unionByName(more)
    by_text = written(opened.groupBy("d", "text_hash").agg(F.collect_set("path").alias("opened")), "opened-paths")
    single = written(texts.join(by_text, ["d", "text_hash"]).select("d", "text_hash", "text", "opened").mapInArrow(kmers, "d long, text_hash long, minimizer long, kmer long, first int"), "kmers")
    key = ["minimizer", "kmer"]
    met = single.groupBy(key).agg(place, F.max("d").alias("most")).filter("least.d < most").select(*key, "least")
    parts = single.join(met, key).filter("d > least.d").withColumn("count", F.lit(1)).select(*columns)
    inside = own.select("d", "text_hash", "first", "count", F.col("d").alias("source_d"), F.col("text_hash").alias("source_hash"), F.col("source").alias("source_first"))
    return whole.unionByName(parts).unionByName(inside)


_SPAN = "d long, text_hash long, first int, count int, source_d long, source_hash long, source_first int"


def long_spans(found: DataFrame) -> DataFrame:
    """The stretches of repeated_windows(), those that follow each other in the
    document and in the source joined to one; each once, however many copies of
    a document there are."""
    by_text = found.groupBy("d", "text_hash").agg(F.collect_set(F.struct("source_d", "source_hash", "source_first", "first", "count")).alias("found"))
    schema = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.int32()) for x in _SPAN.split(", ")])

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(2).flatten()
        source_d, source_hash, source_first, first, count = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten())
        row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
        places = np.column_stack([row, source_d, source_hash, source_first - first, first])
        order = np.lexsort(places.T[::-1])
        places, end = places[order], (first + count)[order]
        other = np.r_[True, (places[1:, :4] != places[:-1, :4]).any(1)]
        line = np.cumsum(other) << 32  # a text's place is an int
        reach = np.maximum.accumulate(line + end)
        starts = np.flatnonzero(other | np.r_[True, places[1:, 4] > (reach - line)[:-1]])
        row, source_d, source_hash, shift, first = places[starts].T
        last = np.r_[starts[1:], len(places)] - 1
        d, text_hash = (batch.column(i).to_numpy()[row] for i in (0, 1))
        columns = (d, text_hash, first, (reach - line)[last] - first, source_d, source_hash, shift + first)
        return pa.record_batch([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield joined(batch.slice(at, 256))

    return by_text.mapInArrow(run, _SPAN)


def source_digests(texts: DataFrame, spans: DataFrame, k: int = K) -> DataFrame:
    """source_d, source_hash, source_first, count, digest: the words of every
    stretch that spans name, read once at its place in the source."""
    named = spans.select("source_d", "source_hash", "source_first", "count").distinct()
    asked = named.groupBy("source_d", "source_hash", (F.col("source_first") / 256).cast("int").alias("block")).agg(F.collect_list(F.struct("source_first", "count")).alias("asked"))
    asked = written(asked.select(F.col("source_d").alias("d"), F.col("source_hash").alias("text_hash"), "asked"), "asked-stretches")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_d", pa.int64()), ("source_hash", pa.int64()), ("source_first", pa.int32()), ("count", pa.int32()), ("digest", pa.binary())])

        def rows():
            held, words = None, None
            for d, h, text, stretches in rows_of(batches, 64):
                if (d, h) != held:
                    held, words = (d, h), Walk.of_words(text, k)
                for x in stretches:
                    yield d, h, x["source_first"], x["count"], words.digest(x["source_first"], x["count"])

        yield from to_batches(rows(), schema, size=8192)

    read = texts.join(small(asked), ["d", "text_hash"]).select("d", "text_hash", "text", "asked")
    return read.mapInArrow(run, "source_d long, source_hash long, source_first int, count int, digest binary").dropDuplicates(["source_d", "source_hash", "source_first", "count"])


def without_spans(texts: DataFrame, spans: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept of texts (d, text_hash, doc_id, text)
    without the words of the spans that are those of their source."""
    digests = written(source_digests(texts.select("d", "text_hash", "text"), spans, k), "source-digests")
    known = spans.join(digests, ["source_d", "source_hash", "source_first", "count"])
    known = written(known.groupBy("d", "text_hash").agg(F.collect_set(F.struct("first", "count", "digest")).alias("spans")), "repeated-spans")
    discard(digests)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, repeats in rows_of(batches):
                walk = Walk.of_words(text, k)
                words = walk.words
                if repeats:
                    change = np.zeros(len(words) + 1, np.int64)
                    for x in repeats:
                        if walk.digest(x["first"], x["count"]) == x["digest"]:
                            change[x["first"]] += 1
                            change[x["first"] + x["count"] + k - 1] -= 1
                    kept = np.cumsum(change)[:-1] == 0
                    words = [w for w, keep in zip(words, kept.tolist()) if keep]
                yield doc_id, len(walk.words), len(walk.words) - len(words), b" ".join(words).decode()

        yield from to_batches(rows(), pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]), size=512)

    marked = texts.join(known, ["d", "text_hash"], "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words that are
    covered by a window of k words that also starts earlier, in a document of a
    smaller id or before in the same one. Words are what stands between ASCII
    white space; kept words are joined by one space.

    Null and empty texts have no words. Null ids are larger than all others.
    Rows with the same id, or with null ids, are not earlier than each other;
    all are kept, and equal texts among them are looked at once. Other columns are ignored; no rows give no rows."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(text_col).alias("text_hash"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = texts.select("d", "text_hash", "text")
    spans = written(long_spans(repeated_windows(plain, k, anchor)), "long-spans")
    return without_spans(texts, spans, k)
