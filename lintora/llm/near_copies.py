"""Near copies of the pipeline: SimHash and Golay-code keys at a wide radius.

Texts link where fingerprints of 256 bits, over their distinct shingles of five
words, agree in 0.8 or more of the bits. Fingerprints of op8's kind with keys for
three errors lose most such pairs: an edited word changes five shingles, and 64
bits then differ in 7 to 16. So

- keys come from two fingerprints of 64 bits over the distinct words, which the
  same edit moves far less;
- each is cut into the segments of op8, and every segment is decoded to the
  codewords of itself and its one-bit neighbours, about five indices. Segments
  of two texts with two errors or fewer always share one, others often;
- by pigeonhole, two of three segments make a key: texts whose words'
  fingerprints differ in five bits always meet, most at 16 bits do.

Texts with the same key meet in a join by shuffle. Those with another text within
MAX_WORD_BITS, over both fingerprints of the words, go on with their wide ones to
a second join by the same keys, which verifies them and writes a forest of each
bucket, never all pairs. Texts with the same words in the same order are one node.

A group of near copies shares some 170 buckets, and a forest of each would link its
texts as often. So a join by the six keys of a text's own codewords goes first, and
what it links has one label from then on; the buckets of all keys are still compared
whole, but a forest's edges are those between labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import TEXT_ROWS, discard, rows_of, to_batches, whole_groups, written
from lintora.llm.components import components, spread_join
from lintora.llm.simhash import MAX_BROADCAST_KEYS, SEGMENTS, codeword, hot_keys

WIDTH, SIMILARITY = 5, 0.8
WIDE, TABLES = 256, 2
#: Of 128. Half of them differ in unrelated texts, and under a quarter in linked ones.
MAX_WORD_BITS = 32
#: Rows of one key from which its bucket is dealt out, by pairs of parts.
BLOCK = 16_384
PAIRS = ((0, 1), (0, 2), (1, 2))
WORDS, WIDES = tuple(f"w{i}" for i in range(TABLES)), tuple(f"s{i}" for i in range(WIDE // 64))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


def fold(hashes: np.ndarray, n_longs: int) -> np.ndarray:
    """64 * n_longs bits; each is set if over half the hashes, mixed anew for
    each long, have it set."""
    n = len(hashes)
    salts = (np.arange(n_longs, dtype=np.uint64) + np.uint64(1)) * _STEP
    counts = np.zeros(64 * n_longs, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(_mixed(hashes[at : at + (1 << 14), None] * _STEP ^ salts).view(np.uint8).reshape(-1, 8 * n_longs), axis=1, bitorder="little")
        for first in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            counts += np.add.reduce(bits[first : first + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.int64)


class Prints:
    """Fingerprints of texts. Words are those of simhash.fingerprint."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.known) > 1 << 17:
            self.known.clear()
        return self.known.setdefault(word, xxhash.xxh64_intdigest(word, 42))

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct hashes of WIDTH successive words; fewer are one shingle."""
        width = min(WIDTH, len(hashes))
        n = max(1, len(hashes) - WIDTH + 1)
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * _STEP + hashes[k : k + n]
        return np.unique(_mixed(out))

    def of(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Node, fingerprints of the words, and the wide one; zeros without words."""
        words, known = (text or "").encode().lower().split(), self.known
        node = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).view(np.int64))
        if not words:
            return node, [0] * TABLES, [0] * len(WIDES)
        hashes = np.fromiter((known[w] if w in known else self._word(w) for w in words), np.uint64, len(words))
        return node, fold(np.unique(hashes), TABLES).tolist(), fold(self.shingles(hashes), len(WIDES)).tolist()


def _nearby(segment: np.ndarray, bits: int) -> np.ndarray:
    """Codewords of each segment and its one-bit neighbours, a row for each; -1 for repeats."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    found = np.sort(codeword(segment[:, None] ^ flips).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _cut(prints: np.ndarray) -> list[np.ndarray]:
    prints = np.ascontiguousarray(prints).view(np.uint64)
    return [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    """The nearby codewords of each segment."""
    return [_nearby(segment, n) for segment, (_, n) in zip(_cut(prints), SEGMENTS)]


def keys(prints: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of 64-bit fingerprints of the words, about 85 for each."""
    near = _segments(prints)
    at, out = [], []
    for kind, (i, j) in enumerate(PAIRS):
        row, a, b = np.nonzero((near[i] >= 0)[:, :, None] & (near[j] >= 0)[:, None, :])
        at.append(row)
        out.append(near[i][row, a] << 12 | near[j][row, b] | (table * len(PAIRS) + kind) << 24)
    return np.concatenate(at), np.concatenate(out)


def _columns(batch: pa.RecordBatch, step: int = 2048) -> Iterator[list[np.ndarray]]:
    for start in range(0, batch.num_rows, step):
        yield [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.slice(start, step).columns]


def _halves(nodes: DataFrame) -> DataFrame:
    """half and the fingerprints of the words: every node under the codewords of
    the first segments of its keys, about 21. The second ones follow from the
    fingerprints and are put in after the shuffle, by _whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prints in _columns(batch):
                for table, fp in enumerate(prints):
                    near = _segments(fp)
                    for i in (0, 1):
                        row, a = np.nonzero(near[i] >= 0)
                        half = near[i][row, a] | (2 * table + i) << 12
                        yield pa.record_batch([pa.array(half), *[pa.array(p[row]) for p in prints]], names=["half", *WORDS])

    return nodes.select(*WORDS).mapInArrow(run, ", ".join(f"{c} long" for c in ("half", *WORDS)))


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of _halves, key and the fingerprints of the words."""
    for batch in batches:
        for half, *prints in _columns(batch, 4096):
            for which in np.unique(half >> 12).tolist():
                table, i = divmod(which, 2)
                at = np.flatnonzero(half >> 12 == which)
                near = _segments(prints[table][at])
                for kind in (k for k, pair in enumerate(PAIRS) if pair[0] == i):
                    row, b = np.nonzero(near[PAIRS[kind][1]] >= 0)
                    key = (half[at] & 4095)[row] << 12 | near[PAIRS[kind][1]][row, b] | (table * len(PAIRS) + kind) << 24
                    yield pa.record_batch([pa.array(key), *[pa.array(p[at][row]) for p in prints]], names=["key", *WORDS])


def _keys_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for prints in _columns(batch):
        yield from ((0, keys(fp, table)[1]) for table, fp in enumerate(prints))


def _hot(nodes: DataFrame, block: int) -> DataFrame:
    """Keys of more than `block` rows with the number of parts they are dealt to."""
    counts = hot_keys(nodes.select(*WORDS), _keys_of, (block, block), 170 * nodes.count())
    return written(counts.select("key", F.ceil(F.col("n0") / block).cast("int").alias("parts")), "hot-keys")


def _dealt(rows: DataFrame, hot: DataFrame, n_hot: int, *by: str) -> DataFrame:
    """rows, whose key comes first, with a salt after it. Each row of a hot key
    goes to all pairs of parts that have its own, by the hash of some columns,
    so that any two rows of the key meet."""
    others = rows.columns[1:]
    if not n_hot:
        return rows.select("key", F.lit(0).cast("long").alias("salt"), *others)
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(*by), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: (F.least(own, p) * parts + F.greatest(own, p)).cast("long"))
    return rows.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot, "key", "left").select("key", F.explode(cells).alias("salt"), *others)


def _groups(part: np.ndarray, n_keys: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each group of equal keys."""
    starts = np.flatnonzero(np.r_[True, (part[1:, :n_keys] != part[:-1, :n_keys]).any(1)])
    return starts, np.diff(np.r_[starts, len(part)])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1)


def _has_near(prints: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether another row of the group is within MAX_WORD_BITS."""
    near = np.zeros(len(prints), bool)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(prints)) - 1  # rows after it in the group
    rows, most = np.arange(len(prints)), 64
    for step in range(1, most + 1):
        rows = rows[left[rows] >= step]
        if not len(rows):
            break
        close = rows[_apart(prints[rows], prints[rows + step]) <= MAX_WORD_BITS]
        near[close] = near[close + step] = True
    for a, n in zip(starts[lengths > most + 1].tolist(), lengths[lengths > most + 1].tolist()):
        group, done = prints[a : a + n], near[a : a + n]
        for i in np.flatnonzero(~done).tolist():  # most that have one have met it within 64 rows
            if not done[i]:
                close = _apart(group, group[i]) <= MAX_WORD_BITS
                close[i] = False
                if close.any():
                    done[i] = True
                    done |= close
    return near


def _active(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, salt, WORDS), those (key, WORDS), once, that are near another."""
    for part in whole_groups(batches, 2):
        near = _has_near(np.ascontiguousarray(part[:, 2:]), *_groups(part))
        if near.any():
            found = np.unique(part[near][:, [0, *range(2, part.shape[1])]], axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, i])) for i in range(found.shape[1])], names=["key", *WORDS])


MAX_WIDE_BITS = int(WIDE * (1 - SIMILARITY) + 1e-9)


def forest(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of edges that connect what pairs of rows within
    MAX_WIDE_BITS connect; no more edges than rows."""
    left, us, vs = np.arange(len(wide)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            linked = _apart(wide[left], wide[at]) <= MAX_WIDE_BITS
            if linked.any():
                us.append(left[linked])
                vs.append(np.full(linked.sum(), at))
                queue += left[linked].tolist()
                left = left[~linked]
    return (np.concatenate(us), np.concatenate(vs)) if us else (left, left)


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, salt, node or its label, wide fingerprint), verified edges of
    each bucket between different ones."""
    for part in whole_groups(batches, 2):
        starts, lengths = _groups(part)
        wide, node = np.ascontiguousarray(part[:, 3:]), part[:, 2]
        first = np.repeat(starts, lengths)
        linked = _apart(wide, wide[first]) <= MAX_WIDE_BITS
        done = np.repeat(np.logical_and.reduceat(linked, starts), lengths)  # all are linked to the first of the bucket
        u, v = [node[done]], [node[first[done]]]
        open_ = ~np.logical_and.reduceat(linked, starts)
        for a, n in zip(starts[open_].tolist(), lengths[open_].tolist()):
            i, j = forest(wide[a : a + n])
            u.append(node[a : a + n][i])
            v.append(node[a : a + n][j])
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)])[u != v], axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["u", "v"])


def _near(rows: DataFrame, columns: str) -> DataFrame:
    return rows.sortWithinPartitions("key", "salt", *WORDS).mapInArrow(_active, columns)


def _own_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, WORDS, WIDES), key, node and WIDES: the keys of the
    codewords of the segments themselves, six for each node."""
    for batch in batches:
        for node, *prints in _columns(batch):
            for table, fp in enumerate(prints[:TABLES]):
                own = [codeword(segment).astype(np.int64) for segment in _cut(fp)]
                for kind, (i, j) in enumerate(PAIRS):
                    key = own[i] << 12 | own[j] | (table * len(PAIRS) + kind) << 24
                    yield pa.record_batch([pa.array(c) for c in (key, node, *prints[TABLES:])], names=["key", "node", *WIDES])


def _first_roots(nodes: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """(node, root) of the nodes that verified links under their own keys connect.
    Each row of a hot key goes to one of its parts: what that leaves apart meets
    under all keys."""
    keyed = nodes.select("node", *WORDS, *WIDES).mapInArrow(_own_keys, ", ".join(f"{c} long" for c in ("key", "node", *WIDES)))
    salt = F.lit(0).cast("long")
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot, "key", "left")
        salt = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    rows = keyed.select("key", salt.alias("salt"), "node", *WIDES)
    return components(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_edges, "u long, v long"))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v), a written table, over the distinct nodes (node, WORDS,
    WIDES): not all pairs, but enough to connect what pairs that share a key
    connect. A node has one edge to the root of those that it meets under its own
    keys; the others are between such roots."""
    hot = _hot(nodes, block)
    n_hot = hot.count()
    first = written(_first_roots(nodes, hot, n_hot), "first-roots")
    columns = ", ".join(f"{c} long" for c in ("key", *WORDS))
    keyed = _halves(nodes).repartition("half").mapInArrow(_whole, columns)
    if n_hot:
        is_hot = F.broadcast(hot.select("key")) if n_hot <= MAX_BROADCAST_KEYS else hot.select("key")
        dealt = _dealt(keyed.join(is_hot, "key", "left_semi"), hot, n_hot, *WORDS).repartition("key", "salt")
        few = keyed.join(is_hot, "key", "left_anti")
        near = _near(few.select("key", F.lit(0).cast("long").alias("salt"), *WORDS), columns).unionByName(_near(dealt, columns)).distinct()
    else:
        near = _near(keyed.select("key", F.lit(0).cast("long").alias("salt"), *WORDS), columns)
    active = written(near, "near-rows")
    labelled = nodes.join(first, "node", "left").withColumn("label", F.coalesce("root", "node"))
    known = _dealt(active.join(labelled, [*WORDS]).select("key", "node", "label", *WIDES), hot, n_hot, "node").drop("node")
    edges = known.repartition("key", "salt").sortWithinPartitions("key", "salt", "label").mapInArrow(_edges, "u long, v long")
    stars = first.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    edges = written(edges.distinct().unionByName(stars), "near-edges")
    discard(active, hot, first)
    return edges


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id that links reach,
    the row's own included.

    Null and empty texts are one node. Rows with null ids take part and get the
    smallest other id, or null if there is none. Rows with equal ids are all
    kept. Other columns are ignored; no rows give no rows."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints()

        def rows():
            for doc_id, text in rows_of(batches):
                node, words, wide = prints.of(text)
                yield doc_id, node, *words, *wide

        yield from to_batches(rows(), pa.schema([(c, pa.int64()) for c in ("doc_id", "node", *WORDS, *WIDES)]), size=8192)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(docs.mapInArrow(name, ", ".join(f"{c} long" for c in ("doc_id", "node", *WORDS, *WIDES))), "named", arrow_rows=TEXT_ROWS)
    nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in (*WORDS, *WIDES)]), "nodes")
    edges = links(nodes, block)
    roots = components(edges)
    discard(edges)
    grouped = written(nodes.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")), "rooted")
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "root-ids")
    labels = written(spread_join(grouped.withColumnRenamed("n", "n_docs"), least, "root", "node").select("node", "component_id", F.col("n_docs").alias("n")), "labels")
    return spread_join(found.select("doc_id", "node"), labels, "node", "doc_id").select("doc_id", "component_id")
