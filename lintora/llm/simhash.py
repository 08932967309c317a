"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. The perfect
binary Golay code puts every word of 23 bits within distance 3 of exactly one
codeword, so a segment has a nearest codeword, and a segment with one more error
has one of the about five codewords nearest to its one-bit neighbours. Of three
errors in three segments (pigeonhole),

- either some segment has none and another at most one: six kinds of keys, an
  exact segment with a codeword index of another;
- or each has exactly one: a seventh kind, codeword indices of two segments with
  the parities of all three, which one error flips.

Every fingerprint is indexed under 7 keys and looked up under about 60. Rows
with the same key meet in a join by shuffle, where the distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import TEXT_ROWS, rows_of, to_batches, written
from lintora.llm.components import components, spread_join

MAX_DISTANCE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0b110001110101
#: Rows of one key that are compared in one task; a key with more is dealt out.
BLOCK = 4096
#: Most keys with more rows than that which are broadcast; more are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000
#: Rows of the index that are compared with a block of probes at a time.
STRIPE = 1024
#: Most slots of keys that are told to every executor when their keys are counted.
MAX_SLOTS = 1_000_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits; each is set if over half the hashed shingles have it set."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)], ends[at + width - 1 : at + width - 1 + (1 << 16)].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, f - (1 << 64) if (f := fingerprint(t)) >> 63 else f) for d, t in rows_of(batches))
        yield from to_batches(rows, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]), size=8192)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _remainders() -> np.ndarray:
    """Of every 12 high bits, what division by the polynomial leaves."""
    out = np.zeros(1 << 12, np.uint32)
    for high in range(1 << 12):
        x = high << 11
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        out[high] = x
    return out


_REMAINDERS = _remainders()


def _errors() -> np.ndarray:
    """The error of weight 3 or less for each of the 2,048 remainders."""
    from itertools import combinations

    out = np.zeros(1 << 11, np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            x = sum(1 << b for b in bits)
            out[_REMAINDERS[x >> 11] ^ (x & 0x7FF)] = x
    return out


_ERRORS = _errors()


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word of 23 bits."""
    return (words ^ _ERRORS[_REMAINDERS[words >> 11] ^ (words & 0x7FF)]) >> 11


def _nearby(segment: np.ndarray, bits: int) -> np.ndarray:
    """Codewords of each segment's one-bit neighbours, a row for each; -1 for repeats."""
    flips = np.array([1 << b for b in range(bits)], np.uint32)
    found = np.sort(codeword(segment[:, None] ^ flips).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(fps: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) under which fingerprints are indexed or looked up."""
    fps = fps.view(np.uint64)
    cut = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    own = [codeword(s).astype(np.int64) for s in cut]
    odd = [(np.bitwise_count(s) & 1).astype(np.int64) for s in cut]
    parity, rows = odd[0] | odd[1] << 1 | odd[2] << 2, np.arange(len(fps))
    at, out = [], []

    def add(kind: int, position: np.ndarray, key: np.ndarray) -> None:
        at.append(position)
        out.append(key | np.int64(kind) << 56)

    near = [_nearby(s, n) for s, (_, n) in zip(cut, SEGMENTS)] if probes else None
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        exact = cut[i].astype(np.int64) << 12
        add(kind, rows, exact | own[j])
        if probes:
            r, c = np.nonzero((near[j] >= 0) & (near[j] != own[j][:, None]))
            add(kind, r, exact[r] | near[j][r, c])
    if probes:
        r, c, d = np.nonzero((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :])
        add(6, r, near[0][r, c] << 15 | near[1][r, d] << 3 | (parity[r] ^ 7))
    else:
        add(6, rows, own[0] << 15 | own[1] << 3 | parity)
    return np.concatenate(at), np.concatenate(out)


def _forest(index: np.ndarray, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what pairs of index and probes at a distance of
    MAX_DISTANCE or less connect; no more edges than rows in two blocks, which
    also bound the memory."""
    whole = np.unique(index)
    for at in range(0, len(probes), BLOCK):
        block = np.unique(probes[at : at + BLOCK])
        for first in range(0, len(whole), STRIPE):
            index = whole[first : first + STRIPE]
            linked = np.bitwise_count((index[:, None] ^ block).view(np.uint64)) <= MAX_DISTANCE
            linked_rows = linked.any(1)
            if not linked_rows.any():
                continue
            label = np.where(linked_rows, np.arange(len(index)), len(index))
            while True:
                low = np.where(linked, label[:, None], len(index)).min(0)
                new = np.minimum(label, np.where(linked, low, len(index)).min(1))
                if (new == label).all():
                    break
                label = new
            for nodes, roots in ((index[linked_rows], index[label[linked_rows]]), (block[linked.any(0)], index[low[linked.any(0)]])):
                keep = nodes != roots
                yield nodes[keep], roots[keep]


def _bucket_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, salt, role, fp) sorted in that order, edges of each bucket."""

    def edges(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(part):
            return
        starts = np.flatnonzero(np.r_[True, (part[1:, :2] != part[:-1, :2]).any(1)])
        stops = np.r_[starts[1:], len(part)]
        worth = np.minimum.reduceat(part[:, 3], starts) != np.maximum.reduceat(part[:, 3], starts)
        worth &= (part[starts, 2] == 0) & (part[stops - 1, 2] == 1)
        for a, b in zip(starts[worth].tolist(), stops[worth].tolist()):
            cut = a + int(np.searchsorted(part[a:b, 2], 1))
            for u, v in _forest(part[a:cut, 3], part[cut:b, 3]):
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    held = np.empty((0, 4), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])])
        last = len(held) - int(np.argmax((held[::-1, :2] != held[-1, :2]).any(1))) if (held[:, :2] != held[-1, :2]).any() else 0
        yield from edges(held[:last])
        held = held[last:]
        if len(held) > 8 * BLOCK and held[0, 2] == 0 and held[-1, 2] == 1:  # a long bucket: its index rows stay
            yield from edges(held)
            held = held[held[:, 2] == 0]
    yield from edges(held)


def _keyed(fps: DataFrame, roles: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(start, 4096).to_numpy().astype(np.int64)
                for role in roles:
                    at, key = keys(values, bool(role))
                    yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), role, np.int8)), pa.array(values[at])], names=["key", "role", "fp"])

    return fps.mapInArrow(run, "key long, role byte, fp long")


def _slot(keys: np.ndarray, n_slots: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(n_slots)


def hot_keys(rows: DataFrame, keys_of, most: tuple[int, int], n_keys: int) -> DataFrame:
    """key, n0, n1: exact numbers of rows by role of the keys that have more than
    most[role] in a role; keys_of gives (role, keys) of an Arrow batch of rows.

    Keys are first counted by slots, of which there are enough for n_keys rows to
    fill each to a quarter of the bound (four million at most). A slot within the
    bounds holds no such key; of the others the keys are counted one by one. So
    none is missed, however thinly its rows are spread over the tasks."""
    n_slots = 1 << min(22, max(12, (4 * n_keys // most[0]).bit_length()))

    def by_slot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, n_slots), np.int64)
        for batch in batches:
            for role, found in keys_of(batch):
                slots, n = np.unique(_slot(found, n_slots), return_counts=True)
                held[role, slots.astype(np.int64)] += n
        some = np.flatnonzero(held.any(0))
        for at in range(0, len(some), 65_536):
            part = some[at : at + 65_536]
            yield pa.record_batch([pa.array(part), *[pa.array(held[r, part]) for r in (0, 1)]], names=["slot", "n0", "n1"])

    sums = [F.sum(f"n{r}").alias(f"n{r}") for r in (0, 1)]
    over = (F.col("n0") > most[0]) | (F.col("n1") > most[1])
    slots = written(rows.mapInArrow(by_slot, "slot long, n0 long, n1 long").groupBy("slot").agg(*sums).filter(over).select("slot"), "hot-slots")
    told = np.sort(slots.toArrow()["slot"].to_numpy()) if slots.count() <= MAX_SLOTS else None
    known = rows.sparkSession.sparkContext.broadcast(told)

    def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = known.value
        for batch in batches:
            for role, found in keys_of(batch):
                keys, n = np.unique(found if told is None else found[np.isin(_slot(found, n_slots).astype(np.int64), told)], return_counts=True)
                if len(keys):
                    counts = (n, np.zeros(len(n), np.int64))
                    yield pa.record_batch([pa.array(keys), pa.array(counts[role]), pa.array(counts[1 - role])], names=["key", "n0", "n1"])

    if told is not None and not len(told):
        return rows.sparkSession.createDataFrame([], "key long, n0 long, n1 long")
    return rows.mapInArrow(by_key, "key long, n0 long, n1 long").groupBy("key").agg(*sums).filter(over)


def _keys_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, batch.num_rows, 4096):
        values = batch.column(0).slice(start, 4096).to_numpy().astype(np.int64)
        yield from ((role, keys(values, bool(role))[1]) for role in (0, 1))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over the distinct values of fps.fp, not all pairs but
    enough to connect what pairs at MAX_DISTANCE or less connect. A bucket of
    more than `block` index rows, or 16 times as many probes, is dealt out: each
    part of its index rows meets each part of its probes."""
    counts = hot_keys(fps, _keys_of, (block, 16 * block), 7 * fps.count())
    parts = [F.ceil(F.greatest(F.col(f"n{r}"), F.lit(1)) / F.lit(block * (16 if r else 1))).cast("int").alias(f"parts{r}") for r in (0, 1)]
    hot = written(counts.select("key", *parts), "hot-keys")
    rows, n_hot = _keyed(fps, (0, 1)), hot.count()
    if n_hot:
        parts = [F.coalesce(f"parts{r}", F.lit(1)) for r in (0, 1)]
        own = [F.pmod(F.xxhash64("fp"), p).cast("int") for p in parts]
        index = F.transform(F.sequence(F.lit(0), parts[1] - 1), lambda p: own[0] * parts[1] + p)
        probe = F.transform(F.sequence(F.lit(0), parts[0] - 1), lambda i: i * parts[1] + own[1])
        dealt = F.when(F.col("role") == 0, index).otherwise(probe)
        rows = rows.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot, "key", "left").select("key", F.explode(dealt).alias("salt"), "role", "fp")
    else:
        rows = rows.select("key", F.lit(0).alias("salt"), "role", "fp")
    met = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    return met.mapInArrow(_bucket_edges, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Fingerprints link at MAX_DISTANCE or fewer differing bits; component_id is
    the smallest doc_id that links reach, the row's own included. Equal
    fingerprints are one node, so copies never meet in pairs.

    Null and empty texts have fingerprint zero, linked like any other. Rows with
    null ids take part and get the smallest other id, or null if there is none.
    Rows with equal ids are all kept. Other columns are ignored; no rows give
    no rows."""
    found = written(fingerprints(docs, id_col, text_col), "fingerprints", arrow_rows=TEXT_ROWS)
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    grouped = written(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "root-ids")
    labels = written(spread_join(grouped.withColumnRenamed("n", "n_docs"), least, "root", "fp").select("fp", "component_id", F.col("n_docs").alias("n")), "labels")
    return spread_join(found, labels, "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
