"""Quartile bucket digests of texts and a bounded difference score.

Six triplets of each five successive bytes are hashed into 256 counters. The
digest writes, in hexadecimal: a byte for the length (its logarithm in steps of
an eighth), a byte of checksum, and two bits for each counter: the quartile of
the 256 counts in which it lies. Texts of like content and any length have like
digests; equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintora.llm.common import rows_of, to_batches, written

BUCKETS = 256
#: Places of a triplet's bytes among five.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_MULTIPLIER = np.uint32(0x9E3779B1)
_PLACES = np.array([1, 4, 16, 64], np.uint8)
#: Cost of two quartile codes: opposite quartiles count six, as in published digests of this kind.
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.uint8)
#: Mean cost of unrelated, evenly spread codes; the score is cut there.
BOUND = int(BUCKETS * _COST.mean())
_LENGTH_STEP, _LENGTH_MOST = 4, 16


def codes(data: bytes) -> np.ndarray:
    """Length code, checksum and the 256 quartile codes."""
    out = np.zeros(BUCKETS + 2, np.uint8)
    out[0] = min(255, int(8 * math.log(len(data) + 1)))
    out[1] = zlib.crc32(data) & 0xFF
    if not data:
        return out
    b = np.frombuffer(data.ljust(5, b"\0"), np.uint8).astype(np.uint32)
    n = len(b) - 4
    first, counts = b[:n], np.zeros(BUCKETS, np.int64)
    for salt, (_, j, k) in enumerate(TRIPLETS):
        x = first | (b[j : n + j] << np.uint32(8))
        x |= b[k : n + k] << np.uint32(16)
        x += np.uint32((salt + 1) << 24)
        x *= _MULTIPLIER
        x >>= np.uint32(24)
        counts += np.bincount(x, minlength=BUCKETS)
    ordered = np.sort(counts)
    out[2:] = (counts[:, None] > ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]).sum(1)
    return out


def to_text(code: np.ndarray) -> str:
    return code[:2].tobytes().hex() + (code[2:].reshape(-1, 4) * _PLACES).sum(1, dtype=np.uint8).tobytes().hex()


def from_text(digest: str) -> np.ndarray:
    data = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.concatenate([data[:2], ((data[2:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)])


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests, BOUND at most."""
    score = int(_COST[a[2:], b[2:]].sum()) + _LENGTH_STEP * min(_LENGTH_MOST, abs(int(a[0]) - int(b[0]))) + int(a[1] != b[1])
    return min(score, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT = pa.schema(_FIELDS)
_PARTIAL = pa.schema([*_FIELDS, ("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    data = changed.encode()
    new = own if changed == text else codes(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), to_text(own), to_text(new), likeness(own, new), likeness(own, other)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every text alone: doc_id, fingerprint. Null texts count as
    empty; every row gives one row; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(((d, to_text(codes((t or "").encode()))) for d, t in rows_of(batches)), pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text and of its edited text (see edited()), compared with
    each other and with the next document's, in descending order of ids; after
    the last document comes the first. Columns: see the fields above.

    Rows are dealt out by ranges of ids. Each task compares its own neighbours;
    the first and the last text of each task (two for each partition, however
    many documents) are matched in a second, small step.

    Null texts are empty. Null ids come last; rows with equal ids follow each
    other in the order of their texts, and all are kept. A single row is its
    own next. Other columns are ignored. No rows give no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            part = TaskContext.get().partitionId()
            before, first = None, None
            for doc_id, text in rows_of(batches):
                text = text or ""
                own = codes(text.encode())
                if before is None:
                    first = text
                else:
                    yield (*_compared(*before, text, own), None, None, None)
                before = doc_id, text, own
            if before is not None:
                yield (before[0], *[None] * 6, part, first, before[1])

        yield from to_batches(rows(), _PARTIAL)

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((d, t, codes(t.encode()), u, codes(u.encode())) for d, t, u in rows_of(batches, 1))
        yield from to_batches((_compared(*p) for p in pairs), _RESULT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order, "text")
    found = written(ranged.mapInArrow(run, f"{_DDL}, part long, first_text string, last_text string"), "digests")
    ends = found.filter(F.col("part").isNotNull())
    parts = ends.select("part")  # numbers alone: one for each partition
    by_part, everything = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(everything)).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    closed = ends.select("part", "doc_id", "last_text").join(after, "part").join(firsts, "next_part").select("doc_id", "last_text", "next_text")
    return found.filter(F.col("part").isNull()).select(*_RESULT.names).unionByName(closed.mapInArrow(close, _DDL))
