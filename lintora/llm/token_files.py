"""Files of token ids: one zstandard frame for each document and a seek table.

A file holds, in this order:

- a frame for each document: its ids as little-endian unsigned 32-bit integers
  (empty documents have a frame too), compressed on its own;
- an index frame: the number n of documents, then n document ids, as
  little-endian signed 64-bit integers, then n bytes that are 1 where the
  document id is null;
- the public zstandard seek table: a skippable frame with compressed size,
  uncompressed size and checksum (low half of the XXH64 of what was
  compressed) of each frame, the number of frames, a descriptor byte whose high
  bit says that there are checksums, and the magic number.

Any zstandard reader decodes a file as one stream; a reader that knows the seek
table fetches and decompresses the wanted documents only.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintora.llm.common import TEXT_ROWS, rows_of, to_batches, written
from lintora.llm.tokens import word_encoder

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_INDEX = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("frame", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; close() adds index and seek table."""

    def __init__(self, uri: str, level: int):
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.doc_ids = [], []

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), _checksum(data)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        n = len(self.doc_ids)
        self._frame(struct.pack(f"<{n + 1}q", n, *(d or 0 for d in self.doc_ids)) + bytes(d is None for d in self.doc_ids))
        entries = b"".join(self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries)
        self.out.write(struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()


class FrameReader:
    """Reads single frames by the seek table and checks their checksums."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        self.file.seek(size - 9 - 12 * n)
        self.entries = list(struct.iter_unpack("<III", self.file.read(12 * n)))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)
        self.decompressor = zstandard.ZstdDecompressor()

    def decode(self, frame: int, packed: bytes) -> bytes:
        _, size, checksum = self.entries[frame]
        data = self.decompressor.decompress(packed, max_output_size=size) if size else b""
        if len(data) != size or _checksum(data) != checksum:
            raise ValueError(f"frame {frame} is damaged")
        return data

    def frame(self, frame: int) -> bytes:
        self.file.seek(self.starts[frame])
        return self.decode(frame, self.file.read(self.entries[frame][0]))

    def doc_ids(self) -> list[int | None]:
        data = self.frame(len(self.entries) - 1)
        n = struct.unpack_from("<q", data)[0]
        return [None if null else d for d, null in zip(struct.unpack_from(f"<{n}q", data, 8), data[8 + 8 * n :])]

    def documents(self, block: int = 4 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, the file read in blocks."""
        doc_ids, first = self.doc_ids(), 0
        while first < len(doc_ids):
            last = first + 1
            while last < len(doc_ids) and self.starts[last + 1] - self.starts[first] <= block:
                last += 1
            self.file.seek(self.starts[first])
            data = memoryview(self.file.read(self.starts[last] - self.starts[first]))
            for i in range(first, last):
                at = self.starts[i] - self.starts[first]
                yield doc_ids[i], self.decode(i, data[at : at + self.entries[i][0]])
            first = last


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Encodes every text, appends end_id, and writes the ids to files below
    `uri`, one file for each partition of ascending document ids.

    Returns the index, a written table: path, doc_id, frame, n_tokens. Only it
    tells which files count: a task that is run again writes another file, and
    what a lost task leaves is never read. Null and empty texts have the end id
    alone. Null document ids come first; rows with equal ids are all kept, in
    the order of their texts. Other columns are ignored. No rows: no files."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer = word_encoder(tokenizer), struct.pack("<I", end_id), None

        def rows():
            nonlocal writer
            for frame, (doc_id, text) in enumerate(rows_of(batches)):
                if writer is None:
                    path = f"{uri}/{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(path, level)
                ids = encoder.encode(text) + end
                writer.add(doc_id, ids)
                yield path, doc_id, frame, len(ids) // 4

        yield from to_batches(rows(), _INDEX, size=8192)
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "path string, doc_id long, frame long, n_tokens long"), "token-index", arrow_rows=TEXT_ROWS)


def file_starts(index: DataFrame) -> DataFrame:
    """One row for each file: path, start (ids in all files before it), n_docs."""
    files = index.groupBy("path").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"), F.count("*").alias("n_docs"))
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n_docs")


def read_token_files(files: DataFrame) -> DataFrame:
    """All documents of the files given by file_starts(): doc_id, start, ids."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, start in rows_of(batches):
                for doc_id, ids in FrameReader(path).documents():
                    yield doc_id, start, ids
                    start += len(ids) // 4

        yield from to_batches(rows(), _READ)

    paths = files.select("path", "start")
    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def read_documents(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the documents whose doc_id is in `wanted` (a column doc_id): only
    their frames are fetched and decompressed, those of a file by one task, which
    reads its seek table once. Unknown ids give no row."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            path, reader = None, None
            for here, frame, doc_id in rows_of(batches):
                if here != path:
                    path, reader = here, FrameReader(here)
                yield doc_id, reader.frame(frame)

        yield from to_batches(rows(), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    frames = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("path", "frame", "doc_id")
    return frames.repartition("path").sortWithinPartitions("path", "frame").mapInArrow(read, "doc_id long, ids binary")


def token_digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_token_files() gives."""
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
