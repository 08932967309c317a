"""What the operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

_CLEANUP, _ARROW_ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts of a batch that goes to Python: Spark's own number, 10,000, may be 100 MB on either side.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only
    where that is unset and all runs in one local process (tests) a folder of
    this machine is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set on {master}")
        base = "file://" + tempfile.mkdtemp(prefix="lintora-")
    if "://" not in base and not base.startswith("file:"):
        store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = ("file://" if store.startswith("file:") else store.rstrip("/")) + base
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/lintora/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", arrow_rows: int | None = None) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder. It cuts the
    lineage, survives lost executors, and fixes values such as row numbers
    that another computation may give differently. The shuffle files of the
    write are removed when it is over. arrow_rows: most rows of the batches that
    go to Python meanwhile, where rows are whole texts."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    wanted = {_CLEANUP: "true"} | ({_ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of written() tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: A table is broadcast if it has no more rows, and no more bytes, than these.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows, and its bytes (strings and
    binaries by their lengths, 16 for each element of an array, all else as 8),
    are within the bounds."""

    def size(f: StructField):
        name, kind = f"`{f.name}`", f.dataType.simpleString()
        length = F.octet_length(name) if kind in ("string", "binary") else F.size(name) * 16 if kind.startswith("array") else F.lit(8)
        return F.coalesce(length, F.lit(0))

    sizes = [size(f) for f in df.schema.fields]
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(sizes, F.lit(0)).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= (MAX_BROADCAST_ROWS if max_rows is None else max_rows) and row["bytes"] <= MAX_BROADCAST_BYTES else df


def whole_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[np.ndarray]:
    """Rows of long columns, sorted by the first n_keys, as arrays in which no
    group of equal keys is cut."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        other = (part[:, :n_keys] != part[-1, :n_keys]).any(1)
        cut = len(part) - int(np.argmax(other[::-1])) if other.any() else 0
        if cut:
            yield np.concatenate([*held, part[:cut]])
            held = [part[cut:]]
        elif held and (held[-1][-1, :n_keys] == part[-1, :n_keys]).all():
            held.append(part)
        else:
            if held:
                yield np.concatenate(held)
            held = [part]
    if held:
        yield np.concatenate(held)


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows as tuples; only `step` of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns))


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1024, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the tuples, cut by rows and by bytes of text."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or total >= max_bytes:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
