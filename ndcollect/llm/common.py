"""What the operators share: durable intermediate tables and vectorised access to text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only where all of Spark runs in
    one process may it be unset: there, a folder of our own will do, which goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="ndcollect-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return "file://" + _own_root[0]


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/ndcollect/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions planned inside delete their shuffle files as soon as they end: their result is a written table,
    so nothing reads those files again. The session's own setting is back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is written inside, but for the tables that are put on the list that it gives."""
    before, keep = len(_written), []
    yield keep
    kept = {t.written_to for t in keep}
    for path in _written[before:]:
        if path not in kept:
            _delete(spark, path)
    del _written[before:]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fewer(df: DataFrame) -> DataFrame:
    """The rows in fewer partitions (four a core, or an eighth of the shuffle partitions where those are more),
    without a shuffle: for rows that are small or streamed through, where a task a shuffle partition would cost
    more in starting than in work. Groups stay together and sorted."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def modest_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts are long rows: unless the session says otherwise, few of them go to a Python worker at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def unused(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, with underscores added where a column has them already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (in UTF-8) or binaries, end to end, and the n + 1 offsets into them. Null is empty."""
    binary = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    array = array.cast(pa.large_binary() if binary else pa.large_string())
    if array.null_count:
        array = array.fill_null(b"" if binary else "")
    n = len(array)
    _, offsets, data = array.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def tidy() -> None:
    """Give memory that a finished task has freed back to the system: workers are kept for other steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices whose ``column`` holds about ``limit`` bytes; a row that is larger comes alone."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    tidy()


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring small batches as one, up to about ``limit`` bytes of ``column``."""
    held, size = [], 0
    for batch in by_bytes(batches, column, limit):
        held.append(batch)
        size += int(text_bytes(batch.column(column))[1][-1])
        if size >= limit:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
