"""Building collections: datasets and slabs one by one from the driver, or whole tables from DataFrames."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .errors import ArrayAlreadyExists, ArrayNotFound, DatasetAlreadyExists, InvalidValue, UnsupportedType, WriterFinished
from .model import DTYPES, STORAGE, attr_row, check_fill, check_name, infer_attr, parse_dtype, typed_attr
from .operators import catalogue, hyperslab, statistics
from .reader import FORMAT, VERSION, Collection
from .sources import location

#: Codec names and what Parquet calls them.
CODECS = {"zstd": "zstd", "lz4": "lz4_raw", "none": "uncompressed"}


def save(collection: Collection, destination: Any, codec: str = "zstd", block_bytes: int = 8 << 20) -> Collection:
    """Write a collection's tables; it becomes visible with its manifest, which is written last.

    Every version has a folder of its own under ``data``. The manifest names it, so one step leads from the old
    version to the new, and only then the old one goes: a collection may be saved over itself, and a failure midway
    leaves the old version as it was. A new version has no deletion mask.
    """
    if codec not in CODECS:
        raise InvalidValue(f"unknown codec {codec!r}; expected one of {', '.join(CODECS)}")
    if block_bytes <= 0:
        raise InvalidValue("the block size must be positive")
    spark, path = collection.spark, location.resolve(destination).rstrip("/")
    version, before = uuid.uuid4().hex, _version_of(spark, path)
    root = f"{path}/data/{version}"
    try:
        _write_tables(collection, root, codec, block_bytes)
        names = spark.read.schema(tables.DATASETS).parquet(f"{root}/datasets")
        twice = catalogue.repeated(names, "name").first()
        if twice is not None:
            raise DatasetAlreadyExists(twice.name)
    except BaseException:
        location.delete(spark, root)
        raise
    manifest = {"format": FORMAT, "version": VERSION, "created_ms": int(time.time() * 1000), "codec": codec, "chunks": sorted(collection.chunks), "data": version, "names_checked": True}
    location.write_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    if before:
        location.delete(spark, f"{path}/data/{before}")
    return Collection.open(spark, path)


def _version_of(spark: SparkSession, path: str) -> str | None:
    try:
        return json.loads(location.read_text(spark, f"{path}/manifest.json") or "{}").get("data")
    except (ValueError, AttributeError):
        return None


def _write_tables(collection: Collection, path: str, codec: str, block_bytes: int) -> None:
    writes: list[Callable[[], None]] = []
    option = lambda w: w.mode("overwrite").option("compression", CODECS[codec]).option("parquet.block.size", str(max(block_bytes, 1 << 16)))
    for name, schema in (("datasets", tables.DATASETS), ("layouts", tables.LAYOUTS), ("attrs", tables.ATTRS), ("stats", tables.STATS)):
        rows = getattr(collection, name)
        writes.append(lambda rows=rows, name=name, schema=schema: option(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write).parquet(f"{path}/{name}"))
    for column, rows in collection.chunks.items():
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in tables.chunks(column)))
        place = ["array", "ordinal", *(f"c{k}" for k in range(tables.AXES))]
        rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)  # by range, so one large dataset is many tasks
        writes.append(lambda rows=rows, column=column: option(rows.write).partitionBy("array").parquet(f"{path}/chunks/{column}"))
    with ThreadPoolExecutor(len(writes)) as pool:  # independent jobs; small ones needn't wait for each other
        list(pool.map(lambda write: write(), writes))


@dataclass
class _Array:
    dtype: str
    dims: list[str]
    shape: list[int]
    chunk_shape: list[int]
    fill: Any
    is_coordinate: bool
    slabs: list[tuple[list[int], list[int], list[Any]]] = field(default_factory=list)


class DatasetWriter:
    """One dataset in the making. Nothing of it is seen before ``commit``."""

    def __init__(self, owner: "CollectionWriter", name: str, sequence: int):
        self.owner, self.name, self.sequence = owner, name, sequence
        self.arrays: dict[str, _Array] = {}
        self.attrs: dict[tuple[str | None, str], tuple[str, Any]] = {}
        self.done = False

    def _open(self) -> None:
        if self.done or self.owner.done:
            raise WriterFinished(f"dataset {self.name} can't be written any more")

    def define_array(self, name: str, dtype: str, dims: list[str], shape: list[int], chunk_shape: list[int] | None = None, fill: Any = None, is_coordinate: bool = False) -> None:
        self._open()
        check_name(name)
        if name in self.arrays:
            raise ArrayAlreadyExists(name)
        parsed = parse_dtype(dtype)
        if parsed.name in ("list", "fixed_size_list", "bool"):
            raise UnsupportedType(f"arrays of {parsed} can't be stored")
        if len(dims) != len(shape) or any(s < 0 for s in shape):
            raise InvalidValue(f"dimensions {dims} don't fit the shape {shape}")
        chunk = [max(1, s) for s in shape] if chunk_shape is None else list(chunk_shape)
        if len(chunk) != len(shape) or any(c < 1 for c in chunk):
            raise InvalidValue(f"chunks {chunk} don't fit the shape {shape}")
        chunk = [max(1, min(c, s)) for c, s in zip(chunk, shape)]
        self.arrays[name] = _Array(parsed.name, list(dims), list(shape), chunk, check_fill(parsed.name, fill), is_coordinate)

    def write(self, name: str, values: Any, start: list[int] | None = None, shape: list[int] | None = None) -> None:
        """A slab of row-major values at any origin; a later slab wins where slabs overlap."""
        self._open()
        if name not in self.arrays:
            raise ArrayNotFound(name)
        a = self.arrays[name]
        if hasattr(values, "shape") and shape is None:
            shape = list(values.shape)
        values = values.ravel().tolist() if hasattr(values, "ravel") else list(values)
        start, shape = list(start or [0] * len(a.shape)), list(a.shape if shape is None else shape)
        n = 1
        for s in shape:
            n *= s
        if n != len(values) or any(o < 0 or o + s > m for o, s, m in zip(start, shape, a.shape)):
            raise InvalidValue(f"a slab of {shape} at {start} with {len(values)} values doesn't fit {a.shape}")
        a.slabs.append((start, shape, values))

    def set_attribute(self, key: str, value: Any, array: str | None = None, dtype: str | None = None) -> None:
        """Set or replace an attribute; a replaced one keeps its place."""
        self._open()
        if array is not None and array not in self.arrays:
            raise ArrayNotFound(array)
        self.attrs[array, key] = typed_attr(value, dtype) if dtype else infer_attr(value)

    def commit(self) -> None:
        self._open()
        self.done = True
        with self.owner.lock:
            self.owner.committed.append(self)

    def abort(self) -> None:
        """Give the dataset up. Its name stays reserved."""
        self.done = True

    def __enter__(self) -> "DatasetWriter":
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.commit() if kind is None else self.abort()


class CollectionWriter:
    """A collection in the making; ordinals follow the order of ``add_dataset``."""

    def __init__(self, spark: SparkSession, destination: Any, codec: str = "zstd", block_bytes: int = 8 << 20):
        if codec not in CODECS:
            raise InvalidValue(f"unknown codec {codec!r}; expected one of {', '.join(CODECS)}")
        self.spark, self.destination, self.codec, self.block_bytes = spark, destination, codec, block_bytes
        self.names: set[str] = set()
        self.committed: list[DatasetWriter] = []
        self.done = False
        self.lock = threading.Lock()

    def add_dataset(self, name: str) -> DatasetWriter:
        if self.done:
            raise WriterFinished("this writer has finished; begin a new collection to write more")
        check_name(name)
        with self.lock:
            if name in self.names:
                raise DatasetAlreadyExists(name)
            self.names.add(name)
            return DatasetWriter(self, name, len(self.names) - 1)

    def abort(self) -> None:
        self.done = True

    def __enter__(self) -> "CollectionWriter":
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.commit() if kind is None else self.abort()

    def commit(self) -> Collection:
        if self.done:
            raise WriterFinished("this writer has finished; begin a new collection to write more")
        self.done = True
        return save(self._collection(), self.destination, self.codec, self.block_bytes)

    def _collection(self) -> Collection:
        spark = self.spark
        names, layouts, attrs = [], [], []
        by_array: dict[tuple[str, str], list[tuple[int, _Array]]] = {}
        for ordinal, d in enumerate(sorted(self.committed, key=lambda d: d.sequence)):
            names.append((ordinal, d.name))
            for position, (name, a) in enumerate(d.arrays.items()):
                fill = None if a.fill is None else {DTYPES[a.dtype][0]: a.fill}
                layouts.append((ordinal, position, name, a.dtype, a.dims, a.shape, a.chunk_shape, None if fill is None else tuple(_cast(k, fill.get(k)) for k in STORAGE), a.is_coordinate))
                by_array.setdefault((name, a.dtype), []).append((ordinal, a))
            places: dict[str | None, int] = {}
            for (array, key), (dtype, value) in d.attrs.items():
                place = places[array] = places.get(array, -1) + 1
                row = {"ordinal": ordinal, "array": array, "pos": place, "key": key, "dtype": dtype, **attr_row(dtype, value)}
                attrs.append(tuple(_cast(f.name, row.get(f.name)) for f in tables.ATTRS))
        layout_rows = spark.createDataFrame(layouts, tables.LAYOUTS)
        chunks: dict[str, DataFrame] = {}
        stats: DataFrame | None = None
        for (name, dtype), holders in by_array.items():
            column = DTYPES[dtype][0]
            cells_of = {}
            for ordinal, a in holders:  # cells of holders with one layout are handled together
                cells_of.setdefault((tuple(a.shape), tuple(a.chunk_shape), _key(a.fill)), []).append((ordinal, a))
            for (shape, chunk, _), group in cells_of.items():
                axes = [f"i{k}" for k in range(len(shape))]
                rows = [(o, *i, n, _cast(column, v)) for o, a in group for n, (start, size, values) in enumerate(a.slabs) for i, v in zip(itertools.product(*(range(s, s + k) for s, k in zip(start, size))), values)]
                schema = T.StructType([T.StructField("ordinal", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in axes), T.StructField("slab", T.IntegerType()), T.StructField("value", STORAGE[column])])
                cells = hyperslab.latest(spark.createDataFrame(rows, schema), axes, "slab")
                fill = group[0][1].fill
                held = cells.withColumn("fill_value", F.lit(_cast(column, fill)).cast(STORAGE[column])) if fill is not None else cells
                own = layout_rows.where((F.col("array") == name) & (F.col("dtype") == dtype) & F.col("ordinal").isin([o for o, _ in group]))
                part = statistics.partial(held, own, dtype)
                stats = part if stats is None else stats.unionByName(part)
                if rows:
                    packed = hyperslab.pack(cells, axes, list(shape), list(chunk)).withColumn("array", F.lit(name))
                    chunks[column] = chunks[column].unionByName(packed) if column in chunks else packed
        empty = lambda s: spark.createDataFrame([], s)
        return Collection(spark, spark.createDataFrame(names, tables.DATASETS), layout_rows, spark.createDataFrame(attrs, tables.ATTRS), stats if stats is not None else empty(tables.STATS), empty(tables.MASK), chunks)


def _key(value: Any) -> str:
    return repr(value)


def _cast(column: str, value: Any) -> Any:
    from decimal import Decimal

    if value is None:
        return None
    if column == "u":
        return Decimal(int(value))
    if column == "us":
        return [Decimal(int(v)) for v in value]
    return float(value) if column in ("f", "g") and not isinstance(value, float) else value
