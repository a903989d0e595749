"""Collections and datasets as readers see them: lazy DataFrames, with small lookups answered at once."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .errors import ArrayNotFound, CorruptCollection, CorruptMask, DatasetNotFound, NotACollection, UnsupportedVersion
from .functions.ndindex import chunk_count, coordinate, coordinates, unravel, window_chunks
from .log import LOGGER
from .model import DTYPES, STORAGE, attr_value, zero
from .operators import attributes, catalogue, hyperslab, statistics
from .schema import ArrayMeta, SchemaView
from .sources import location

FORMAT, VERSION = "ndcollect", 1
_BOUND = {"int": "i", "timestamp": "i", "uint": "u", "float": "f", "bytes": "b"}


@dataclass
class Collection:
    """The logical tables of a collection: read from a location, or derived from DataFrames and never written."""

    spark: SparkSession
    datasets: DataFrame
    layouts: DataFrame
    attrs: DataFrame
    stats: DataFrame
    mask: DataFrame
    chunks: dict[str, DataFrame] = field(default_factory=dict)  # by storage column
    path: str | None = None
    manifest: dict[str, Any] = field(default_factory=dict)

    # -- opening ---------------------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, source: Any, **store: Any) -> "Collection":
        """The collection at a location; ``store`` are options of its object store."""
        path = location.use(spark, source, store).rstrip("/")
        text = location.read_text(spark, f"{path}/manifest.json")
        if text is None:
            raise NotACollection(f"no manifest under {path}")
        try:
            manifest = json.loads(text)
            kind, version = manifest["format"], manifest["version"]
        except (ValueError, KeyError, TypeError) as e:
            raise NotACollection(f"{path}/manifest.json is no manifest") from e
        if kind != FORMAT:
            raise NotACollection(f"{path} is of the format {kind!r}")
        if version != VERSION:
            raise UnsupportedVersion(f"collection version {version}; this library reads version {VERSION}")
        root = f"{path}/data/{manifest.get('data')}"
        if not location.exists(spark, f"{root}/datasets"):
            raise CorruptCollection(f"the tables of {path} are missing")
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}")
        chunks = {c: spark.read.schema(tables.chunks(c)).parquet(f"{root}/chunks/{c}") for c in manifest["chunks"]}
        out = cls(spark, read("datasets", tables.DATASETS), read("layouts", tables.LAYOUTS), read("attrs", tables.ATTRS), read("stats", tables.STATS), spark.createDataFrame([], tables.MASK), chunks, path, manifest)
        if not manifest.get("names_checked"):  # who wrote it has not vouched for it
            twice = catalogue.repeated(out.datasets, "name").first()
            if twice is not None:
                raise CorruptCollection(f"dataset name {twice.name!r} repeats in {path}")
        out._load_mask()
        return out

    @property
    def root(self) -> str:
        """The folder of the version that is open."""
        return f"{self.path}/data/{self.manifest['data']}"

    def _load_mask(self) -> None:
        """The current mask: the one that the pointer file names. Ordinals of no dataset are ignored, with a warning."""
        text = location.read_text(self.spark, f"{self.root}/mask.json")
        if text is None:
            return
        try:
            where = f"{self.root}/mask/{json.loads(text)['mask']}"
            stored = self.spark.read.schema(tables.MASK).parquet(where)
            known = stored.join(self.datasets, "ordinal", "left_semi")
            lost = stored.join(self.datasets, "ordinal", "left_anti").count()
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptMask(f"{self.root}/mask.json is no deletion mask") from e
        except (PySparkException, Py4JJavaError) as e:
            raise CorruptMask(f"the deletion mask that {self.root}/mask.json names can't be read") from e
        if lost:
            LOGGER.warning("the mask of %s names %d unknown ordinals, which are ignored", self.path, lost)
        self.mask = known

    def validate(self) -> DataFrame:
        """Contradictions between the tables; no rows if there are none."""
        return catalogue.faults(self.datasets, self.layouts, self.attrs, self.stats, self.mask, list(self.chunks.values()))

    def register(self, prefix: str = "") -> None:
        """The live logical tables as temporary views, for SQL."""
        for name in ("datasets", "layouts", "attrs", "stats"):
            rows = getattr(self, name)
            catalogue.live(rows, self.mask).createOrReplaceTempView(prefix + name)
        for column, rows in self.chunks.items():
            catalogue.live(rows, self.mask).createOrReplaceTempView(f"{prefix}chunks_{column}")

    # -- catalogue -------------------------------------------------------------------------------------------

    def live(self) -> DataFrame:
        return catalogue.live(self.datasets, self.mask)

    def list_datasets(self) -> list[str]:
        return [r.name for r in self.live().orderBy("ordinal").toLocalIterator()]

    def dataset_exists(self, name: str) -> bool:
        return not self.live().where(F.col("name") == name).isEmpty()

    def dataset_count(self) -> int:
        return self.live().count()

    def total_datasets(self) -> int:
        return self.datasets.count()

    __contains__ = dataset_exists
    __len__ = dataset_count

    def __iter__(self) -> Iterator[str]:
        return iter(self.list_datasets())

    def __repr__(self) -> str:
        return f"<Collection {self.path or 'of DataFrames'}>"

    def dataset(self, name: str) -> "Dataset":
        row = self.live().where(F.col("name") == name).first()
        if row is None:
            raise DatasetNotFound(name)
        return Dataset(self, name, row.ordinal)

    def list_arrays(self) -> list[str]:
        return [r.array for r in catalogue.array_names(self.layouts, self.live()).collect()]

    def schemas(self) -> DataFrame:
        return catalogue.schemas(self.datasets, self.layouts, self.attrs)

    def interned_schemas(self) -> int:
        """Different schemas of all datasets, deleted ones included."""
        return self.schemas().select("schema").distinct().count()

    def merged_schema(self) -> DataFrame:
        return catalogue.merged(self.layouts, self.attrs)

    # -- attributes ------------------------------------------------------------------------------------------

    def attributes_by_dataset(self, key: str, array: str | None = None) -> dict[str, Any]:
        """{dataset: value} in write order; datasets without the attribute are absent."""
        rows = attributes.column(self.attrs, key, array).drop("array").join(self.live(), "ordinal").orderBy("ordinal")
        return {r.name: attr_value(r.asDict()) for r in rows.toLocalIterator()}

    def catalogue_table(self, keys: dict[str, str]) -> DataFrame:
        return attributes.catalogue(self.live(), self.attrs, keys)

    def with_attribute(self, key: str, condition) -> DataFrame:
        """Live datasets whose attribute's row satisfies ``condition``."""
        return self.live().join(attributes.column(self.attrs, key).where(condition).select("ordinal"), "ordinal", "left_semi")

    # -- statistics ------------------------------------------------------------------------------------------

    def stats_by_dataset(self, array: str) -> DataFrame:
        """A row of statistics for every live dataset with the array, named by dataset, in write order."""
        return self.stats.where(F.col("array") == array).join(self.live(), "ordinal").orderBy("ordinal")

    def array_stats(self, array: str) -> dict[str, Any] | None:
        """Statistics over all live datasets; null for an unknown array."""
        row = statistics.final(catalogue.live(self.stats.where(F.col("array") == array), self.mask)).first()
        return None if row is None else stats_dict(row.asDict(), self._class(array))

    def _class(self, array: str) -> str:
        first = catalogue.live(self.stats.where(F.col("array") == array), self.mask).orderBy("ordinal").select("dtype").first()
        return DTYPES[first.dtype][2]

    def with_stats(self, array: str, condition) -> DataFrame:
        """Live datasets whose statistics of an array satisfy ``condition``."""
        return self.live().join(self.stats.where(F.col("array") == array).where(condition).select("ordinal"), "ordinal", "left_semi")

    # -- data ------------------------------------------------------------------------------------------------

    def array_chunks(self, array: str) -> DataFrame:
        """Chunk rows of one array over all live datasets; the array is a partition of the stored chunks."""
        kinds = [r.dtype for r in self.layouts.where(F.col("array") == array).select("dtype").distinct().collect()]
        if not kinds:
            raise ArrayNotFound(array)
        columns = {DTYPES[k][0] for k in kinds}
        if len(columns) > 1:
            raise CorruptCollection(f"array {array} has different types in different datasets: {', '.join(sorted(kinds))}")
        return catalogue.live(self.chunks[columns.pop()].where(F.col("array") == array), self.mask)

    def _holders(self, array: str, dtype: str | None) -> tuple[DataFrame, DataFrame, int, Column]:
        """Chunks and layouts of the live datasets with an array, its rank, and what unwritten cells read as."""
        own = self.layouts.where(F.col("array") == array)
        kinds = own.agg(F.min("dtype").alias("low"), F.max("dtype").alias("high"), F.min(F.size("shape")).alias("rank"), F.max(F.size("shape")).alias("most")).first()
        if kinds.low is None:
            raise ArrayNotFound(array)
        if kinds.low != kinds.high or kinds.rank != kinds.most or dtype not in (None, kinds.low):
            raise CorruptCollection(f"array {array} is {kinds.low}{'' if kinds.low == kinds.high else ' and ' + kinds.high} of {kinds.rank} to {kinds.most} axes, not {dtype or 'one type'}")
        column = DTYPES[kinds.low][0]
        fill = F.coalesce(F.col(f"fill.{column}"), F.lit(zero(kinds.low)).cast(STORAGE[column])).alias("unwritten")
        layouts = catalogue.live(own, self.mask).select("ordinal", "shape", "chunk_shape", fill)
        chunks = self.chunks.get(column)
        if chunks is None:
            chunks = self.spark.createDataFrame([], tables.chunks(column))
        return chunks.where(F.col("array") == array), layouts, kinds.rank, F.col("unwritten")

    def read_window(self, array: str, start: list[int], shape: list[int], dtype: str | None = None) -> DataFrame:
        """Written cells (ordinal, ``i0`` and on, value) of a window of every live dataset, in one scan.

        The scan is bounded by literal chunk coordinates, from the largest and smallest chunks that any dataset has.
        """
        chunks, layouts, rank, _ = self._holders(array, dtype)
        if len(start) != rank or len(shape) != rank or any(s < 0 or n < 0 for s, n in zip(start, shape)):
            raise CorruptCollection(f"window {start} of {shape} doesn't fit {rank} axes")
        names, sizes = [f"i{k}" for k in range(rank)], [F.element_at("chunk_shape", k + 1) for k in range(rank)]
        most = layouts.agg(*(f(s).alias(f"{n}{k}") for k, s in enumerate(sizes) for n, f in (("low", F.min), ("high", F.max)))).first() if rank else None
        for k, (s, n) in enumerate(zip(start, shape)):
            if most is not None and most[f"low{k}"] is not None:
                chunks = chunks.where(coordinate(k).between(F.lit(s // most[f"high{k}"]), F.lit(max(s + n - 1, 0) // most[f"low{k}"])))
        rows = chunks.join(layouts.drop("unwritten"), "ordinal")
        cells = hyperslab.unpack(rows, names, [F.element_at("shape", k + 1) for k in range(rank)], sizes).where("value IS NOT NULL")
        for a, s, n in zip(names, start, shape):
            cells = cells.where((F.col(a) >= s) & (F.col(a) < s + n))
        return cells

    def read_tail(self, array: str, n: int, dtype: str | None = None) -> DataFrame:
        """Written cells of the last ``n`` places of the first axis of every live dataset. Chunks before them aren't scanned."""
        chunks, layouts, rank, _ = self._holders(array, dtype)
        first = F.greatest(F.element_at("shape", 1) - n, F.lit(0))
        layouts = layouts.withColumn("first", first).withColumn("from_chunk", F.floor(first / F.element_at("chunk_shape", 1)))
        least = layouts.agg(F.min("from_chunk")).first()[0] or 0
        rows = chunks.where(F.col("c0") >= F.lit(least)).join(layouts.drop("unwritten"), "ordinal").where(F.col("c0") >= F.col("from_chunk"))
        names = [f"i{k}" for k in range(rank)]
        cells = hyperslab.unpack(rows, names, [F.element_at("shape", k + 1) for k in range(rank)], [F.element_at("chunk_shape", k + 1) for k in range(rank)]).where("value IS NOT NULL")
        return cells.join(layouts.select("ordinal", "first"), "ordinal").where(F.col("i0") >= F.col("first")).drop("first")

    def read_complete(self, array: str, dtype: str | None = None) -> DataFrame:
        """Every cell of every live dataset; those nobody wrote have the dataset's fill, or zero."""
        chunks, layouts, rank, unwritten = self._holders(array, dtype)
        names = [f"i{k}" for k in range(rank)]
        cells = hyperslab.complete(chunks, hyperslab.grid(layouts, rank), names, F.lit(None))
        return cells.join(layouts.select("ordinal", unwritten), "ordinal").select("ordinal", *names, F.coalesce("value", "unwritten").alias("value"))

    # -- deletion --------------------------------------------------------------------------------------------

    def delete_datasets(self, names: list[str]) -> int:
        """Hide datasets. All names must be live or nothing changes; repeats count once.

        The mask is read again, written whole beside the old one and then pointed to in one step: readers see the old
        or the new one. Of calls that overlap in time the last one's mask holds.
        """
        wanted = list(dict.fromkeys(names))
        if not wanted:
            return 0
        if self.path:
            self._load_mask()
        found = {r.name: r.ordinal for r in self.live().join(F.broadcast(self.spark.createDataFrame([(n,) for n in wanted], "name string")), "name", "left_semi").collect()}
        lost = [n for n in wanted if n not in found]
        if lost:
            raise DatasetNotFound(", ".join(sorted(lost)))
        more = self.spark.createDataFrame([(o,) for o in found.values()], tables.MASK)
        mask = self.mask.select("ordinal").unionByName(more).distinct()
        if self.path:
            name = uuid.uuid4().hex
            mask.coalesce(1).sortWithinPartitions("ordinal").write.parquet(f"{self.root}/mask/{name}")
            location.write_text(self.spark, f"{self.root}/mask.json", json.dumps({"mask": name}))
            self._load_mask()
        else:
            self.mask = mask
        return len(wanted)

    # -- container -------------------------------------------------------------------------------------------

    def segment_names(self) -> list[str]:
        """Arrays of which any cell is stored, deleted datasets included, sorted."""
        stored = [rows.select("array") for rows in self.chunks.values()]
        return sorted({r.array for rows in stored for r in rows.distinct().collect()})

    def segment_entry(self, array: str) -> dict[str, Any] | None:
        """Folders and stored bytes of one array; null if no cell of it is stored."""
        if not self.path:
            return None
        places = [f"{self.root}/chunks/{c}/array={array}" for c in self.manifest["chunks"]]
        sizes = {p: location.size(self.spark, p) for p in places if location.exists(self.spark, p)}
        return {"array": array, "paths": list(sizes), "bytes": sum(sizes.values())} if sizes else None

    def segment_bytes(self) -> dict[str, int]:
        """Stored bytes by array."""
        return {a: entry["bytes"] for a in self.segment_names() if (entry := self.segment_entry(a))}

    @property
    def format_version(self) -> int:
        return self.manifest.get("version", VERSION)

    @property
    def created_unix_ms(self) -> int:
        return self.manifest.get("created_ms", 0)

    @property
    def codec(self) -> str | None:
        return self.manifest.get("codec")

    def container_bytes(self) -> int:
        return location.size(self.spark, self.root) if self.path else 0

    def summary(self) -> dict[str, Any]:
        return {"format_version": self.format_version, "created_unix_ms": self.created_unix_ms, "codec": self.codec, "container_bytes": self.container_bytes(), "total_datasets": self.total_datasets(), "interned_schemas": self.interned_schemas()}


@dataclass
class Dataset:
    collection: Collection
    name: str
    ordinal: int

    def _layouts(self) -> DataFrame:
        return self.collection.layouts.where(F.col("ordinal") == self.ordinal)

    def _attrs(self, array: str | None) -> DataFrame:
        scope = F.col("array").isNull() if array is None else F.col("array") == array
        return self.collection.attrs.where((F.col("ordinal") == self.ordinal) & scope)

    def list_arrays(self) -> list[str]:
        return [r.array for r in self._layouts().orderBy("position").collect()]

    def schema(self) -> SchemaView:
        """What the dataset declares: arrays with their attribute keys, and its own attributes, in order."""
        own = self.collection.attrs.where(F.col("ordinal") == self.ordinal).orderBy("pos").select("array", "key", "dtype").collect()
        arrays = [ArrayMeta(r.array, r.dtype, r.position, tuple(a.key for a in own if a.array == r.array)) for r in self._layouts().orderBy("position").collect()]
        return SchemaView(tuple(arrays), tuple((a.key, a.dtype) for a in own if a.array is None))

    def layout(self, array: str) -> dict[str, Any]:
        row = self._layouts().where(F.col("array") == array).first()
        if row is None:
            raise ArrayNotFound(array)
        fill = getattr(row.fill, DTYPES[row.dtype][0]) if row.fill is not None else None
        n = 1
        for s in row.shape:
            n *= s
        return {"name": array, "dtype": row.dtype, "position": row.position, "shape": list(row.shape), "chunk_shape": list(row.chunk_shape), "dimension_names": list(row.dims), "fill_value": int(fill) if row.dtype == "uint64" and fill is not None else fill, "element_count": n, "is_coordinate": bool(row.is_coordinate), "attribute_names": list(self.array_attributes(array))}

    def dimensions(self) -> dict[str, int]:
        rows = self._layouts().orderBy("position").collect()
        out: dict[str, int] = {}
        for r in rows:
            for d, s in zip(r.dims, r.shape):
                out.setdefault(d, s)
        return out

    def attributes(self) -> dict[str, Any]:
        return {r.key: attr_value(r.asDict()) for r in self._attrs(None).orderBy("pos").collect()}

    def array_attributes(self, array: str) -> dict[str, Any]:
        """An array's attributes; none for an unknown array."""
        return {r.key: attr_value(r.asDict()) for r in self._attrs(array).orderBy("pos").collect()}

    def _one(self, array: str | None, key: str) -> Any:
        row = self._attrs(array).where(F.col("key") == key).first()
        return None if row is None else attr_value(row.asDict())

    def get_attribute(self, key: str) -> Any:
        return self._one(None, key)

    def get_array_attribute(self, array: str, key: str) -> Any:
        if self._layouts().where(F.col("array") == array).isEmpty():
            raise ArrayNotFound(array)
        return self._one(array, key)

    def array_stats(self, array: str) -> dict[str, Any] | None:
        row = self.collection.stats.where((F.col("ordinal") == self.ordinal) & (F.col("array") == array)).first()
        return None if row is None else stats_dict(row.asDict(), DTYPES[row.dtype][2])

    def read(self, array: str, dtype: str | None = None, start: list[int] | None = None, shape: list[int] | None = None) -> DataFrame:
        """Cells (one column an axis, named ``i0`` and on, and ``value``) of a window; the whole array if none is named.

        A ``dtype`` that isn't the array's is an error, never a cast. Cells nobody wrote have the fill, or zero.
        """
        at = self.layout(array)
        if dtype is not None and dtype != at["dtype"]:
            raise CorruptCollection(f"array {array} is {at['dtype']}, not {dtype}")
        rank = len(at["shape"])
        start, size = list(start or []), list(shape or [])
        if not start and not size:
            start, size = [0] * rank, list(at["shape"])
        if len(start) != rank or len(size) != rank or any(s < 0 or n < 0 or s + n > m for s, n, m in zip(start, size, at["shape"])):
            raise CorruptCollection(f"window {start} of {size} isn't within {at['shape']}")
        names = [f"i{k}" for k in range(rank)]
        column = DTYPES[at["dtype"]][0]
        missing = at["fill_value"] if at["fill_value"] is not None else zero(at["dtype"])
        low = [s // c for s, c in zip(start, at["chunk_shape"])]
        counts = [(s + n - 1) // c - k + 1 if n else 0 for s, n, c, k in zip(start, size, at["chunk_shape"], low)]
        spark = self.collection.spark
        inner = unravel(F.col("id"), [F.lit(c).cast("long") for c in counts])
        wanted = spark.range(math.prod(counts)).select(F.lit(self.ordinal).alias("ordinal"), *(F.array(*(F.lit(x).cast("long") for x in at[c])).cast("array<bigint>").alias(c) for c in ("shape", "chunk_shape")), *coordinates([i + k for i, k in zip(inner, low)]))
        rows = self.collection.chunks.get(column)
        if rows is None:
            rows = spark.createDataFrame([], tables.chunks(column))
        rows = rows.where((F.col("array") == array) & (F.col("ordinal") == self.ordinal) & window_chunks(start, size, at["chunk_shape"]))
        cells = hyperslab.complete(rows, wanted, names, F.lit(missing).cast(STORAGE[column]))
        for n, s, k in zip(names, start, size):
            cells = cells.where(F.col(n).between(s, s + k - 1))
        return cells.drop("ordinal")

    def read_values(self, array: str, dtype: str | None = None, start: list[int] | None = None, shape: list[int] | None = None) -> list[Any]:
        """A window's values in row-major order, on the driver."""
        rows = self.read(array, dtype, start, shape)
        axes = rows.columns[:-1]
        return [r.value for r in (rows.orderBy(*axes) if axes else rows).collect()]

    def touched_chunks(self, array: str, start: list[int], shape: list[int]) -> int:
        return chunk_count(start, shape, self.layout(array)["chunk_shape"])


def stats_dict(row: dict[str, Any], kind: str) -> dict[str, Any]:
    """min, max, null_count, row_count; bounds of texts are bytes."""
    letter = _BOUND[kind]
    low, high = row[f"min_{letter}"], row[f"max_{letter}"]
    convert = {"u": int, "b": bytes}.get(letter, lambda v: v)
    return {"min": None if low is None else convert(low), "max": None if high is None else convert(high), "null_count": row["null_count"], "row_count": row["row_count"]}
