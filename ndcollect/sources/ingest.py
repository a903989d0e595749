"""Collections from DataFrames: long tables of cells become datasets, layouts, statistics and chunks, all lazily."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables
from ..functions.conversions import timestamp_to_ns
from ..model import DTYPES, STORAGE, check_fill, check_name, dtype_of_spark
from ..operators import hyperslab, statistics
from ..reader import Collection


CHUNK_CELLS = 1 << 20


@dataclass
class ArraySpec:
    """One array: the column of its values, the axes it runs over, and how it is stored.

    ``axes`` maps dimension names to index columns (long, from 0). ``written`` marks rows whose cell is written;
    other rows only contribute to the shape. ``shape`` fixes the sizes instead of deriving them. An axis without
    an index column is as long as the dataset has rows; such an array has statistics but no chunks. Without ``chunk``
    an array is cut along its first axis into chunks of about ``CHUNK_CELLS`` cells.
    """

    value: str | Column | None
    axes: dict[str, str | None]
    dtype: str | None = None
    fill: Any = None
    chunk: list[int] | None = None
    written: Column | None = None
    sequence: str | None = None
    shape: dict[str, int] = field(default_factory=dict)
    is_coordinate: bool = False


def ordinals(names: DataFrame) -> DataFrame:
    """ordinal and name of distinct names, in the order of names. Only the distinct names are sorted in one place."""
    return names.select("name").distinct().withColumn("ordinal", (F.row_number().over(Window.orderBy("name")) - 1).cast("int")).select("ordinal", "name")


def from_dataframe(df: DataFrame, dataset: str, arrays: dict[str, ArraySpec], attributes: dict[str, tuple[str, Column]] | None = None) -> Collection:
    """A collection of ``df``'s rows, one dataset for each value of the column ``dataset``.

    ``attributes`` maps keys to (type, aggregate over a dataset's rows); a null result leaves the attribute out.
    Only the distinct names are computed here, to see whether they are few enough to broadcast. Statistics are a
    partial aggregate of the cells, chunks a grouping by chunk coordinates, and whoever reads one of them runs only that.
    """
    spark = df.sparkSession
    rows = df.withColumn("name", F.col(dataset).cast("string")).where("name IS NOT NULL")
    few = _few(rows)
    datasets = ordinals(rows) if few is None else spark.createDataFrame(list(enumerate(few)), tables.DATASETS)
    rows = rows.join(datasets if few is None else F.broadcast(datasets), "name")
    layouts: DataFrame | None = None
    stats: DataFrame | None = None
    chunks: dict[str, DataFrame] = {}
    for position, (name, spec) in enumerate(arrays.items()):
        check_name(name)
        value = F.lit(None) if spec.value is None else F.col(spec.value) if isinstance(spec.value, str) else spec.value
        kind = df.select(value.alias("v")).schema["v"].dataType
        dtype = spec.dtype or dtype_of_spark(kind)
        column = DTYPES[dtype][0]
        if dtype == "timestamp_ns" and kind.simpleString().startswith("timestamp"):
            value = timestamp_to_ns(value)
        fill = check_fill(dtype, spec.fill)
        names = list(spec.axes)
        sizes = [F.lit(spec.shape[d]).cast("long") if d in spec.shape else F.count(F.lit(1)) if spec.axes[d] is None else (F.max(spec.axes[d]) + 1).cast("long") for d in names]
        indexed = None not in spec.axes.values()
        shape = rows.groupBy("ordinal").agg(F.array(*sizes).cast("array<bigint>").alias("shape"))
        whole = F.transform("shape", lambda s: F.greatest(s, F.lit(1).cast("long")))
        rest = F.aggregate(F.slice(whole, F.lit(2), F.size(whole)), F.lit(1).cast("long"), lambda n, s: n * s)
        rows_of_chunk = F.greatest(F.floor(F.lit(CHUNK_CELLS) / rest), F.lit(1).cast("long"))  # of the first axis
        leading = F.transform(whole, lambda s, k: F.when(k == 0, F.least(s, rows_of_chunk)).otherwise(s))
        chunk = leading if spec.chunk is None else F.zip_with(whole, F.array(*(F.lit(c).cast("long") for c in spec.chunk)), lambda a, b: F.least(a, b))
        stored = F.struct(*(F.lit(fill if k == column else None).cast(t).alias(k) for k, t in STORAGE.items()))
        own = shape.select(
            "ordinal", F.lit(position).cast("int").alias("position"), F.lit(name).alias("array"), F.lit(dtype).alias("dtype"), F.array(*map(F.lit, names)).cast("array<string>").alias("dims"), "shape", chunk.alias("chunk_shape"),
            (stored if fill is not None else F.lit(None).cast(tables.LAYOUTS["fill"].dataType)).alias("fill"), F.lit(spec.is_coordinate).alias("is_coordinate"),
        )
        layouts = own if layouts is None else layouts.unionByName(own)
        cells = rows if spec.written is None else rows.where(spec.written)
        axes = [f"i{k}" for k in range(len(names))]
        cells = cells.select("ordinal", *(F.col(spec.axes[d]).cast("long").alias(a) for d, a in zip(names, axes) if indexed), *([F.col(spec.sequence).alias("__seq")] if spec.sequence else []), value.cast(STORAGE[column]).alias("value"))
        if spec.value is None:
            cells = cells.limit(0)
        if spec.sequence:
            cells = hyperslab.latest(cells, axes, "__seq")
        held = cells if fill is None else cells.withColumn("fill_value", F.lit(fill).cast(STORAGE[column]))
        part = statistics.partial(held, own, dtype)
        stats = part if stats is None else stats.unionByName(part)
        if spec.value is not None and indexed:
            sized = cells.join(own.select("ordinal", "shape", "chunk_shape"), "ordinal")
            packed = hyperslab.pack(sized, axes, [F.element_at("shape", k + 1) for k in range(len(axes))], [F.element_at("chunk_shape", k + 1) for k in range(len(axes))])
            packed = packed.withColumn("array", F.lit(name))
            chunks[column] = chunks[column].unionByName(packed) if column in chunks else packed
    attrs: DataFrame | None = None
    for pos, (key, (dtype, aggregate)) in enumerate((attributes or {}).items()):
        column = DTYPES[dtype][0]
        column = "f" if column == "g" else column
        got = rows.groupBy("ordinal").agg(aggregate.alias("__v")).where("__v IS NOT NULL")
        fixed = {"array": F.lit(None), "pos": F.lit(pos), "key": F.lit(key), "dtype": F.lit(dtype), column: F.col("__v")}
        one = got.select(*((F.col("ordinal") if f.name == "ordinal" else fixed.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in tables.ATTRS))
        attrs = one if attrs is None else attrs.unionByName(one)
    empty = lambda schema: spark.createDataFrame([], schema)
    return Collection(spark, datasets, layouts if layouts is not None else empty(tables.LAYOUTS), attrs if attrs is not None else empty(tables.ATTRS), stats if stats is not None else empty(tables.STATS), empty(tables.MASK), chunks)


def _few(rows: DataFrame, most: int = 10_000) -> list[str] | None:
    """The distinct names in order, if they are at most ``most``: then their table is small enough to broadcast. Null if not."""
    names = [r.name for r in rows.select("name").distinct().limit(most + 1).collect()]
    return sorted(names) if len(names) <= most else None


def union(*collections: Collection) -> Collection:
    """Several collections as one; later datasets follow earlier ones. Names must differ (``validate`` tells)."""
    first = collections[0]
    out = Collection(first.spark, first.datasets, first.layouts, first.attrs, first.stats, first.mask, dict(first.chunks))
    for more in collections[1:]:
        base = out.datasets.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
        moved = lambda t: t.withColumn("ordinal", (F.col("ordinal") + base).cast("int"))  # noqa: B023, E731
        out.datasets, out.layouts, out.attrs = (getattr(out, n).unionByName(moved(getattr(more, n))) for n in ("datasets", "layouts", "attrs"))
        out.stats, out.mask = out.stats.unionByName(moved(more.stats)), out.mask.unionByName(moved(more.mask))
        for column, rows in more.chunks.items():
            out.chunks[column] = out.chunks[column].unionByName(moved(rows)) if column in out.chunks else moved(rows)
    return out
