"""Chunks of cells, and windows of cells read back from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ndindex import chunk_of, coordinate, coordinates, extent, ravel, unravel, window_chunks
from ..tables import AXES


def latest(cells: DataFrame, axes: list[str], sequence: str) -> DataFrame:
    """One value a cell: of slabs that overlap, the one written last."""
    return cells.groupBy("ordinal", *axes).agg(F.max_by("value", sequence).alias("value"))


def pack(cells: DataFrame, axes: list[str], shape: list[Column | int], chunk_shape: list[Column | int]) -> DataFrame:
    """Chunk rows (ordinal, chunk coordinates, values) of cells (ordinal, axes, value); cells nobody wrote are null in ``values``."""
    index = [F.col(a) for a in axes]
    chunk = chunk_of(index, chunk_shape)
    sizes = extent(chunk, shape, chunk_shape)
    inner = [i - c * (s if isinstance(s, Column) else F.lit(s).cast("long")) for i, c, s in zip(index, chunk, chunk_shape)]
    total = F.lit(1).cast("long")
    for s in sizes:
        total = total * s
    rows = cells.select("ordinal", *coordinates(chunk), ravel(inner, sizes).alias("off"), total.alias("total"), "value")
    keys = [c for c in rows.columns if c not in ("off", "total", "value")]
    held = rows.groupBy(*keys).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("off", "value"))).alias("held"))
    nothing = held.schema["held"].dataType.elementType["value"].dataType
    offsets = F.transform("held", lambda x: x.off)
    gaps = F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), offsets), lambda o: F.struct(o.alias("off"), F.lit(None).cast(nothing).alias("value")))
    full = F.when(F.size("held") == F.col("total"), F.col("held")).otherwise(F.array_sort(F.concat("held", gaps)))
    return held.select(*keys, F.transform(full, lambda x: x.value).alias("values"))


def unpack(chunks: DataFrame, names: list[str], shape: list[Column | int], chunk_shape: list[Column | int]) -> DataFrame:
    """Cells (ordinal, names, value) of chunk rows."""
    at = [coordinate(k) for k in range(len(names))]
    sizes = extent(at, shape, chunk_shape)
    rows = chunks.select("*", F.posexplode("values").alias("off", "value"))
    inner = unravel(F.col("off"), sizes)
    index = [c * (s if isinstance(s, Column) else F.lit(s).cast("long")) + i for c, s, i in zip(at, chunk_shape, inner)]
    return rows.select("ordinal", *(i.alias(n) for i, n in zip(index, names)), "value")


def window(chunks: DataFrame, names: list[str], shape: list[int], chunk_shape: list[int], start: list[int], size: list[int]) -> DataFrame:
    """Written cells of a window. Only chunks that it touches are scanned: the bounds on chunk coordinates are pushed down."""
    rows = unpack(chunks.where(window_chunks(start, size, chunk_shape)), names, shape, chunk_shape)
    for n, s, k in zip(names, start, size):
        rows = rows.where(F.col(n).between(s, s + k - 1))
    return rows


def grid(layouts: DataFrame, rank: int) -> DataFrame:
    """A row for every chunk of each dataset of ``layouts`` (ordinal, shape, chunk_shape): its coordinates, with those columns."""
    counts = [F.ceil(F.element_at("shape", k + 1) / F.element_at("chunk_shape", k + 1)) for k in range(rank)]
    total = F.lit(1).cast("long")
    for c in counts:
        total = total * c
    every = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = layouts.select("ordinal", "shape", "chunk_shape", F.explode(every).alias("__chunk"))
    return rows.select("ordinal", "shape", "chunk_shape", *coordinates(unravel(F.col("__chunk"), counts)))


def complete(chunks: DataFrame, wanted: DataFrame, names: list[str], unwritten: Column) -> DataFrame:
    """Every cell (ordinal, names, value) of the chunks that ``wanted`` (as ``grid`` gives them) lists; cells nobody wrote
    read as ``unwritten``. Stored chunks meet the list by their coordinates, a row a chunk; cells come after that."""
    rank = len(names)
    keys = ["ordinal", *(f"c{k}" for k in range(min(rank, AXES))), *(["cx"] if rank > AXES else [])]
    kind = chunks.schema["values"].dataType
    shape, chunk = ([F.element_at(c, k + 1) for k in range(rank)] for c in ("shape", "chunk_shape"))
    size = F.lit(1).cast("long")
    for s in extent([coordinate(k) for k in range(rank)], shape, chunk):
        size = size * s
    met = wanted.join(chunks.select(*keys, "values"), keys, "left")
    nothing = F.array_repeat(F.lit(None).cast(kind.elementType), size.cast("int"))
    cells = unpack(met.withColumn("values", F.coalesce("values", nothing)), names, shape, chunk)
    return cells.withColumn("value", F.coalesce("value", unwritten))
