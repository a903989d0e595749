"""N-dimensional index arithmetic as column expressions: ravel, unravel, chunks of an index, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import AXES


def element_count(shape: Column) -> Column:
    """Product of the sizes; 1 for an array without axes."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def _n(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def chunk_of(index: list[Column], chunk_shape: list[Column | int]) -> list[Column]:
    return [F.floor(i / _n(c)) for i, c in zip(index, chunk_shape)]


def extent(chunk: list[Column], shape: list[Column | int], chunk_shape: list[Column | int]) -> list[Column]:
    """Sizes of a chunk, clipped at the array's edge."""
    return [F.least(_n(c), _n(s) - k * _n(c)) for k, s, c in zip(chunk, shape, chunk_shape)]


def ravel(inner: list[Column], sizes: list[Column]) -> Column:
    """Row-major offset of an index within a block of ``sizes``."""
    return reduce(lambda at, x: at * x[1] + x[0], zip(inner, sizes), F.lit(0).cast("long"))


def unravel(offset: Column, sizes: list[Column]) -> list[Column]:
    out: list[Column] = []
    rest = offset.cast("long")
    for size in reversed(sizes):
        safe = F.greatest(size, F.lit(1).cast("long"))
        out.insert(0, rest % safe)
        rest = F.floor(rest / safe)
    return out


def coordinate(axis: int) -> Column:
    """A chunk's coordinate on an axis, as stored."""
    return F.col(f"c{axis}") if axis < AXES else F.element_at("cx", axis - AXES + 1)


def coordinates(chunk: list[Column]) -> list[Column]:
    """Chunk coordinates as the stored columns."""
    none = F.lit(None).cast("long")
    scalars = [(chunk[k] if k < len(chunk) else none).cast("long").alias(f"c{k}") for k in range(AXES)]
    rest = F.array(*(c.cast("long") for c in chunk[AXES:])) if len(chunk) > AXES else F.lit(None).cast("array<bigint>")
    return [*scalars, rest.alias("cx")]


def window_chunks(start: list[int], size: list[int], chunk_shape: list[int]) -> Column:
    """Filter on stored chunk coordinates: chunks that a window touches. Bounds are literals, so they are pushed to the scan."""
    bounds = [coordinate(k).between(F.lit(s // c), F.lit((s + n - 1) // c)) for k, (s, n, c) in enumerate(zip(start, size, chunk_shape))]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def chunk_count(start: list[int], size: list[int], chunk_shape: list[int]) -> int:
    """How many chunks a window touches."""
    out = 1
    for s, n, c in zip(start, size, chunk_shape):
        out *= (s + n - 1) // c - s // c + 1 if n else 0
    return out


def axis_domain(name: str, start: Column | int, size: Column | int) -> Column:
    """All indices of one axis of a window; none where its size is 0."""
    start, size = _n(start), _n(size)
    return F.explode(F.when(size > 0, F.sequence(start, start + size - 1)).otherwise(F.array().cast("array<bigint>"))).alias(name)
