"""Collections from NetCDF files: discovery, conversion on the executors, and ingest in waves.

The driver lists the files and numbers them. Tasks open files, convert them block by block, and emit rows of
chunks, layouts, attributes and statistics, which are staged in one table; the logical tables are selections of
it. No cell passes the driver, and a task holds one block at a time. Files that xarray can't be asked for, since
it isn't there, are read by the built-in reader of the classic format.
"""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..errors import CollectionError, DatasetAlreadyExists, InvalidValue, UnsupportedType
from ..log import LOGGER
from ..model import DTYPES, NAT, STORAGE, attr_row, check_fill, check_name, default_fill, dtype_of_numpy, encode_attr, infer_attr, sanitize
from ..reader import Collection
from ..streaming import blocks
from ..writer import save
from . import location
from .classic import ClassicFile, julian_day

#: File name endings of NetCDF files. Fixed values.
SUFFIXES = (".nc", ".nc4", ".cdf", ".netcdf")
TIMEDELTA_MARK = "_timedelta"
WHOLE = 4  # a file is opened whole if so many times its size fit the budget
WAVE = 64  # files a task takes in one wave
HELD = 8 << 20  # bytes of blocks that a task gathers before it hands them on


def find_files(spark: SparkSession, directory: Any, recursive: bool = True) -> list[tuple[str, int]]:
    """Path and size of the NetCDF files under a folder of any file system, sorted by the parts of their paths."""
    found = ((path, size) for path, size in location.files(spark, location.resolve(directory), recursive) if posixpath.splitext(path)[1].lower() in SUFFIXES)
    return sorted(found, key=lambda f: f[0].split("/"))


def dataset_name(target: Any) -> str:
    """What follows the last slash of a file's path, with its suffix; a plain name stays as it is."""
    return os.fspath(target).rstrip("/").rpartition("/")[2]


def check_mode(mode: Any) -> None:
    if mode is not None and not isinstance(mode, dict) and mode not in ("auto", "native"):
        raise InvalidValue(f"open_chunks is {mode!r}: it may be 'auto', 'native', None or sizes by dimension")


def parse_bytes(text: str | int) -> int:
    """A number of bytes such as ``64MiB`` or ``1.5 GB``."""
    if isinstance(text, int):
        return text
    t = text.strip().lower().replace(" ", "")
    for unit, n in (("kib", 1 << 10), ("mib", 1 << 20), ("gib", 1 << 30), ("tib", 1 << 40), ("kb", 10**3), ("mb", 10**6), ("gb", 10**9), ("tb", 10**12), ("b", 1)):
        if t.endswith(unit):
            return int(float(t[: -len(unit)]) * n)
    return int(t)


def fit_block(shape: list[int], item_bytes: int, budget: int) -> list[int]:
    """A block of at most ``budget`` bytes (one cell at least): the longest axes are halved first."""
    block = [max(1, s) for s in shape]
    while np.prod(block, dtype=float) * item_bytes > budget and max(block, default=1) > 1:
        k = block.index(max(block))
        block[k] = -(-block[k] // 2)
    return block


def block_shape(v: Any, mode: Any, budget: int, file_bytes: int, own: list[int] | None = None) -> list[int]:
    """The stored chunk shape of a variable: as stated for it, else by the mode."""
    shape = list(v.shape)
    stated = v.encoding.get("chunksizes") or ([c[0] for c in v.chunks] if v.chunks else None)
    if own is not None:
        block = own
    elif isinstance(mode, dict):
        block = [mode.get(d, s) if mode.get(d, s) > 0 else s for d, s in zip(v.dims, shape)]
    elif mode == "native" and stated:
        block = list(stated)
    elif mode == "auto" and file_bytes * WHOLE > budget:
        block = fit_block(shape, max(v.dtype.itemsize, 1), budget)
    else:
        block = shape
    if len(block) != len(shape):
        raise InvalidValue(f"chunks {block} don't fit the shape {shape}")
    return [max(1, min(b, s)) for b, s in zip(block, shape)]


def plain_fill(value: Any, dtype: np.dtype) -> Any:
    """A fill value, as files or callers give it, as the plain value of an array of ``dtype``."""
    if value is None:
        return None
    got = np.asarray(value)
    if got.dtype.kind in "mM":
        return int(got.astype(f"{got.dtype.kind}8[ns]").view(np.int64))
    value = got.item() if got.dtype.kind != "O" else value
    if dtype.kind in "mM" and value is not None:
        return int(value)
    if isinstance(value, bytes) and dtype.kind in "OSU":
        return value.decode("utf-8", "replace")
    return value


def resolve_fill(name: str, dtype: np.dtype, attributes: dict[str, Any], explicit: Any = None) -> Any:
    """The fill of an array: stated for it in a mapping (null: none), or as one number for all numeric arrays; else
    its ``_FillValue``; else that of its type."""
    if isinstance(explicit, dict) and name in explicit:
        return plain_fill(explicit[name], dtype)
    if explicit is not None and not isinstance(explicit, dict) and dtype.kind in "iuf":
        return plain_fill(explicit, dtype)
    if attributes.get("_FillValue") is not None:
        return plain_fill(attributes["_FillValue"], dtype)
    return NAT if dtype.kind == "m" else default_fill("timestamp_ns" if dtype.kind == "M" else "string" if dtype.kind in "OSU" else f"float{8 * dtype.itemsize}" if dtype.kind == "f" else "int64")


def texts(values: Any, fill: str, what: str) -> list[str]:
    """Text cells; what is missing becomes the fill, with a warning that says how many. Any other object is refused."""
    flat = np.asarray(values).ravel()
    gone = pd.isna(flat) if flat.dtype.kind == "O" else np.zeros(len(flat), bool)
    out = []
    for v, missing in zip(flat.tolist(), gone.tolist()):
        if missing:
            out.append(fill)
        elif isinstance(v, (str, bytes)):
            out.append(sanitize(v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v))
        else:
            raise UnsupportedType(f"{what} holds objects of type {type(v).__name__}; only texts are stored")
    if gone.any():
        warnings.warn(f"{what}: {int(gone.sum())} missing texts were stored as {fill!r}", stacklevel=2)
    return out


def first_object(v: Any) -> Any:
    """The first cell of an array of objects that isn't missing."""
    flat = np.asarray(v.values, object).ravel()
    return next((x for x, missing in zip(flat, pd.isna(flat)) if not missing), None)


def calendar_ns(values: Any) -> list[int]:
    """Exact instants of calendar dates, in nanoseconds since the epoch, by their Julian days; missing ones are NaT."""
    flat = np.asarray(values, object).ravel()
    out = []
    for d, missing in zip(flat, pd.isna(flat)):
        if missing:
            out.append(NAT)
            continue
        calendar = getattr(d, "calendar", "standard")
        gregorian = calendar == "proleptic_gregorian" or calendar in ("standard", "gregorian") and (d.year, d.month, d.day) >= (1582, 10, 15)
        if not gregorian and calendar not in ("julian", "standard", "gregorian"):
            raise UnsupportedType(f"a date of the calendar {calendar!r} names no instant; decode_times=False keeps the numbers")
        days = julian_day(d.year, d.month, d.day, gregorian) - 2_440_588
        ns = (days * 86_400 + d.hour * 3600 + d.minute * 60 + d.second) * 10**9 + getattr(d, "microsecond", 0) * 1000
        if not -(1 << 63) < ns < 1 << 63:
            raise InvalidValue(f"{d} is out of the range of nanosecond timestamps; decode_times=False keeps the numbers")
        out.append(ns)
    return out


_LETTER = {"int": "i", "timestamp": "i", "uint": "u", "float": "f", "bytes": "b"}
STAGED = T.StructType(
    [T.StructField(n, k) for n, k in (("tag", T.StringType()), ("ordinal", T.IntegerType()), ("array", T.StringType()), ("note", T.StringType()), ("layout", tables.LAYOUTS), ("attr", tables.ATTRS), ("stat", tables.STATS))]
    + [T.StructField(f"c{k}", T.LongType()) for k in range(tables.AXES)]
    + [T.StructField("cx", T.ArrayType(T.LongType())), *(T.StructField(f"v_{c}", T.ArrayType(k)) for c, k in STORAGE.items())]
)


class _Bounds:
    """Statistics of one array, block by block: cells that equal the fill are missing, NaN is never a bound."""

    def __init__(self, dtype: str, fill: Any):
        self.kind, self.fill, self.held, self.low, self.high = DTYPES[dtype][2], fill, 0, None, None

    def add(self, values: Any) -> None:
        if self.kind == "bytes":
            rest = [v for v in values if v != self.fill]
            self.held += len(rest)
            rest = [v.encode() if isinstance(v, str) else v for v in (min(rest), max(rest))] if rest else []
        else:
            x = np.asarray(values)
            missing = np.isnan(x) if isinstance(self.fill, float) and self.fill != self.fill else x == self.fill if self.fill is not None else np.zeros(x.shape, bool)
            rest = x[~missing]
            self.held += len(rest)
            rest = rest[~np.isnan(rest)] if self.kind == "float" else rest
            rest = [rest.min().item(), rest.max().item()] if len(rest) else []
        if rest:
            self.low, self.high = min(rest[0], rest[0] if self.low is None else self.low), max(rest[-1], rest[-1] if self.high is None else self.high)

    def row(self, array: str, ordinal: int, dtype: str, size: int) -> dict[str, Any]:
        letter = _LETTER[self.kind]
        wrap = Decimal if letter == "u" else lambda v: v
        return {"array": array, "ordinal": ordinal, "dtype": dtype, f"min_{letter}": None if self.low is None else wrap(self.low), f"max_{letter}": None if self.high is None else wrap(self.high), "null_count": size - self.held, "row_count": size}


def _cells(part: np.ndarray, dtype: str, calendar: bool, fill: Any, name: str) -> Any:
    """A block's values, flat, in the type of their storage column."""
    if calendar:
        return np.array(calendar_ns(part), np.int64)
    if dtype == "string":
        return texts(part, fill or "", name)
    part = np.asarray(part)
    if part.dtype.kind in "mM":
        return part.astype(f"{part.dtype.kind}8[ns]").view(np.int64).ravel()
    return part.ravel() if dtype == "uint64" else part.ravel().astype({"i": np.int64, "g": np.float32, "f": np.float64}[DTYPES[dtype][0]])


def convert(ordinal: int, dataset: str, ds: Any, options: dict[str, Any], file_bytes: int = 0) -> Iterator[dict[str, Any]]:
    """Staged rows of an xarray dataset: coordinates, then variables, block by block; then its attributes."""
    base = {"ordinal": ordinal}
    plans = []
    for name in [*ds.coords, *(n for n in ds.data_vars if n not in ds.coords)]:
        v = ds[name]
        sample = first_object(v) if v.dtype.kind == "O" and v.size else None
        calendar = hasattr(sample, "calendar")
        try:
            check_name(str(name))
            dtype = "timestamp_ns" if calendar else dtype_of_numpy(v.dtype.kind, v.dtype.itemsize)
            if dtype == "bool":
                raise UnsupportedType(f"array {name} of dtype bool can't be stored")
            if calendar and not options["convert_calendar"]:
                raise UnsupportedType(f"array {name} holds dates of the calendar {sample.calendar!r}; convert_calendar stores their exact instants, decode_times=False their numbers")
            if sample is not None and not calendar and not isinstance(sample, (str, bytes)):
                raise UnsupportedType(f"array {name} holds objects of type {type(sample).__name__}; only texts are stored")
        except UnsupportedType as e:
            if options["on_unsupported"] == "stop":
                raise
            yield {**base, "tag": "skipped", "array": str(name), "note": f"skipped array {str(name)!r} of dtype {v.dtype} of {dataset}: {e}", "layout": {"dtype": str(v.dtype)}}
            continue
        plans.append((str(name), v, dtype, calendar))
    for position, (name, v, dtype, calendar) in enumerate(plans):
        column, shape = DTYPES[dtype][0], list(v.shape)
        fill = check_fill(dtype, resolve_fill(name, np.dtype("M8[ns]") if calendar else v.dtype, {**v.encoding, **v.attrs}, options["fills"]))
        block = block_shape(v, options["mode"], options["budget"], file_bytes, (options["chunks"] or {}).get(name))
        stored = None if fill is None else {column: Decimal(fill) if column == "u" else fill}
        yield {**base, "tag": "layout", "layout": {**base, "position": position, "array": name, "dtype": dtype, "dims": [str(d) for d in v.dims], "shape": shape, "chunk_shape": block, "fill": stored, "is_coordinate": name in ds.coords}}
        bounds = _Bounds(dtype, fill)
        for start, size in blocks(shape, block):
            values = _cells(v[tuple(slice(a, a + n) for a, n in zip(start, size))].values, dtype, calendar, fill, name)
            bounds.add(values)
            at = [a // b for a, b in zip(start, block)]
            yield {**base, "tag": "chunk_" + column, "array": name, **{f"c{k}": c for k, c in enumerate(at[: tables.AXES])}, "cx": at[tables.AXES :] or None, f"v_{column}": [Decimal(int(x)) for x in values] if column == "u" else values}
        yield {**base, "tag": "stat", "stat": bounds.row(name, ordinal, dtype, int(np.prod(shape, dtype=np.int64)))}
        own = {k: x for k, x in v.attrs.items() if k != "_FillValue"} | ({TIMEDELTA_MARK: "ns"} if v.dtype.kind == "m" else {})
        yield from _attributes(ordinal, name, own)
    yield from _attributes(ordinal, None, ds.attrs)


def _attributes(ordinal: int, array: str | None, attrs: dict[str, Any]) -> Iterator[dict[str, Any]]:
    for pos, (key, value) in enumerate(attrs.items()):
        dtype, value = infer_attr(encode_attr(value))
        yield {"tag": "attr", "ordinal": ordinal, "attr": {"ordinal": ordinal, "array": array, "pos": pos, "key": str(key), "dtype": dtype, **attr_row(dtype, value)}}


def _open(path: str, content: bytes | None, options: dict[str, Any]) -> Any:
    if options["opener"] is not None:
        return options["opener"](path)
    try:
        import xarray
    except ImportError:
        return ClassicFile(path if content is None else content, options["decode_times"])
    if content is not None:
        with tempfile.NamedTemporaryFile(suffix=".nc") as f:  # of this task alone
            f.write(content)
            f.flush()
            return xarray.load_dataset(f.name, decode_times=options["decode_times"])
    return xarray.open_dataset(path, decode_times=options["decode_times"])  # lazy: slices are read when they are asked for


def _ingest(options: dict[str, Any]):
    """A task: staged rows of its files, a block or a file's small rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(STAGED)

    def batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for files in batches:
            for f in files.to_pylist():
                name, told = dataset_name(f["path"]), []
                try:
                    with warnings.catch_warnings(record=True) as told, _open(f["path"], f.get("content"), options) as ds:
                        warnings.simplefilter("always")
                        for row in convert(f["ordinal"], name, ds, options, f["size"]):
                            held.append(row)
                            values = row.get("v_" + row["tag"][6:]) if row["tag"].startswith("chunk_") else ()
                            size += getattr(values, "nbytes", 64 * len(values)) + 100
                            if size > HELD:
                                yield batch(held)
                                held, size = [], 0
                    held.append({"tag": "dataset", "ordinal": f["ordinal"], "note": name})
                except Exception as e:  # noqa: BLE001 - what a file can't be read for is for the driver to judge
                    held.append({"tag": "error", "ordinal": f["ordinal"], "note": f"{type(e).__name__}: {e}"})
                held += [{"tag": "warning", "ordinal": f["ordinal"], "note": f"{name}: {w.message}"} for w in told]
        if held:
            yield batch(held)

    return run


def ingest(spark: SparkSession, files: list[tuple[str, int]], destination: Any, *, codec: str, chunks: Any, mode: Any, budget: int, decode_times: bool, convert_calendar: bool, workers: int | None, on_error: str, on_unsupported: str, progress: Callable[[str], None] | None, opener: Callable | None = None, fills: Any = None) -> dict[str, Any]:
    """Convert files on at most ``workers`` tasks at once (default: the cluster's cores); ordinals follow the order of files.

    Files go in waves of ``WAVE`` a task: after each, ``progress`` hears of the datasets that landed, and a file that
    failed stops the ingest (or is skipped). Nothing is seen at the destination before all have landed.
    """
    LOGGER.info("ingesting %d file(s) into %s", len(files), destination)
    skipped: list[dict[str, str]] = []
    names: dict[str, str] = {}
    for path, _ in files:
        if dataset_name(path) in names:
            e = DatasetAlreadyExists(dataset_name(path))
            if on_error == "stop":
                raise e
            skipped.append({"file": path, "error": f"dataset {e} is already there"})
        else:
            names[dataset_name(path)] = path
    sizes = dict(files)
    wanted = [(i, path, sizes[path]) for i, path in enumerate(names.values())]
    tasks = workers or spark.sparkContext.defaultParallelism
    options = {"chunks": chunks, "mode": mode, "budget": budget, "decode_times": decode_times, "convert_calendar": convert_calendar, "on_unsupported": on_unsupported, "opener": opener, "fills": fills}
    staged = f"{location.resolve(destination).rstrip('/')}/staging/{uuid.uuid4().hex}"
    arrays, lost = [], set()
    try:
        for at in range(0, len(wanted), tasks * WAVE):
            wave = wanted[at : at + tasks * WAVE]
            _stage(spark, wave, tasks, options, f"{staged}/{at}")
            told = spark.read.schema(STAGED).parquet(f"{staged}/{at}").where(F.col("tag").isin("error", "skipped", "warning", "dataset")).select("tag", "ordinal", "array", "note", "layout.dtype").orderBy("ordinal", "array").collect()
            for r in told:
                path = wanted[r.ordinal][1]
                if r.tag == "error":
                    if on_error == "stop":
                        LOGGER.error("%s: %s", path, r.note)
                        raise CollectionError(f"{path}: {r.note}")
                    LOGGER.warning("skipping %s: %s", path, r.note)
                    skipped.append({"file": path, "error": r.note})
                    lost.add(r.ordinal)
                elif r.tag == "skipped":
                    LOGGER.warning("%s", r.note)
                    arrays.append({"dataset": dataset_name(path), "array": r.array, "dtype": r.dtype})
                elif r.tag == "warning":
                    LOGGER.warning("%s", r.note)
                elif progress:
                    progress(r.note)
        kept = [o for o, *_ in wanted if o not in lost]
        save(_collection(spark, [f"{staged}/{at}" for at in range(0, len(wanted), tasks * WAVE)], {o: i for i, o in enumerate(kept)}, [dataset_name(wanted[o][1]) for o in kept]), destination, codec)
    finally:
        location.delete(spark, staged.rpartition("/")[0])
    LOGGER.info("wrote %d dataset(s) to %s; skipped %d file(s) and %d array(s)", len(kept), destination, len(skipped), len(arrays))
    return {"destination": str(destination), "dataset_count": len(kept), "datasets": [dataset_name(wanted[o][1]) for o in kept], "skipped": skipped, "skipped_arrays": arrays}


def _stage(spark: SparkSession, wave: list[tuple[int, str, int]], tasks: int, options: dict[str, Any], path: str) -> None:
    local = all("://" not in p for _, p, _ in wave)
    rows = spark.createDataFrame(wave, "ordinal int, path string, size long")
    if not local and options["opener"] is None:  # only Spark's file systems reach them: their bytes travel with the rows
        rows = rows.join(spark.read.format("binaryFile").load([p for _, p, _ in wave]).select("path", "content"), "path")
    dealt = rows.repartition(min(tasks, len(wave)), F.pmod("ordinal", F.lit(tasks)))
    dealt.mapInArrow(_ingest(options), STAGED).write.option("maxRecordsPerFile", 0).partitionBy("tag").parquet(path)


def _collection(spark: SparkSession, paths: list[str], places: dict[int, int], names: list[str]) -> Collection:
    """The logical tables as selections of the staged rows of the files that landed whole, renumbered without gaps."""
    moved = spark.createDataFrame(list(places.items()), "ordinal int, place int")
    staged = (spark.read.schema(STAGED).option("basePath", p).parquet(p) for p in paths)
    rows: DataFrame | None = None
    for p in staged:
        rows = p if rows is None else rows.unionByName(p)
    if rows is None:
        rows = spark.createDataFrame([], STAGED)
    rows = rows.join(F.broadcast(moved) if len(places) <= 100_000 else moved, "ordinal")

    def part(tag: str, column: str, schema: T.StructType) -> DataFrame:
        return rows.where(F.col("tag") == tag).select(*((F.col("place") if f.name == "ordinal" else F.col(f"{column}.{f.name}")).alias(f.name) for f in schema))

    used = [r.tag.removeprefix("chunk_") for r in rows.select("tag").distinct().collect() if r.tag.startswith("chunk_")]
    chunks = {c: rows.where(F.col("tag") == f"chunk_{c}").select(F.col("place").alias("ordinal"), "array", *(f"c{k}" for k in range(tables.AXES)), "cx", F.col(f"v_{c}").alias("values")) for c in used}
    datasets = spark.createDataFrame(list(enumerate(names)), tables.DATASETS)
    return Collection(spark, datasets, part("layout", "layout", tables.LAYOUTS), part("attr", "attr", tables.ATTRS), part("stat", "stat", tables.STATS), spark.createDataFrame([], tables.MASK), chunks)


__all__ = ["SUFFIXES", "block_shape", "calendar_ns", "convert", "dataset_name", "find_files", "fit_block", "ingest", "parse_bytes", "plain_fill", "resolve_fill", "texts"]
