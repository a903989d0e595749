"""Reader of NetCDF classic files (CDF-1, CDF-2 and CDF-5) without other packages, by the published format.

Variables are read lazily through a memory map, slice by slice. Times in "<unit> since <date>" are decoded to
nanoseconds where their calendar is the real one, and to dates of their own calendar elsewhere; packed values
(``scale_factor``, ``add_offset``) are unpacked. The objects have as much of xarray's shape as ingest looks at.
"""

from __future__ import annotations

import datetime
import math
import mmap
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..errors import SourceError

#: External types by their tag. Fixed values of the format.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_UNITS = {"days": 86_400 * 10**9, "day": 86_400 * 10**9, "hours": 3600 * 10**9, "hour": 3600 * 10**9, "h": 3600 * 10**9, "minutes": 60 * 10**9, "minute": 60 * 10**9, "seconds": 10**9, "second": 10**9, "s": 10**9, "milliseconds": 10**6, "microseconds": 10**3}
_SINCE = re.compile(r"\s*(\w+)\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?")


@dataclass(frozen=True)
class CalendarDate:
    """A date of a calendar, with as much of cftime's shape as conversion looks at."""

    year: int
    month: int
    day: int
    hour: int
    minute: int
    second: int
    microsecond: int
    calendar: str


def _julian(day: int) -> tuple[int, int, int]:
    """Year, month and day of the Julian calendar from a Julian day number."""
    c = day + 32_082
    d = (4 * c + 3) // 1461
    e = c - 1461 * d // 4
    m = (5 * e + 2) // 153
    return d - 4800 + m // 10, m + 3 - 12 * (m // 10), e - (153 * m + 2) // 5 + 1


def julian_day(y: int, m: int, d: int, gregorian: bool) -> int:
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 + (yy // 400 - yy // 100 - 32_045 if gregorian else -32_083)


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    attrs: dict[str, Any]
    load: Callable[[tuple[slice, ...]], np.ndarray]
    encoding: dict[str, Any] = field(default_factory=dict)
    chunks: None = None

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))

    @property
    def values(self) -> np.ndarray:
        return self.load(tuple(slice(0, n) for n in self.shape))

    def __getitem__(self, key: tuple[slice, ...]) -> "_Part":
        return _Part(self.load(tuple(slice(*k.indices(n)) for k, n in zip(key, self.shape))))


@dataclass
class _Part:
    values: np.ndarray


class _Header:
    def __init__(self, data: Any):
        self.data, self.at = data, 4
        kind = data[3]
        self.wide, self.far = kind == 5, kind in (2, 5)

    def take(self, form: str) -> Any:
        got = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return got[0]

    def count(self) -> int:
        return self.take("q" if self.wide else "i")

    def name(self) -> str:
        n = self.count()
        text = bytes(self.data[self.at : self.at + n]).decode("utf-8", "surrogateescape")
        self.at += -(-n // 4) * 4
        return text

    def values(self) -> Any:
        kind, n = self.take("i"), self.count()
        dtype = np.dtype(_TYPES[kind])
        size = n * dtype.itemsize
        raw = bytes(self.data[self.at : self.at + size])
        self.at += -(-size // 4) * 4
        if kind == 2:
            return raw.decode("utf-8", "surrogateescape").rstrip("\0")
        got = np.frombuffer(raw, dtype).astype(dtype.newbyteorder("="))
        return got[0] if n == 1 else got

    def list_of(self, tag: int, one: Callable[[], Any]) -> list[Any]:
        found, n = self.take("i"), self.count()
        if found not in (0, tag) or n and found != tag:
            raise SourceError("not a NetCDF classic file: a list of the header is malformed")
        return [one() for _ in range(n)]

    def attributes(self) -> dict[str, Any]:
        return dict(self.list_of(_ATTRIBUTES, lambda: (self.name(), self.values())))


class ClassicFile:
    """A file as coordinates, data variables and attributes; a context manager that closes it."""

    def __init__(self, source: Any, decode_times: bool = True):
        self._file = None if isinstance(source, (bytes, bytearray)) else open(source, "rb")
        try:
            self._data = source if self._file is None else mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
            if bytes(self._data[:3]) != b"CDF" or self._data[3] not in (1, 2, 5):
                raise SourceError("not a NetCDF classic file")
            self._parse(decode_times)
        except (ValueError, struct.error, IndexError, KeyError) as e:
            self.close()
            raise e if isinstance(e, SourceError) else SourceError(f"not a NetCDF classic file: {e}") from e

    def _parse(self, decode_times: bool) -> None:
        h = _Header(self._data)
        records = h.count()
        dims = h.list_of(_DIMENSIONS, lambda: (h.name(), h.count()))
        self.attrs = h.attributes()

        def variable():
            name = h.name()
            own = [dims[h.count()] for _ in range(h.count())]
            attrs, kind, size = h.attributes(), h.take("i"), h.count()
            return name, own, attrs, np.dtype(_TYPES[kind]), size, h.take("q" if h.far else "i")

        found = h.list_of(_VARIABLES, variable)
        growing = [v for v in found if v[1] and v[1][0][1] == 0]
        step = sum(v[4] for v in growing)
        if len(growing) == 1:  # a single record variable is not padded
            step = growing[0][3].itemsize * int(np.prod([n for _, n in growing[0][1][1:]], dtype=np.int64))
        variables = {}
        for name, own, attrs, dtype, _, begin in found:
            shape = tuple(records if n == 0 else n for _, n in own)
            variables[name] = _decoded(self._raw(tuple(d for d, _ in own), shape, dtype, attrs, begin, step if own and own[0][1] == 0 else 0), decode_times)
        listed = {c for v in variables.values() for c in str(v.attrs.get("coordinates", "")).split()}
        coordinate = lambda n: variables[n].dims == (n,) or n in listed
        self.coords = {n: v for n, v in variables.items() if coordinate(n)}
        self.data_vars = {n: v for n, v in variables.items() if not coordinate(n)}

    def _raw(self, dims: tuple[str, ...], shape: tuple[int, ...], dtype: np.dtype, attrs: dict[str, Any], begin: int, step: int) -> Variable:
        inner = np.cumprod([dtype.itemsize, *reversed(shape[1:])])[::-1].tolist() if shape else []
        strides = [step, *inner[1:]] if step and shape else inner

        def load(key: tuple[slice, ...]) -> np.ndarray:
            if not shape:
                return np.frombuffer(self._data, dtype, 1, begin).reshape(()).astype(dtype.newbyteorder("="))
            if 0 in shape:
                return np.zeros([len(range(n)[k]) for n, k in zip(shape, key)], dtype.newbyteorder("="))
            return np.ndarray(shape, dtype, self._data, begin, strides)[key].astype(dtype.newbyteorder("="))

        if dtype.kind == "S" and shape:  # characters: the last axis holds a text
            def text(key: tuple[slice, ...]) -> np.ndarray:
                rows = load((*key, slice(0, shape[-1])))
                whole = np.ascontiguousarray(rows.reshape(-1, max(shape[-1], 1))).view(f"S{max(shape[-1], 1)}").ravel().tolist() if rows.size else [b""] * math.prod(rows.shape[:-1])
                flat = [t.rstrip(b" \0").decode("utf-8", "surrogateescape") for t in whole]
                out = np.empty(len(flat), object)
                out[:] = flat
                return out.reshape(rows.shape[:-1])

            return Variable(dims[:-1], shape[:-1], np.dtype(object), attrs, text)
        return Variable(dims, shape, dtype.newbyteorder("="), attrs, load)

    def __getitem__(self, name: str) -> Variable:
        return self.coords[name] if name in self.coords else self.data_vars[name]

    def close(self) -> None:
        if self._file is not None:
            self._file.close()

    def __enter__(self) -> "ClassicFile":
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def _decoded(v: Variable, decode_times: bool) -> Variable:
    """The variable with packed values unpacked and times as instants or dates; attributes used for that move to its encoding."""
    since = _SINCE.match(str(v.attrs.get("units", ""))) if decode_times and v.dtype.kind in "iuf" else None
    if since and since[1].lower() in _UNITS:
        return _times(v, since)
    if {"scale_factor", "add_offset"} & v.attrs.keys():
        scale, offset, fill = float(v.attrs.get("scale_factor", 1)), float(v.attrs.get("add_offset", 0)), v.attrs.get("_FillValue")
        attrs = {k: x for k, x in v.attrs.items() if k not in ("scale_factor", "add_offset", "_FillValue")}

        def unpacked(key: tuple[slice, ...]) -> np.ndarray:
            raw = v.load(key)
            return np.where(raw == fill, np.nan, raw * scale + offset) if fill is not None else raw * scale + offset

        return Variable(v.dims, v.shape, np.dtype(float), attrs, unpacked)
    return v


def _times(v: Variable, since: re.Match) -> Variable:
    unit = _UNITS[since[1].lower()]
    y, m, d = (int(since[k]) for k in (2, 3, 4))
    of_day = (int(since[5] or 0) * 3600 + int(since[6] or 0) * 60) * 10**9 + round(float(since[7] or 0) * 10**9)
    calendar = str(v.attrs.get("calendar", "standard")).lower()
    real = calendar == "proleptic_gregorian" or calendar in ("standard", "gregorian") and (y, m, d) >= (1582, 10, 15)
    fill = v.attrs.get("_FillValue")
    attrs = {k: x for k, x in v.attrs.items() if k not in ("units", "calendar", "_FillValue")}
    start = julian_day(y, m, d, real) if real or calendar == "julian" else 0

    def nanos(x: Any) -> int | None:
        return None if x != x or fill is not None and x == fill else round(x * unit) if isinstance(x, float) else x * unit

    def stamps(key: tuple[slice, ...]) -> np.ndarray:
        raw = v.load(key)
        base = (start - 2_440_588) * 86_400 * 10**9 + of_day
        got = [nanos(x) for x in raw.ravel().tolist()]
        if any(n is not None and not -(1 << 63) < n + base < 1 << 63 for n in got):
            raise SourceError("a date is out of the range of nanosecond timestamps; decode_times=False keeps the numbers")
        return np.array([np.iinfo(np.int64).min if n is None else n + base for n in got], np.int64).view("datetime64[ns]").reshape(raw.shape)

    def dates(key: tuple[slice, ...]) -> np.ndarray:
        raw = v.load(key)
        out = np.empty(raw.size, object)
        for i, x in enumerate(raw.ravel().tolist()):
            n = nanos(x)
            if n is None:
                continue
            days, rest = divmod(n + of_day, 86_400 * 10**9)
            clock = (datetime.datetime.min + datetime.timedelta(microseconds=rest // 1000)).time()
            ymd = _julian(start + days) if calendar == "julian" else (y, m, d)  # other calendars name no instant; conversion refuses them
            out[i] = CalendarDate(*ymd, clock.hour, clock.minute, clock.second, clock.microsecond, calendar)
        return out.reshape(raw.shape)

    return Variable(v.dims, v.shape, np.dtype("datetime64[ns]") if real else np.dtype(object), attrs, stamps if real else dates)
