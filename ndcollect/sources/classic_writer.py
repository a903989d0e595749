"""Writer of small NetCDF classic files, for exports, benches and tests."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

TAGS = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}


def write(path: Any, dims: dict[str, int | None], variables: dict[str, tuple], attrs: Any = (), version: int = 1) -> None:
    with open(path, "wb") as f:
        f.write(encode(dims, variables, attrs, version))


def encode(dims: dict[str, int | None], variables: dict[str, tuple], attrs: Any = (), version: int = 1) -> bytes:
    """A file's bytes. ``dims``: name -> size (None: the record dimension); ``variables``: name -> (dims, array, attributes)."""
    count = lambda n: struct.pack(">q" if version == 5 else ">i", n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: count(len(s.encode())) + pad(s.encode())

    def attribute(key, value):
        if isinstance(value, (str, bytes)):
            raw = value.encode() if isinstance(value, str) else value
            return name(key) + struct.pack(">i", 2) + count(len(raw)) + pad(raw)
        x = np.atleast_1d(value)
        x = x.astype(x.dtype.newbyteorder(">"))
        return name(key) + struct.pack(">i", TAGS[x.dtype.str[1:]]) + count(len(x)) + pad(x.tobytes())

    def attributes(items):
        items = dict(items)
        return (struct.pack(">i", 12) if items else struct.pack(">i", 0)) + count(len(items)) + b"".join(attribute(k, v) for k, v in items.items())

    names = list(dims)
    records = next((len(a) for d, a, _ in variables.values() if d and dims[d[0]] is None), 0)
    arrays = {}
    for n, (d, a, at) in variables.items():
        a = np.asarray(a)
        arrays[n] = d, a.astype(a.dtype.newbyteorder(">")) if a.dtype.kind != "S" else a, at, bool(d) and dims[d[0]] is None

    def header(begins):
        out = b"CDF" + bytes([version]) + count(records)
        out += struct.pack(">i", 10 if dims else 0) + count(len(dims)) + b"".join(name(k) + count(n or 0) for k, n in dims.items())
        out += attributes(attrs) + struct.pack(">i", 11 if arrays else 0) + count(len(arrays))
        for n, (d, a, at, grows) in arrays.items():
            size = a[0].nbytes if grows and records else a.nbytes
            out += name(n) + count(len(d)) + b"".join(count(names.index(x)) for x in d) + attributes(at) + struct.pack(">i", TAGS[a.dtype.str[1:]]) + count(-(-size // 4) * 4)
            out += struct.pack(">q" if version in (2, 5) else ">i", begins.get(n, 0))
        return out

    at, begins = len(header({})), {}
    for n, (_, a, _, grows) in arrays.items():
        if not grows:
            begins[n] = at
            at += -(-a.nbytes // 4) * 4
    growing = [n for n, x in arrays.items() if x[3]]
    for n in growing:
        begins[n] = at
        at += -(-arrays[n][1][0].nbytes // 4) * 4 if records else 0
    data = header(begins) + b"".join(pad(a.tobytes()) for _, a, _, grows in arrays.values() if not grows)
    for r in range(records):
        for n in growing:
            raw = arrays[n][1][r : r + 1].tobytes()
            data += raw if len(growing) == 1 else pad(raw)
    return data
