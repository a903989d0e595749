"""Schemas of the logical tables that make up a collection."""

from __future__ import annotations

from pyspark.sql import types as T

from .model import STORAGE

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TYPED = {k: v for k, v in STORAGE.items() if k not in ("g", "t")}
DATASETS = _struct(ordinal=_I, name=_S)
LAYOUTS = _struct(ordinal=_I, position=_I, array=_S, dtype=_S, dims=T.ArrayType(_S), shape=T.ArrayType(_L), chunk_shape=T.ArrayType(_L), fill=T.StructType([T.StructField(k, v) for k, v in STORAGE.items()]), is_coordinate=T.BooleanType())
ATTRS = T.StructType([*_struct(ordinal=_I, array=_S, pos=_I, key=_S, dtype=_S).fields, *(T.StructField(k, v) for k, v in _TYPED.items()), *(T.StructField(f"{k}s", T.ArrayType(v)) for k, v in _TYPED.items())])
STATS = _struct(array=_S, ordinal=_I, dtype=_S, min_i=_L, max_i=_L, min_u=STORAGE["u"], max_u=STORAGE["u"], min_f=T.DoubleType(), max_f=T.DoubleType(), min_b=T.BinaryType(), max_b=T.BinaryType(), null_count=_L, row_count=_L)
MASK = _struct(ordinal=_I)
AXES = 4  # scalar chunk coordinates, for pushed-down filters; further axes are in ``cx``


def chunks(column: str) -> T.StructType:
    return T.StructType([*_struct(ordinal=_I, array=_S).fields, *(T.StructField(f"c{k}", _L) for k in range(AXES)), T.StructField("cx", T.ArrayType(_L)), T.StructField("values", T.ArrayType(STORAGE[column]))])
