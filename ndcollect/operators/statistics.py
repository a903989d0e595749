"""Fill-aware statistics: per dataset (partial) and of a whole collection (final)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ndindex import element_count
from ..model import DTYPES
from ..tables import STATS

_BOUNDS = {"int": "i", "timestamp": "i", "uint": "u", "float": "f", "bytes": "b"}


def is_missing(value: Column, fill: Column) -> Column:
    """A cell counts as null if nobody wrote it or if it equals the fill; NaN equals NaN."""
    return value.isNull() | F.coalesce(value.eqNullSafe(fill) & fill.isNotNull(), F.lit(False))


def partial(cells: DataFrame, layouts: DataFrame, dtype: str) -> DataFrame:
    """Statistics rows of one array's cells (ordinal, value, and fill_value where there is a fill), one a dataset of ``layouts``.

    Cells are summed map-side by dataset; datasets that have the array but no cell come from ``layouts``.
    """
    kind = DTYPES[dtype][2]
    letter = _BOUNDS[kind]
    sizes = layouts.select("ordinal", "array", element_count(F.col("shape")).alias("row_count"))
    value = F.col("value")
    missing = is_missing(value, F.col("fill_value")) if "fill_value" in cells.columns else value.isNull()
    valid = F.when(~missing, value)
    bound = F.nullif(valid.cast("double"), F.lit(float("nan"))) if kind == "float" else valid.cast("binary") if kind == "bytes" else valid
    grouped = cells.groupBy("ordinal").agg(F.count(valid).alias("held"), F.min(bound).alias("low"), F.max(bound).alias("high"))
    rows = sizes.join(grouped, "ordinal", "left")
    out = [F.col("array"), F.col("ordinal"), F.lit(dtype).alias("dtype")]
    for f in STATS.fields[3:-2]:
        own = f.name.endswith("_" + letter)
        out.append((F.col("low" if f.name.startswith("min") else "high") if own else F.lit(None)).cast(f.dataType).alias(f.name))
    return rows.select(*out, (F.col("row_count") - F.coalesce("held", F.lit(0))).alias("null_count"), "row_count")


def final(stats: DataFrame, *by: str) -> DataFrame:
    """Statistics of several datasets as one: counts add, bounds widen, absent bounds yield.

    Where datasets hold an array in different classes of types, those of the first holder's class count.
    """
    kind = F.create_map(*[F.lit(x) for name, (_, _, k) in DTYPES.items() for x in (name, k)])[F.col("dtype")]
    rows = stats.withColumn("__class", kind)
    first = rows.groupBy("array").agg(F.min_by("__class", "ordinal").alias("__first"))
    rows = rows.join(first, "array").where(F.col("__class") == F.col("__first"))
    bounds = [getattr(F, f.name[:3])(f.name).alias(f.name) for f in STATS.fields[3:-2]]
    return rows.groupBy("array", *by).agg(*bounds, F.sum("null_count").alias("null_count"), F.sum("row_count").alias("row_count"))
