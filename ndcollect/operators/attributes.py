"""Attribute columns over datasets and their join into a catalogue table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def column(attrs: DataFrame, key: str, array: str | None = None) -> DataFrame:
    """Rows of one attribute, of datasets or of one array; datasets without it have no row."""
    scope = F.col("array").isNull() if array is None else F.col("array") == array
    return attrs.where(scope & (F.col("key") == key))


def catalogue(datasets: DataFrame, attrs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Datasets with a column for each key (``keys``: key -> storage column); null where a dataset lacks it. One shuffle of the attributes."""
    rows = attrs.where(F.col("array").isNull() & F.col("key").isin(*keys))
    picks = [F.max(F.when(F.col("key") == k, F.col(c))).alias(k) for k, c in keys.items()]
    return datasets.join(rows.groupBy("ordinal").agg(*picks), "ordinal", "left")
