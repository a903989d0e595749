"""Listing, lookup, schemas and deletion over the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ndindex import element_count


def live(datasets: DataFrame, mask: DataFrame) -> DataFrame:
    """Datasets that the deletion mask doesn't hide."""
    return datasets.join(mask.select("ordinal"), "ordinal", "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def array_names(layouts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Distinct array names of the given datasets, sorted."""
    return layouts.join(datasets.select("ordinal"), "ordinal", "left_semi").select("array").distinct().orderBy("array")


def dimensions(layouts: DataFrame) -> DataFrame:
    """ordinal, dim, size: each dimension's size at its first use, in the order of arrays and axes."""
    rows = layouts.select("ordinal", "position", F.posexplode(F.arrays_zip("dims", "shape")).alias("axis", "d"))
    return rows.groupBy("ordinal", F.col("d.dims").alias("dim")).agg(F.min_by("d.shape", F.struct("position", "axis")).alias("size"))


def schemas(datasets: DataFrame, layouts: DataFrame, attrs: DataFrame) -> DataFrame:
    """ordinal and schema: arrays (name, type, attribute keys) in order, and dataset attributes (key, type) in order.

    Order counts, shapes don't.
    """
    keys = attrs.where("array IS NOT NULL").groupBy("ordinal", "array").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "dtype"))).alias("k"))
    arrays = layouts.join(keys, ["ordinal", "array"], "left").groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("position", "array", "dtype", "k"))).alias("a"))
    own = attrs.where("array IS NULL").groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "dtype"))).alias("d"))
    pair = "array<struct<key:string,dtype:string>>"
    pairs = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x.key.alias("key"), x.dtype.alias("dtype"))), F.array().cast(pair))
    entries = F.transform(F.col("a"), lambda x: F.struct(x.array.alias("name"), x.dtype.alias("dtype"), pairs(x.k).alias("attributes")))
    none = F.array().cast(f"array<struct<name:string,dtype:string,attributes:{pair}>>")
    rows = datasets.select("ordinal").join(arrays, "ordinal", "left").join(own, "ordinal", "left")
    return rows.select("ordinal", F.struct(F.coalesce(entries, none).alias("arrays"), pairs(F.col("d")).alias("attributes")).alias("schema"))


def interned(schemas: DataFrame) -> DataFrame:
    """ordinal and schema_id: equal schemas have one number, by first appearance."""
    first = schemas.groupBy("schema").agg(F.min("ordinal").alias("first"))
    number = first.withColumn("schema_id", F.row_number().over(Window.orderBy("first")) - 1)
    return schemas.join(number, "schema").select("ordinal", "schema_id")


def merged(layouts: DataFrame, attrs: DataFrame) -> DataFrame:
    """scope, array, name, dtypes: every type that a name has anywhere, deleted datasets included; types never merge."""
    none = F.lit(None).cast("string")
    rows = layouts.select(F.lit("array").alias("scope"), none.alias("array"), F.col("array").alias("name"), "dtype")
    scope = F.when(F.col("array").isNull(), F.lit("attribute")).otherwise(F.lit("array_attribute"))
    rows = rows.unionByName(attrs.select(scope.alias("scope"), "array", F.col("key").alias("name"), "dtype"))
    return rows.groupBy("scope", "array", "name").agg(F.array_sort(F.collect_set("dtype")).alias("dtypes"))


def faults(datasets: DataFrame, layouts: DataFrame, attrs: DataFrame, stats: DataFrame | None = None, mask: DataFrame | None = None, chunks: list[DataFrame] | None = None) -> DataFrame:
    """What contradicts what, in tables of names, layouts and attributes and, where given, of statistics, mask and chunks: empty for a sound collection."""
    orphan = lambda t, name: t.join(datasets, "ordinal", "left_anti").select(F.concat(F.lit(f"{name} of unknown dataset "), F.col("ordinal").cast("string")).alias("fault")).distinct()
    twice = lambda t, keys, what: t.groupBy(*keys).count().where("count > 1").select(F.concat_ws(" ", F.lit(what), *(F.col(k).cast("string") for k in keys)).alias("fault"))
    lost = attrs.where("array IS NOT NULL").join(layouts, ["ordinal", "array"], "left_anti").select(F.concat_ws(" ", F.lit("attribute of unknown array"), "array").alias("fault"))
    odd = layouts.where((F.size("shape") != F.size("dims")) | (F.size("shape") != F.size("chunk_shape"))).select(F.concat_ws(" ", F.lit("axes differ in array"), "array").alias("fault"))
    parts = [orphan(layouts, "layout"), orphan(attrs, "attribute"), twice(datasets, ["name"], "dataset name repeats:"), twice(datasets, ["ordinal"], "ordinal repeats:"), twice(layouts, ["ordinal", "array"], "array repeats:"), lost, odd]
    named = lambda t, what: t.select(F.concat_ws(" ", F.lit(what), "array", F.col("ordinal").cast("string")).alias("fault")).distinct()
    if stats is not None:
        counted = stats.join(layouts.select("ordinal", "array", F.col("dtype").alias("declared"), element_count(F.col("shape")).alias("size")), ["ordinal", "array"], "left")
        parts.append(named(counted.where("size IS NULL"), "statistics of undeclared array"))
        parts.append(named(counted.where("declared <> dtype OR size <> row_count OR null_count NOT BETWEEN 0 AND row_count"), "statistics contradict array"))
    if mask is not None:
        parts.append(orphan(mask, "mask"))
    for rows in chunks or []:
        held = rows.join(layouts.select("ordinal", "array", "shape", "chunk_shape"), ["ordinal", "array"], "left")
        parts.append(named(held.where("shape IS NULL"), "chunk of undeclared array"))
        at = F.concat(F.filter(F.array("c0", "c1", "c2", "c3"), lambda c: c.isNotNull()), F.coalesce("cx", F.array().cast("array<bigint>")))
        size = F.aggregate(F.arrays_zip(at.alias("at"), "shape", "chunk_shape"), F.lit(1).cast("long"), lambda n, x: n * F.least(x.chunk_shape, x.shape - x["at"] * x.chunk_shape))
        parts.append(named(held.where((F.size(at) != F.size("shape")) | (size != F.size("values"))), "chunk of wrong size in array"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
