"""Collections over the star-schema tables, the queries on them, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model
from ..functions import conversions
from ..functions.ndindex import element_count
from ..operators import attributes, catalogue, hyperslab, statistics
from ..reader import Collection
from ..sources.ingest import ArraySpec, from_dataframe, union

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _numbered(rows: DataFrame, by: str, order: str, width: int = 1 << 16) -> DataFrame:
    """Rows with their place among those of the same dataset, from 0, in the order of an integer key.

    Places are counted within stretches of ``width`` keys, and stretches are offset by running sums of their
    counts, so a dataset with a third of all rows is still many tasks.
    """
    rows = rows.withColumn("__b", F.floor(F.col(order) / width))
    counts = rows.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(by, "__b", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(by, "__b").orderBy(order)) - 1
    return rows.withColumn("__place", place).join(offsets, [by, "__b"]).withColumn("i", (F.col("__place") + F.col("__before")).cast("long")).drop("__b", "__place", "__before")


def events(spark: SparkSession, sf: str, *, indexed: bool = True, fill=None, value: str | None = "value", written=None, chunk: list[int] | None = None, attrs=None, dtype: str = "float64") -> Collection:
    """Five datasets by event type; ``value`` is one-dimensional in the order of event ids.

    Where only statistics are asked for, places aren't needed (``indexed=False``) and the shape is the row count.
    """
    rows = _read(spark, sf, "events")
    if indexed:
        rows = _numbered(rows, "event_type", "event_id")
        return from_dataframe(rows, "event_type", {"value": ArraySpec(value, {"obs": "i"}, dtype, fill, chunk, written)}, attrs)
    return _counted(rows, "event_type", {"value": (value, dtype, fill)}, attrs)


def _counted(rows: DataFrame, dataset: str, arrays: dict[str, tuple], attrs=None) -> Collection:
    """A collection for statistics alone: each dataset is as long as it has rows."""
    return from_dataframe(rows, dataset, {k: ArraySpec(v, {"obs": None}, t, f) for k, (v, t, f) in arrays.items()}, attrs)


def vectors(spark: SparkSession, sf: str, chunk: list[int] | None = None) -> Collection:
    """Ten datasets by label; ``embedding`` is a float32 matrix, a row a vector, in the order of vector ids."""
    rows = _numbered(_read(spark, sf, "embeddings").withColumn("name", F.concat(F.lit("label-"), F.col("label"))), "label", "vec_id")
    cells = rows.select("name", "i", F.posexplode("embedding").alias("j", "v"))
    return from_dataframe(cells.withColumn("j", F.col("j").cast("long")), "name", {"embedding": ArraySpec("v", {"vector": "i", "component": "j"}, "float32", None, chunk or [16, 24])})


def _stats(c: Collection, array: str, low: str, high: str, cast: str | None = None) -> DataFrame:
    rows = catalogue.live(c.stats.where(F.col("array") == array), c.mask).join(c.live(), "ordinal")
    bound = lambda n: F.col(n).cast(cast) if cast else F.col(n)
    return rows.select("ordinal", "name", bound(low).alias("min_value"), bound(high).alias("max_value"), "null_count", "row_count")


def _without(c: Collection, *names: str) -> Collection:
    c.mask = c.datasets.where(F.col("name").isin(*names)).select("ordinal")
    return c


_TYPES = "(SELECT event_type AS name, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS ordinal FROM (SELECT DISTINCT event_type FROM events))"
_EVENTS = f"(SELECT e.*, t.ordinal, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events e JOIN {_TYPES} t ON t.name = e.event_type)"
_LABELS = "(SELECT name, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal FROM (SELECT DISTINCT 'label-' || label AS name FROM embeddings))"
_CELLS = f"(SELECT t.name, t.ordinal, r.i, unnest(range(0, 64)) AS j, unnest(r.embedding) AS v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) r JOIN {_LABELS} t ON t.name = 'label-' || r.label)"


@query(f"SELECT ordinal, name FROM {_TYPES}")
def list_datasets(spark, sf):
    return events(spark, sf, indexed=False).live()


@query("SELECT count(DISTINCT event_type) - 2 AS n FROM events")
def dataset_count_after_delete(spark, sf):
    return _without(events(spark, sf, indexed=False), "click", "view").live().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('embedding'), ('value')) t(\"array\")")
def list_arrays(spark, sf):
    c = union(events(spark, sf, indexed=False), vectors(spark, sf))
    return catalogue.array_names(c.layouts, c.live())


@query("SELECT CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS ordinal, o_orderpriority AS name FROM (SELECT DISTINCT o_orderpriority FROM orders) QUALIFY o_orderpriority = (SELECT max(o_orderpriority) FROM orders)")
def lookup_dataset(spark, sf):
    orders = _read(spark, sf, "orders")
    last = orders.agg(F.max("o_orderpriority")).first()[0]
    return _counted(orders, "o_orderpriority", {"customer": ("o_custkey", "int64", None)}).live().where(F.col("name") == last)


@query(f"SELECT t.ordinal, count(*) AS rows, CAST(64 AS BIGINT) AS columns, least(count(*), 16) AS chunk_rows, CAST(24 AS BIGINT) AS chunk_columns FROM embeddings e JOIN {_LABELS} t ON t.name = 'label-' || e.label GROUP BY 1")
def array_layout(spark, sf):
    at = lambda c, k: F.element_at(c, k)
    return vectors(spark, sf).layouts.select("ordinal", at("shape", 1).alias("rows"), at("shape", 2).alias("columns"), at("chunk_shape", 1).alias("chunk_rows"), at("chunk_shape", 2).alias("chunk_columns"))


@query(f"SELECT t.ordinal, count(*) * 64 AS n FROM embeddings e JOIN {_LABELS} t ON t.name = 'label-' || e.label GROUP BY 1")
def element_counts(spark, sf):
    return vectors(spark, sf).layouts.select("ordinal", element_count(F.col("shape")).alias("n"))


@query(f"SELECT t.ordinal, 'vector' AS dim, count(*) AS size FROM embeddings e JOIN {_LABELS} t ON t.name = 'label-' || e.label GROUP BY 1 UNION ALL SELECT ordinal, 'component', 64 FROM {_LABELS}")
def dataset_dimensions(spark, sf):
    return catalogue.dimensions(vectors(spark, sf).layouts)


@query(f"SELECT ordinal, event_type AS name, min(value) AS min_value, max(value) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM {_EVENTS} GROUP BY ALL")
def stats_by_dataset_float(spark, sf):
    return _stats(events(spark, sf, indexed=False), "value", "min_f", "max_f")


@query("SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal, * FROM (SELECT o_orderpriority AS name, min(o_custkey) AS min_value, max(o_custkey) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM orders GROUP BY 1)")
def stats_by_dataset_int(spark, sf):
    return _stats(_counted(_read(spark, sf, "orders"), "o_orderpriority", {"customer": ("o_custkey", "int64", None)}), "customer", "min_i", "max_i")


@query("SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal, * FROM (SELECT o_orderpriority AS name, min(o_orderstatus) AS min_value, max(o_orderstatus) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM orders GROUP BY 1)")
def stats_by_dataset_string(spark, sf):
    return _stats(_counted(_read(spark, sf, "orders"), "o_orderpriority", {"status": ("o_orderstatus", "string", "")}), "status", "min_b", "max_b", "string")


@query(f"SELECT ordinal, event_type AS name, epoch_us(min(ts)) * 1000 AS min_value, epoch_us(max(ts)) * 1000 AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM {_EVENTS} GROUP BY ALL")
def stats_by_dataset_timestamp(spark, sf):
    return _stats(_counted(_read(spark, sf, "events"), "event_type", {"at": ("ts", "timestamp_ns", -(1 << 63))}), "at", "min_i", "max_i")


@query(f"SELECT ordinal, event_type AS name, min(value) FILTER (value <> 0.01) AS min_value, max(value) FILTER (value <> 0.01) AS max_value, count(*) FILTER (value = 0.01) AS null_count, count(*) AS row_count FROM {_EVENTS} GROUP BY ALL")
def stats_with_fill(spark, sf):
    return _stats(events(spark, sf, indexed=False, fill=0.01), "value", "min_f", "max_f")


@query(f"SELECT ordinal, event_type AS name, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, count(*) AS null_count, count(*) AS row_count FROM {_EVENTS} GROUP BY ALL")
def stats_never_written(spark, sf):
    return _stats(events(spark, sf, indexed=False, value=None), "value", "min_f", "max_f")


def _final(c: Collection) -> DataFrame:
    return statistics.final(catalogue.live(c.stats, c.mask)).select("array", F.col("min_f").alias("min_value"), F.col("max_f").alias("max_value"), "null_count", "row_count")


@query("SELECT 'value' AS \"array\", min(value) AS min_value, max(value) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM events")
def collection_stats(spark, sf):
    return _final(events(spark, sf, indexed=False))


@query("SELECT 'value' AS \"array\", min(value) AS min_value, max(value) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM events WHERE event_type <> 'click'")
def collection_stats_masked(spark, sf):
    return _final(_without(events(spark, sf, indexed=False), "click"))


@query(f"SELECT ordinal, event_type AS name FROM {_EVENTS} GROUP BY ALL HAVING max(value) > 360")
def stats_filter(spark, sf):
    return events(spark, sf, indexed=False).with_stats("value", F.col("max_f") > 360)




def _attributed(spark: SparkSession, sf: str) -> Collection:
    """Events with two attributes: the number of users (views have none) and the type's first letter."""
    return events(spark, sf, indexed=False, attrs={"n_users": ("int64", F.when(F.max("event_type") != "view", F.countDistinct("user_id"))), "letter": ("string", F.substring(F.max("event_type"), 1, 1))})


_USERS = "SELECT ordinal, event_type AS name, CASE WHEN event_type <> 'view' THEN count(DISTINCT user_id) END AS n_users, substr(event_type, 1, 1) AS letter, max(value) AS highest FROM " + _EVENTS + " GROUP BY ordinal, event_type"


@query(f"SELECT name, n_users FROM ({_USERS}) WHERE n_users IS NOT NULL")
def attribute_column(spark, sf):
    c = _attributed(spark, sf)
    return attributes.column(c.attrs, "n_users").drop("array").join(c.live(), "ordinal").select("name", F.col("i").alias("n_users"))


@query(f"SELECT ordinal, name FROM ({_USERS}) WHERE letter = 'p'")
def attribute_filter(spark, sf):
    return _attributed(spark, sf).with_attribute("letter", F.col("s") == "p")


@query(f"SELECT name, n_users, letter, highest FROM ({_USERS})")
def catalogue_table(spark, sf):
    c = _attributed(spark, sf)
    rows = c.catalogue_table({"n_users": "i", "letter": "s"})
    return rows.join(c.stats.where(F.col("array") == "value").select("ordinal", F.col("max_f").alias("highest")), "ordinal", "left").select("name", "n_users", "letter", "highest")


def _parts(spark: SparkSession, sf: str) -> Collection:
    """Parts by type in two halves: one holds sizes as integers, the other as doubles."""
    rows = _read(spark, sf, "part")
    small = _counted(rows.where("p_size <= 25").withColumn("n", F.concat(F.lit("a "), F.col("p_type"))), "n", {"size": ("p_size", "int32", None)})
    large = _counted(rows.where("p_size > 25").withColumn("n", F.concat(F.lit("b "), F.col("p_type"))), "n", {"size": ("p_size", "float64", None)})
    return union(small, large)


@query("SELECT 'array' AS scope, 'size' AS name, CASE WHEN min(p_size) <= 25 AND max(p_size) > 25 THEN 'float64,int32' END AS dtypes FROM part")
def merged_schema(spark, sf):
    return _parts(spark, sf).merged_schema().select("scope", "name", F.array_join("dtypes", ",").alias("dtypes"))


@query("SELECT count(DISTINCT p_size <= 25) AS n FROM part")
def interned_schemas(spark, sf):
    return _parts(spark, sf).schemas().agg(F.countDistinct("schema").alias("n"))


@query(f"SELECT ordinal, i AS i0, value FROM {_EVENTS} WHERE i BETWEEN 20 AND 69")
def read_window_1d(spark, sf):
    return events(spark, sf, chunk=[64]).read_window("value", [20], [50], "float64")


@query(f"SELECT ordinal, i AS i0, CAST(j AS BIGINT) AS i1, v AS value FROM {_CELLS} WHERE i BETWEEN 3 AND 7 AND j BETWEEN 10 AND 19")
def read_window_2d(spark, sf):
    return vectors(spark, sf).read_window("embedding", [3, 10], [5, 10], "float32")


@query(f"SELECT ordinal, max(value) AS peak, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY ordinal) AS size FROM {_EVENTS}) WHERE i >= size - 6 GROUP BY 1")
def read_tail(spark, sf):
    return events(spark, sf, chunk=[64]).read_tail("value", 6).groupBy("ordinal").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT ordinal, i AS i0, v AS value FROM {_CELLS} WHERE j = 0")
def read_all_datasets(spark, sf):
    c = vectors(spark, sf)
    rows = c.chunks["g"].where("c1 = 0").join(c.layouts.select("ordinal", "shape"), "ordinal")
    cells = hyperslab.unpack(rows, ["i0", "i1"], [F.element_at("shape", 1), 64], [16, 24])
    return cells.where("i1 = 0").select("ordinal", "i0", "value")


@query(f"SELECT ordinal, i AS i0, CASE WHEN i % 2 = 0 AND (i // 64) % 3 <> 1 THEN value ELSE -1.0 END AS value FROM {_EVENTS}")
def read_with_fill(spark, sf):
    """Whole arrays of which every odd cell and every third chunk was never written."""
    c = events(spark, sf, fill=-1.0, chunk=[64], written=(F.col("i") % 2 == 0) & (F.floor(F.col("i") / 64) % 3 != 1))
    return c.read_complete("value", "float64")


def _slabs(spark: SparkSession, sf: str, chunk: int) -> DataFrame:
    """All cells of two overlapping slabs over all events: the first covers every cell, the second those from 10 on, with the sign changed."""
    rows = _numbered(_read(spark, sf, "events"), "event_type", "event_id")
    first = rows.select("event_type", "i", F.lit(0).alias("slab"), "value")
    second = rows.where("i >= 10").select("event_type", "i", F.lit(1).alias("slab"), (-F.col("value")).alias("value"))
    c = from_dataframe(first.unionByName(second), "event_type", {"value": ArraySpec("value", {"obs": "i"}, "float64", None, [chunk], None, "slab")})
    rows = c.chunks["f"].join(c.layouts.select("ordinal", "shape"), "ordinal")
    return hyperslab.unpack(rows, ["i0"], [F.element_at("shape", 1)], [chunk])


@query(f"SELECT ordinal, i AS i0, CASE WHEN i >= 10 THEN -value ELSE value END AS value FROM {_EVENTS}")
def slab_assembly(spark, sf):
    """All cells of the assembled slabs."""
    return _slabs(spark, sf, 4096)


@query(f"SELECT ordinal, count(DISTINCT (i // 16, j // 24)) AS n FROM {_CELLS} WHERE i BETWEEN 10 AND 35 AND j BETWEEN 20 AND 50 GROUP BY 1")
def chunk_touch_count(spark, sf):
    rows = vectors(spark, sf).chunks["g"].where("c0 BETWEEN 0 AND 2 AND c1 BETWEEN 0 AND 2")
    return rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT ordinal, name FROM {_TYPES} WHERE name NOT IN ('click', 'signup')")
def delete_batch(spark, sf):
    c = events(spark, sf, indexed=False)
    c.delete_datasets(["click", "signup", "click"])
    return c.live()


@query(f"SELECT ordinal, name FROM {_TYPES} WHERE name <> 'error'")
def delete_idempotent(spark, sf):
    c = events(spark, sf, indexed=False)
    c.delete_datasets([])
    c.delete_datasets(["error"])
    return c.live()


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def dataset_name_from_path(spark, sf):
    return _read(spark, sf, "pages").select("page_id", conversions.dataset_name(F.col("url")).alias("name"))


@query("SELECT name, name <> '' AND NOT starts_with(name, '_') AND NOT contains(name, '/') AND name NOT IN ('.', '..') AS valid FROM (SELECT DISTINCT url AS name FROM pages UNION SELECT DISTINCT p_type FROM part UNION SELECT '_' || p_brand FROM part UNION SELECT '..')")
def validate_names(spark, sf):
    parts = _read(spark, sf, "part")
    names = _read(spark, sf, "pages").select(F.col("url").alias("name")).union(parts.select("p_type")).union(parts.select(F.concat(F.lit("_"), "p_brand"))).union(spark.range(1).select(F.lit("..")))
    return names.distinct().select("name", conversions.valid_name(F.col("name")).alias("valid"))


@query("SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal, * FROM (SELECT lang AS name, min(s) FILTER (s <> '') AS min_value, max(s) FILTER (s <> '') AS max_value, count(*) FILTER (s = '') AS null_count, count(*) AS row_count FROM (SELECT lang, CASE WHEN n_chars < 500 THEN '' ELSE source END AS s FROM documents) GROUP BY 1)")
def fill_missing_strings(spark, sf):
    rows = _read(spark, sf, "documents").withColumn("s", conversions.fill_missing(F.when(F.col("n_chars") >= 500, F.col("source"))))
    return _stats(_counted(rows, "lang", {"source": ("s", "string", "")}), "source", "min_b", "max_b", "string")


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def timestamp_ns(spark, sf):
    return _read(spark, sf, "events").select("event_id", conversions.timestamp_to_ns(F.col("ts")).alias("ns"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 13 AS VARCHAR) AS day FROM orders")
def julian_to_gregorian(spark, sf):
    d = F.col("o_orderdate")
    return _read(spark, sf, "orders").select("o_orderkey", conversions.julian_to_gregorian(F.year(d), F.month(d), F.day(d)).cast("string").alias("day"))


@query("SELECT count(DISTINCT event_type) - 1 AS live, CAST(1 AS BIGINT) AS deleted, count(DISTINCT event_type) AS total, CAST(1 AS BIGINT) AS arrays, CAST(1 AS BIGINT) AS schemas, min(value) FILTER (event_type <> 'view') AS min_value, max(value) FILTER (event_type <> 'view') AS max_value, count(*) FILTER (event_type <> 'view') AS row_count FROM events")
def collection_info(spark, sf):
    c = _without(events(spark, sf, indexed=False), "view")
    counts = c.datasets.join(c.mask.withColumn("gone", F.lit(1)), "ordinal", "left").agg((F.count(F.lit(1)) - F.count("gone")).alias("live"), F.count("gone").alias("deleted"), F.count(F.lit(1)).alias("total"))
    arrays = c.layouts.agg(F.countDistinct("array").alias("arrays"))
    schemas = c.schemas().agg(F.countDistinct("schema").alias("schemas"))
    bounds = _final(c).select("min_value", "max_value", "row_count")
    one = lambda t: t.withColumn("__k", F.lit(1))
    return one(counts).join(one(arrays), "__k").join(one(schemas), "__k").join(one(bounds), "__k").drop("__k")


@query(f"SELECT name, name IN ('click', 'view') AS live FROM (SELECT name FROM {_TYPES} UNION SELECT 'nothing') WHERE name IN ('click', 'view', 'error', 'nothing')")
def dataset_exists(spark, sf):
    """Of four names two are live: one is deleted, one was never there."""
    c = _without(events(spark, sf, indexed=False), "error")
    asked = spark.createDataFrame([("click",), ("view",), ("error",), ("nothing",)], "name string")
    live = c.live().select("name", F.lit(True).alias("live"))
    return asked.join(live, "name", "left").select("name", F.coalesce("live", F.lit(False)).alias("live"))


@query("SELECT count(DISTINCT event_type) AS n FROM events")
def total_datasets(spark, sf):
    return _without(events(spark, sf, indexed=False), "click").datasets.agg(F.count(F.lit(1)).alias("n"))


def _orders(spark: SparkSession, sf: str) -> Collection:
    """Orders by priority with four arrays, one of them a coordinate."""
    arrays = {"key": ("o_orderkey", "int64"), "customer": ("o_custkey", "int64"), "status": ("o_orderstatus", "string"), "day": ("o_orderdate", "timestamp_ns")}
    specs = {k: ArraySpec(v, {"obs": None}, t, "" if t == "string" else None, is_coordinate=k == "key") for k, (v, t) in arrays.items()}
    attrs = {"n": ("int32", F.count(F.lit(1)).cast("int")), "highest": ("float64", F.max("o_totalprice")), "flag": ("bool", F.max((F.col("o_totalprice") > 400_000).cast("int")))}
    return from_dataframe(_read(spark, sf, "orders"), "o_orderpriority", specs, attrs)


_PRIORITIES = "(SELECT o_orderpriority AS name, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS ordinal FROM (SELECT DISTINCT o_orderpriority FROM orders))"
_ARRAYS = "(VALUES (0, 'key', 'int64', TRUE), (1, 'customer', 'int64', FALSE), (2, 'status', 'string', FALSE), (3, 'day', 'timestamp_ns', FALSE)) a(position, \"array\", dtype, is_coordinate)"


@query(f"SELECT ordinal, position, \"array\", dtype FROM {_PRIORITIES}, {_ARRAYS}")
def schema_view(spark, sf):
    c = _orders(spark, sf)
    return c.schemas().select("ordinal", F.posexplode("schema.arrays").alias("position", "a")).select("ordinal", "position", F.col("a.name").alias("array"), F.col("a.dtype").alias("dtype"))


@query("SELECT CAST(dense_rank() OVER (ORDER BY large, p_type) - 1 AS INTEGER) AS ordinal, CAST(large AS INTEGER) AS schema_id FROM (SELECT DISTINCT p_type, p_size > 25 AS large FROM part)")
def interned_schema_ids(spark, sf):
    """Two schemas: small parts come first and hold integers, large ones doubles."""
    return catalogue.interned(_parts(spark, sf).schemas())


@query(f"SELECT name, \"array\" FROM {_PRIORITIES}, {_ARRAYS} WHERE is_coordinate")
def coordinate_flags(spark, sf):
    c = _orders(spark, sf)
    return c.layouts.where("is_coordinate").join(c.live(), "ordinal").select("name", "array")


@query(f"SELECT ordinal, * EXCLUDE (ordinal) FROM {_PRIORITIES} JOIN (SELECT o_orderpriority AS name, unnest(['n', 'highest', 'flag']) AS key, unnest(['int32', 'float64', 'bool']) AS dtype, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos, unnest([count(*), NULL, CAST(max(o_totalprice) > 400000 AS BIGINT)]) AS i, unnest([NULL, max(o_totalprice), NULL]) AS f FROM orders GROUP BY 1) USING (name)")
def dataset_attributes(spark, sf):
    c = _orders(spark, sf)
    return c.attrs.where("array IS NULL").join(c.live(), "ordinal").select("ordinal", "name", "key", "dtype", "pos", "i", "f")


@query(f"SELECT \"array\", dtype, is_coordinate, count(*) AS size, CASE \"array\" WHEN 'key' THEN min(o_orderkey) WHEN 'customer' THEN min(o_custkey) WHEN 'day' THEN min(epoch_us(o_orderdate)) * 1000 END AS min_i, CASE \"array\" WHEN 'status' THEN min(o_orderstatus) END AS min_s FROM orders, {_ARRAYS} WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY 1, 2, 3")
def describe_dataset(spark, sf):
    """Arrays of the first dataset with type, coordinate flag, size and lower bound."""
    c = _orders(spark, sf)
    own = c.layouts.where("ordinal = 0").join(c.stats.where("ordinal = 0").drop("dtype", "ordinal"), "array")
    return own.select("array", "dtype", "is_coordinate", element_count(F.col("shape")).alias("size"), "min_i", F.col("min_b").cast("string").alias("min_s"))


@query(f"SELECT what || ' of unknown dataset ' || ordinal AS fault FROM {_PRIORITIES}, (VALUES ('layout'), ('attribute')) w(what) WHERE name = (SELECT max(o_orderpriority) FROM orders) UNION ALL SELECT 'statistics contradict array key ' || ordinal FROM {_PRIORITIES} UNION ALL SELECT 'mask of unknown dataset 77'")
def validate_collection(spark, sf):
    """A collection with three faults: a dataset is missing, the row counts of one array are wrong, the mask names nobody."""
    c = _orders(spark, sf)
    last = c.datasets.agg(F.max("name")).first()[0]
    c.datasets = c.datasets.where(F.col("name") != last)
    c.stats = c.stats.withColumn("row_count", F.when(F.col("array") == "key", F.col("row_count") + 1).otherwise(F.col("row_count")))
    c.mask = spark.createDataFrame([(77,)], "ordinal int")
    return c.validate()


@query("SELECT \"array\", CASE \"array\" WHEN 'key' THEN max(o_orderkey) WHEN 'customer' THEN max(o_custkey) WHEN 'day' THEN max(epoch_us(o_orderdate)) * 1000 END AS max_i, count(*) AS row_count FROM orders, (VALUES ('key'), ('customer'), ('day'), ('status')) a(\"array\") GROUP BY 1")
def info_array_stats(spark, sf):
    c = _orders(spark, sf)
    return statistics.final(catalogue.live(c.stats, c.mask)).select("array", "max_i", "row_count")


@query("SELECT lang, source, source AS scalar, 'json:[\"' || lang || '\", ' || n || ']' AS list, lang AS back, 'string' AS dtype FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def attribute_encoding(spark, sf):
    """Attributes of each pair of language and source, encoded for a file and decoded again: scalars stay, lists become JSON text."""
    pairs = _read(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).collect()  # of attribute values, not of rows
    rows = []
    for r in pairs:
        scalar, text = model.encode_attr(r.source), model.encode_attr([r.lang, r.n])
        rows.append((r.lang, r.source, scalar, text, model.decode_attr(text)[0], model.infer_attr(text)[0]))
    return spark.createDataFrame(rows, "lang string, source string, scalar string, list string, back string, dtype string")
