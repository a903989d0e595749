"""Queries over collections that are written, opened again, changed and read, and the SQL that checks each.

Collections go to the folder that the driver and all executors share (``spark.checkpoint.dir``), or to one of our
own where all of Spark runs in one process.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, model, ops
from ..errors import ArrayAlreadyExists, ArrayNotFound, CollectionError, DatasetAlreadyExists, InvalidName, InvalidValue, NotACollection, UnsupportedType, UnsupportedVersion, WriterFinished
from ..reader import Collection
from ..sources import classic_writer, location, netcdf
from ..sources.ingest import ArraySpec, from_dataframe
from ..writer import CODECS, CollectionWriter, save
from .queries import _CELLS, _EVENTS, _LABELS, _PRIORITIES, _TYPES, _USERS, _numbered, _orders, _read, events, query, vectors

_own: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ndcollect-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = "file://" + _own[0]
    return f"{root.rstrip('/')}/collections/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, c: Collection, name: str, **options: Any) -> Collection:
    path = place(spark, name)
    save(c, path, **options)
    return Collection.open(spark, path)


def refused(call: Callable[[], Any], kind: type[Exception]) -> bool:
    try:
        call()
    except kind:
        return True
    return False


@query(f"SELECT ordinal, i AS i0, value FROM {_EVENTS} WHERE i BETWEEN 100 AND 149")
def stored_window_1d(spark, sf):
    """A window of every dataset of a stored collection: partitions and chunk bounds prune the scan."""
    return stored(spark, events(spark, sf, chunk=[64]), "window").read_window("value", [100], [50], "float64")


@query(f"SELECT ordinal, i AS i0, CAST(j AS BIGINT) AS i1, v AS value FROM {_CELLS} WHERE i BETWEEN 3 AND 20 AND j BETWEEN 10 AND 40")
def stored_window_2d(spark, sf):
    return stored(spark, vectors(spark, sf), "window").read_window("embedding", [3, 10], [18, 31], "float32")


@query("SELECT i AS i0, CAST(j AS BIGINT) AS i1, v AS value FROM " + _CELLS + f" WHERE name = (SELECT max(name) FROM {_LABELS})")
def stored_dataset_read(spark, sf):
    """The whole array of the last dataset by name."""
    c = stored(spark, vectors(spark, sf), "read")
    return c.dataset(c.list_datasets()[-1]).read("embedding", "float32")


@query(f"SELECT ordinal, i AS i0, value FROM (SELECT *, count(*) OVER (PARTITION BY ordinal) AS size FROM {_EVENTS}) WHERE i >= size - 6")
def stored_tail(spark, sf):
    return stored(spark, events(spark, sf, chunk=[64]), "tail").read_tail("value", 6)


@query(f"SELECT ordinal, i AS i0, CASE WHEN i % 2 = 0 AND (i // 64) % 3 <> 1 THEN value ELSE -1.0 END AS value FROM {_EVENTS}")
def stored_fill(spark, sf):
    """Whole arrays read back; every odd cell and every third chunk was never written."""
    c = events(spark, sf, fill=-1.0, chunk=[64], written=(F.col("i") % 2 == 0) & (F.floor(F.col("i") / 64) % 3 != 1))
    return stored(spark, c, "fill").read_complete("value", "float64")


@query(f"SELECT ordinal, i AS i0, CASE WHEN i >= 10 THEN -value ELSE value END AS value FROM {_EVENTS}")
def stored_slabs(spark, sf):
    """Two overlapping slabs over all events, written and read back whole."""
    rows = _numbered(_read(spark, sf, "events"), "event_type", "event_id")
    first = rows.select("event_type", "i", F.lit(0).alias("slab"), "value")
    second = rows.where("i >= 10").select("event_type", "i", F.lit(1).alias("slab"), (-F.col("value")).alias("value"))
    c = from_dataframe(first.unionByName(second), "event_type", {"value": ArraySpec("value", {"obs": "i"}, "float64", None, [1000], None, "slab")})
    return stored(spark, c, "slabs").read_complete("value")


@query(f"SELECT ordinal, i AS i0, event_id AS value FROM {_EVENTS}")
def stored_integers(spark, sf):
    """An integer array without stated chunks."""
    rows = _numbered(_read(spark, sf, "events"), "event_type", "event_id")
    return stored(spark, from_dataframe(rows, "event_type", {"id": ArraySpec("event_id", {"obs": "i"})}), "integers").read_complete("id", "int64")


@query(f"SELECT name, min(value) AS min_value, max(value) AS max_value, count(*) AS row_count FROM (SELECT *, event_type AS name FROM {_EVENTS}) WHERE name NOT IN ('click', 'view') GROUP BY 1")
def stored_delete(spark, sf):
    """Two datasets go by two handles of one stored collection; a third handle sees what is left."""
    c = stored(spark, events(spark, sf, indexed=False), "delete")
    other = Collection.open(spark, c.path)
    c.delete_datasets(["click", "click"])
    other.delete_datasets(["view"])
    return Collection.open(spark, c.path).stats_by_dataset("value").select("name", F.col("min_f").alias("min_value"), F.col("max_f").alias("max_value"), "row_count")


@query("SELECT codec, count(DISTINCT event_type) AS datasets, max(value) AS highest, min(value) AS lowest, TRUE AS alone, count(*) AS cells FROM events, (VALUES ('lz4'), ('none'), ('zstd')) c(codec) GROUP BY 1")
def stored_over_itself(spark, sf):
    """A collection saved over itself with each codec: one version stays, and it reads the same."""
    path, rows = place(spark, "over"), []
    c = save(events(spark, sf, chunk=[512]), path)
    for codec in CODECS:
        c = save(c, path, codec)
        got = c.read_complete("value").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("value").alias("n")).first()
        versions = {p.split("/data/")[1].split("/")[0] for p, _ in location.files(spark, f"{path}/data")}
        rows.append((Collection.open(spark, path).codec, c.dataset_count(), got.high, got.low, len(versions) == 1, got.n))
    return spark.createDataFrame(rows, "codec string, datasets long, highest double, lowest double, alone boolean, cells long")


@query(f"SELECT name, n_users, letter FROM ({_USERS})")
def stored_attributes(spark, sf):
    """Single attributes of each dataset of a stored collection; what a dataset lacks is null."""
    attrs = {"n_users": ("int64", F.when(F.max("event_type") != "view", F.countDistinct("user_id"))), "letter": ("string", F.substring(F.max("event_type"), 1, 1))}
    c = stored(spark, events(spark, sf, indexed=False, attrs=attrs), "attributes")
    rows = [(name, c.dataset(name).get_attribute("n_users"), c.dataset(name).get_attribute("letter")) for name in c]
    return spark.createDataFrame(rows, "name string, n_users long, letter string")


@query("SELECT doubled.wrong_type AND doubled.unknown_array AND doubled.outside AS refused, n FROM (SELECT TRUE AS wrong_type, TRUE AS unknown_array, TRUE AS outside) doubled, (SELECT count(DISTINCT event_type) AS n FROM events)")
def stored_guards(spark, sf):
    """Reads of another type, of an unknown array and beyond the array are refused for every dataset."""
    c = stored(spark, events(spark, sf, chunk=[64]), "guards")
    checks = []
    for name in c:
        d = c.dataset(name)
        size = d.layout("value")["shape"][0]
        checks.append(refused(lambda: d.read("value", "float32"), CollectionError) and refused(lambda: d.read("nothing"), ArrayNotFound) and refused(lambda: d.read("value", None, [size], [1]), CollectionError))  # noqa: B023
    return spark.createDataFrame([(all(checks), len(checks))], "refused boolean, n long")


@query("SELECT count(DISTINCT event_type) AS live, count(DISTINCT event_type) + 1 AS total FROM events WHERE event_type <> 'error'")
def stored_mask_version(spark, sf):
    """All or nothing: a deletion that names an unknown dataset, or one that is gone, changes nothing."""
    c = stored(spark, events(spark, sf, indexed=False), "mask")
    c.delete_datasets(["error"])
    for names in (["click", "nothing"], ["error"], ["click", "error"]):
        assert refused(lambda: c.delete_datasets(names), CollectionError)  # noqa: B023
    again = Collection.open(spark, c.path)
    return spark.createDataFrame([(len(again), again.total_datasets())], "live long, total long")


def _regions(spark: SparkSession, sf: str, path: str) -> Collection:
    """Nations by region, set down array by array through a writer; one dataset is given up midway."""
    rows = _read(spark, sf, "nation").join(_read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name").orderBy("r_name", "n_nationkey").collect()  # 25 rows at every size
    with CollectionWriter(spark, path) as w:
        for region in dict.fromkeys(r.r_name for r in rows):
            own = [r for r in rows if r.r_name == region]
            with w.add_dataset(region) as d:
                d.define_array("key", "int32", ["nation"], [len(own)], [2], fill=-1, is_coordinate=True)
                d.define_array("name", "string", ["nation"], [len(own)], fill="")
                d.define_array("never", "float64", ["nation", "month"], [len(own), 12], fill=float("nan"))
                for at in range(0, len(own), 3):  # slabs across chunks, the later ones over the earlier
                    part = own[max(0, at - 1) : at + 3]
                    d.write("key", [r.n_nationkey for r in part], [max(0, at - 1)], [len(part)])
                d.write("name", [r.n_name for r in own])
                d.set_attribute("n", 0)
                d.set_attribute("first", own[0].n_name)
                d.set_attribute("n", len(own))
                d.set_attribute("long_name", "name of the nation", "name")
                d.set_attribute("width", 8, "key", "uint8")
        w.add_dataset("given up").abort()
    return Collection.open(spark, path)


_NATIONS = "(SELECT r_name AS dataset, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT dataset, i AS i0, n_nationkey AS key, n_name AS name FROM {_NATIONS}")
def writer_values(spark, sf):
    c = _regions(spark, sf, place(spark, "writer"))
    keys, names = c.read_complete("key", "int32"), c.read_complete("name", "string").withColumnRenamed("value", "name")
    return keys.join(names, ["ordinal", "i0"]).join(c.live().withColumnRenamed("name", "dataset"), "ordinal").select("dataset", "i0", F.col("value").cast("int").alias("key"), "name")


@query(f"SELECT dataset, CASE pos WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'key' ELSE 'name' END AS \"array\", CASE pos WHEN 0 THEN 'n' WHEN 1 THEN 'first' WHEN 2 THEN 'width' ELSE 'long_name' END AS key, CASE pos WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN n_name WHEN 2 THEN '8' ELSE 'name of the nation' END AS value FROM {_NATIONS}, range(0, 4) p(pos) WHERE i = 0")
def writer_attributes(spark, sf):
    """Attributes of datasets and arrays, in the order in which they were set first."""
    c, rows = _regions(spark, sf, place(spark, "writer")), []
    for name in c:
        d = c.dataset(name)
        assert list(d.attributes()) == ["n", "first"] and d.get_array_attribute("name", "units") is None
        rows += [(name, None, k, str(v)) for k, v in d.attributes().items()]
        rows += [(name, a, k, str(d.get_array_attribute(a, k))) for a in d.list_arrays() for k in d.array_attributes(a)]
    return spark.createDataFrame(rows, "dataset string, array string, key string, value string")


@query(f"SELECT dataset, position, CASE position WHEN 0 THEN 'key' WHEN 1 THEN 'name' ELSE 'never' END AS \"array\", CASE position WHEN 0 THEN 'int32' WHEN 1 THEN 'string' ELSE 'float64' END AS dtype, CASE position WHEN 0 THEN 'width' WHEN 1 THEN 'long_name' ELSE '' END AS keys, n * CASE position WHEN 2 THEN 12 ELSE 1 END AS cells, CASE position WHEN 0 THEN least(2, n) ELSE n END AS chunk FROM {_NATIONS}, range(0, 3) p(position) WHERE i = 0")
def writer_schemas(spark, sf):
    """Schema views and layouts of every dataset; all views are equal."""
    c, rows, views = _regions(spark, sf, place(spark, "writer")), [], []
    for name in c:
        d = c.dataset(name)
        views.append(d.schema())
        for a in views[-1]:
            at = d.layout(a.name)
            assert views[-1].index_of(a.name) == at["position"] and views[-1].get(a.name) == a
            rows.append((name, a.position, a.name, a.dtype, ",".join(a.attribute_names), at["element_count"], at["chunk_shape"][0]))
    assert all(v == views[0] for v in views)
    return spark.createDataFrame(rows, "dataset string, position long, array string, dtype string, keys string, cells long, chunk long")


@query(f"SELECT dataset, min(n_nationkey) AS min_key, max(n_nationkey) AS max_key, min(n_name) AS min_name, max(n_name) AS max_name, count(*) * 12 AS never_nulls FROM {_NATIONS} GROUP BY 1")
def writer_stats(spark, sf):
    """Statistics of single arrays of single datasets; an array nobody wrote is all null."""
    c, rows = _regions(spark, sf, place(spark, "writer")), []
    for name in c:
        d = c.dataset(name)
        key, text, never = (d.array_stats(a) for a in ("key", "name", "never"))
        assert never["min"] is None and never["row_count"] == never["null_count"]
        rows.append((name, key["min"], key["max"], text["min"].decode(), text["max"].decode(), never["null_count"]))
    return spark.createDataFrame(rows, "dataset string, min_key int, max_key int, min_name string, max_name string, never_nulls long")


@query("SELECT unnest(['ArrayAlreadyExists', 'ArrayNotFound', 'DatasetAlreadyExists', 'InvalidName', 'InvalidValue', 'NotACollection', 'UnsupportedType', 'UnsupportedVersion', 'WriterFinished']) AS error, count(*) AS datasets FROM region")
def writer_refusals(spark, sf):
    """What a writer and an opener refuse, each by its error; the collection that is there stays as it was."""
    path = place(spark, "refusals")
    c = _regions(spark, sf, path)
    w = CollectionWriter(spark, path)
    d = w.add_dataset("d")
    d.define_array("x", "int8", ["i"], [2])
    location.write_text(spark, f"{path}-future/manifest.json", json.dumps({"format": "ndcollect", "version": 99}))
    done = CollectionWriter(spark, path)
    done.abort()
    tried = {
        ArrayAlreadyExists: lambda: d.define_array("x", "int8", ["i"], [2]), ArrayNotFound: lambda: d.write("y", [1]), DatasetAlreadyExists: lambda: w.add_dataset("d"), InvalidName: lambda: w.add_dataset("a/b"), InvalidValue: lambda: d.write("x", [1, 2], [1], [2]),
        NotACollection: lambda: Collection.open(spark, f"{path}-nothing"), UnsupportedType: lambda: d.define_array("f", "bool", ["i"], [2]), UnsupportedVersion: lambda: Collection.open(spark, f"{path}-future"), WriterFinished: lambda: done.add_dataset("e"),
    }
    found = [kind.__name__ for kind, call in tried.items() if refused(call, kind)]
    w.abort()
    return spark.createDataFrame([(e, len(Collection.open(spark, c.path))) for e in found], "error string, datasets long")


@query("SELECT count(DISTINCT event_type) - 1 AS live, CAST(1 AS BIGINT) AS deleted, count(DISTINCT event_type) AS total, 'value' AS arrays, CAST(1 AS BIGINT) AS schemas, 'lz4' AS codec, min(value) FILTER (event_type <> 'view') AS min_value, max(value) FILTER (event_type <> 'view') AS max_value, count(*) FILTER (event_type <> 'view') AS row_count, TRUE AS sized FROM events")
def operation_info(spark, sf):
    """``remove`` (by path and with an unknown name), then ``info``."""
    c = stored(spark, events(spark, sf, chunk=[256]), "info", codec="lz4")
    gone = ops.remove(c.path, ["some/where/view", "nothing", "view"], missing_ok=True, spark=spark)
    s = ops.info(c.path, spark=spark)
    assert gone["removed"] == ["view"] and gone["missing"] == ["nothing"] and gone["remaining"] == s["dataset_count"]
    v = s["array_stats"]["value"]
    row = (s["dataset_count"], s["deleted_count"], s["total_datasets"], ",".join(s["distinct_arrays"]), s["interned_schemas"], s["codec"], v["min"], v["max"], v["row_count"], 0 < sum(Collection.open(spark, c.path).segment_bytes().values()) < s["container_bytes"])
    return spark.createDataFrame([row], "live long, deleted long, total long, arrays string, schemas long, codec string, min_value double, max_value double, row_count long, sized boolean")


@query(f"SELECT \"array\", CASE \"array\" WHEN 'key' THEN 'int64' WHEN 'customer' THEN 'int64' WHEN 'status' THEN 'string' ELSE 'timestamp_ns' END AS dtype, \"array\" = 'key' AS is_coordinate, count(*) AS size, CASE \"array\" WHEN 'key' THEN CAST(min(o_orderkey) AS VARCHAR) WHEN 'customer' THEN CAST(min(o_custkey) AS VARCHAR) WHEN 'day' THEN CAST(min(epoch_us(o_orderdate)) * 1000 AS VARCHAR) ELSE min(o_orderstatus) END AS least FROM orders, (VALUES ('key'), ('customer'), ('status'), ('day')) a(\"array\") WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders) GROUP BY 1")
def operation_describe(spark, sf):
    """``describe`` of the last dataset of a stored collection."""
    c = stored(spark, _orders(spark, sf), "describe")
    d = ops.describe(c.path, ops.list_datasets(c.path, spark=spark)[-1], spark=spark)
    assert d["coordinates"] == ["key"] and list(d["attributes"]) == ["n", "highest", "flag"] and d["dimensions"] == {"obs": d["attributes"]["n"]}
    text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
    return spark.createDataFrame([(a["name"], a["dtype"], a["is_coordinate"], a["shape"][0], text(a["stats"]["min"])) for a in d["arrays"]], "array string, dtype string, is_coordinate boolean, size long, least string")


def _said(*arguments: str) -> tuple[int, str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        code = cli.main(list(arguments))
    return code, out.getvalue()


@query(f"SELECT name, ordinal, 0 AS code, (SELECT count(*) FROM events WHERE event_type = name) AS cells, 1 AS unknown FROM {_TYPES} WHERE name <> 'error'")
def command_line(spark, sf):
    """``rm``, ``ls``, ``show`` and ``info`` of the command line, and its exit code for an unknown dataset."""
    c = stored(spark, events(spark, sf, chunk=[256]), "cli")
    code, _ = _said("rm", c.path, "error")
    names = json.loads(_said("ls", c.path, "--json")[1])
    rows = []
    for name in names:
        shown = json.loads(_said("show", c.path, name, "--json")[1])
        text = _said("show", c.path, name)[1]
        assert text.startswith(f"dataset {name} {{") and f"obs = {shown['dimensions']['obs']} ;" in text
        rows.append((name, shown["ordinal"], code, shown["arrays"][0]["stats"]["row_count"], _said("show", c.path, "nothing")[0]))
    assert f"{len(names) + 1} written" in _said("info", c.path)[1]
    return spark.createDataFrame(rows, "name string, ordinal int, code int, cells long, unknown int")


@query(f"SELECT dataset || '.nc' AS dataset, i AS i0, n_nationkey AS key, n_name AS name, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 13 DAY) * 1000 + n_nationkey * 86400000000000 AS day, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey / 2.0 END AS half FROM {_NATIONS}")
def netcdf_ingest(spark, sf):
    """NetCDF files of nations by region, ingested by tasks and read back: integers, texts, Julian dates, packed values."""
    rows = _read(spark, sf, "nation").join(_read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_nationkey").collect()  # 25 rows at every size
    folder = place(spark, "netcdf")
    for region in dict.fromkeys(r.r_name for r in rows):
        own = [r for r in rows if r.r_name == region]
        keys = np.array([r.n_nationkey for r in own], "i4")
        names = np.array([list(r.n_name.ljust(30, "\0")) for r in own], "S1")
        half = np.where(keys % 5 == 0, -1, keys)
        variables = {"key": (("nation",), keys, {}), "name": (("nation", "letter"), names, {"long_name": "nation"}), "day": (("nation",), keys.astype("f8"), {"units": "days since 2024-01-01", "calendar": "julian"}), "half": (("nation",), half.astype("i2"), {"scale_factor": 0.5, "_FillValue": np.int16(-1)})}
        location.write_bytes(spark, f"{folder}/files/{region}.nc", classic_writer.encode({"nation": None, "letter": 30}, variables, {"n": np.int32(len(own))}, 2))
    seen: list[str] = []
    got = ops.create(f"{folder}/files", f"{folder}/c", convert_calendar=True, workers=3, progress=seen.append, spark=spark)
    c = Collection.open(spark, f"{folder}/c")
    assert sorted(seen) == got["datasets"] == c.list_datasets() and c.validate().isEmpty()
    out = c.live().withColumnRenamed("name", "dataset")
    for array in ("key", "name", "day", "half"):
        cells = c.read_complete(array).withColumnRenamed("value", array)
        out = out.join(cells, "ordinal") if array == "key" else out.join(cells, ["ordinal", "i0"])
    return out.select("dataset", "i0", F.col("key").cast("int").alias("key"), "name", "day", F.nullif("half", F.lit(float("nan"))).alias("half"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, epoch_us(o_orderdate + INTERVAL 13 DAY) * 1000 AS ns FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS o_orderdate FROM orders)")
def julian_instants(spark, sf):
    """The exact instants of order dates read as labels of the Julian calendar, by the conversion of file ingest."""
    from ..sources.classic import CalendarDate

    days = [r.d for r in _read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().collect()]  # of a calendar's days, not of rows
    ns = netcdf.calendar_ns(np.array([CalendarDate(d.year, d.month, d.day, 0, 0, 0, 0, "julian") for d in days], object))
    return spark.createDataFrame([(str(d), n) for d, n in zip(days, ns)], "day string, ns long")


@query("SELECT v AS value, v BETWEEN -128 AND 127 AS int8, v BETWEEN 0 AND 255 AS uint8, v BETWEEN -32768 AND 32767 AS int16, v >= 0 AS uint64, FALSE AS string, CAST(v AS DOUBLE) AS float64, 'int64' AS inferred FROM (SELECT DISTINCT (p_size - 25) * 20 AS v FROM part)")
def typed_values(spark, sf):
    """Which types take an attribute's value, its value as a float and the type inferred for it."""
    values = [r.v for r in _read(spark, sf, "part").select(((F.col("p_size") - 25) * 20).alias("v")).distinct().collect()]  # 50 values at most
    takes = lambda v, t: not refused(lambda: model.typed_attr(v, t), CollectionError)
    rows = []
    for v in values:
        dtype, x = model.typed_attr(v, "float64")
        back = model.attr_value({"dtype": dtype, **model.attr_row(dtype, x)})
        rows.append((v, *(takes(v, t) for t in ("int8", "uint8", "int16", "uint64", "string")), back, model.infer_attr(v)[0]))
    return spark.createDataFrame(rows, "value int, int8 boolean, uint8 boolean, int16 boolean, uint64 boolean, string boolean, float64 double, inferred string")


@query(f"SELECT dtype, 'list[' || dtype || ']' AS list, CASE dtype WHEN 'float64' THEN 'nan' WHEN 'string' THEN '' WHEN 'timestamp_ns' THEN '-9223372036854775808' END AS fill FROM (SELECT DISTINCT unnest(['int64', 'int64', 'string', 'timestamp_ns', 'float64']) AS dtype FROM {_PRIORITIES})")
def type_names(spark, sf):
    """The types of a stored collection's arrays and one float: parsed, printed, nested, and their default fills."""
    kinds = {r.dtype for r in stored(spark, _orders(spark, sf), "types").layouts.select("dtype").distinct().collect()} | {"float64"}
    numpy_kinds = {"int64": "i8", "string": "O", "timestamp_ns": "M8[ns]", "float64": "f8"}
    rows = []
    for k in sorted(kinds):
        dtype = np.dtype(numpy_kinds[k])
        assert model.dtype_of_numpy(dtype.kind, dtype.itemsize) == k and str(model.parse_dtype(k.upper())) == k
        fill = netcdf.resolve_fill("x", dtype, {})
        assert fill is None or model.check_fill(k, fill) is not None
        rows.append((k, str(model.parse_dtype(f"List[ {k} ]")), None if fill is None else str(fill)))
    return spark.createDataFrame(rows, "dtype string, list string, fill string")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars % 3 = 0) AS missing FROM documents GROUP BY ALL")
def missing_texts(spark, sf):
    """Missing texts of a column become the fill at ingest, and are counted; escaped bytes become the text they stand for."""

    def run(frames):
        import warnings

        import pandas as pd

        for f in frames:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                cells = netcdf.texts(f["source"].where(f["n_chars"] % 3 != 0, None).to_numpy(object), "", "source")
            sane = [model.sanitize(t.encode().decode("ascii", "surrogateescape")) for t in cells]
            yield pd.DataFrame({"lang": f["lang"], "source": f["source"], "n": 1, "missing": [int(t == "") for t in sane]})

    out = _read(spark, sf, "documents").select("lang", "source", "n_chars").mapInPandas(run, "lang string, source string, n long, missing long")
    return out.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"))


@query(f"SELECT ordinal, count(*) AS n, CAST(sum(i0) AS BIGINT) AS places FROM (SELECT ordinal, i AS i0, j FROM {_CELLS}) WHERE i0 BETWEEN 3 AND 20 AND j BETWEEN 10 AND 40 GROUP BY 1")
def sql_views(spark, sf):
    """A stored collection as views, queried in SQL."""
    c = stored(spark, vectors(spark, sf), "views")
    c.register("own_")
    c.read_window("embedding", [3, 10], [18, 31]).createOrReplaceTempView("own_cells")
    return spark.sql("SELECT d.ordinal, count(*) AS n, sum(c.i0) AS places FROM own_cells c JOIN own_datasets d USING (ordinal) JOIN own_stats s ON s.ordinal = d.ordinal AND s.array = 'embedding' GROUP BY d.ordinal")


@query(f"SELECT name AS dataset, n, TRUE AS same FROM (SELECT event_type AS name, count(*) AS n FROM {_EVENTS} GROUP BY 1)")
def container_parts(spark, sf):
    """Stored parts of a container: names and sizes agree with its files; statistics agree with its cells."""
    c = stored(spark, events(spark, sf, chunk=[256]), "parts")
    entry = c.segment_entry("value")
    same = c.segment_names() == ["value"] and entry["bytes"] == c.segment_bytes()["value"] > 0 and c.format_version == 1 and c.created_unix_ms > 0 and c.validate().isEmpty()
    cells = c.read_complete("value").groupBy("ordinal").agg(F.count("value").alias("n"), F.max("value").alias("high"))
    rows = cells.join(c.stats_by_dataset("value").select("ordinal", "name", "max_f"), "ordinal")
    return rows.select(F.col("name").alias("dataset"), "n", (F.lit(same) & (F.col("high") == F.col("max_f"))).alias("same"))


__all__ = ["DataFrame", "place", "stored"]
