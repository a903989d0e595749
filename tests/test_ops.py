import json
import math
import pathlib
import types


import numpy as np
import pytest
from pyspark.sql import functions as F

from ndcollect import Collection, CollectionError, log, ops
from ndcollect.cli import Encoder, human_bytes, main, show_value
from ndcollect.errors import SourceError, UnsupportedType
from ndcollect.functions import conversions
from ndcollect.sources import classic_writer, location, netcdf


class Var:
    def __init__(self, dims, values, **attrs):
        self.dims, self.data, self.attrs, self.encoding, self.chunks = dims, np.asarray(values), attrs, {}, None

    shape = property(lambda s: s.data.shape)
    dtype = property(lambda s: s.data.dtype)
    size = property(lambda s: s.data.size)
    values = property(lambda s: s.data)

    def __getitem__(self, key):
        return types.SimpleNamespace(values=self.data[tuple(key)])


class Data:
    """As much of an xarray dataset as ingest looks at."""

    def __init__(self, coords, data_vars, **attrs):
        self.coords, self.data_vars, self.attrs = coords, data_vars, attrs

    def __getitem__(self, name):
        return {**self.coords, **self.data_vars}[name]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def month(path):
    if "bad" in path.name:
        raise OSError("not a NetCDF file")
    m = int(path.stem[-2:])
    return Data({"lat": Var(("lat",), np.arange(4.0)), "lon": Var(("lon",), np.arange(6.0))}, {"temperature": Var(("lat", "lon"), np.arange(24, dtype="f4").reshape(4, 6) + m), "station": Var(("lat",), np.array(list("abcd"), object), long="name"), "age": Var(("lat",), np.arange(4).astype("m8[s]"))}, month=m, source="test", bounds=[1, 2])


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("nc")
    (root / "q1").mkdir()
    for name in ("2024-01.nc", "q1/2024-02.NC", "2024-03.nc", "bad.nc", "notes.txt"):
        (root / name).write_text("")
    path = str(tmp_path_factory.mktemp("out") / "c")
    seen = []
    got = ops.create(root, path, chunks={"temperature": [2, 3]}, workers=2, on_error="skip", opener=lambda p: month(pathlib.Path(p)), progress=seen.append, spark=spark)
    return root, path, got, seen


def test_create_skips_and_reports(made):
    _, path, got, seen = made
    assert got["datasets"] == ["2024-01.nc", "2024-03.nc", "2024-02.NC"] == seen and len(got["skipped"]) == 1 and "bad.nc" in got["skipped"][0]["file"]
    assert sorted(x.name for x in pathlib.Path(path).iterdir() if not x.name.startswith(".")) == ["data", "manifest.json"]


def test_create_stops(spark, made, tmp_path):
    root = made[0]
    with pytest.raises(CollectionError, match="bad.nc"):
        ops.create(root, str(tmp_path / "x"), opener=lambda p: month(pathlib.Path(p)), spark=spark)
    with pytest.raises(CollectionError):
        Collection.open(spark, str(tmp_path / "x"))
    for bad in ({"on_error": "maybe"}, {"workers": 0}, {"open_chunks": "odd"}):
        with pytest.raises((CollectionError, ValueError)):
            ops.create(root, str(tmp_path / "x"), opener=month, spark=spark, **bad)
    with pytest.raises(CollectionError):
        ops.create(tmp_path / "nothing", str(tmp_path / "x"), spark=spark)


def test_describe_and_info(spark, made):
    d = ops.describe(made[1], "some/where/2024-01.nc", spark=spark)
    assert d["dimensions"] == {"lat": 4, "lon": 6} and d["coordinates"] == ["lat", "lon"] and d["attributes"] == {"month": 1, "source": "test", "bounds": [1, 2]}
    t = next(a for a in d["arrays"] if a["name"] == "temperature")
    assert t["chunk_shape"] == [2, 3] and t["stats"] == {"min": 1.0, "max": 24.0, "null_count": 0, "row_count": 24} and math.isnan(t["fill_value"])
    age = next(a for a in d["arrays"] if a["name"] == "age")
    assert age["dtype"] == "int64" and age["stats"]["max"] == 3 * 10**9
    s = ops.info(made[1], spark=spark)
    assert s["dataset_count"] == 3 and s["interned_schemas"] == 1 and s["array_stats"]["temperature"]["row_count"] == 72 and s["array_stats"]["station"]["max"] == b"d"
    with pytest.raises(CollectionError):
        ops.describe(made[1], "nothing.nc", spark=spark)


def test_cli(spark, made, capsys):
    path = made[1]
    assert main(["ls", path]) == 0 and capsys.readouterr().out.split() == ["2024-01.nc", "2024-03.nc", "2024-02.NC"]
    assert main(["show", path, "2024-01.nc"]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("dataset 2024-01.nc {\ndimensions:\n\tlat = 4 ;") and "temperature:_ChunkShape = [2, 3] ;" in shown and "// ordinal 0" in shown
    assert main(["info", path, "--json"]) == 0 and json.loads(capsys.readouterr().out)["array_stats"]["station"]["min"] == "a"
    assert main(["rm", path, "nothing"]) == 1
    assert main(["rm", path, "x/2024-03.nc", "nothing", "--missing-ok"]) == 0
    assert "2 dataset(s) remain" in capsys.readouterr().out
    assert main(["info", path]) == 0 and "(of 3 written; space not reclaimed)" in capsys.readouterr().out
    assert main(["ls", path + "-no"]) == 1


def test_formats():
    assert [human_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 40)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "5.0 TiB"]
    assert [show_value(v) for v in (None, True, "a", b"b", [1, "x"], 2.5, b"\xff", {"k": 1})] == ["-", "true", '"a"', '"b"', '1, "x"', "2.5", "b'\\xff'", '{"k": 1}']
    assert json.dumps([b"x", b"\xff\x00"], cls=Encoder) == '["x", "ff00"]'


def test_files_and_options(spark, made):
    assert [p.rpartition("/")[2] for p, _ in netcdf.find_files(spark, made[0])] == ["2024-01.nc", "2024-03.nc", "bad.nc", "2024-02.NC"]
    assert len(netcdf.find_files(spark, made[0], recursive=False)) == 3
    assert netcdf.parse_bytes("64MiB") == 64 << 20 and netcdf.parse_bytes("1.5 kB") == 1500
    v = Var(("y", "x"), np.zeros((100, 50)))
    shape = lambda mode, budget=1 << 20, size=0, own=None: netcdf.block_shape(v, mode, budget, size, own)
    assert shape("auto") == [100, 50] == shape(None) == shape("native") and shape("auto", 4000, 10**6) == [13, 25] and shape("auto", 4000, 1000) == [100, 50]
    assert shape({"y": 10, "x": -1}) == [10, 50] and shape("auto", own=[7, 500]) == [7, 50]
    v.encoding["chunksizes"] = (20, 25)
    assert shape("native") == [20, 25]


def test_missing_texts_warn():
    import pandas as pd

    with pytest.warns(UserWarning, match="4 missing"):
        assert netcdf.texts(np.array(["1", None, b"2", math.nan, pd.NA, pd.NaT], object), "", "qc") == ["1", "", "2", "", "", ""]
    for bad in ([object()], ["a"] * 64 + [3, {"k": 1}]):
        with pytest.raises(UnsupportedType):
            netcdf.texts(np.array(bad, object), "", "x")


def test_fills():
    own = lambda dtype, attrs={}, explicit=None: netcdf.resolve_fill("v", np.dtype(dtype), attrs, explicit)  # noqa: B006, E731
    assert own("i4") is None and math.isnan(own("f4")) and own("O") == own("U3") == "" and own("M8[ns]") == own("m8[ns]") == -(2**63)
    assert own("S4", {"_FillValue": b"-"}) == "-" and own("i2", {"_FillValue": np.array(-9, "i2")}) == -9 and own("f8", {"_FillValue": np.float32(2)}) == 2.0
    assert own("M8[s]", {"_FillValue": np.datetime64("1970-01-02", "D")}) == 86_400 * 10**9 and own("m8[s]", {"_FillValue": np.timedelta64(3, "s")}) == 3 * 10**9
    assert own("f4", {"_FillValue": 1.0}, {"v": 5}) == 5 and own("f4", {"_FillValue": 1.0}, {"v": None}) is None and own("f4", {"_FillValue": 1.0}, {"w": 5}) == 1.0
    assert own("f4", {}, 7) == 7 and own("O", {}, 7) == "" and own("i8", {}, 7) == 7


def date(y, m, d, calendar):
    return types.SimpleNamespace(year=y, month=m, day=d, hour=0, minute=0, second=0, calendar=calendar)


def test_calendars(spark):
    days = netcdf.calendar_ns(np.array([date(2024, 1, 1, "julian"), date(1973, 2, 25, "julian"), date(2024, 1, 1, "standard"), None, math.nan], object))
    assert [str(np.datetime64(d, "ns"))[:10] for d in days[:3]] == ["2024-01-14", "1973-03-10", "2024-01-01"] and days[3] == days[4] == -(2**63)
    with pytest.raises(UnsupportedType):
        netcdf.calendar_ns(np.array([date(2024, 1, 1, "360_day")], object))
    row = spark.range(1).select(conversions.day_number(F.lit(1900), F.lit(2), F.lit(29)).alias("a"), conversions.calendar_to_ns(F.lit(2024), F.lit(1), F.lit(1), None, "proleptic_gregorian").alias("b")).first()
    assert str(np.datetime64(row.a, "D")) == "1900-03-13" and row.b == 1_704_067_200 * 10**9


def test_locations(spark):
    assert location.resolve("a/b") == "a/b" and location.resolve("file:///x") == location.resolve("file:/x") == "file:///x" and location.resolve("s3a://b/k") == "s3a://b/k" == location.resolve("s3://b/k")
    assert location.resolve(b"/p") == "/p" == location.resolve(pathlib.Path("/p")) and location.resolve("C:/x") == "C:/x"
    for bad in ("ftp://x/y", "nothing:/x"):
        with pytest.raises(SourceError):
            location.resolve(bad)
    assert location.use(spark, "s3://bucket-1/k", {"region": "eu-north-1", "skip_signature": True, "endpoint": None}) == "s3a://bucket-1/k"
    conf = spark._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.bucket-1.endpoint.region") == "eu-north-1" and "Anonymous" in conf.get("fs.s3a.bucket.bucket-1.aws.credentials.provider") and conf.get("fs.s3a.endpoint.region") != "eu-north-1"
    for where, options in (("/p", {"region": "x"}), ("s3://b/k", {"odd": 1})):
        with pytest.raises(SourceError):
            location.use(spark, where, options)


def monthly(root, months=(1, 2, 3), version=2):
    for m in months:
        variables = {
            "lat": (("lat",), np.arange(4.0), {}), "lon": (("lon",), np.arange(6.0), {}), "time": ((), np.array(m - 1, "f8"), {"units": "days since 2024-01-01"}),
            "temperature": (("lat", "lon"), np.arange(24, dtype="f4").reshape(4, 6) + m, {"units": "K", "coordinates": "time"}), "counts": (("lat",), np.array([10, 20, 30, 40], "i4"), {"_FillValue": np.int32(20)}),
            "station": (("lat", "len"), np.array([list("ab"), list("b\0"), list("c "), list("\0\0")], "S1"), {"long_name": "name"}), "packed": (("lat",), np.array([0, 1, 2, -1], "i2"), {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-1)}),
        }
        classic_writer.write(root / f"2024-{m:02}.nc", {"lat": 4, "lon": 6, "len": 2}, variables, {"month": np.int32(m), "source": "test", "bounds": np.array([1, 2], "i4")}, version)


@pytest.mark.parametrize("version", [1, 2, 5])
def test_real_files(spark, tmp_path, version):
    monthly(tmp_path, version=version)
    got = ops.create(tmp_path, tmp_path / "c", spark=spark)
    assert got["datasets"] == ["2024-01.nc", "2024-02.nc", "2024-03.nc"] and not got["skipped"]
    c = Collection.open(spark, tmp_path / "c")
    assert c.array_stats("temperature") == {"min": 1.0, "max": 26.0, "null_count": 0, "row_count": 72} and c.interned_schemas() == 1 and c.validate().isEmpty()
    assert c.array_stats("counts") == {"min": 10, "max": 40, "null_count": 3, "row_count": 12} and c.array_stats("station") == {"min": b"ab", "max": b"c", "null_count": 3, "row_count": 12}
    assert c.array_stats("packed") == {"min": 10.0, "max": 11.0, "null_count": 3, "row_count": 12}
    d = c.dataset("2024-02.nc")
    assert d.list_arrays() == ["lat", "lon", "time", "temperature", "counts", "station", "packed"] and d.dimensions() == {"lat": 4, "lon": 6}
    assert d.attributes() == {"month": 2, "source": "test", "bounds": "json:[1, 2]"} and d.get_array_attribute("temperature", "units") == "K" and d.layout("counts")["fill_value"] == 20
    assert d.read_values("temperature", "float32", [1, 2], [2, 2]) == [10.0, 11.0, 16.0, 17.0] and d.read_values("station") == ["ab", "b", "c", ""]
    assert str(np.datetime64(d.read_values("time")[0], "ns"))[:10] == "2024-01-02" and d.layout("time")["is_coordinate"] and d.layout("time")["dtype"] == "timestamp_ns"


def test_records_calendars_and_large_files(spark, tmp_path):
    values = np.arange(5 * 300 * 7, dtype="f8").reshape(5, 300, 7)
    julian = {"units": "hours since 2024-01-01 12:00", "calendar": "julian", "_FillValue": -1.0}
    classic_writer.write(tmp_path / "a.nc", {"t": None, "y": 300, "x": 7}, {"t": (("t",), np.array([0.0, 24.0, -1.0, 48.5, 72.0]), julian), "big": (("t", "y", "x"), values, {}), "flag": (("t",), np.array([1, 2, 3, 4, 5], "i2"), {})}, {}, 2)
    classic_writer.write(tmp_path / "b.nc", {"t": None}, {"only": (("t",), np.array([1, 2, 3], "i1"), {}), }, {}, 1)
    classic_writer.write(tmp_path / "c.nc", {"t": None}, {"none": (("t",), np.zeros(0, "f4"), {})}, {}, 1)
    with pytest.raises(CollectionError, match="convert_calendar"):
        ops.create(tmp_path, tmp_path / "c", spark=spark)
    ops.create(tmp_path, tmp_path / "c", spark=spark, convert_calendar=True, chunk_size="16KiB")
    c = Collection.open(spark, tmp_path / "c")
    d = c.dataset("a.nc")
    assert math.prod(d.layout("big")["chunk_shape"]) * 8 <= 16 << 10 and d.read_values("big") == values.ravel().tolist() and d.read_values("flag") == [1, 2, 3, 4, 5]
    assert [str(np.datetime64(x, "ns"))[:16] for x in d.read_values("t")] == ["2024-01-14T12:00", "2024-01-15T12:00", "NaT", "2024-01-16T12:30", "2024-01-17T12:00"]
    assert d.array_stats("t")["null_count"] == 1 and c.dataset("b.nc").read_values("only") == [1, 2, 3] and c.array_stats("none") == {"min": None, "max": None, "null_count": 0, "row_count": 0}
    raw = Collection.open(spark, ops.create(tmp_path, tmp_path / "raw", spark=spark, decode_times=False)["destination"]).dataset("a.nc")
    assert raw.layout("t")["dtype"] == "float64" and raw.get_array_attribute("t", "calendar") == "julian" and raw.array_stats("t")["null_count"] == 1


def test_policies_and_log_lines(spark, tmp_path):
    monthly(tmp_path)
    (tmp_path / "more").mkdir()
    monthly(tmp_path / "more", (3, 4))
    (tmp_path / "z.nc").write_bytes(b"no NetCDF file")
    classic_writer.write(tmp_path / "x.nc", {"t": 2}, {"t": (("t",), np.array([0.0, 1.0]), {"units": "days since 2000-01-01", "calendar": "360_day"}), "v": (("t",), np.array([1, 2], "i4"), {})})
    handler = log.log_to_file(str(tmp_path / "log.txt"))
    assert log.log_to_file(str(tmp_path / "log.txt")) is handler
    seen = []
    try:
        got = ops.create(tmp_path, tmp_path / "c", spark=spark, on_error="skip", on_unsupported="skip", progress=seen.append, workers=3)
    finally:
        log.LOGGER.removeHandler(handler)
        handler.close()
    assert got["datasets"] == ["2024-01.nc", "2024-02.nc", "2024-03.nc", "2024-04.nc", "x.nc"] and sorted(seen) == sorted(got["datasets"])
    assert {x["file"].rpartition("/")[2] for x in got["skipped"]} == {"z.nc", "2024-03.nc"} and got["skipped_arrays"] == [{"dataset": "x.nc", "array": "t", "dtype": "object"}]
    text = (tmp_path / "log.txt").read_text()
    assert "INFO" in text and "ingesting 7 file(s)" in text and "WARNING" in text and "skipping" in text and "z.nc" in text and "skipped array 't' of dtype object of x.nc" in text and "wrote 5 dataset(s)" in text
    assert Collection.open(spark, tmp_path / "c").list_datasets() == got["datasets"]
    with pytest.raises(CollectionError):
        ops.create(tmp_path, tmp_path / "d", spark=spark)


def test_many_waves_keep_the_order_of_files(spark, tmp_path):
    for i in range(40):
        classic_writer.write(tmp_path / f"f{i:03}.nc", {"x": 3}, {"v": (("x",), np.arange(3, dtype="i4") + i, {})})
    got = ops.create(tmp_path, tmp_path / "c", spark=spark, workers=1, fills={"v": 2})
    c = Collection.open(spark, tmp_path / "c")
    assert got["datasets"] == c.list_datasets() == [f"f{i:03}.nc" for i in range(40)] and c.dataset("f039.nc").read_values("v") == [39, 40, 41]
    assert c.array_stats("v") == {"min": 0, "max": 41, "null_count": 3, "row_count": 120}
