"""Fixtures as rows, with hand-computed results."""

import math

import pytest
from pyspark.sql import functions as F

from ndcollect import Collection, CollectionWriter, save
from ndcollect.errors import ArrayAlreadyExists, ArrayNotFound, CorruptCollection, CorruptMask, DatasetAlreadyExists, DatasetNotFound, InvalidName, InvalidValue, NotACollection, UnsupportedType, UnsupportedVersion, WriterFinished
from ndcollect.sources import location

NAN = math.nan
NS = 1_700_000_000_000_000_000


def fill_main(w):
    for month, name, values in ((1, "jan_2024", [float(i) for i in range(32)]), (2, "feb_2024", [-1.5] * 32)):
        with w.add_dataset(name) as d:
            d.define_array("temperature", "float32", ["lat", "lon"], [4, 8], [2, 4], NAN)
            d.define_array("counts", "int64", ["lat"], [4])
            d.write("temperature", values)
            d.set_attribute("month", month)
            if month == 1:
                d.write("counts", [10, 20, 30, 40])
                d.set_attribute("source", "buoy")
                d.set_attribute("units", "celsius", "temperature")
    with w.add_dataset("stations") as d:
        d.define_array("name", "string", ["station"], [3])
        d.define_array("observed", "timestamp_ns", ["station"], [3], fill=-(2**63))
        d.write("name", ["alpha", "beta", "gamma"])
        d.write("observed", [NS, NS + 10**9, NS + 2 * 10**9])
        d.set_attribute("installed", 1_600_000_000_000_000_000)
        d.set_attribute("installed_units", "ns since epoch")


@pytest.fixture(scope="module")
def main_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("main") / "c")
    with CollectionWriter(spark, path) as w:
        fill_main(w)
    return path


@pytest.fixture(scope="module")
def main(spark, main_path):
    return Collection.open(spark, main_path)


def test_catalogue(main):
    assert main.list_datasets() == ["jan_2024", "feb_2024", "stations"] and len(main) == 3 and "jan_2024" in main
    assert main.list_arrays() == ["counts", "name", "observed", "temperature"]
    assert main.dataset("stations").list_arrays() == ["name", "observed"]
    assert main.validate().isEmpty()


def test_stats_fold_over_datasets(main):
    assert main.array_stats("temperature") == {"min": -1.5, "max": 31.0, "null_count": 0, "row_count": 64}
    assert main.array_stats("counts") == {"min": 10, "max": 40, "null_count": 4, "row_count": 8}
    assert main.array_stats("name")["min"] == b"alpha" and main.array_stats("nothing") is None
    rows = main.stats_by_dataset("temperature").collect()
    assert [(r.name, r.max_f) for r in rows] == [("jan_2024", 31.0), ("feb_2024", -1.5)]


def test_attributes(main):
    assert main.attributes_by_dataset("month") == {"jan_2024": 1, "feb_2024": 2}
    assert main.attributes_by_dataset("units", "temperature") == {"jan_2024": "celsius"}
    d = main.dataset("stations")
    assert d.attributes() == {"installed": 1_600_000_000_000_000_000, "installed_units": "ns since epoch"}
    assert d.get_attribute("nothing") is None and d.array_attributes("nothing") == {}
    with pytest.raises(ArrayNotFound):
        d.get_array_attribute("nothing", "x")


def test_windows(main):
    jan = main.dataset("jan_2024")
    assert jan.read_values("temperature", "float32", [1, 3], [2, 2]) == [11.0, 12.0, 19.0, 20.0]
    assert jan.read_values("temperature") == [float(i) for i in range(32)]
    assert main.dataset("feb_2024").read_values("counts") == [0, 0, 0, 0]
    assert jan.touched_chunks("temperature", [0, 0], [2, 2]) == 1
    assert main.dataset("stations").read_values("observed")[2] == NS + 2 * 10**9
    for bad in (lambda: jan.read("temperature", "float64"), lambda: jan.read("temperature", None, [3, 0], [2, 2])):
        with pytest.raises(CorruptCollection):
            bad()
    with pytest.raises(ArrayNotFound):
        jan.read("nothing")


def test_chunk_bounds_reach_the_scan(main, capsys):
    main.dataset("jan_2024").read("temperature", None, [0, 0], [2, 2]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "array" in plan and "GreaterThanOrEqual(c0,0)" in plan and "LessThanOrEqual(c1,0)" in plan


def test_schemas_and_layout(main):
    assert main.interned_schemas() == 3
    at = main.dataset("jan_2024").layout("temperature")
    assert (at["shape"], at["chunk_shape"], at["dimension_names"], at["element_count"]) == ([4, 8], [2, 4], ["lat", "lon"], 32)
    assert math.isnan(at["fill_value"]) and at["attribute_names"] == ["units"]
    assert main.dataset("jan_2024").dimensions() == {"lat": 4, "lon": 8}


def test_deletion_is_all_or_nothing_and_accumulates(spark, tmp_path):
    path = str(tmp_path / "c")
    with CollectionWriter(spark, path) as w:
        fill_main(w)
    one, two = Collection.open(spark, path), Collection.open(spark, path)
    with pytest.raises(DatasetNotFound):
        one.delete_datasets(["feb_2024", "nothing"])
    assert one.dataset_count() == 3 and one.delete_datasets([]) == 0 and not location.exists(spark, f"{one.root}/mask.json")
    assert one.delete_datasets(["feb_2024", "feb_2024"]) == 1
    assert two.delete_datasets(["stations"]) == 1
    c = Collection.open(spark, path)
    assert c.list_datasets() == ["jan_2024"] and c.total_datasets() == 3
    assert c.array_stats("temperature") == {"min": 0.0, "max": 31.0, "null_count": 0, "row_count": 32}
    with pytest.raises(DatasetNotFound):
        c.delete_datasets(["feb_2024"])
    for text in ("nonsense", '{"mask": "nowhere"}', "[]"):
        location.write_text(spark, f"{c.root}/mask.json", text)
        with pytest.raises(CorruptMask):
            Collection.open(spark, path)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no Parquet")
    location.write_text(spark, f"{c.root}/mask.json", '{"mask": "../../../../broken"}')
    with pytest.raises(CorruptMask):
        Collection.open(spark, path)


def test_stored_masks_with_unknown_ordinals_warn(spark, tmp_path, caplog):
    with CollectionWriter(spark, str(tmp_path / "c")) as w:
        fill_main(w)
    c = Collection.open(spark, str(tmp_path / "c"))
    spark.createDataFrame([(99,), (1,)], "ordinal int").write.parquet(f"{c.root}/mask/m")
    location.write_text(spark, f"{c.root}/mask.json", '{"mask": "m"}')
    with caplog.at_level("WARNING", logger="ndcollect"):
        assert Collection.open(spark, str(tmp_path / "c")).list_datasets() == ["jan_2024", "stations"]
    assert "1 unknown ordinals" in caplog.text


def test_saving_over_itself_and_failing_midway(spark, tmp_path):
    path = str(tmp_path / "c")
    with CollectionWriter(spark, path) as w:
        fill_main(w)
    c = Collection.open(spark, path)
    c.delete_datasets(["feb_2024"])
    again = save(Collection.open(spark, path), path, "none")
    assert again.codec == "none" and again.total_datasets() == 3 == again.dataset_count() and again.dataset("jan_2024").read_values("temperature", None, [1, 3], [2, 2]) == [11.0, 12.0, 19.0, 20.0]
    assert len(list((tmp_path / "c" / "data").iterdir())) == 1
    broken = Collection.open(spark, path)
    broken.chunks["g"] = broken.chunks["g"].withColumn("values", F.raise_error(F.lit("disk on fire")).cast("array<float>"))
    with pytest.raises(Exception, match="disk on fire"):
        save(broken, path)
    assert len(list((tmp_path / "c" / "data").iterdir())) == 1 and Collection.open(spark, path).array_stats("temperature")["row_count"] == 64
    twice = Collection.open(spark, path)
    twice.datasets = twice.datasets.withColumn("name", F.lit("same"))
    with pytest.raises(DatasetAlreadyExists):
        save(twice, path)
    assert Collection.open(spark, path).list_datasets() == ["jan_2024", "feb_2024", "stations"]


def test_repeated_names_are_refused_at_open(spark, tmp_path):
    path = str(tmp_path / "c")
    with CollectionWriter(spark, path) as w:
        fill_main(w)
    c = Collection.open(spark, path)
    c.datasets.withColumn("name", F.lit("same")).write.mode("overwrite").parquet(str(tmp_path / "names"))
    import json
    import shutil

    shutil.rmtree(f"{c.root}/datasets")
    shutil.copytree(tmp_path / "names", f"{c.root}/datasets")
    location.write_text(spark, f"{path}/manifest.json", json.dumps({k: v for k, v in c.manifest.items() if k != "names_checked"}))
    with pytest.raises(CorruptCollection, match="same"):
        Collection.open(spark, path)


def test_schema_views(spark, tmp_path):
    def view(name, dtype="int64", key="k", value=1, arrays=("a", "b")):
        with CollectionWriter(spark, str(tmp_path / name)) as w, w.add_dataset("d") as d:
            for a in arrays:
                d.define_array(a, dtype, ["i"], [2])
            d.set_attribute("units", "m", arrays[0])
            d.set_attribute(key, value)
        return Collection.open(spark, str(tmp_path / name)).dataset("d").schema()

    one = view("one")
    assert len(one) == 2 and one.names() == ["a", "b"] and [a.dtype for a in one] == ["int64"] * 2 and one.index_of("b") == 1 and one.index_of("x") is None
    assert one.get("a").attribute_names == ("units",) and one.get("x") is None and one.get_index(1).name == "b" and one.get_index(2) is None
    assert one.pairs == (("k", "int64"),) and one.attribute_names == ("k",) and one.attribute_dtype("k") == "int64" and one.attribute_dtype("x") is None
    assert one == view("two", value="text") and one != view("three", dtype="int32") and one != view("four", key="other") and one != view("five", arrays=("b", "a"))


def test_container_introspection(spark, main):
    assert main.segment_names() == ["counts", "name", "observed", "temperature"] and main.format_version == 1 and main.codec == "zstd" and main.created_unix_ms > 10**12
    entry = main.segment_entry("temperature")
    assert entry["bytes"] > 0 and entry["paths"][0].endswith("array=temperature") and main.segment_entry("nothing") is None
    assert 0 < sum(main.segment_bytes().values()) < main.container_bytes() and main.validate().isEmpty()


def test_validation_finds_each_contradiction(spark, main_path):
    def faults(**changed):
        c = Collection.open(spark, main_path)
        for k, f in changed.items():
            setattr(c, k, f(getattr(c, k)))
        return {r.fault.split(" ")[0] + " " + r.fault.split(" ")[1] for r in c.validate().collect()}

    assert faults(stats=lambda t: t.withColumn("row_count", F.col("row_count") + 1)) == {"statistics contradict"}
    assert faults(stats=lambda t: t.withColumn("array", F.lit("x"))) == {"statistics of"}
    assert faults(mask=lambda t: spark.createDataFrame([(99,)], "ordinal int")) == {"mask of"}
    assert faults(chunks=lambda m: {k: t.withColumn("values", F.slice("values", 1, 1)) for k, t in m.items()}) == {"chunk of"}
    assert faults(datasets=lambda t: t.where("ordinal <> 1")) == {"layout of", "attribute of"} and "attribute of" in faults(layouts=lambda t: t.where("array <> 'temperature'"))


def test_mask_of_unknown_ordinals_is_ignored(spark, main_path):
    c = Collection.open(spark, main_path)
    c.mask = spark.createDataFrame([(99,)], "ordinal int")
    assert c.dataset_count() == 3


def test_unaligned_and_overlapping_slabs(spark, tmp_path):
    with CollectionWriter(spark, str(tmp_path / "c")) as w, w.add_dataset("d") as d:
        d.define_array("x", "int32", ["i"], [8], [3])
        for start, values in (([0], [0, 1]), ([2], [9, 9, 9, 9]), ([2], [2, 3, 4, 5]), ([6], [6, 7])):
            d.write("x", values, start, [len(values)])
    assert Collection.open(spark, str(tmp_path / "c")).dataset("d").read_values("x") == list(range(8))


def test_fill_is_null_and_partly_written_chunks(spark, tmp_path):
    with CollectionWriter(spark, str(tmp_path / "c"), "lz4") as w, w.add_dataset("d") as d:
        d.define_array("qc", "string", ["n"], [4], fill="")
        d.write("qc", ["1", "", "2", ""])
        d.define_array("p", "float32", ["a", "b"], [4, 4], [2, 3], 0.0)
        d.write("p", [1.0, 2.0], [0, 2], [1, 2])
        d.define_array("scalar", "float64", [], [])
        d.write("scalar", [7.5])
        d.define_array("empty", "float32", ["z", "y"], [0, 3])
        d.define_array("big", "uint64", ["k"], [2])
        d.write("big", [18_000_000_000_000_000_000, 1])
    c = Collection.open(spark, str(tmp_path / "c"))
    d = c.dataset("d")
    assert d.array_stats("qc") == {"min": b"1", "max": b"2", "null_count": 2, "row_count": 4}
    assert d.array_stats("p") == {"min": 1.0, "max": 2.0, "null_count": 14, "row_count": 16}
    assert d.read_values("p", None, [0, 1], [2, 3]) == [0.0, 1.0, 2.0, 0.0, 0.0, 0.0]
    assert d.read_values("scalar") == [7.5] and d.layout("scalar")["element_count"] == 1
    assert d.read_values("empty") == [] and d.array_stats("empty") == {"min": None, "max": None, "null_count": 0, "row_count": 0}
    assert d.layout("empty")["chunk_shape"] == [1, 3] and d.dimensions()["z"] == 0
    assert d.array_stats("big")["max"] == 18_000_000_000_000_000_000


def test_five_axes(spark, tmp_path):
    with CollectionWriter(spark, str(tmp_path / "c"), "none") as w, w.add_dataset("d") as d:
        d.define_array("x", "int16", list("abcde"), [2, 1, 3, 2, 3], [1, 1, 2, 2, 2])
        d.write("x", list(range(36)))
    assert Collection.open(spark, str(tmp_path / "c")).dataset("d").read_values("x", None, [1, 0, 1, 0, 1], [1, 1, 2, 1, 2]) == [25, 26, 31, 32]


def test_schema_order_counts_and_shape_does_not(spark, tmp_path):
    def collection(path, datasets):
        with CollectionWriter(spark, str(path)) as w:
            for name, arrays in datasets.items():
                with w.add_dataset(name) as d:
                    for a, values in arrays:
                        d.define_array(a, "float32", ["i"], [len(values)])
                        d.write(a, values)
        return Collection.open(spark, str(path))

    swapped = collection(tmp_path / "a", {"a": [("t", [1.0, 2.0]), ("s", [101.0, 102.0])], "b": [("s", [10.0, 11.0]), ("t", [110.0, 111.0])]})
    assert swapped.interned_schemas() == 2 and swapped.array_stats("t") == {"min": 1.0, "max": 111.0, "null_count": 0, "row_count": 4}
    sized = collection(tmp_path / "b", {"short": [("t", [1.5, 1.5])], "long": [("t", [1.5] * 3)]})
    assert sized.interned_schemas() == 1


def test_merged_schema_keeps_types_apart(spark, tmp_path):
    with CollectionWriter(spark, str(tmp_path / "c")) as w:
        for name, dtype, units in (("a", "float32", "K"), ("b", "float64", 3)):
            with w.add_dataset(name) as d:
                d.define_array("t", dtype, ["i"], [1])
                d.write("t", [1.0])
                d.set_attribute("units", units)
    c = Collection.open(spark, str(tmp_path / "c"))
    c.delete_datasets(["b"])
    got = {(r.scope, r.name): r.dtypes for r in c.merged_schema().collect()}
    assert got == {("array", "t"): ["float32", "float64"], ("attribute", "units"): ["int64", "string"]}


def test_writer_refusals(spark, tmp_path):
    w = CollectionWriter(spark, str(tmp_path / "c"))
    d = w.add_dataset("a")
    d.abort()
    with pytest.raises(DatasetAlreadyExists):
        w.add_dataset("a")
    with pytest.raises(InvalidName):
        w.add_dataset("x/y")
    d = w.add_dataset("b")
    d.define_array("x", "int8", ["i"], [2])
    for error, call in ((ArrayAlreadyExists, lambda: d.define_array("x", "int8", ["i"], [2])), (ArrayNotFound, lambda: d.write("y", [1])), (InvalidValue, lambda: d.write("x", [1, 2], [1], [2])), (UnsupportedType, lambda: d.define_array("f", "bool", ["i"], [2]))):
        with pytest.raises(error):
            call()
    d.set_attribute("k", 1)
    d.set_attribute("l", 2)
    d.set_attribute("k", 3)
    d.commit()
    c = w.commit()
    assert c.list_datasets() == ["b"] and list(c.dataset("b").attributes().items()) == [("k", 3), ("l", 2)]
    with pytest.raises(WriterFinished):
        w.add_dataset("c")


def test_ordinals_follow_the_order_of_adding(spark, tmp_path):
    with CollectionWriter(spark, str(tmp_path / "c")) as w:
        first, second = w.add_dataset("first"), w.add_dataset("second")
        second.commit()
        first.commit()
    assert Collection.open(spark, str(tmp_path / "c")).list_datasets() == ["first", "second"]


def test_empty_collections_and_rejections(spark, tmp_path):
    empty = CollectionWriter(spark, str(tmp_path / "e")).commit()
    assert empty.list_datasets() == [] and empty.list_arrays() == [] and empty.interned_schemas() == 0
    with CollectionWriter(spark, str(tmp_path / "n")) as w, w.add_dataset("only attributes") as d:
        d.set_attribute("a", 1)
    assert Collection.open(spark, str(tmp_path / "n")).dataset("only attributes").attributes() == {"a": 1}
    (tmp_path / "foreign").mkdir()
    with pytest.raises(NotACollection):
        Collection.open(spark, str(tmp_path / "foreign"))
    (tmp_path / "foreign" / "manifest.json").write_text("{}")
    with pytest.raises(NotACollection):
        Collection.open(spark, str(tmp_path / "foreign"))
    (tmp_path / "foreign" / "manifest.json").write_text('{"format": "ndcollect", "version": 99}')
    with pytest.raises(UnsupportedVersion):
        Collection.open(spark, str(tmp_path / "foreign"))


def test_failed_writer_leaves_no_collection(spark, tmp_path):
    with pytest.raises(RuntimeError):
        with CollectionWriter(spark, str(tmp_path / "c")) as w, w.add_dataset("a"):
            raise RuntimeError
    with pytest.raises(NotACollection):
        Collection.open(spark, str(tmp_path / "c"))


def test_filters_and_views(spark, main):
    assert [r.name for r in main.with_attribute("month", F.col("i") == 2).collect()] == ["feb_2024"]
    assert [r.name for r in main.with_stats("temperature", F.col("max_f") > 30).collect()] == ["jan_2024"]
    table = {r.name: (r.month, r.source) for r in main.catalogue_table({"month": "i", "source": "s"}).collect()}
    assert table == {"jan_2024": (1, "buoy"), "feb_2024": (2, None), "stations": (None, None)}
    main.register("v_")
    assert spark.sql("SELECT max(max_f) m FROM v_stats WHERE array = 'temperature'").first().m == 31.0
