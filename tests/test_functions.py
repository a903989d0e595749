import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ndcollect import ArraySpec, Collection, from_dataframe, save
from ndcollect.errors import CorruptCollection
from ndcollect.functions import conversions, ndindex
from ndcollect.operators import hyperslab, statistics
from ndcollect.plans.queries import _numbered
from ndcollect.sources.ingest import union


@pytest.mark.parametrize("shape,chunk", [([7], [3]), ([4, 6], [2, 5]), ([3, 1, 5], [2, 1, 2]), ([2, 3, 2, 2, 3], [1, 2, 2, 1, 2]), ([], [])])
def test_packing_and_unpacking_are_inverse(spark, shape, chunk):
    n = reduce(lambda a, b: a * b, shape, 1)
    axes = [f"i{k}" for k in range(len(shape))]
    index = ndindex.unravel(F.col("id"), [F.lit(s).cast("long") for s in shape])
    cells = spark.range(n).select(F.lit(0).alias("ordinal"), *(i.alias(a) for i, a in zip(index, axes)), F.col("id").alias("value"))
    chunks = hyperslab.pack(cells, axes, shape, chunk)
    assert chunks.count() == ndindex.chunk_count([0] * len(shape), shape, chunk)
    back = hyperslab.unpack(chunks, axes, shape, chunk)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_domain_of_an_empty_axis_is_empty(spark):
    assert spark.range(1).select(ndindex.axis_domain("i", 3, 0)).count() == 0
    assert [r.i for r in spark.range(1).select(ndindex.axis_domain("i", 3, 2)).collect()] == [3, 4]
    assert spark.range(1).select(ndindex.element_count(F.array().cast("array<bigint>")).alias("n")).first().n == 1


def test_nan_fill_counts_as_missing_and_bounds_skip_nan(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("nan")), ("a", 2, -2.0), ("b", 0, float("nan"))], "d string, i long, v double")
    for fill, nulls in ((float("nan"), {"a": 1, "b": 1}), (None, {"a": 0, "b": 0})):
        c = from_dataframe(rows, "d", {"x": ArraySpec("v", {"n": "i"}, fill=fill)})
        got = {r.name: r for r in c.stats_by_dataset("x").collect()}
        assert {k: r.null_count for k, r in got.items()} == nulls and (got["a"].min_f, got["a"].max_f) == (-2.0, 1.0) and got["b"].min_f is None


def test_numbering_in_stretches(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"))
    got = {(r.k, r.o): r.i for r in _numbered(rows, "k", "o", width=64).collect()}
    want = {(k, o): i for k in range(3) for i, o in enumerate(sorted(j * 7 for j in range(1000) if j % 3 == k))}
    assert got == want


def test_gregorian_day_numbers(spark):
    days = [datetime.date(1600, 2, 29), datetime.date(1970, 1, 1), datetime.date(2024, 12, 31)]
    rows = spark.createDataFrame([(d.year, d.month, d.day, d) for d in days], "y int, m int, d int, at date")
    got = rows.select(conversions.day_number(F.col("y"), F.col("m"), F.col("d"), "proleptic_gregorian").alias("n"), F.unix_date("at").alias("w")).collect()
    assert all(r.n == r.w for r in got)
    switch = rows.limit(1).select(*(conversions.day_number(F.lit(1582), F.lit(10), F.lit(d), "standard").alias(f"d{d}") for d in (4, 15))).first()
    assert switch.d15 == switch.d4 + 1


def test_times_and_durations(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.000001' AS t, interval '1 02:03:04.5' day to second AS d").select(conversions.timestamp_to_ns(F.col("t")).alias("t"), conversions.duration_to_ns(F.col("d")).alias("d"), conversions.ns_to_timestamp(F.lit(1_704_067_200_000_001_999)).cast("string").alias("b")).first()
    assert r.t == 1_704_067_200_000_001_000 and r.d == (86400 + 2 * 3600 + 3 * 60 + 4.5) * 10**9 and r.b == "2024-01-01 00:00:00.000001"


def test_saved_frames_read_back(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 2).alias("d"), F.floor(F.col("id") / 2).alias("i"), F.col("id").alias("v"))
    c = save(from_dataframe(rows, "d", {"x": ArraySpec("v", {"n": "i"}, chunk=[16])}, {"n": ("int64", F.count(F.lit(1)))}), str(tmp_path / "c"))
    again = Collection.open(spark, str(tmp_path / "c"))
    assert c.list_datasets() == ["d0", "d1"] and again.dataset("d1").read_values("x", "int64", [30], [3]) == [61, 63, 65]
    assert again.attributes_by_dataset("n") == {"d0": 100, "d1": 100} and again.segment_bytes()["x"] > 0


def test_mixed_types_stay_apart(spark):
    ints = spark.createDataFrame([("a", 0, 5)], "d string, i long, v int")
    texts = spark.createDataFrame([("b", 0, "z")], "d string, i long, v string")
    c = union(from_dataframe(ints, "d", {"x": ArraySpec("v", {"n": "i"})}), from_dataframe(texts, "d", {"x": ArraySpec("v", {"n": "i"})}))
    assert c.array_stats("x") == {"min": 5, "max": 5, "null_count": 0, "row_count": 1}
    assert statistics.final(c.stats).count() == 1
    with pytest.raises(CorruptCollection):
        c.array_chunks("x")
