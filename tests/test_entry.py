import pytest

import __spark_entry__ as entry
from ndcollect.plans import queries, stored


def test_entry_and_queries(spark):
    assert entry.entry(spark).count() == 5
    names = set(entry.queries())
    assert {"stats_by_dataset_float", "read_window_2d"} <= names and set(entry.oracle_sql()) <= names


def test_slabs_are_assembled_over_all_events(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "value").collect()
    expected = []
    for ordinal, name in enumerate(sorted({r.event_type for r in rows})):
        values = [r.value for r in sorted((r for r in rows if r.event_type == name), key=lambda r: r.event_id)]
        expected += [(ordinal, i, -v if i >= 10 else v) for i, v in enumerate(values)]
    got = sorted(map(tuple, entry.queries()["slab_assembly"](spark, sf).select("ordinal", "i0", "value").collect()))
    assert len(expected) == len(rows) > 150 and got == expected


@pytest.mark.parametrize("name", ["stored_window_1d", "stored_fill", "stored_over_itself", "stored_delete", "operation_info", "command_line", "netcdf_ingest", "writer_values", "validate_collection"])
def test_stored_collections_against_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want


def test_stored_windows_are_pruned(spark, capsys):
    stored.stored(spark, queries.events(spark, "/root/testdata/sf0.001", chunk=[16]), "pruned").read_window("value", [40], [8]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(c0,2)" in plan and "LessThanOrEqual(c0,2)" in plan
