"""Imports, retries and exports: what they add, what a second run changes, and what their scans read."""

import glob
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quayside.operators import changes
from quayside.operators.sinks import write_partitioned
from quayside.workspace import new_path, new_table, quoted

ROWS = "id int, upd int, v string"


def made(spark, rows, schema=ROWS, partition=()):
    name = new_table(spark, "t")
    df = spark.createDataFrame(rows, schema)
    changes.recreate_table(spark, name, df, partition=partition)
    if rows:
        changes.append_rows(spark, name, df)
    return name


def content(spark, name):
    return sorted((tuple(r) for r in spark.table(quoted(name)).collect()), key=str)


@pytest.mark.parametrize("mode, want", [("append", [(1, 10, "a"), (1, 20, "new"), (2, 11, "b"), (3, 11, "tie"), (3, 21, "new")]), ("latest", [(1, 20, "new"), (2, 11, "b"), (3, 21, "new")])])
def test_import_keeps_updates_and_ties(spark, mode, want):
    """An update above the mark is imported, a new row that ties with the mark too, a row below the mark not; a second run adds nothing."""
    name = made(spark, [(1, 10, "a"), (2, 11, "b")])
    source = spark.createDataFrame([(1, 20, "new"), (3, 21, "new"), (3, 11, "tie"), (2, 11, "b"), (4, 5, "late")], ROWS)
    for _ in range(2):
        changes.incremental_import(spark, source, name, "upd", ["id"], mode=mode)
        assert content(spark, name) == want
        assert changes.stored_mark(spark, name, "upd") == "21"


@pytest.mark.parametrize("mode, want", [("append", [(1, 90, "a"), (2, 100, "b"), (2, 95, "older"), (3, 95, "late")]), ("latest", [(1, 90, "a"), (2, 100, "b"), (3, 95, "late")])])
def test_import_of_late_rows(spark, mode, want):
    """A row below the mark is imported as far down as `lookback` reaches, once; it does not replace a later one, and the mark stays."""
    name = made(spark, [])
    changes.incremental_import(spark, spark.createDataFrame([(1, 90, "a"), (2, 100, "b")], ROWS), name, "upd", ["id"], mode=mode)
    later = spark.createDataFrame([(1, 90, "a"), (2, 100, "b"), (2, 95, "older"), (3, 95, "late"), (4, 94, "too late")], ROWS)
    for _ in range(2):
        changes.incremental_import(spark, later, name, "upd", ["id"], mode=mode, lookback=5)
        assert content(spark, name) == want
        assert changes.stored_mark(spark, name, "upd") == "100"
    with pytest.raises(ValueError):
        changes.incremental_import(spark, later, name, "upd", ["id"], mode=mode, lookback=-1)


@pytest.mark.parametrize("kind, at", [("date", lambda k: date(2024, 3, 1) + timedelta(days=k)), ("timestamp", lambda k: datetime(2024, 3, 1, 12) + timedelta(days=k)), ("double", float)])
def test_import_of_late_rows_by_type(spark, kind, at):
    """Dates and timestamps take a time span, over the end of a month too."""
    schema = f"id int, upd {kind}"
    name = made(spark, [], schema)
    back = 2.0 if kind == "double" else timedelta(days=2)
    changes.incremental_import(spark, spark.createDataFrame([(1, at(0))], schema), name, "upd", ["id"], lookback=back)
    late = spark.createDataFrame([(1, at(0)), (2, at(-2)), (3, at(-3))], schema)
    for _ in range(2):
        changes.incremental_import(spark, late, name, "upd", ["id"], lookback=back)
        assert content(spark, name) == [(1, at(0)), (2, at(-2))]


def test_import_after_a_lost_mark(spark):
    """Rows that an import has added before it could store its mark are not added again."""
    name = made(spark, [])
    changes.incremental_import(spark, spark.createDataFrame([(1, 10, "a")], ROWS), name, "upd", ["id"])
    changes.append_rows(spark, name, spark.createDataFrame([(2, 12, "b")], ROWS))
    changes.incremental_import(spark, spark.createDataFrame([(1, 10, "a"), (2, 12, "b"), (3, 12, "c")], ROWS), name, "upd", ["id"])
    assert content(spark, name) == [(1, 10, "a"), (2, 12, "b"), (3, 12, "c")]


@pytest.mark.parametrize("mode", ["append", "latest"])
@pytest.mark.parametrize("bad", [[(5, None, "x")], [(None, 50, "x")], [(5, 50, "x"), (5, 50, "y")]])
def test_import_refuses(spark, mode, bad):
    """A NULL check value, a NULL key and a key twice with one check value."""
    name = made(spark, [(1, 10, "a")])
    with pytest.raises(Exception):
        changes.incremental_import(spark, spark.createDataFrame(bad, ROWS), name, "upd", ["id"], mode=mode)
    assert content(spark, name) == [(1, 10, "a")]


def test_import_by_date_in_partitions(spark):
    """Dates as marks; only partitions with imported rows are written anew."""
    schema = "id int, upd date, part int"
    name = made(spark, [(k, date(2024, 1, k), k % 2) for k in (1, 2, 3, 4)], schema, ["part"])
    source = spark.createDataFrame([(1, date(2024, 2, 1), 1), (7, date(2024, 2, 1), 1)], schema)
    folder = [r["data_type"] for r in spark.sql(f"describe extended {quoted(name)}").collect() if r["col_name"] == "Location"][0].removeprefix("file:")
    before = set(glob.glob(f"{folder}/part=0/*.parquet"))
    for _ in range(2):
        changes.incremental_import(spark, source, name, "upd", ["id"], mode="latest", partition="part")
    assert content(spark, name) == [(1, date(2024, 2, 1), 1), (2, date(2024, 1, 2), 0), (3, date(2024, 1, 3), 1), (4, date(2024, 1, 4), 0), (7, date(2024, 2, 1), 1)]
    assert changes.stored_mark(spark, name, "upd") == "2024-02-01" and before and before == set(glob.glob(f"{folder}/part=0/*.parquet"))
    with pytest.raises(ValueError):
        changes.incremental_import(spark, source, name, "upd", ["id"], mode="other")


@pytest.mark.parametrize("lookback, least", [(None, 11), (3, 8)])
def test_import_reads_the_target_from_the_mark(spark, monkeypatch, lookback, least):
    """The filter on the mark, less what is looked back, reaches the scan of the target."""
    name = made(spark, [(1, 10, "a")])
    source = spark.createDataFrame([(2, 11, "b")], ROWS)
    changes.incremental_import(spark, source, name, "upd", ["id"])
    plans = []
    monkeypatch.setattr(changes, "append_rows", lambda spark, table, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    changes.incremental_import(spark, source, name, "upd", ["id"], lookback=lookback)
    assert f"PushedFilters: [IsNotNull(upd), GreaterThanOrEqual(upd,{least})" in plans[0]


def test_append_once_refuses_a_key_twice(spark):
    name = made(spark, [(1, 10, "a")])
    for bad in ([(2, 1, "x"), (2, 1, "y")], [(None, 1, "x")]):
        with pytest.raises(Exception):
            changes.append_once(spark, name, spark.createDataFrame(bad, ROWS), ["id"])
    for _ in range(2):
        changes.append_once(spark, name, spark.createDataFrame([(1, 11, "again"), (2, 12, "b")], ROWS), ["id"])
    assert content(spark, name) == [(1, 10, "a"), (2, 12, "b")]


def test_replaced_partitions(spark):
    """A retry leaves the table as it is, also with NULL and odd partition values; a key twice changes nothing."""
    schema = "id int, day string"
    name = made(spark, [(1, "a/ b"), (2, "c"), (3, None)], schema, ["day"])
    batch = spark.createDataFrame([(4, "a/ b"), (5, None), (6, "new")], schema)
    mode = spark.conf.get(changes.OVERWRITE_MODE)
    for _ in range(2):
        changes.replace_partitions(spark, name, batch, keys=["id"])
        assert content(spark, name) == [(2, "c"), (4, "a/ b"), (5, None), (6, "new")]
    with pytest.raises(Exception):
        changes.replace_partitions(spark, name, spark.createDataFrame([(7, "c"), (7, "c")], schema), keys=["id"])
    assert content(spark, name) == [(2, "c"), (4, "a/ b"), (5, None), (6, "new")] and spark.conf.get(changes.OVERWRITE_MODE) == mode
    with pytest.raises(ValueError):
        changes.replace_partitions(spark, made(spark, [(1, "a")], schema), batch)


def test_exported_partition_is_replaced(spark):
    schema = "id int, v string, dt string"
    source = spark.createDataFrame([(1, "a", "x'1"), (2, None, "x'1"), (3, "c", "2")], schema)
    target = made(spark, [(9, "old", "x'1"), (8, "stays", "3")], schema, ["dt"])
    for _ in range(2):
        changes.export_partition(spark, source, "dt", "x'1", target)
    assert content(spark, target) == [(1, "a", "x'1"), (2, None, "x'1"), (8, "stays", "3")]


def test_partitions_have_few_files(spark):
    """However many tasks had rows of a partition; the scan of one partition opens its files alone."""
    path = new_path(spark, "parts")
    write_partitioned(spark.range(0, 3000, 1, 12).select("id", (F.col("id") % 5).cast("string").alias("dt")), path, ["dt"])
    files = [len(glob.glob(f"{path.removeprefix('file://')}/dt={k}/*.parquet")) for k in range(5)]
    assert all(1 <= n <= 2 for n in files)
    one = spark.read.schema("id bigint, dt string").parquet(path).where("dt = '3'")
    assert one.count() == 600
    assert "PartitionFilters: [isnotnull(dt" in one._jdf.queryExecution().executedPlan().toString()


def test_registered_table_has_its_partitions(spark):
    path, name = new_path(spark, "folders"), new_table(spark, "registered")
    df = spark.range(10).select("id", F.lpad(F.col("id").cast("string"), 2, "0").alias("day"))
    write_partitioned(df, path, ["day"])
    changes.register_table(spark, name, df, path, partition=["day"])
    assert spark.sql(f"show partitions {quoted(name)}").count() == 10 and changes.partition_columns(spark, name) == ["day"]
    assert spark.table(quoted(name)).where("day = '07'").first()["id"] == 7
