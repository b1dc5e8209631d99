"""Queries whose input is not made smaller than the tables give it."""

from datetime import date

from pyspark.sql import functions as F

from quayside.plans import fixtures
from quayside.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_a_customer_has_one_document(spark, monkeypatch):
    """Orders with keys far apart, repeated or missing are numbered through in one document per customer."""
    orders = [(9000, 1, "F"), (1, 1, "O"), (5000, 1, None), (None, 1, "P"), (20, 2, "O"), (20, 2, "O"), (90000, 2, "F"), (3, None, "F"), (8000, None, "O")]
    monkeypatch.setattr(fixtures, "table", lambda spark, sf_dir, name: spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string"))
    assert fixtures.json_documents(spark, SF, whole=True).count() == 3
    found = plans.json_header_promotion(spark, SF).select("o_custkey", "row_number", "key", "status", "value").collect()
    assert {tuple(r) for r in found} == {
        (1, 1, "1", "ok", "O"), (1, 2, "5000", "ok", None), (1, 3, "9000", "ok", "F"), (1, 4, None, "ok", "P"),
        (2, 1, "20", "ok", "O"), (2, 2, "20", "ok", "O"), (2, 3, "90000", "ok", "F"), (None, 1, "3", "ok", "F"), (None, 2, "8000", "ok", "O"),
    }
    assert len(found) == len(orders)


def test_a_partition_is_a_day(spark, monkeypatch):
    """Every day, also one without a date, is a partition of its own with whole orders, and only the one asked for is read."""
    orders = [(1, 7, "O", date(1997, 5, 28)), (1, 7, "O", date(1997, 5, 28)), (2, None, "F", date(1997, 5, 28)), (3, 8, "F", date(1997, 5, 27)), (4, 8, "P", date(1997, 6, 28)), (5, 9, "P", None)]
    monkeypatch.setattr(fixtures, "table", lambda spark, sf_dir, name: spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date"))
    by_day = fixtures.orders_by_day(spark, SF)
    assert by_day.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "dt"]
    assert {r[0] for r in by_day.select(F.regexp_extract(F.input_file_name(), "/dt=([^/]*)/", 1)).collect()} == {"19970527", "19970528", "19970628", "__HIVE_DEFAULT_PARTITION__"}
    found = plans.partition_filter(spark, SF)
    assert "PartitionFilters: [isnotnull(dt" in found._jdf.queryExecution().toString()
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 7, '19970528')", "(1, 7, '19970528')", "(2, None, '19970528')"]
