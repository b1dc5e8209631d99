"""Inputs in the shapes that the operators read, derived by Spark from whole given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.sinks import write_delimited, write_lines, write_partitioned
from quayside.workspace import new_path

STAGED = ["order_id", "first_name", "last_name", "item_code", "order_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: order, customer name in two parts, item and date."""
    orders, customers, lines = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    name = F.split("c_name", "#")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.get(name, F.lit(0)).alias("first_name"),
            F.get(name, F.lit(1)).alias("last_name"),
            F.col("l_partkey").alias("item_code"),
            F.to_date("o_orderdate").alias("order_date"),
        )
    )


def delimited_files(df: DataFrame, label: str) -> str:
    """A folder of headered files without quotes, the columns as text."""
    path = new_path(df.sparkSession, label)
    write_delimited(df, path)
    return path


def tab_lines(df: DataFrame, label: str) -> str:
    """A folder of tab separated lines."""
    path = new_path(df.sparkSession, label)
    write_lines(df, path)
    return path


def _orders_by_dt(spark: SparkSession, sf_dir: str, columns: Sequence[str], pattern: str) -> DataFrame:
    """Columns of the orders with their date as the text partition `dt`, written and read as a partitioned table."""
    path = new_path(spark, "orders_by_dt")
    orders = table(spark, sf_dir, "orders").select(*columns, F.date_format("o_orderdate", pattern).alias("dt"))
    write_partitioned(orders, path, ["dt"])
    return spark.read.schema(orders.schema).parquet(path)


def orders_by_month(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of the orders, partitioned by `dt` (yyyyMM)."""
    return _orders_by_dt(spark, sf_dir, columns, "yyyyMM")


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders, partitioned by `dt` (yyyyMMdd)."""
    return _orders_by_dt(spark, sf_dir, ["*"], "yyyyMMdd")


def dated_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with the day `upd` of their last change, and further versions of every fifth, 400 days later; many share a day."""
    first = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("upd"), F.pmod("o_orderkey", F.lit(8)).cast("int").alias("part")
    )
    later = first.where("o_orderkey % 5 = 0").withColumns({"status": F.lit("U"), "upd": F.date_add("upd", 400)})
    return first, later


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts")


def events_by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events with the text partitions `month` and `day`, and the folder that they lie in."""
    path = new_path(spark, "events_by_day")
    events = _events(spark, sf_dir).select("event_id", "event_type", F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"))
    write_partitioned(events, path, ["month", "day"])
    return spark.read.schema(events.schema).parquet(path), path


def events_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events partitioned by the date `d`."""
    path = new_path(spark, "events_by_date")
    events = _events(spark, sf_dir).select("event_id", "event_type", F.to_date("ts").alias("d"))
    write_partitioned(events, path, ["d"])
    return spark.read.schema(events.schema).parquet(path)


def access_log(spark: SparkSession, sf_dir: str) -> str:
    """A folder of access-log lines, one per event; some without user or bytes, some malformed."""
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("broken "), F.col("event_id"))).otherwise(
        F.concat(
            F.lit("10.0.0."), F.col("user_id") % 20, F.lit(" - "),
            F.when(F.col("event_id") % 7 == 0, "-").otherwise(F.concat(F.lit("u"), F.col("user_id"))),
            F.lit(' [10/Oct/2000:13:55:36 -0700] "GET /'), "event_type", F.lit(' HTTP/1.0" 200 '),
            F.when(F.col("event_id") % 5 == 0, "-").otherwise((F.col("event_id") % 1000).cast("string")),
            F.lit(' "http://example.com/" "agent"'),
        )
    )
    path = new_path(spark, "access_log")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return path


ORDERS_PER_DOCUMENT = 4096


def json_documents(spark: SparkSession, sf_dir: str, *, whole: bool = False) -> DataFrame:
    """Arrays of rows with a header, in the order of the keys (NULL last); every other customer has the columns in another order.

    With `whole`, one document per customer holds all its orders. Else there is one per customer and range of
    ORDERS_PER_DOCUMENT order keys, which are unique, so no document grows with a customer.
    """
    swapped = F.col("o_custkey") % 2 == 1
    a, b = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    row = F.when(swapped, F.array(b, a)).otherwise(F.array(a, b))
    header = F.when(swapped, F.array(F.lit("value"), F.lit("key"))).otherwise(F.array(F.lit("key"), F.lit("value")))
    entry = F.struct(F.col("o_orderkey").isNull().alias("last"), "o_orderkey", row.alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"])
    chunk = F.floor(F.col("o_orderkey") / ORDERS_PER_DOCUMENT).cast("bigint").alias("chunk")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey", *([] if whole else [chunk])).agg(rows.alias("rows"), F.first(header).alias("header"))
    return grouped.select("o_custkey", *([] if whole else ["chunk"]), F.to_json(F.concat(F.array("header"), "rows")).alias("doc"))
