"""Scans of tables partitioned by a true date, from a table of run dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_scan(dated: DataFrame, runs: DataFrame, day: str, *, days: int = 7, run_date: str = "run_date") -> DataFrame:
    """The rows of `dated` of the `days` days that end with a run date of `runs`, with that date as `run_date`.

    `dated` is partitioned by the DATE column `day`. The days wanted are a join side of their own, so
    the scan is pruned to their partitions when the query runs, however `runs` came about, and
    days of another month or year are days like any other. A row appears once for each run whose
    days hold it; equal run dates are one run, a NULL run date none. `runs` is a list of dates.
    """
    asked = runs.select(F.col(f"`{run_date}`").cast("date").alias("run_date")).where("run_date is not null").distinct()
    first = F.date_sub("run_date", days - 1)
    wanted = asked.select("run_date", F.explode(F.sequence(first, F.col("run_date"))).alias("_day")).where(F.col("_day") >= first)
    return dated.join(wanted, F.col(f"`{day}`") == F.col("_day")).drop("_day")
