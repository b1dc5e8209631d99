"""SQL statements: batches, scripts, saved queries."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.listing import list_objects
from quayside.workspace import quoted

REPORT = "n int, name string, ok boolean, error string, message string, seconds double"


def execute(spark: SparkSession, statement: str, args: Mapping | None = None) -> DataFrame:
    """Run a statement to its end and return its result.

    A command runs when it is given to Spark. A query does not, so its rows are computed and thrown
    away; an error in any row is raised here and not when someone reads the result.
    """
    result = spark.sql(statement, args=dict(args or {}))
    result.write.format("noop").mode("overwrite").save()
    return result


def _reported(spark: SparkSession, steps: Sequence[tuple[str, Callable[[], DataFrame]]], on_error: str) -> tuple[DataFrame, DataFrame | None]:
    """Run the named steps in order; the REPORT of those that ran, and the result of the last that went well."""
    if on_error not in ("continue", "stop"):
        raise ValueError(f"unknown mode {on_error}")
    rows, last = [], None
    for number, (name, step) in enumerate(steps, 1):
        start = time.monotonic()
        try:
            last = step()
            rows.append((number, name, True, None, None, time.monotonic() - start))
        except PySparkException as error:
            rows.append((number, name, False, error.getCondition(), str(error).split("\n")[0], time.monotonic() - start))
            if on_error == "stop":
                break
    return spark.createDataFrame(rows, REPORT), last


def run_batch(spark: SparkSession, statements: Sequence[str], args: Mapping | None = None, *, on_error: str = "continue") -> DataFrame:
    """Run all statements in order; the REPORT has one row for each that ran, `name` being its text.

    Every statement is executed, a query as well as a command, so `ok` says that it went through
    and not only that it could be planned. A failed statement is reported with the condition of the
    error, and the next one runs; with `on_error="stop"` none does. What a failed statement had changed
    before stays changed.
    """
    steps = [(statement, lambda statement=statement: execute(spark, statement, args)) for statement in statements]
    return _reported(spark, steps, on_error)[0]


def script_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Name and text of a script file, or of all files of a folder by name; none is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    if not rows:
        raise ValueError(f"no script in {path}")
    return sorted((row["name"], row["value"]) for row in rows)


def as_block(script: str) -> str:
    """A script as one block: statements that semicolons separate need no BEGIN and END of their own."""
    text = script.strip()
    if text[:5].upper() == "BEGIN" and text[5:6].isspace():
        return text
    return f"BEGIN\n{text.rstrip(';')}\n;\nEND"


def run_scripts(spark: SparkSession, path: str, args: Mapping | None = None, *, on_error: str = "stop") -> tuple[DataFrame, DataFrame | None]:
    """Run a script file, or all files of a folder in the order of their names.

    A file holds statements that semicolons separate, or a `BEGIN ... END` block, with variables,
    conditions and handlers for errors. Returns the REPORT, one row per file that ran, and the result of the
    last query of the last file that went well. After a file that failed (and had no handler) the rest do not run,
    or with `on_error="continue"` they do. `args` are the named parameters of all files.
    """
    steps = [(name, lambda text=text: execute(spark, as_block(text), args)) for name, text in script_files(spark, path)]
    return _reported(spark, steps, on_error)


def run_script(spark: SparkSession, path: str, args: Mapping | None = None) -> DataFrame:
    """The result of the last query of the scripts of `path`; the first error of any is raised."""
    result = None
    for _, text in script_files(spark, path):
        result = execute(spark, as_block(text), args)
    return result


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON in `row`; a NULL column is there as null."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))


def refresh_query(spark: SparkSession, query: str, tables: Sequence[str], args: Mapping | None = None) -> DataFrame:
    """Run a saved query on the current state of its tables."""
    for table in tables:
        spark.catalog.refreshTable(quoted(table))
    return spark.sql(query, args=dict(args or {}))


def table_state(spark: SparkSession, table: str) -> str:
    """A text that changes with the files of a table: their number, bytes, times and names, without reading them."""
    found = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").collect() if r["col_name"] == "Location"]
    if not found:
        raise ValueError(f"{table} has no files of its own, so its state cannot be told")
    names = F.sum(F.xxhash64("key", "length", "modified").cast("decimal(38,0)"))
    return "/".join(map(str, list_objects(spark, found[0]).agg(F.count(F.lit(1)), F.sum("length"), F.max("modified"), names).first()))


def result_key(spark: SparkSession, query: str, tables: Sequence[str], args: Mapping | None = None) -> str:
    """What a stored result belongs to: the query's text, its parameters with their types, and the state of its tables."""
    given = {name: [type(value).__name__, str(value)] for name, value in (args or {}).items()}
    states = {quoted(table): table_state(spark, table) for table in tables}
    return hashlib.sha256(json.dumps([query, given, states], sort_keys=True).encode()).hexdigest()


def stored_results(spark: SparkSession, store: str, key: str) -> list[tuple[float, str]]:
    """Time and path of the results under `key` that were written to the end, the latest last."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{key}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [status.getPath().getParent() for status in found or []]
    return sorted((int(path.getName().split("-")[0]) / 1000, path.toString()) for path in paths)


def saved_result(
    spark: SparkSession, query: str, tables: Sequence[str], args: Mapping | None = None, *, store: str, max_age: float | None = 0
) -> DataFrame:
    """The rows of a saved query, from `store` if they are there and not too old, else computed and stored.

    A stored result belongs to the query's text, its parameters and the state of its `tables` (all
    that it reads), so a table that has changed is never answered from an old result. `max_age` is the age in
    seconds up to which a stored result is served; 0 serves none and runs the query, None serves
    any. Results are written whole before they can be found, and several jobs may write the same.
    """
    key = result_key(spark, query, tables, args)
    fresh = [path for at, path in stored_results(spark, store, key) if max_age is None or time.time() - at <= max_age] if max_age != 0 else []
    if fresh:
        return spark.read.parquet(fresh[-1])
    path = f"{store}/{key}/{int(time.time() * 1000)}-{uuid.uuid4().hex}"
    rows = refresh_query(spark, query, tables, args)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
