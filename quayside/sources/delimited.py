"""Delimited text with a header line: external scans, quoted CSV, landing as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.workspace import quoted

# What stands for NULL in a delimited text table.
NULL_TEXT = "\\N"
# A character that no line may hold; a line that does makes the scan fail.
NEVER = "\u0001"


def text_schema(columns: Sequence[str]) -> T.StructType:
    """A schema of text columns; amounts and dates stay text until a query casts them."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def _lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Every line below the header of every file, as the one column `line`.

    The header of each file has to be `header`; else, or when a line holds NEVER, the scan fails
    when it runs. Files are split for reading. Blank lines are left out, as the reader gives them no row.
    """
    return (
        spark.read.schema(text_schema([header]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", NEVER)
        .option("quote", "")
        .option("mode", "FAILFAST")
        .csv(path)
        .toDF("line")
    )


def scan_delimited(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    *,
    separator: str = ",",
    empty_as_null: bool = False,
) -> DataFrame:
    """Scan a folder of delimited files, skipping one header line in every file.

    The rules are those of a delimited text table: quotes are ordinary characters, a field that a
    short line lacks is NULL, an empty field is an empty text (NULL with `empty_as_null`), `\\N` is
    NULL, and surplus fields are dropped. Only the selected fields are cut out.
    """
    fields = F.split("line", f"\\Q{separator}\\E", -1)
    rows = _lines(spark, path, separator.join(columns)).select(fields.alias("_f"))
    values = [F.nullif(F.get("_f", F.lit(i)), F.lit(NULL_TEXT)) for i in range(len(columns))]
    if empty_as_null:
        values = [F.nullif(value, F.lit("")) for value in values]
    return rows.select([value.alias(name) for value, name in zip(values, columns)])


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str], *, null_text: str = "") -> DataFrame:
    """Scan headered CSV whose quotes are doubled inside quoted fields; every column is text.

    An empty field is NULL, and so is one that is `null_text`; with a `null_text`, `""` is an empty text.

    A record is one line, so files are split for reading. A header in another order, a line with
    an odd number of quotes (a field with a line break) and a line with too few or too many fields make
    the scan fail; nothing is read by position or cut.
    """
    line = F.col("line")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    checked = F.when(odd, F.raise_error(F.concat(F.lit("a quoted field goes on in the next line: "), line))).otherwise(line)
    schema = ", ".join(f"{quoted_name} string" for quoted_name in ("`" + c.replace("`", "``") + "`" for c in columns))
    parsed = F.from_csv(checked, schema, {"mode": "FAILFAST", "escape": '"', "nullValue": null_text})
    return _lines(spark, path, ",".join(columns)).select(parsed.alias("_r")).select("_r.*")


def create_delimited_table(spark: SparkSession, table: str, columns: Sequence[str], location: str) -> None:
    """Fill a table from a scan of headered files, so that it has the rows and NULLs of the scan."""
    scan_delimited(spark, location, columns).write.saveAsTable(quoted(table))


def land_csv(spark: SparkSession, source: str, columns: Sequence[str], landing: str) -> DataFrame:
    """Land headered CSV files as Parquet, replacing what was landed; codes stay text."""
    scan_csv(spark, source, columns).write.mode("overwrite").parquet(landing)
    return spark.read.schema(text_schema(columns)).parquet(landing)
