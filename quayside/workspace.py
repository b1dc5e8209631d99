"""Shared places for what a job writes between its steps: folders, tables and cut lineage.

Everything goes below the folder the cluster names in `spark.checkpoint.dir`, so that every
executor sees it and a lost executor loses nothing. Where the session names none, the warehouse
folder takes its place, but on a cluster only if it is not a folder of one machine.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_roots: dict[str, str] = {}
_databases: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's own folder below `spark.checkpoint.dir`, or below the warehouse where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
            local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None
            if not local and re.match(r"(file:|/)", base):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
        _roots[app] = f"{base.rstrip('/')}/quayside-{uuid.uuid4().hex}"
        atexit.register(cleanup, spark)
    return _roots[app]


def cleanup(spark: SparkSession) -> None:
    """Drop the session's database and delete its folder; results that read from them end with it.

    It also runs when the driver's Python ends, if the session is still up then.
    """
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    app = spark.sparkContext.applicationId
    if database := _databases.pop(app, None):
        spark.sql(f"DROP DATABASE IF EXISTS {quoted(database)} CASCADE")
    if root := _roots.pop(app, None):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no one has used yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def session_database(spark: SparkSession) -> str:
    """A database of this session whose managed tables lie in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _databases:
        name = f"quayside_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION {text_literal(new_path(spark, 'database'))}")
        _databases[app] = name
    return _databases[app]


def new_table(spark: SparkSession, label: str) -> str:
    """A qualified table name that is not taken."""
    return f"{session_database(spark)}.{label}_{uuid.uuid4().hex}"


def text_literal(value: str) -> str:
    """`value` as a SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_parts(name: str) -> list[str]:
    """The parts of a dotted name; dots inside back quotes belong to a part."""
    parts = re.findall(r"`((?:[^`]|``)+)`|([^.`]+)", name)
    return [quoted_part.replace("``", "`") or plain for quoted_part, plain in parts]


def quoted(name: str) -> str:
    """Quote each part of a dotted name on its own.

    One pair of quotes around `db.table` would name a table with a dot in it: DROP would silently
    find nothing and CREATE would fail.
    """
    return ".".join("`" + part.replace("`", "``") + "`" for part in name_parts(name))


def columns_sql(columns: Sequence[str]) -> str:
    """Column names as a quoted, comma separated list."""
    return ", ".join("`" + column.replace("`", "``") + "`" for column in columns)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the cut in the lineage is a real table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
