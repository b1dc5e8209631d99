"""Listings of stored objects by prefix."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme and authority of its file system."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")


def root_path(spark: SparkSession, prefix: str) -> str:
    """The path of `prefix` inside its file system."""
    return spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, prefix)).toUri().getPath().rstrip("/")


def relative(path: Column, root: str) -> Column:
    """The place of a full path below `root`."""
    return F.substr(F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", ""), F.lit(len(root) + 2))


def list_objects(spark: SparkSession, prefix: str, glob: str = "*") -> DataFrame:
    """Every object below `prefix`: `key` relative to it, `folder`, `name`, `length` and the time `modified`.

    Only file status is read, never content. A prefix that does not exist is an empty listing.
    Names that begin with `_` or `.`, in any part of the key, are hidden from Spark and not listed.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(prefix)
            .select("path", "length", F.col("modificationTime").alias("modified"))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, folder string, name string, length bigint, modified timestamp")
    key = relative(F.col("path"), root_path(spark, prefix))
    return files.select(key.alias("key"), "length", "modified").select(
        "key",
        F.regexp_replace("key", r"/?[^/]*$", "").alias("folder"),
        F.substring_index("key", "/", -1).alias("name"),
        "length",
        "modified",
    )
