"""Comparisons, completeness checks, dated scans and files."""

import subprocess
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quayside.operators import changes, checks, rollups
from quayside.operators.sinks import write_csv, write_delimited, write_lines, write_partitioned
from quayside.plans import fixtures
from quayside.sources.dated import trailing_scan
from quayside.sources.delimited import create_delimited_table, scan_csv, scan_delimited
from quayside.sources.documents import promote_header
from quayside.sources.text import scan_lines
from quayside.workspace import new_path, new_table, quoted

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_diff_by_buckets(spark):
    """The rows of differing buckets alone; NULL in one column is not NULL in another; duplicates and order."""
    rows = [(k % 50, None if k % 7 else k, f"v{k % 3}") for k in range(400)]
    a = spark.createDataFrame(rows, "a int, b int, c string")
    b = spark.createDataFrame([*rows[::-1], (1, None, None)], "a int, b int, c string")
    assert checks.result_diff(a, a.orderBy("c")).count() == 0 and checks.differing_buckets(a, a).count() == 0
    assert [tuple(r) for r in checks.result_diff(a, b).collect()] == [(1, None, None, "right_only", 1)]
    assert checks.differing_buckets(a, b).count() == 1
    x, y = spark.createDataFrame([(None, 1)], "p int, q int"), spark.createDataFrame([(1, None)], "p int, q int")
    assert sorted(tuple(r) for r in checks.result_diff(x, y).select("side", "times").collect()) == [("left_only", 1), ("right_only", 1)]
    zero = spark.createDataFrame([(0.0, float("nan"))], "p double, q double")
    assert checks.result_diff(zero, spark.createDataFrame([(-0.0, float("nan"))], "p double, q double"), buckets=1).count() == 0
    assert checks.result_diff(a.where("false"), a.where("false")).count() == 0


def test_equal_results_shuffle_digests_only(spark):
    path = new_path(spark, "rows")
    spark.range(5000).select("id", F.col("id").cast("string").alias("s")).write.parquet(path)
    one, two = spark.read.parquet(path), spark.read.parquet(path)
    diff = checks.result_diff(one, two, buckets=64)
    assert diff.collect() == []
    final = plan_of(diff).split("== Initial Plan ==")[0]
    # With no differing bucket, the side of the rows is gone from the plan that ran.
    assert "EmptyRelation" in final or "LocalTableScan" in final


def test_partitions_from_the_catalogue(spark, tmp_path):
    """No data file is opened: the files hold no Parquet. A folder without rows counts once it is registered."""
    for day in ("01", "02", "a b+c%2F"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.parquet").write_text("broken")
    (tmp_path / "day=05").mkdir()
    name = new_table(spark, "t")
    like = spark.createDataFrame([], "v int, day string")
    changes.register_table(spark, name, like, f"file://{tmp_path}", partition=["day"])
    (tmp_path / "day=06").mkdir()
    days = spark.createDataFrame([("01",), ("02",), ("03",), ("05",), ("06",), ("a b+c/",), (None,), ("03",)], "day string")
    assert sorted(str(r["day"]) for r in checks.partitions_missing(spark, name, [days]).collect()) == ["03", "06", "None"]


def test_partitions_by_two_columns_and_null(spark):
    name = new_table(spark, "t")
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, None, 1)], "v int, p string, q int")
    changes.recreate_table(spark, name, df, partition=["p", "q"])
    changes.append_rows(spark, name, df)
    p = spark.createDataFrame([("x",), (None,)], "p string")
    q = spark.range(1, 4).select(F.col("id").cast("int").alias("q"))
    assert sorted(map(str, ((r["p"], r["q"]) for r in checks.partitions_missing(spark, name, [p, q]).collect()))) == ["('x', 3)", "(None, 2)", "(None, 3)"]


def test_files_missing_looks_into_folders(spark, tmp_path):
    for file in ("a/x", "b/deep/er/y", "c/_hidden", "d/.z", "e/_tmp/w", "odd name+%/v"):
        (tmp_path / file).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / file).write_text("1")
    (tmp_path / "empty").mkdir()
    expected = spark.createDataFrame([(f,) for f in ("a", "b", "b/deep", "c", "d", "e", "odd name+%", "empty", "none", "a")], "folder string")
    assert sorted(r["folder"] for r in checks.files_missing(spark, expected, f"file://{tmp_path}").collect()) == ["c", "d", "e", "empty", "none"]
    assert checks.files_missing(spark, expected, f"file://{tmp_path}/nowhere").count() == 9


def test_trailing_scan_over_the_end_of_a_year(spark):
    path = new_path(spark, "dated")
    days = [date(2023, 12, 20) + timedelta(days=k) for k in range(40)]
    write_partitioned(spark.createDataFrame([(k, d) for k, d in enumerate(days)], "id int, d date"), path, ["d"])
    dated = spark.read.schema("id int, d date").parquet(path)
    runs = spark.createDataFrame([("2024-01-03",), ("2024-01-03",), (None,), ("2024-03-01",)], "run_date string")
    found = trailing_scan(dated, runs, "d")
    assert sorted((str(r["run_date"]), str(r["d"])) for r in found.collect()) == [("2024-01-03", str(date(2023, 12, 28) + timedelta(days=k))) for k in range(7)]
    assert "dynamicpruning" in plan_of(trailing_scan(dated, runs, "d"))
    scanned = [m for m in plan_of(found).split("\n") if "Scan parquet" in m]
    assert scanned and trailing_scan(dated, runs.where("false"), "d").count() == 0


def test_csv_comes_back(spark):
    """Commas, quotes, spaces, empty texts and NULLs; what a line cannot hold is refused."""
    rows = [("a,b", '"', " x "), ("", None, "\\"), (None, "", 'say "hi", you'), ("é", "\t", "#c")]
    df, path = spark.createDataFrame(rows, "p string, `q.r` string, s string"), new_path(spark, "csv")
    write_csv(df, path)
    assert {tuple(r) for r in scan_csv(spark, path, df.columns, null_text="\\N").collect()} == set(rows)
    for bad in ("two\nlines", "\\N", "cr\r"):
        with pytest.raises(Exception):
            write_csv(spark.createDataFrame([(bad,)], "p string"), new_path(spark, "bad"))


def test_delimited_comes_back(spark):
    rows = [('"a"', None, "x y"), ("", " z ", "\\"), ("'", "", "é")]
    df, path = spark.createDataFrame(rows, "p string, q string, r string"), new_path(spark, "delimited")
    write_delimited(df, path, separator="|")
    assert {tuple(r) for r in scan_delimited(spark, path, df.columns, separator="|").collect()} == set(rows)
    name = new_table(spark, "from_files")
    other = new_path(spark, "delimited")
    write_delimited(df, other)
    create_delimited_table(spark, name, df.columns, other)
    assert {tuple(r) for r in spark.table(quoted(name)).collect()} == set(rows)
    for bad in (("a,b", "c"), ("a\n", "b")):
        with pytest.raises(Exception):
            write_delimited(spark.createDataFrame([bad], "p string, q string"), new_path(spark, "bad"))
    with pytest.raises(Exception):
        write_delimited(spark.createDataFrame([("",)], "p string"), new_path(spark, "bad"))


def test_lines_keep_fields_in_place(spark):
    path = new_path(spark, "lines")
    write_lines(spark.createDataFrame([(1, None, "x"), (None, "b", "")], "p int, q string, r string"), path)
    assert {r["value"] for r in scan_lines(spark, path).collect()} == {"1\t\\N\tx", "\\N\tb\t"}


def test_file_counts_equal_wc(spark, tmp_path):
    """Files that end with and without a line feed, with carriage returns, empty, in folders and under odd names."""
    texts = {"a.txt": b"one two\nthree\n", "b.txt": b"no end", "c d+%.txt": b"cr\r\nlf \r\n\r\nx\r", "deep/d.txt": b"\n\n\n", "e.txt": b"", "f.txt": "é ü\n\x0b\x0c tab\tx".encode(), "g.txt": b" " * 300 + b"\n" + b"w " * 50_000}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r["key"]: (r["lines"], r["words"], r["bytes"]) for r in rollups.file_text_counts(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wc = {name: tuple(map(int, subprocess.run(["wc", "-lwc", str(tmp_path / name)], capture_output=True, text=True, env={"LC_ALL": "C.UTF-8"}).stdout.split()[:3])) for name in texts}
    assert rows == {name: counts for name, counts in wc.items() if name != "e.txt"} and wc["e.txt"] == (0, 0, 0)


def test_documents_as_variants(spark):
    """Fields of any type are text, a NULL stays one, a row that is no array has no fields."""
    docs = spark.createDataFrame([(1, '[["a","b"],[1,true],[null,{"x":[1]}],5,[]]'), (2, '{"a":1}'), (3, "[]"), (4, '["a"]')], "k int, doc string")
    rows = [tuple(r) for r in promote_header(docs, "doc", ["a", "b"], keep=["k"]).orderBy("k", "row_number").collect()]
    assert rows == [(1, "ok", 1, "1", "true"), (1, "ok", 2, None, '{"x":[1]}'), (1, "ok", 3, None, None), (1, "ok", 4, None, None), (2, "malformed", None, None, None), (3, "empty", None, None, None), (4, "empty", None, None, None)]


def test_documents_are_bounded(spark, monkeypatch):
    """A customer with many orders has many documents, none with more rows than the range of keys."""
    monkeypatch.setattr(fixtures, "ORDERS_PER_DOCUMENT", 100)
    monkeypatch.setattr(fixtures, "table", lambda spark, sf_dir, name: spark.range(1000).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("F").alias("o_orderstatus")))
    docs = fixtures.json_documents(spark, SF)
    assert docs.count() == 10 and promote_header(docs, "doc", ["key"], keep=["chunk"]).groupBy("chunk").count().agg(F.max("count")).first()[0] == 100
