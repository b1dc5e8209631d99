"""Edge cases of sources and operators on small inputs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quayside.functions.dates import as_date, run_date_predicate
from quayside.functions.text import line_byte_count, word_count
from quayside.operators import changes, checks, rollups
from quayside.session import SESSION_CONF, build_session, shuffle_conf
from quayside.sources.delimited import scan_csv, scan_delimited
from quayside.sources.documents import promote_header
from quayside.sources.listing import list_objects
from quayside.sources.text import split_columns
from quayside.workspace import name_parts, new_path, new_table, quoted, text_literal


def files(tmp_path, *texts):
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.csv").write_text(text)
    return f"file://{tmp_path}"


def test_delimited_short_blank_and_surplus(spark, tmp_path):
    path = files(tmp_path, "A,B,C\n1,2,3\n\n4\n5,,\n", "A,B,C\n6,7,8,9\n\\N,\"x\",y\n")
    rows = {tuple(r) for r in scan_delimited(spark, path, ["A", "B", "C"]).collect()}
    assert rows == {("1", "2", "3"), ("4", None, None), ("5", "", ""), ("6", "7", "8"), (None, '"x"', "y")}
    assert ("5", None, None) in {tuple(r) for r in scan_delimited(spark, path, ["A", "B", "C"], empty_as_null=True).collect()}


@pytest.mark.parametrize("text", ["B,A\n1,2\n", "A,B\n1,2\x01\n"])
def test_delimited_refuses(spark, tmp_path, text):
    with pytest.raises(Exception):
        scan_delimited(spark, files(tmp_path, text), ["A", "B"]).collect()


def test_csv_quotes(spark, tmp_path):
    path = files(tmp_path, 'A,B\n1,"x, ""y"""\n2,\n')
    assert {tuple(r) for r in scan_csv(spark, path, ["A", "B"]).collect()} == {("1", 'x, "y"'), ("2", None)}


@pytest.mark.parametrize("text", ['A,B\n02,"x\ny"\n', "B,A\n1,2\n", "A,B\n1,2,3\n"])
def test_csv_refuses(spark, tmp_path, text):
    with pytest.raises(Exception):
        scan_csv(spark, files(tmp_path, text), ["A", "B"]).collect()


def test_split_columns(spark):
    lines = spark.createDataFrame([("a\tb",), ("a",), ("a\tb\tc\td",), (None,)], "value string")
    assert [tuple(r) for r in split_columns(lines, ["x", "y"], rest="rest").collect()] == [("a", "b", None), ("a", None, None), ("a", "b", "c\td"), (None, None, None)]
    with pytest.raises(Exception):
        split_columns(lines, ["x", "y"]).collect()


def test_promote_header_keeps_every_document(spark):
    docs = spark.createDataFrame([(1, '[["a.b","c"],["1","2"],["3"]]'), (2, "{oops"), (3, None), (4, '[["c"]]'), (5, '[["c","a.b"],["x","01"]]')], "k int, doc string")
    rows = {tuple(r) for r in promote_header(docs, "doc", ["a.b", "c"], keep=["k"]).collect()}
    assert rows == {(1, "ok", 1, "1", "2"), (1, "ok", 2, "3", None), (2, "malformed", None, None, None), (3, "missing", None, None, None), (4, "empty", None, None, None), (5, "ok", 1, "01", "x")}


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("12")
    (tmp_path / "y.csv").write_text("1")
    assert {tuple(r)[:4] for r in list_objects(spark, f"file://{tmp_path}").collect()} == {("a/x.csv", "a", "x.csv", 2), ("y.csv", "", "y.csv", 1)}
    assert list_objects(spark, f"file://{tmp_path}/none").columns == ["key", "folder", "name", "length", "modified"]
    with pytest.raises(Exception):
        checks.files_missing(spark, spark.createDataFrame([("_a",)], "folder string"), f"file://{tmp_path}").collect()


def test_access_log(spark):
    good = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a b HTTP/1.0" 200 {} "r" "a"{}'
    lines = [good.format(5, ""), good.format("-", ""), good.format(7, " tail"), good.replace("bob", "-").format(9, ""), "junk", None, "\x01" + good.format(1, "")]
    rows = {tuple(r) for r in rollups.access_log_rollup(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert rows == {("1.2.3.4", "bob", "GET /a b HTTP/1.0", 3, 12), (None, None, None, 4, 9)}


def test_text_and_dates(spark):
    df = spark.createDataFrame([(None,), ("",), (" a  b\tc",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [None, 0, 3]
    assert [r[0] for r in df.select(line_byte_count(F.col("t"))).collect()] == [None, 1, 8]
    assert as_date(datetime(2024, 3, 1, 5)) == date(2024, 3, 1) and type(as_date(datetime(2024, 3, 1, 5))) is date
    days = spark.createDataFrame([("02", "29"), ("03", "01"), ("03", "29")], "month string, day string")
    assert {tuple(r) for r in days.where(run_date_predicate("2024-03-01")).collect()} == {("02", "29"), ("03", "01")}
    assert {tuple(r) for r in days.where(run_date_predicate("2024-03-01", mode="cross")).collect()} == {("03", "01"), ("03", "29")}


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    name = new_table(spark, "t")
    changes.recreate_table(spark, name, rows)
    changes.append_rows(spark, name, rows.select("v", "k"))
    assert spark.table(quoted(name)).count() == 3
    changes.append_once(spark, name, spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), ["k"])
    changes.incremental_import(spark, spark.createDataFrame([(3, "again"), (4, "d"), (1, "old")], "k int, v string"), name, "k", ["k"])
    assert sorted(r["k"] for r in spark.table(quoted(name)).collect()) == [1, 2, 2, 3, 4]
    with pytest.raises(Exception):
        changes.append_once(spark, name, spark.createDataFrame([(None, "x")], "k int, v string"), ["k"])


def test_checks(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    assert {tuple(r) for r in checks.result_diff(a, b).collect()} == {(1, None, "left_only", 1), (2, "x", "left_only", 1), (3, "y", "right_only", 1)}
    assert checks.result_diff(a, a).count() == 0


def test_trailing_days(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 7)), ("a", date(2024, 1, 8))], "k string, d date")
    assert [r["n_trailing"] for r in rollups.trailing_measure(df, "k", "d").orderBy("d").collect()] == [1, 2, 2]


def test_workspace(spark):
    assert name_parts("`a.b`.c") == ["a.b", "c"] and quoted("`a.b`.c") == "`a.b`.`c`"
    assert spark.sql(f"select {text_literal(chr(39) + chr(92) + 'x')} as v").first()[0] == "'\\x"
    assert new_path(spark, "p").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_session(spark):
    assert shuffle_conf(1 << 40, 8) == {"spark.sql.shuffle.partitions": "8192"} and shuffle_conf(0, 8) == {"spark.sql.shuffle.partitions": "8"}
    same = build_session(spark__sql__shuffle__partitions="4")
    assert same.sparkContext is spark.sparkContext and all(spark.conf.get(key) == value for key, value in SESSION_CONF.items())
