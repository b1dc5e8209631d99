"""Batches, scripts and saved queries."""

import time

import pytest

from quayside.operators import changes, statements
from quayside.plans.queries import store_text
from quayside.workspace import new_path, new_table, quoted


def test_batch_runs_queries_to_their_end(spark):
    """A query that fails only when it runs is reported as failed; later statements run, or do not."""
    batch = ["select 1", "select raise_error('boom')", "select * from nowhere", "select 2 as a"]
    rows = statements.run_batch(spark, batch).collect()
    assert [(r["n"], r["ok"], r["error"]) for r in rows] == [(1, True, None), (2, False, "USER_RAISED_EXCEPTION"), (3, False, "TABLE_OR_VIEW_NOT_FOUND"), (4, True, None)]
    assert "boom" in rows[1]["message"] and [r["name"] for r in rows] == batch
    assert [r["ok"] for r in statements.run_batch(spark, batch, on_error="stop").collect()] == [True, False]
    assert statements.run_batch(spark, []).count() == 0
    with pytest.raises(ValueError):
        statements.run_batch(spark, batch, on_error="ignore")


def folder_of(spark, **files):
    folder = new_path(spark, "scripts")
    for name, text in files.items():
        store_text(spark, f"{folder}/{name}.sql", text)
    return folder


def test_scripts_run_by_name(spark):
    name = new_table(spark, "log")
    spark.sql(f"create table {quoted(name)} (n int) using parquet")
    folder = folder_of(
        spark,
        b_second="insert into identifier(:t) values (2); select * from nowhere",
        a_first="insert into identifier(:t) values (1) -- no semicolon",
        c_third="begin declare x int default 3; insert into identifier(:t) values (x); select x as last; end",
    )
    report, last = statements.run_scripts(spark, folder, {"t": quoted(name)})
    assert [(r["name"], r["ok"]) for r in report.collect()] == [("a_first.sql", True), ("b_second.sql", False)] and sorted(r["n"] for r in spark.table(quoted(name)).collect()) == [1, 2]
    report, last = statements.run_scripts(spark, folder, {"t": quoted(name)}, on_error="continue")
    assert [r["ok"] for r in report.collect()] == [True, False, True] and [r["last"] for r in last.collect()] == [3]
    with pytest.raises(Exception):
        statements.run_script(spark, folder, {"t": quoted(name)})
    assert statements.run_script(spark, f"{folder}/c_third.sql", {"t": quoted(name)}).first()["last"] == 3


def test_no_script_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        statements.run_scripts(spark, f"file://{tmp_path}")


def test_block(spark):
    assert statements.as_block(" begin select 1; end ") == "begin select 1; end"
    assert spark.sql(statements.as_block("select 1 as a; -- note\nselect 2 as a;")).first()["a"] == 2
    assert spark.sql(statements.as_block("select 3 as beginning")).first()["beginning"] == 3


def test_saved_result(spark, monkeypatch):
    """Miss, hit, too old, forced, other parameters, and a table that has changed."""
    name, store = new_table(spark, "saved"), new_path(spark, "store")
    changes.recreate_table(spark, name, spark.createDataFrame([], "a int, b string"))
    changes.append_rows(spark, name, spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    runs = []
    real = statements.refresh_query
    monkeypatch.setattr(statements, "refresh_query", lambda *a: runs.append(a[1]) or real(*a))

    def asked(max_age, least=0):
        args = {"t": quoted(name), "least": least}
        rows = statements.saved_result(spark, "select * from identifier(:t) where a > :least", [name], args, store=store, max_age=max_age)
        return sorted(r["row"] for r in statements.as_json(rows).collect()), len(runs)

    both = ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert asked(3600) == (both, 1)
    assert asked(3600) == (both, 1) and asked(None) == (both, 1)
    assert asked(0) == (both, 2)
    assert asked(3600, least=1) == (both[1:], 3)
    now = time.time()
    monkeypatch.setattr(statements.time, "time", lambda: now + 100)
    assert asked(3600) == (both, 3) and asked(50) == (both, 4)
    changes.append_rows(spark, name, spark.createDataFrame([(3, "y")], "a int, b string"))
    assert asked(None) == ([*both, '{"a":3,"b":"y"}'], 5)
    spark.range(1).createOrReplaceTempView("no_files")
    with pytest.raises(Exception):
        statements.saved_result(spark, "select 1", ["no_files"], store=store)
