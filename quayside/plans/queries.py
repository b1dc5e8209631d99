"""One query per operator on the given tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.dates import run_date_predicate
from quayside.operators import changes, checks, rollups, statements
from quayside.operators.sinks import write_csv, write_partitioned
from quayside.plans.fixtures import (
    STAGED,
    access_log,
    dated_orders,
    delimited_files,
    events_by_date,
    events_by_day,
    json_documents,
    orders_by_day,
    orders_by_month,
    staged_orders,
    tab_lines,
    table,
)
from quayside.sources.dated import trailing_scan
from quayside.sources.delimited import land_csv, scan_csv, scan_delimited
from quayside.sources.documents import promote_header
from quayside.sources.text import scan_lines, split_columns
from quayside.workspace import new_path, new_table, quoted

RUN_DATE = date(2024, 1, 15)
RUN_DATES = ("2024-01-03", "2024-01-15", "2024-01-18")
PARTITION = "19970528"
PARTITIONS = ("199705", "199706")


def csv_external_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headered files with text columns, one header line in each."""
    return scan_delimited(spark, delimited_files(staged_orders(spark, sf_dir), "staged"), STAGED)


def orders_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged files, cast and appended to a re-created table by INSERT ... SELECT of five columns."""
    staged = csv_external_scan(spark, sf_dir).select(
        F.col("order_id").cast("bigint"), "first_name", "last_name", F.col("item_code").cast("bigint"), F.col("order_date").cast("date")
    )
    target = new_table(spark, "orders_trans")
    changes.recreate_table(spark, target, staged)
    changes.append_rows(spark, target, staged)
    return spark.table(quoted(target))


def table_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled table, re-created: only what is appended afterwards is in it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    target = new_table(spark, "recreated")
    for status in ("F", "O"):
        changes.recreate_table(spark, target, orders)
        changes.append_rows(spark, target, orders.where(F.col("o_orderstatus") == status))
    return spark.table(quoted(target))


def _imported(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Orders imported by the day of their last change: up to a day, then all and further versions, then once more without effect."""
    first, later = dated_orders(spark, sf_dir)
    target = new_table(spark, "imported")
    changes.recreate_table(spark, target, first, partition=["part"] if mode == "latest" else [])
    for source in (first.where("upd < date'1996-01-01'"), first.unionByName(later), first.unionByName(later)):
        changes.incremental_import(spark, source, target, "upd", ["o_orderkey"], mode=mode, partition="part" if mode == "latest" else None)
    return spark.table(quoted(target)).select("o_orderkey", "status", "upd")


def incremental_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the orders that an import by their last change adds."""
    return _imported(spark, sf_dir, "append")


def incremental_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest imported version of each order."""
    return _imported(spark, sf_dir, "latest")


def incremental_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which a third come late: those of the last 60 days before the mark are still imported, and all above it."""
    orders = dated_orders(spark, sf_dir)[0].drop("part")
    target = new_table(spark, "late")
    changes.recreate_table(spark, target, orders)
    for source in (orders.where("upd < date'1996-01-01' and o_orderkey % 3 <> 0"), orders.where("upd < date'1996-01-01'"), orders):
        changes.incremental_import(spark, source, target, "upd", ["o_orderkey"], lookback=timedelta(days=60))
    return spark.table(quoted(target))


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended by year, each batch twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    target = new_table(spark, "appended")
    changes.recreate_table(spark, target, orders, partition=["o_year"])
    for batch in (orders.where("o_year <= 1997"), orders.where("o_year > 1997")):
        for _ in range(2):
            changes.append_once(spark, target, batch, ["o_orderkey"], partition="o_year")
    return spark.table(quoted(target))


def replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year, in batches of whole years that overlap, each batch twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("o_year"))
    target = new_table(spark, "replaced")
    changes.recreate_table(spark, target, orders, partition=["o_year"])
    for batch in (orders.where("o_year <= 1996"), orders.where("o_year >= 1996").withColumn("o_orderstatus", F.lit("N"))):
        for _ in range(2):
            changes.replace_partitions(spark, target, batch, keys=["o_orderkey"])
    return spark.table(quoted(target))


def json_header_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a JSON document whose first row names the columns."""
    return promote_header(json_documents(spark, sf_dir, whole=True), "doc", ["key", "value"], keep=["o_custkey"])


def csv_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files with text codes, landed as Parquet."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    source = new_path(spark, "customers")
    write_csv(customers, source)
    return land_csv(spark, source, customers.columns, new_path(spark, "landing"))


def tsv_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tab separated lines, read as lines and cut into columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    return split_columns(scan_lines(spark, tab_lines(lines, "tsv")), lines.columns)


def trailing_days_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the seven days that end with each run date."""
    runs = spark.createDataFrame([(day,) for day in RUN_DATES], "run_date string")
    return trailing_scan(events_by_date(spark, sf_dir), runs, "d").select("run_date", "event_id", "event_type", "d")


SCRIPTS = {
    "01_stage.sql": """
        -- Statements without a block of their own; the first fails and is handled.
        begin
            declare held int default 0;
            begin
                declare exit handler for sqlexception set held = 1;
                select raise_error('no staging yet');
            end;
            insert into identifier(:t) select o_orderpriority, o_orderkey, held from script_orders where o_orderstatus = :status;
        end
    """,
    "02_report.sql": """
        insert into identifier(:t) select o_orderpriority, o_orderkey, 2 from script_orders where o_orderstatus = 'P';
        select o_orderpriority, held, count(*) as n, min(o_orderkey) as first_key from identifier(:t) group by o_orderpriority, held;
    """,
}


def sql_script_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of a folder, run over the orders by name, with parameters and a handled error."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("script_orders")
    target = new_table(spark, "scripted")
    changes.recreate_table(spark, target, spark.createDataFrame([], "o_orderpriority string, o_orderkey bigint, held int"))
    folder = new_path(spark, "scripts")
    for name, text in SCRIPTS.items():
        store_text(spark, f"{folder}/{name}", text)
    return statements.run_script(spark, folder, {"t": quoted(target), "status": "F"})


def store_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file under its own name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def partition_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months' orders exported to a table, the first of them twice, and read back."""
    orders = orders_by_month(spark, sf_dir, ["o_orderkey", "o_custkey", "o_orderstatus"])
    target = new_table(spark, "exported")
    changes.recreate_table(spark, target, orders, partition=["dt"])
    for month in (*PARTITIONS, PARTITIONS[0]):
        changes.export_partition(spark, orders, "dt", month, target)
    return spark.table(quoted(target))


def csv_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through CSV files, with texts that have commas, quotes and spaces, empty texts and NULLs."""
    note = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit(' "'), "o_orderstatus", F.lit('", '), "o_orderpriority", F.lit(" ")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", note.alias("note"), "o_orderpriority")
    path = new_path(spark, "csv_sink")
    write_csv(orders, path, null_text="\\N")
    return scan_csv(spark, path, orders.columns, null_text="\\N")


def text_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tab separated lines, one file per task, read back as lines."""
    return scan_lines(spark, tab_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "text_sink"))


def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of one day, whose partition is the only one that is read."""
    return orders_by_day(spark, sf_dir).where(F.col("dt") == F.lit(PARTITION)).select("o_orderkey", "o_custkey", "dt")


def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey < 10").select("o_orderkey", "o_custkey")


def run_date_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the partitions of the run date and the day before."""
    return events_by_day(spark, sf_dir)[0].where(run_date_predicate(RUN_DATE)).select("event_id", "month", "day")


def bound_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table name and two values as parameters."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("param_orders")
    return spark.sql(
        "select o_orderkey, o_custkey from identifier(:t) where o_orderstatus = :status and o_custkey <= :most",
        args={"t": "param_orders", "status": "O", "most": 100},
    )


def sql_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts with statements between them that fail when planned and when run; all are reported, and the inserts done."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    orders.createOrReplaceTempView("batch_orders")
    target = new_table(spark, "batch")
    changes.recreate_table(spark, target, orders)
    insert = "insert into identifier(:t) select o_orderkey, o_orderstatus from batch_orders where o_orderstatus = '{}'"
    batch = [
        insert.format("F"), "select * from no_such_table_here", insert.format("P"),
        "select assert_true(o_orderkey < 0) from batch_orders", "select count(*) from identifier(:t)",
    ]
    report = statements.run_batch(spark, batch, {"t": quoted(target)}).select("n", "ok", "error")
    rows = spark.table(quoted(target)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))
    return report.join(rows, (F.col("n") == 1) & (F.col("o_orderstatus") == "F") | (F.col("n") == 3) & (F.col("o_orderstatus") == "P"), "left").drop("o_orderstatus")


def saved_query_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved query run, served from its stored result, and run again after its table has grown."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"))
    target, store = new_table(spark, "saved"), new_path(spark, "results")
    changes.recreate_table(spark, target, orders)
    query = "select status, count(*) as n from identifier(:t) where o_orderkey >= :least group by status"
    args = {"t": quoted(target), "least": 100}
    changes.append_rows(spark, target, orders.where("o_orderkey % 2 = 0"))
    for max_age in (0, 3600):
        statements.saved_result(spark, query, [target], args, store=store, max_age=max_age)
    changes.append_rows(spark, target, orders.where("o_orderkey % 2 = 1"))
    return statements.as_json(statements.saved_result(spark, query, [target], args, store=store, max_age=3600))


def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections of line items, duplicates counted."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    return checks.result_diff(lines.where("l_returnflag <> 'A'"), lines.where("l_linestatus <> 'F'"))


def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events without a file; every seventh day is left out on purpose."""
    events = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").alias("day"), F.date_format("ts", "yyyyMMdd").alias("dt"))
    path = new_path(spark, "landed")
    write_partitioned(events.where("day % 7 <> 3"), path, ["dt"])
    return checks.files_missing(spark, events.select(F.concat(F.lit("dt="), "dt").alias("folder")).distinct(), path)


def partitions_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days 25 to 31 of January and February that are no partition of the events."""
    events, path = events_by_day(spark, sf_dir)
    name = new_table(spark, "events_by_day")
    changes.register_table(spark, name, events, path, partition=["month", "day"])
    months = spark.range(1, 3).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("month"))
    days = spark.range(25, 32).select(F.col("id").cast("string").alias("day"))
    return checks.partitions_missing(spark, name, [months, days])


def access_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.access_log_rollup(scan_lines(spark, access_log(spark, sf_dir)))


def conditional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valuable events per type."""
    return rollups.conditional_share(table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 10)


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words and bytes of the documents per source."""
    return rollups.text_counts(table(spark, sf_dir, "documents"), "source", "text")


def file_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words and bytes of the files that hold the documents, per source."""
    documents = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("value"))
    path = new_path(spark, "texts")
    documents.hint("rebalance", "source").write.partitionBy("source").text(path)
    per_file = rollups.file_text_counts(spark, path)
    source = F.regexp_extract("key", "^source=([^/]*)/", 1).alias("source")
    return per_file.groupBy(source).agg(*[F.sum(c).alias(c) for c in ("lines", "words", "bytes")])


def trailing_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day, and of the seven days up to it."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("d"))
    return rollups.trailing_measure(events, "event_type", "d")


STAGED_SQL = """
    select o_orderkey as order_id, split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name,
           l_partkey as item_code, cast(o_orderdate as date) as order_date
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
"""

ORACLES = {
    "orders_insert_select": STAGED_SQL,
    "csv_external_scan": f"""
        select cast(order_id as varchar) as order_id, first_name, last_name, cast(item_code as varchar) as item_code,
               cast(order_date as varchar) as order_date from ({STAGED_SQL})
    """,
    "table_recreate": "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'",
    "incremental_import": """
        with first as (select o_orderkey, o_orderstatus as status, cast(o_orderdate as date) as upd from orders),
             later as (select o_orderkey, 'U' as status, upd + 400 as upd from first where o_orderkey % 5 = 0)
        select o_orderkey, status, upd from first union all
        select o_orderkey, status, upd from later where upd >= (select max(upd) from first where upd < date '1996-01-01')
    """,
    "incremental_latest": """
        with first as (select o_orderkey, o_orderstatus as status, cast(o_orderdate as date) as upd from orders),
             later as (select o_orderkey, 'U' as status, upd + 400 as upd from first where o_orderkey % 5 = 0),
             found as (select * from first union all select * from later where upd >= (select max(upd) from first where upd < date '1996-01-01'))
        select o_orderkey, arg_max(status, upd) as status, max(upd) as upd from found group by o_orderkey
    """,
    "incremental_lookback": """
        with first as (select o_orderkey, o_orderstatus as status, cast(o_orderdate as date) as upd from orders),
             early as (select * from first where upd < date '1996-01-01' and o_orderkey % 3 <> 0)
        select * from early union all
        select * from first where upd >= (select max(upd) from early) - 60 and not (upd < date '1996-01-01' and o_orderkey % 3 <> 0)
    """,
    "append_once": "select o_orderkey, o_custkey, cast(year(o_orderdate) as integer) as o_year from orders",
    "replace_partitions": """
        select o_orderkey, case when year(o_orderdate) >= 1996 then 'N' else o_orderstatus end as o_orderstatus, cast(year(o_orderdate) as integer) as o_year
        from orders
    """,
    "json_header_promotion": """
        select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as row_number,
               cast(o_orderkey as varchar) as key, 'ok' as status, o_orderstatus as value from orders
    """,
    "csv_landing": """
        select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment from customer
    """,
    "tsv_text_scan": """
        select cast(l_orderkey as varchar) as l_orderkey, cast(l_partkey as varchar) as l_partkey,
               cast(l_linenumber as varchar) as l_linenumber, l_returnflag from lineitem
    """,
    "trailing_days_scan": """
        select run_date, event_id, event_type, cast(ts as date) as d from events
        join (select cast(unnest(['2024-01-03', '2024-01-15', '2024-01-18']) as date) as run_date) r
             on cast(ts as date) between run_date - 6 and run_date
    """,
    "sql_script_run": """
        select o_orderpriority, cast(case o_orderstatus when 'F' then 1 else 2 end as integer) as held, count(*) as n, min(o_orderkey) as first_key
        from orders where o_orderstatus in ('F', 'P') group by 1, 2
    """,
    "partition_export": """
        select o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y%m') as dt from orders where strftime(o_orderdate, '%Y%m') in ('199705', '199706')
    """,
    "csv_sink_roundtrip": """
        select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority,
               case when o_orderkey % 5 = 0 then '' when o_orderkey % 7 <> 0 then ' "' || o_orderstatus || '", ' || o_orderpriority || ' ' end as note
        from orders
    """,
    "text_sink_roundtrip": "select o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority as value from orders",
    "partition_filter": """
        select o_orderkey, o_custkey, strftime(o_orderdate, '%Y%m%d') as dt from orders where cast(o_orderdate as date) = date '1997-05-28'
    """,
    "row_filter": "select o_orderkey, o_custkey from orders where o_custkey < 10",
    "run_date_partitions": """
        select event_id, strftime(ts, '%m') as month, strftime(ts, '%d') as day from events
        where cast(ts as date) in (date '2024-01-15', date '2024-01-14')
    """,
    "bound_params": "select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_custkey <= 100",
    "sql_batch": """
        with n as (select o_orderstatus as s, count(*) as rows from orders group by 1)
        select n, ok, error, rows from (values
            (1, true, null, 'F'), (2, false, 'TABLE_OR_VIEW_NOT_FOUND', null), (3, true, null, 'P'), (4, false, 'USER_RAISED_EXCEPTION', null), (5, true, null, null)
        ) as r(n, ok, error, status) left join n on s = status
    """,
    "saved_query_refresh": """
        select '{"status":' || coalesce('"' || nullif(o_orderstatus, 'O') || '"', 'null') || ',"n":' || count(*) || '}' as row
        from orders where o_orderkey >= 100 group by nullif(o_orderstatus, 'O')
    """,
    "result_diff": """
        with a as (select l_partkey, l_returnflag, l_linestatus, case when l_returnflag <> 'A' then 1 else 0 end
                          - case when l_linestatus <> 'F' then 1 else 0 end as d from lineitem),
             s as (select l_partkey, l_returnflag, l_linestatus, sum(d) as d from a group by 1, 2, 3)
        select l_partkey, l_returnflag, l_linestatus, case when d > 0 then 'left_only' else 'right_only' end as side,
               cast(abs(d) as bigint) as times from s where d <> 0
    """,
    "files_missing": "select distinct 'dt=' || strftime(ts, '%Y%m%d') as folder from events where day(ts) % 7 = 3",
    "partitions_missing": """
        select m.month, d.day from (select unnest(['01', '02']) as month) m, (select cast(unnest(range(25, 32)) as varchar) as day) d
        where not exists (select 1 from events where strftime(ts, '%m') = m.month and strftime(ts, '%d') = d.day)
    """,
    "access_log_rollup": """
        with e as (select *, event_id % 11 <> 0 as whole, event_id % 11 <> 0 and event_id % 7 <> 0 as named from events)
        select case when named then '10.0.0.' || (user_id % 20) end as ip, case when named then 'u' || user_id end as usr,
               case when named then 'GET /' || event_type || ' HTTP/1.0' end as request, count(*) as n,
               cast(sum(case when whole and event_id % 5 <> 0 then event_id % 1000 else 0 end) as bigint) as bytes
        from e group by 1, 2, 3
    """,
    "conditional_share": """
        select event_type, count(*) as n, count(*) filter (value < 10) as n_met, count(*) filter (value < 10) / count(*) as share
        from events group by 1
    """,
    "text_counts": r"""
        select source, cast(sum(length(text) - length(replace(text, chr(10), ''))) as bigint) as lines,
               cast(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) as bigint) as words,
               cast(sum(octet_length(encode(text))) as bigint) as bytes
        from documents group by 1
    """,
    "file_text_counts": r"""
        select coalesce(source, 'none') as source, cast(sum(length(body) - length(replace(body, chr(10), '')) + 1) as bigint) as lines,
               cast(sum(len(list_filter(regexp_split_to_array(body, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) as bigint) as words,
               cast(sum(octet_length(encode(body)) + 1) as bigint) as bytes
        from (select *, coalesce(text, '') as body from documents) group by 1
    """,
    "trailing_7d": """
        with d as (select event_type, cast(ts as date) as d, count(*) as n from events group by 1, 2)
        select event_type, d, n, cast(sum(n) over (partition by event_type order by d
               range between interval 6 days preceding and current row) as bigint) as n_trailing from d
    """,
}

QUERIES = {name: globals()[name] for name in ORACLES}
