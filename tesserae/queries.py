"""The engine's queries over the driver's tables, most as text of the dialect, each with the DuckDB SQL it must equal."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from http.client import HTTPConnection
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.plans.compiler import compile_select
from tesserae.plans.parser import parse
from tesserae.sources.background import Compactor
from tesserae.sources.catalog import Catalog
from tesserae.sources.formats import render
from tesserae.sources.scratch import scratch
from tesserae.sources.server import serve
from tesserae.types import DialectError

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def run_text(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SELECT of the dialect over <sf_dir>/<table>.parquet."""
    select = parse(text)
    return compile_select(select, spark.read.parquet(f"{sf_dir}/{select.table}.parquet"))[0]


def _text(name: str, text: str, oracle: str, rounded: tuple[str, ...] = ()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_text(spark, sf_dir, text)
        for c in rounded:
            out = out.withColumn(c, F.round(F.col(c), 4))
        return out

    QUERIES[name] = query
    ORACLE_SQL[name] = oracle


# Scans, projections, expressions
_text("scan_star", "SELECT * FROM region", "SELECT * FROM region")
_text("project_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
_text("project_alias", "SELECT c_custkey AS id, c_mktsegment segment FROM customer", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
_text("project_literals", "SELECT n_nationkey, 7 AS i, 2.5 AS f, 'x''y' AS s FROM nation", "SELECT n_nationkey, CAST(7 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS f, 'x''y' AS s FROM nation")
_text(
    "project_arith", "SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity + 1) * l_extendedprice - l_tax AS a, l_linenumber + 1 AS b FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity + 1) * l_extendedprice - l_tax AS a, CAST(l_linenumber AS DOUBLE) + 1 AS b FROM lineitem", ("a",),
)
ORACLE_SQL["project_arith"] = "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity + 1) * l_extendedprice - l_tax, 4) AS a, CAST(l_linenumber AS DOUBLE) + 1 AS b FROM lineitem"
_text("project_neg", "SELECT s_suppkey, -s_acctbal AS n, -(s_suppkey - 5) AS m FROM supplier", "SELECT s_suppkey, -s_acctbal AS n, -(CAST(s_suppkey AS DOUBLE) - 5) AS m FROM supplier")
_text(
    "div_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax / l_discount AS q FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS q FROM lineitem",
)
_text("project_cmp", "SELECT o_orderkey, o_totalprice > 100000 AS big, NOT o_custkey = 7 AS other FROM orders", "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big, CAST(o_custkey <> 7 AS BIGINT) AS other FROM orders")
_text(
    "default_names", "SELECT o_custkey, count(*), sum(o_totalprice), max(o_totalprice) FROM orders GROUP BY o_custkey",
    'SELECT o_custkey, count(*) AS "count(*)", round(sum(o_totalprice), 4) AS "sum(o_totalprice)", max(o_totalprice) AS "max(o_totalprice)" FROM orders GROUP BY 1', ("sum(o_totalprice)",),
)

# Filters
_text("filter_cmp", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
_text(
    "filter_and_or", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' OR o_custkey < 50",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' OR o_custkey < 50",
)
_text("filter_not", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_retailprice < 950)", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_retailprice < 950)")
_text("filter_truthy", "SELECT doc_id FROM labels WHERE toxic OR NOT quality", "SELECT doc_id FROM labels WHERE toxic <> 0 OR NOT quality <> 0")
_text("filter_string", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment <> 'MACHINERY'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment <> 'MACHINERY'")
_text("filter_mixed_string", "SELECT o_orderkey FROM orders WHERE o_orderkey > '5'", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '5'")

# Functions
for _name, _call, _sql in (
    ("to_yyyymm", "toYYYYMM", "year({0}) * 100 + month({0})"),
    ("to_year", "toYear", "year({0})"),
    ("to_month", "toMonth", "month({0})"),
    ("to_yyyymmdd", "toYYYYMMDD", "year({0}) * 10000 + month({0}) * 100 + day({0})"),
):
    _text(_name, f"SELECT o_orderkey, {_call}(o_orderdate) AS v FROM orders", f"SELECT o_orderkey, CAST({_sql.format('o_orderdate')} AS BIGINT) AS v FROM orders")
_text("epoch_seconds", "SELECT event_id, toString(ts) AS t FROM events WHERE ts > 1704067200", "SELECT event_id, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS t FROM events WHERE floor(epoch(ts)) > 1704067200")
_text(
    "int_div", "SELECT o_orderkey, intDiv(o_orderkey, 7) AS a, intDiv(o_custkey - 700, 9) AS b, intDiv(o_orderkey, o_custkey - o_custkey) AS z FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS a, (o_custkey - 700) // 9 AS b, CAST(0 AS BIGINT) AS z FROM orders",
)
_text("to_string", "SELECT o_orderkey, toString(o_custkey) AS k FROM orders", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k FROM orders")
_text(
    "to_string_float", "SELECT l_orderkey, l_partkey, l_linenumber, toString(l_quantity) AS q, toString(l_discount) AS d FROM lineitem",
    "SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(CAST(l_discount AS VARCHAR), '0') END AS d FROM lineitem",
)

# Aggregates
_text(
    "group_sum_count", "SELECT l_returnflag, count(*) AS c, sum(l_quantity) AS s FROM lineitem WHERE l_quantity >= 5 GROUP BY l_returnflag ORDER BY l_returnflag",
    "SELECT l_returnflag, count(*) AS c, round(sum(l_quantity), 4) AS s FROM lineitem WHERE l_quantity >= 5 GROUP BY 1", ("s",),
)
_text("group_min_max", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_custkey) AS hi FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_totalprice) AS lo, CAST(max(o_custkey) AS DOUBLE) AS hi FROM orders GROUP BY 1")
_text("group_avg", "SELECT l_linestatus, avg(l_discount) AS a FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(avg(l_discount), 4) AS a FROM lineitem GROUP BY 1", ("a",))
_text("group_expr", "SELECT l_returnflag, sum(l_extendedprice * l_discount) AS r FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 4) AS r FROM lineitem GROUP BY 1", ("r",))
_text("group_distinct", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_text("group_uniq", "SELECT event_type, uniq(user_id) AS u FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY 1")
_text(
    "group_quantile", "SELECT l_returnflag, quantiles(l_extendedprice) AS m, quantiles(0.9, l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS m, list_sort(list(l_quantity))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS q FROM lineitem GROUP BY 1",
)
_TOP = "SELECT {keys}string_agg(k, ',' ORDER BY n DESC, k) AS t FROM (SELECT *, row_number() OVER ({part}ORDER BY n DESC, k) AS r FROM (SELECT {keys}{col} AS k, count(*) AS n FROM {table} GROUP BY ALL)) WHERE r <= {most}{group}"
_text("topk", "SELECT topK(3, p_brand) AS t FROM part", _TOP.format(keys="", part="", col="p_brand", table="part", most=3, group=""))
_text("topk_grouped", "SELECT o_orderstatus, topK(2, o_orderpriority) AS t FROM orders GROUP BY o_orderstatus", _TOP.format(keys="o_orderstatus, ", part="PARTITION BY o_orderstatus ", col="o_orderpriority", table="orders", most=2, group=" GROUP BY o_orderstatus"))
_text(
    "agg_empty", "SELECT count(*) AS c, sum(l_tax) AS s, min(l_tax) AS lo, max(l_tax) AS hi, avg(l_tax) AS a, uniq(l_tax) AS u, quantiles(l_tax) AS q, topK(l_returnflag) AS t FROM lineitem WHERE l_quantity < 0",
    "SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS a, CAST(0 AS BIGINT) AS u, CAST(0 AS DOUBLE) AS q, '' AS t",
)

# Order and limit
_text("order_multi", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey")
_text("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
_text("top_n", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")


def _query(oracle: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = oracle
        return function

    return add


def _loaded(spark: SparkSession, sf_dir: str, source: str, ddl: str, batches: int, key: str, columns: list[str], extra: tuple[str, ...] = ()) -> Catalog:
    """A catalog with table `t` (and what `extra` creates) after inserting `source` in so many batches, by key."""
    catalog = Catalog(spark, scratch(spark, "db"))
    for text in (ddl, *extra):
        catalog.sql(text)
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(*columns)
    for k in range(batches):
        catalog.insert("t", rows.where(F.pmod(F.col(key), F.lit(batches)) == k))
    return catalog


_EVENTS = "CREATE TABLE t (event_id Int64, ts DateTime, user_id UInt64, event_type LowCardinality(String), value Float64) ENGINE = MergeTree() ORDER BY (user_id, event_id) PARTITION BY toYYYYMM(ts)"
_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@_query("SELECT CAST(strftime(l_shipdate, '%Y%m') AS VARCHAR) AS pid, count(*) AS n FROM lineitem GROUP BY 1")
def partition_yyyymm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "CREATE TABLE t (l_orderkey Int64, l_shipdate DateTime) ENGINE = MergeTree() ORDER BY l_orderkey PARTITION BY toYYYYMM(l_shipdate)"
    catalog = _loaded(spark, sf_dir, "lineitem", ddl, 1, "l_orderkey", ["l_orderkey", "l_shipdate"])
    return catalog.describe("t").groupBy(F.col("partition").alias("pid")).agg(F.sum("rows").alias("n"))


@_query("SELECT l_orderkey, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-03-01'")
def pruned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "CREATE TABLE t (l_orderkey Int64, l_shipdate DateTime) ENGINE = MergeTree() ORDER BY l_orderkey PARTITION BY toYYYYMM(l_shipdate)"
    catalog = _loaded(spark, sf_dir, "lineitem", ddl, 2, "l_orderkey", ["l_orderkey", "l_shipdate"])
    return catalog.sql("SELECT l_orderkey, l_shipdate FROM t WHERE l_shipdate >= 883612800 AND l_shipdate < 888710400")


@_query("SELECT CAST(user_id AS BIGINT) AS user_id, round(sum(value), 4) AS total FROM events GROUP BY 1")
def mv_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (
        "CREATE TABLE totals (user_id UInt64, total Float64) ENGINE = AggregatingMergeTree() ORDER BY user_id",
        "CREATE MATERIALIZED VIEW v TO totals AS SELECT user_id, sum(value) AS total FROM t GROUP BY user_id",
    )
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 3, "event_id", _EVENT_COLUMNS, extra)
    return catalog.sql("SELECT user_id, sum(total) AS total FROM totals GROUP BY user_id").select(F.col("user_id").cast("long").alias("user_id"), F.round("total", 4).alias("total"))


@_query("SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY 1")
def mv_sum_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (
        "CREATE TABLE states (event_type String, s AggregateFunction(sum, Float64)) ENGINE = AggregatingMergeTree() ORDER BY event_type",
        "CREATE MATERIALIZED VIEW v TO states AS SELECT event_type, sumState(value) AS s FROM t GROUP BY event_type",
    )
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 3, "event_id", _EVENT_COLUMNS, extra)
    return catalog.sql("SELECT event_type, sumMerge(s) AS total FROM states GROUP BY event_type").withColumn("total", F.round("total", 4))


@_query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def mv_uniq_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (
        "CREATE TABLE states (event_type String, s AggregateFunction(uniq, UInt64)) ENGINE = AggregatingMergeTree() ORDER BY event_type",
        "CREATE MATERIALIZED VIEW v TO states AS SELECT event_type, uniqState(user_id) AS s FROM t GROUP BY event_type",
    )
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 3, "event_id", _EVENT_COLUMNS, extra)
    return catalog.sql("SELECT event_type, uniqMerge(s) AS users FROM states GROUP BY event_type")


@_query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, value FROM events")
def merge_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 3, "event_id", _EVENT_COLUMNS)
    catalog.optimize("t")
    return catalog.sql("SELECT event_id, user_id, event_type, value FROM t").withColumn("user_id", F.col("user_id").cast("long"))


@_query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS n, arg_min(event_type, (event_id % 3, event_id)) AS first_type FROM events GROUP BY 1")
def merge_aggregating(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "CREATE TABLE t (user_id UInt64, n Int64, first_type String) ENGINE = AggregatingMergeTree() ORDER BY user_id"
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql(ddl)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        batch = events.where(F.pmod("event_id", F.lit(3)) == k)
        catalog.insert("t", batch.groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", "event_id").alias("first_type")))
    catalog.optimize("t")
    return catalog.sql("SELECT user_id, n, first_type FROM t").withColumn("user_id", F.col("user_id").cast("long"))


@_query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def merge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (
        "CREATE TABLE states (event_type String, s AggregateFunction(uniq, UInt64)) ENGINE = AggregatingMergeTree() ORDER BY event_type",
        "CREATE MATERIALIZED VIEW v TO states AS SELECT event_type, uniqState(user_id) AS s FROM t GROUP BY event_type",
    )
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 3, "event_id", _EVENT_COLUMNS, extra)
    catalog.optimize("states")
    return catalog.sql("SELECT event_type, uniqMerge(s) AS users FROM states GROUP BY event_type")


@_query("SELECT * FROM (VALUES ('a'), ('b'), ('c')) AS x(name)")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    for name in ("b", "c", "a", "gone"):
        catalog.sql(f"CREATE TABLE {name} (id UInt64) ENGINE = MergeTree ORDER BY id")
    catalog.sql("DROP TABLE gone")
    return catalog.sql("SHOW TABLES")


@_query("SELECT CAST(id AS BIGINT) AS id, CAST(small AS BIGINT) AS small, name, f FROM (VALUES (1, 44, 'it''s', 1.5::DOUBLE), (2, 255, '', -2::DOUBLE)) AS x(id, small, name, f)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id UInt64, small UInt8, name String, f Float64) ENGINE = MergeTree() ORDER BY id")
    catalog.sql("INSERT INTO t VALUES (2, -1, '', -2), (1, 300, 'it''s', 1.5)")
    out = catalog.sql("SELECT id, small, name, f FROM t")
    return out.select(F.col("id").cast("long").alias("id"), F.col("small").cast("long").alias("small"), "name", "f")


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.streaming.ingest import ingest

    root = scratch(spark, "stream")
    catalog = Catalog(spark, f"{root}/db")
    catalog.sql(_EVENTS)
    catalog.sql("CREATE TABLE totals (event_type String, n Int64, total Float64) ENGINE = AggregatingMergeTree() ORDER BY event_type")
    catalog.sql("CREATE MATERIALIZED VIEW v TO totals AS SELECT event_type, count(*) AS n, sum(value) AS total FROM t GROUP BY event_type")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(*_EVENT_COLUMNS).repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.select(*_EVENT_COLUMNS).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest(stream, catalog, "t", f"{root}/checkpoint", once=True).awaitTermination()
    out = catalog.sql("SELECT event_type, sum(n) AS n, sum(total) AS total FROM totals GROUP BY event_type")
    return out.select("event_type", F.col("n").cast("long").alias("n"), F.round("total", 4).alias("total"))


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all active parts before and after a merge, from their descriptions."""
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 4, "event_id", _EVENT_COLUMNS)
    before = catalog.describe("t").agg(F.sum("rows").alias("n"), F.count("*").alias("parts"))
    catalog.optimize("t")
    return before.union(catalog.describe("t").agg(F.sum("rows"), F.count("*"))).withColumn("n", F.col("n").cast("long"))


QUERIES["describe"] = _part_rows
ORACLE_SQL["describe"] = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(4 AS BIGINT) AS parts FROM events UNION ALL SELECT CAST(count(*) AS BIGINT), CAST(1 AS BIGINT) FROM events"


# Literals, partition keys, order on write


@_query("SELECT * FROM (VALUES (1::BIGINT, 0.123456789012345::DOUBLE, '1e-12'), (2, 0.000000000012::DOUBLE, ''), (3, 100000000000000000000000000000000.5::DOUBLE, '0.1'), (4, -7::DOUBLE, '-3')) AS x(id, f, s)")
def insert_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id Int64, f Float64, s String) ENGINE = MergeTree() ORDER BY id")
    catalog.sql("INSERT INTO t VALUES (1, 0.123456789012345, '1e-12'), (2, 0.000000000012, ''), (3, 100000000000000000000000000000000.5, 0.1), (4, -7, -3)")
    return catalog.sql("SELECT id, f, s FROM t")


@_query("SELECT * FROM (VALUES ('', 3::BIGINT), ('/', 1), ('a=b', 1), ('eu', 1)) AS x(partition, n)")
def insert_partition_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id Int64, region String) ENGINE = MergeTree() ORDER BY id PARTITION BY region")
    catalog.sql("INSERT INTO t VALUES (1, ''), (2, '/'), (3, 'eu')")
    catalog.insert("t", spark.createDataFrame([(4, None), (5, ""), (6, "a=b")], "id long, region string"))
    rows = catalog.sql("SELECT region, count(*) AS n FROM t GROUP BY region").withColumnRenamed("region", "partition")
    parts = catalog.describe("t").groupBy("partition").agg(F.sum("rows").alias("rows"))
    return rows.join(parts, "partition").where("n = rows").select("partition", "n")


@_query("SELECT CAST(0 AS BIGINT) AS inversions, count(*) AS n FROM events")
def sort_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours out of order in the files of all parts, in the order they stand there."""
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 2, "event_id", _EVENT_COLUMNS)
    paths = [p["path"] for p in catalog.table("t")["parts"]]
    files = spark.read.option("mergeSchema", "false").parquet(*paths).select("user_id", "event_id", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag(F.struct("user_id", "event_id")).over(Window.partitionBy("file").orderBy("at"))
    marked = files.withColumn("wrong", F.coalesce((before > F.struct("user_id", "event_id")).cast("long"), F.lit(0)))
    return marked.agg(F.sum("wrong").alias("inversions"), F.count("*").alias("n"))


# Pruning


def _pruned(catalog: Catalog, text: str) -> DataFrame:
    """The rows of a query with what its pruning counted."""
    rows = catalog.sql(text)
    return rows.withColumn("parts", F.lit(catalog.pruned["parts"])).withColumn("skipped", F.lit(catalog.pruned["skipped"]))


@_query("SELECT * FROM (VALUES (1::BIGINT, 3, 1), (6, 3, 1)) AS x(id, parts, skipped)")
def pruned_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id Int64, f Float64) ENGINE = MergeTree() ORDER BY f")
    for rows in ([(1, 5.0), (2, float("nan"))], [(3, 6.0), (4, 9.5)], [(5, -1.0), (6, 5.0)]):
        catalog.insert("t", spark.createDataFrame(rows, "id long, f double"))
    return _pruned(catalog, "SELECT id FROM t WHERE f = 5")


@_query("SELECT event_id, CAST(3 AS INT) AS parts, CAST(2 AS INT) AS skipped FROM events WHERE event_id % 3 = 1 AND event_id < 300")
def pruned_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second key column alone decides which parts are read."""
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (user_id UInt64, batch Int64, event_id Int64) ENGINE = MergeTree() ORDER BY (user_id, batch)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("batch", F.pmod("event_id", F.lit(3)))
    for k in range(3):
        catalog.insert("t", events.where(F.col("batch") == k).select("user_id", "batch", "event_id"))
    return _pruned(catalog, "SELECT event_id FROM t WHERE batch = 1 AND event_id < 300")


@_query("SELECT l_orderkey, TRUE AS pushed FROM lineitem WHERE l_orderkey < 100")
def pruned_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside a part, the filter reaches the scan of its sorted files, where row groups and pages are skipped."""
    catalog = _loaded(spark, sf_dir, "lineitem", "CREATE TABLE t (l_orderkey Int64, l_tax Float64) ENGINE = MergeTree() ORDER BY l_orderkey", 1, "l_orderkey", ["l_orderkey", "l_tax"])
    rows = catalog.sql("SELECT l_orderkey FROM t WHERE l_orderkey < 100")
    pushed = "LessThan(l_orderkey,100)" in rows._jdf.queryExecution().executedPlan().toString()
    return rows.withColumn("pushed", F.lit(pushed))


# Statements, their errors, and what outlives a session


@_query("SELECT * FROM (VALUES (0, 'OK'), (1, 'OK'), (2, 'error'), (3, 'error'), (4, 'error'), (5, 'OK'), (6, 'error'), (7, 'OK'), (8, 'OK'), (9, 'OK'), (10, 'OK. 1 rows inserted.'), (11, 'error'), (12, 'OK')) AS x(step, said)")
def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = (
        "CREATE TABLE a (id UInt64, s LowCardinality(String)) ENGINE = MergeTree() ORDER BY id", "CREATE TABLE b (s LowCardinality(String), n Int64) ENGINE = AggregatingMergeTree() ORDER BY s",
        "CREATE TABLE a (id UInt64) ENGINE = MergeTree() ORDER BY id", "CREATE TABLE c (id UInt64) ENGINE = MergeTree() ORDER BY nope", "CREATE TABLE c (id Strange) ENGINE = MergeTree()",
        "CREATE TABLE IF NOT EXISTS a (id UInt64) ENGINE = MergeTree()", "CREATE MATERIALIZED VIEW v TO nope AS SELECT s FROM a",
        "CREATE MATERIALIZED VIEW v TO b AS SELECT s, count(*) AS n FROM a GROUP BY s", "CREATE MATERIALIZED VIEW IF NOT EXISTS v TO b AS SELECT s, count(*) AS n FROM a GROUP BY s",
        "DROP TABLE IF EXISTS nope", "INSERT INTO a VALUES (1, 'x')", "DROP TABLE nope", "DROP TABLE a",
    )
    catalog, said = Catalog(spark, scratch(spark, "db")), []
    for k, text in enumerate(statements):
        try:
            said.append((k, catalog.sql(text).first()[0]))
        except DialectError:
            said.append((k, "error"))
    return spark.createDataFrame(said, "step int, said string")


@_query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS rows, 'id,x' AS columns")
def empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id UInt64, x Float64) ENGINE = MergeTree() ORDER BY id")
    every = catalog.sql("SELECT * FROM t WHERE id > 3 ORDER BY id LIMIT 5")
    return catalog.sql("SELECT count(*) AS n, sum(x) AS s FROM t").withColumn("rows", F.lit(every.count()).cast("long")).withColumn("columns", F.lit(",".join(every.columns)))


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second catalog over the same folder knows tables, parts and views, and goes on inserting."""
    extra = (
        "CREATE TABLE totals (event_type LowCardinality(String), n Int64, total Float64) ENGINE = AggregatingMergeTree() ORDER BY event_type",
        "CREATE MATERIALIZED VIEW v TO totals AS SELECT event_type, count(*) AS n, sum(value) AS total FROM t GROUP BY event_type",
    )
    catalog = Catalog(spark, scratch(spark, "db"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*_EVENT_COLUMNS)
    for text in (_EVENTS, *extra):
        catalog.sql(text)
    for k in range(2):
        again = Catalog(spark, catalog.files.root)
        again.insert("t", events.where(F.pmod("event_id", F.lit(2)) == k))
    out = Catalog(spark, catalog.files.root).sql("SELECT event_type, sum(n) AS n, sum(total) AS total FROM totals GROUP BY event_type")
    return out.select("event_type", F.col("n").cast("long").alias("n"), F.round("total", 4).alias("total"))


@_query("SELECT * FROM (VALUES ('arithmetic on text', 'DialectError'), ('no such column', 'DialectError'), ('no such function', 'DialectError'), ('sum in WHERE', 'DialectError')) AS x(filter, raised)")
def filter_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that cannot be evaluated is an error; no row is dropped silently."""
    out = []
    for name, condition in {"arithmetic on text": "r_name + 1 > 2", "no such column": "nope = 1", "no such function": "lower(r_name) = 'x'", "sum in WHERE": "sum(r_regionkey) > 1"}.items():
        try:
            run_text(spark, sf_dir, f"SELECT r_name FROM region WHERE {condition}").collect()
        except Exception as e:  # noqa: BLE001
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "filter string, raised string")


# Formats and HTTP


def _lines(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    select = parse("SELECT r_regionkey, r_name, r_regionkey / 4 AS f FROM region ORDER BY r_regionkey")
    frame, kinds = compile_select(select, spark.read.parquet(f"{sf_dir}/region.parquet"))
    return spark.createDataFrame(list(enumerate("".join(render(frame, kinds, form)).splitlines())), "line int, text string")


_ROW_LINES = "SELECT CAST(0 AS INT) AS line, {head} AS text UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INT), {row} FROM region"
_SHORT = "CASE WHEN r_regionkey % 4 = 0 THEN CAST(r_regionkey // 4 AS VARCHAR) ELSE CAST(r_regionkey / 4 AS VARCHAR) END"


@_query(_ROW_LINES.format(head="concat_ws(chr(9), 'r_regionkey', 'r_name', 'f')", row=f"concat_ws(chr(9), r_regionkey, r_name, {_SHORT})"))
def fmt_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "TabSeparated")


@_query(_ROW_LINES.format(head="'r_regionkey,r_name,f'", row=f"concat_ws(',', r_regionkey, concat(chr(34), r_name, chr(34)), {_SHORT})"))
def fmt_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "CSV")


@_query("SELECT r_regionkey, r_name, r_regionkey / 4 AS f, (SELECT count(*) FROM region) AS rows, 'Int32,String,Float64' AS types FROM region")
def fmt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text of a result, read back by Spark."""
    text = "\n".join(r["text"] for r in _lines(spark, sf_dir, "JSON").orderBy("line").collect())
    schema = "meta array<struct<name string, type string>>, data array<struct<r_regionkey long, r_name string, f double>>, rows long"
    read = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("j"))
    return read.select(F.explode("j.data").alias("d"), "j.rows", F.array_join(F.transform("j.meta", lambda m: m["type"]), ",").alias("types")).select("d.*", "rows", "types")


@_query(
    "SELECT * FROM (VALUES ('ping', 200, 'text/plain', 'Ok.'), ('create', 200, 'text/plain', 'OK'), ('insert', 200, 'text/plain', 'OK. 2 rows inserted.'), ('rows', 200, 'text/csv', 'id|1|2'),"
    " ('default', 200, 'text/tab-separated-values', 'count(*)|2'), ('empty', 200, 'text/plain', ''), ('unreadable', 400, 'text/plain', NULL), ('unknown', 500, 'text/plain', NULL)) AS x(request, status, type, body)"
)
def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the server answers to each kind of request; the text of errors is left open."""
    server = serve(Catalog(spark, scratch(spark, "db")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = {
        "ping": ("ping", ""), "create": ("", "CREATE TABLE t (id UInt64) ENGINE = MergeTree ORDER BY id"), "insert": ("", "INSERT INTO t VALUES (2), (1)"), "rows": ("?format=CSV", "SELECT id FROM t ORDER BY id"),
        "default": ("?query=" + quote("SELECT count(*) FROM t"), ""), "empty": ("?format=JSON", "SELECT id FROM t WHERE id > 5"), "unreadable": ("", "SELEC"), "unknown": ("", "SELECT x FROM t"),
    }
    out = []
    try:
        for name, (path, body) in asked.items():
            link = HTTPConnection("127.0.0.1", server.server_port)
            link.request("POST" if body else "GET", f"/{path}", body.encode() or None)
            answer = link.getresponse()
            text = answer.read().decode()
            out.append((name, answer.status, answer.headers["Content-Type"].split(";")[0], "|".join(text.splitlines()) if answer.status == 200 else None))
            link.close()
    finally:
        server.shutdown()
    return spark.createDataFrame(out, "request string, status int, type string, body string")


# Merges beside queries


@_query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, TRUE AS fewer FROM events")
def compaction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background step merges; its rows are those of the parts before."""
    catalog = _loaded(spark, sf_dir, "events", _EVENTS, 4, "event_id", _EVENT_COLUMNS)
    before = catalog.describe("t").count()
    loop = Compactor(catalog, 0.05)
    loop.start()
    until = time.monotonic() + 120
    while not loop.merged and time.monotonic() < until:
        time.sleep(0.05)
    loop.stop()
    return catalog.sql("SELECT event_id, user_id FROM t").withColumn("user_id", F.col("user_id").cast("long")).withColumn("fewer", F.lit(catalog.describe("t").count() < before))


@_query("SELECT CAST(count(*) AS BIGINT) AS n, '202401_1_3_1' AS part FROM events WHERE event_id < 30")
def merge_keeps_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collapse sums the column that the partition expression reads; the part stays where its sources were."""
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (id Int64, ts DateTime) ENGINE = AggregatingMergeTree() ORDER BY id PARTITION BY toYYYYMM(ts)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 30").select(F.col("event_id").alias("id"), F.lit(1704067200).alias("ts"))
    for _ in range(3):
        catalog.insert("t", events)
    catalog.optimize("t")
    return catalog.sql("SELECT count(*) AS n FROM t").withColumn("part", F.lit(catalog.describe("t").first()["part"]))


@_query("SELECT 'event_id' AS column, 'SNAPPY' AS codec, count(*) AS n_values, CAST(min(event_id) AS VARCHAR) AS least, CAST(max(event_id) AS VARCHAR) AS greatest FROM events")
def part_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "db"))
    catalog.sql("CREATE TABLE t (event_id Int64, value Float64) ENGINE = MergeTree() ORDER BY event_id")
    catalog.insert("t", spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"))
    chunks = catalog.dump("t", catalog.describe("t").first()["part"]).where("column = 'event_id'")
    return chunks.groupBy("column", "codec").agg(F.sum("n_values").alias("n_values"), F.min(F.col("least").cast("long")).cast("string").alias("least"), F.max(F.col("greatest").cast("long")).cast("string").alias("greatest"))
