import json
import random
import threading
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.functions.scalars import float_text
from tesserae.operators.compaction import select_parts
from tesserae.plans.compiler import compile_select
from tesserae.plans.parser import parse, parse_expr
from tesserae.sources.formats import render
from tesserae.sources.pruning import may_match
from tesserae.types import DialectError


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def run(frame, text):
    return rows(compile_select(parse(text), frame)[0])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, 100, "a", 0.5), (2, 200, "b", 0.0), (3, 300, "a", 2.0), (4, 400, "", -1.5), (5, 500, "a|b", 0.0)], "id long, value long, name string, f double").cache()


def test_expressions(points):
    assert run(points, "SELECT id FROM t WHERE id > 2 AND NOT name = ''") == [(3,), (5,)]
    assert run(points, "SELECT id FROM t WHERE name") == [(1,), (2,), (3,), (5,)]
    assert run(points, "SELECT id FROM t WHERE f") == [(1,), (3,), (4,)]
    assert run(points, "SELECT value / f AS q FROM t WHERE id < 3") == [(0.0,), (200.0,)]
    assert run(points, "SELECT id FROM t WHERE value > '3'") == [(3,), (4,), (5,)]
    assert run(points, "SELECT intDiv(-7, 2) AS a, intDiv(7, 0) AS b, -id AS c FROM t WHERE id = 1") == [(-3, 0, -1.0)]
    assert run(points, "SELECT id = 1 AS x FROM t WHERE id < 3") == [(0,), (1,)]


def test_float_text(spark):
    cases = {45.0: "45", 0.5: "0.5", 999999.0: "999999", 1e6: "1e+06", 1.5e-5: "1.5e-05", 1234567.0: "1.234567e+06", 0.0001: "0.0001", 1e100: "1e+100", -2.25: "-2.25", 0.0: "0", 100000.0: "100000", 123456.789: "123456.789"}
    frame = spark.createDataFrame([(k,) for k in [*cases, float("nan"), float("inf"), -0.0]], "f double").select("f", float_text(F.col("f")).alias("t"))
    found = [r["t"] for r in frame.collect()]
    assert found == [*cases.values(), "NaN", "+Inf", "-0"]


def test_aggregates(points):
    assert run(points, "SELECT count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, avg(value) AS a, uniq(name) AS u FROM t") == [(5, 1500.0, 100.0, 500.0, 300.0, 4)]
    assert run(points, "SELECT quantiles(value) AS m, quantiles(0.9, value) AS q, topK(1, name) AS t FROM t") == [(300.0, 400.0, "a")]
    assert run(points, "SELECT sum(value) AS s, name FROM t GROUP BY name") == [("", 400.0), ("a", 400.0), ("a|b", 500.0), ("b", 200.0)]
    assert run(points, "SELECT name, topK(2, id) AS t, quantiles(value) AS q FROM t WHERE name = 'a' GROUP BY name") == [("a", "1,3", 100.0)]
    assert run(points, "SELECT name FROM t GROUP BY name") == [("",), ("a",), ("a|b",), ("b",)]
    assert run(points, "SELECT name, count(*) AS n FROM t WHERE id > 9 GROUP BY name") == []
    assert run(points, "SELECT count() AS n, avg(f) AS a, topK(name) AS k FROM t WHERE id > 9") == [(0, 0.0, "")]


def test_order_and_limit(points):
    assert [r["x"] for r in compile_select(parse("SELECT id AS x FROM t ORDER BY x DESC LIMIT 2"), points)[0].collect()] == [5, 4]
    assert run(points, "SELECT id FROM t LIMIT 0") == [] == run(points, "SELECT id FROM t LIMIT -3")


@pytest.mark.parametrize("text", ["SELECT nope FROM t", "SELECT id FROM t ORDER BY value", "SELECT lower(name) FROM t", "SELECT name + 1 FROM t", "SELECT min(name) FROM t", "SELECT id, count(*) FROM t", "SELECT sum(id) + 1 FROM t", "SELECT id FROM t WHERE sum(id) > 1", "SELECT id, * FROM t"])
def test_raises(points, text):
    with pytest.raises(DialectError):
        compile_select(parse(text), points)


def test_plan_is_pruned_and_pushed(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(str(tmp_path / "p"))
    frame, _ = compile_select(parse("SELECT sum(v) AS s FROM t WHERE id >= 50"), spark.read.parquet(str(tmp_path / "p")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan and "Python" not in plan


def test_insert_wraps(catalog):
    catalog.sql("CREATE TABLE t (k UInt64, a UInt8, b Int8, c UInt64, f Float32, s LowCardinality(String)) ENGINE = MergeTree() ORDER BY k")
    assert catalog.sql("INSERT INTO t VALUES (1, 300, 200, -1, 1.5, 'x'), (9007199254740993, -1, -129, 7, 2, 'it''s')").first()[0] == "OK. 2 rows inserted."
    assert [tuple(map(str, r)) for r in catalog.sql("SELECT * FROM t ORDER BY k").collect()] == [("1", "44", "-56", "18446744073709551615", "1.5", "x"), ("9007199254740993", "255", "127", "7", "2.0", "it's")]
    for bad in ("INSERT INTO t (k) VALUES (1)", "INSERT INTO t VALUES (1, 2)", "INSERT INTO nope VALUES (1)", "CREATE TABLE t (a UInt8) ENGINE = M", "DROP TABLE nope"):
        with pytest.raises(DialectError):
            catalog.sql(bad)
    catalog.sql("CREATE TABLE IF NOT EXISTS t (a UInt8) ENGINE = M")
    catalog.sql("DROP TABLE IF EXISTS nope")


def test_partitions_and_pruning(catalog):
    catalog.sql("CREATE TABLE t (id UInt64, ts DateTime) ENGINE = MergeTree() ORDER BY id PARTITION BY toYYYYMM(ts)")
    catalog.sql("INSERT INTO t VALUES (1, 1704067200), (2, 1706745600), (3, 1709251200)")
    catalog.sql("INSERT INTO t VALUES (4, 1704153600), (5, 1709337600)")
    assert sorted(r["partition"] for r in catalog.describe("t").collect()) == ["202401", "202401", "202402", "202403", "202403"]
    assert rows(catalog.sql("SELECT id FROM t WHERE ts >= 1706745600")) == [(2,), (3,), (5,)]
    assert catalog.pruned == {"parts": 5, "read": 3, "skipped": 2}
    assert rows(catalog.sql("SELECT id FROM t WHERE ts < 1704153600 OR id = 5")) == [(1,), (5,)]
    assert rows(catalog.sql("SELECT id FROM t WHERE ts > 1709251200.5")) == [(5,)]


def test_pruning_verdicts():
    bounds = {"a": (10, 20)}
    for text, yes in {"a = 5": False, "a = 20": True, "5 > a": False, "a != 3": True, "NOT a >= 10": False, "a < 10.5": True, "a > -1": True, "b = 1": True, "a = 5 AND b = 1": False, "a = 5 OR b = 1": True, "intDiv(a, 10) = 3": False, "a > 'x'": True}.items():
        assert may_match(parse_expr(text), bounds)[0] is yes, text


def test_pruning_with_nan():
    nan = float("nan")
    for bounds, matching, failing in (((1.0, nan), ("a = 5", "a > 9", "a != 1", "NOT a < 3", "a >= 1", "a <= 1"), ("a = 0", "a < 1", "NOT a >= -1 AND a < 0")), ((nan, nan), ("a = 5", "a < 1", "NOT a = 2"), ())):
        for text in matching:
            assert may_match(parse_expr(text), {"a": bounds})[0], text
        for text in failing:
            assert not may_match(parse_expr(text), {"a": bounds})[0], text


def test_quantiles_equal_brute_force(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([rng.gauss(0, 50), 7.0, float(rng.randrange(5))]), rng.random() if rng.random() < 0.9 else float("nan")) for g in ["hot"] * 6000 + ["warm"] * 401 + ["cold"] * 7 + ["one"]]
    data.append((None, 2.0, 3.0))
    frame = spark.createDataFrame(data, "g string, x double, y double").repartition(7)
    greatest_last = lambda v: (v != v, v)
    text = "quantiles(x) AS a, quantiles(0.99, x) AS b, quantiles(0.001, y) AS c, quantiles(0.95, y) AS d, topK(2, x) AS t"
    for keys in (["g"], []):
        out, _ = compile_select(parse(f"SELECT {'g, ' if keys else ''}{text} FROM t{' GROUP BY g' if keys else ''}"), frame)
        for r in out.collect():
            rows = [d for d in data if not keys or d[0] == r["g"]]
            for name, k, q in (("a", 1, 0.5), ("b", 1, 0.99), ("c", 2, 0.001), ("d", 2, 0.95)):
                values = sorted((d[k] for d in rows), key=greatest_last)
                assert repr(r[name]) == repr(values[int(q * (len(values) - 1))]), (r, name)
            counts = Counter(d[1] for d in rows)
            top = sorted(counts, key=lambda v: (-counts[v], float_key(v)))[:2]
            assert r["t"] == ",".join(map(float_key, top))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def float_key(v):
    return f"{v:g}" if v == int(v) else repr(v)


def test_few_files(spark, catalog):
    catalog.sql("CREATE TABLE t (id Int64, p Int64) ENGINE = MergeTree() ORDER BY id PARTITION BY p")
    catalog.insert("t", spark.range(4000).select("id", (F.col("id") % 20).alias("p")).repartition(16))
    files = [n for p in catalog.table("t")["parts"] for n in catalog.files.names(p["path"]) if n.endswith(".parquet")]
    assert len(catalog.table("t")["parts"]) == 20 and len(files) <= 40


def test_merge_step_survives_a_failure(catalog, monkeypatch):
    for name in ("a", "b"):
        catalog.sql(f"CREATE TABLE {name} (id Int64) ENGINE = MergeTree() ORDER BY id")
        for k in range(3):
            catalog.sql(f"INSERT INTO {name} VALUES ({k})")
    plain = catalog.optimize
    monkeypatch.setattr(catalog, "optimize", lambda name: plain(name) if name == "b" else 1 / 0)
    assert catalog.optimize_step() == {"b": "all_1_3_1"}
    assert catalog.vacuum(3600) == 0  # what was replaced is too young, and named by older manifests


def test_views_states_and_restart(catalog, spark):
    from tesserae.sources.catalog import Catalog

    catalog.sql("CREATE TABLE src (k UInt64, v Int64, s String) ENGINE = MergeTree() ORDER BY k")
    catalog.sql("CREATE TABLE dst (k UInt64, t AggregateFunction(sum, Int64), u AggregateFunction(uniq, String), n Int32) ENGINE = AggregatingMergeTree() ORDER BY k")
    catalog.sql("CREATE MATERIALIZED VIEW v TO dst AS SELECT k, sumState(v) AS t, uniqState(s) AS u, count(*) AS n FROM src WHERE (k = 1 OR k = 2) AND v > 0 GROUP BY k")
    catalog.sql("INSERT INTO src VALUES (1, 10, 'a'), (2, 7, 'b'), (3, 1, 'c'), (1, -5, 'z')")
    again = Catalog(spark, catalog.files.root)
    again.sql("INSERT INTO src VALUES (1, 7, 'b'), (2, 3, 'b')")
    again.sql("INSERT INTO src VALUES (1, 1, 'a')")
    query = "SELECT k, sumMerge(t) AS t, uniqMerge(u) AS u, sum(n) AS n FROM dst GROUP BY k"
    expected = [(1, 18.0, 2, 3.0), (2, 10.0, 1, 2.0)]
    assert rows(again.sql(query)) == expected
    assert again.optimize("dst") == "all_1_3_1"
    assert rows(again.sql(query)) == expected and again.sql("SELECT k FROM dst").count() == 2
    assert rows(Catalog(spark, catalog.files.root).sql(query)) == expected
    again.vacuum()
    assert rows(again.sql(query)) == expected
    again.sql("DROP TABLE src")
    assert again.manifest()["views"] == {}


def test_compaction_keeps_rows(catalog):
    catalog.sql("CREATE TABLE t (id UInt64, value Int64) ENGINE = MergeTree() ORDER BY id")
    for k in range(3):
        catalog.sql(f"INSERT INTO t VALUES ({9 - k}, 1), ({3 + k}, 2)")
    before = rows(catalog.sql("SELECT * FROM t"))
    assert catalog.optimize("t") == "all_1_3_1" and catalog.optimize("t") is None
    assert rows(catalog.sql("SELECT * FROM t")) == before and catalog.describe("t").first()["level"] == 1


def test_collapse_wraps_and_keeps_first(catalog):
    catalog.sql("CREATE TABLE t (k UInt64, v UInt8, s String) ENGINE = AggregatingMergeTree() ORDER BY k")
    for v, s in ((200, "first"), (100, "second"), (1, "third")):
        catalog.sql(f"INSERT INTO t VALUES (1, {v}, '{s}')")
    catalog.optimize("t")
    assert rows(catalog.sql("SELECT * FROM t")) == [(1, 45, "first")]


def test_select_parts():
    part = lambda block, size, pid="a": {"min_block": block, "bytes": size, "rows": 1, "partition": pid}
    assert select_parts([part(1, 10), part(2, 10)]) == []
    chosen = select_parts([part(1, 1000), part(2, 10), part(3, 10), part(4, 10), part(5, 10, "b")])
    assert [p["min_block"] for p in chosen] == [2, 3, 4]


def test_formats(points, spark):
    frame, kinds = compile_select(parse("SELECT id, name, f FROM t WHERE id < 3 ORDER BY id"), points)
    assert "".join(render(frame, kinds)) == "id\tname\tf\n1\ta\t0.5\n2\tb\t0\n"
    quoted = spark.createDataFrame([('say "hi", x', 1)], 's string, `a,b` long')
    assert "".join(render(quoted, {}, "csv")) == 's,"a,b"\n"say ""hi"", x",1\n'
    assert json.loads("".join(render(frame, kinds, "JSON"))) == {"meta": [{"name": "id", "type": "Int64"}, {"name": "name", "type": "String"}, {"name": "f", "type": "Float64"}], "data": [{"id": 1, "name": "a", "f": 0.5}, {"id": 2, "name": "b", "f": 0.0}], "rows": 2}


def test_server(catalog):
    from tesserae.sources.server import serve

    server = serve(catalog)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(text, form=""):
        try:
            with urllib.request.urlopen(f"{base}/?format={form}" if form else base, text.encode()) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert urllib.request.urlopen(f"{base}/ping").read() == b"Ok.\n"
        assert post("CREATE TABLE t (id UInt64) ENGINE = MergeTree ORDER BY id") == (200, "OK\n")
        assert post("INSERT INTO t VALUES (2), (1)")[1] == "OK. 2 rows inserted.\n"
        assert post("SELECT id FROM t ORDER BY id", "CSV") == (200, "id\n1\n2\n")
        assert urllib.request.urlopen(f"{base}/?query={urllib.parse.quote('SELECT count(*) FROM t')}").read() == b"count(*)\n2\n"
        assert post("SELEC")[0] == 400 and post("SELECT x FROM t")[0] == 500
    finally:
        server.shutdown()


def test_replayed_batch_counts_once(catalog, spark):
    catalog.sql("CREATE TABLE t (id Int64) ENGINE = MergeTree() ORDER BY id")
    assert catalog.insert("t", spark.range(3), ("q", 0)) == 3 and catalog.insert("t", spark.range(3), ("q", 0)) == 0
    assert catalog.sql("SELECT id FROM t").count() == 3


def test_sketch_tolerance(spark):
    frame, _ = compile_select(parse("SELECT uniqState(id) AS u FROM t"), spark.range(50_000))
    merged, _ = compile_select(parse("SELECT uniqMerge(u) AS n FROM t"), frame.union(compile_select(parse("SELECT uniqState(id) AS u FROM t"), spark.range(20_000))[0]))
    assert abs(merged.first()[0] - 50_000) < 2500


def test_merged_states_count_exactly(catalog, spark):
    catalog.sql("CREATE TABLE src (k UInt64, a UInt64, s String) ENGINE = MergeTree() ORDER BY k")
    catalog.sql("CREATE TABLE dst (k UInt64, u AggregateFunction(uniq, UInt64), n Int64, w AggregateFunction(uniq, String)) ENGINE = AggregatingMergeTree() ORDER BY k")
    catalog.sql("CREATE MATERIALIZED VIEW v TO dst AS SELECT k, uniqState(a) AS u, count(*) AS n, uniqState(s) AS w FROM src GROUP BY k")
    for batch in range(3):  # key 0 has 1,500 values in all, some in several batches
        catalog.insert("src", spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") + 1000 * batch).alias("a"), F.concat(F.col("id") % 14, F.lit(', "\n')).alias("s")))
        catalog.insert("src", spark.range(700).select(F.lit(0).alias("k"), (2 * F.col("id")).alias("a"), F.lit("").alias("s")))
    query = "SELECT k, uniqMerge(u) AS u, sum(n) AS n, uniqMerge(w) AS w FROM dst GROUP BY k"
    expected = [(0, 1500, 3600.0, 8), (1, 1500, 1500.0, 7)]
    assert rows(catalog.sql(query)) == expected
    assert catalog.optimize("dst") is not None and rows(catalog.sql(query)) == expected
    assert catalog.sql("SELECT k FROM dst").count() == 2
    assert rows(catalog.sql("SELECT uniqMerge(u) AS u FROM dst")) == [(3000,)] and rows(catalog.sql("SELECT uniqMerge(u) AS u FROM dst WHERE k > 5")) == [(0,)]


def test_unmerged_states_count_exactly(spark):
    data = [(n % 3, None if n % 10 == 1 else f"{n % 5000}") for n in range(9000)] + [(3, None), (None, ""), (None, "x")]
    frame = spark.createDataFrame(data, "k int, s string")
    made = [compile_select(parse("SELECT k, uniqState(s) AS u, count(*) AS n FROM t GROUP BY k"), f)[0] for f in (frame, frame.where("k < 2"))]
    wanted = {k: len({s for g, s in data if g == k and s is not None}) for k in (0, 1, 2, 3, None)}
    found = compile_select(parse("SELECT k, uniqMerge(u) AS u, count(*) AS c FROM t GROUP BY k"), made[0].union(made[1]))[0].collect()
    assert {r["k"]: (r["u"], r["c"]) for r in found} == {k: (u, 2 if k in (0, 1) else 1) for k, u in wanted.items()}
    assert run(made[0], "SELECT uniqMerge(u) AS u FROM t") == [(len({s for _, s in data if s is not None}),)] == run(frame, "SELECT uniqMerge(s) AS u FROM t")
    with pytest.raises(DialectError):  # states of another maker
        compile_select(parse("SELECT uniqMerge(b) AS u FROM t"), frame.selectExpr("cast(s AS binary) AS b"))


def test_command_line(catalog, capsys):
    from tesserae.__main__ import main

    catalog.sql("CREATE TABLE t (id Int64) ENGINE = MergeTree() ORDER BY id")
    catalog.sql("INSERT INTO t VALUES (2), (1)")
    assert main(["--data", catalog.files.root, "query", "SELECT id FROM t ORDER BY id", "--format", "CSV"]) == 0
    assert capsys.readouterr().out.endswith("id\n1\n2\n")
    main(["--data", catalog.files.root, "describe", "t"])
    found = json.loads(capsys.readouterr().out)["data"]
    assert [p["part"] for p in found] == ["all_1_1_0"] and json.loads(found[0]["bounds"]) == {"id": [1, 2]}
