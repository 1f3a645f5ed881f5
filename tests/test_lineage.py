"""The lineage engine: oracle equality, replay, single rows, storage, nulls."""

import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparktrail import catalogue
from sparktrail.functions import polynomials, sketches, statistics
from sparktrail.operators import backtrace, cached, capture, differences, graph_json, layers_of, lineage, load, release, replay, save
from sparktrail.operators.backtrace import ARRAY, _in_arrays
from sparktrail.plans import micro, scan, tpch
from sparktrail.plans.sql import Catalog, Unsupported
from sparktrail.sources import tables

SF = "/root/testdata/sf0.001"


def bag(df, cols=None):
    return Counter(tuple(r) for r in df.select(*(cols or sorted(df.columns))).collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in tables.TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    return c


ORACLES = catalogue.oracle_sql()
CHOSEN = [
    "filter_lineage", "join3_lineage", "selfjoin_lineage_second", "left_outer_lineage", "full_outer_lineage", "exists_lineage_inner", "anti_lineage", "not_in_lineage", "in_lineage",
    "nested_in_lineage_inner", "corr_scalar_lineage", "uncorr_scalar_lineage", "having_scalar_lineage", "sublink_or_lineage", "view_twice_lineage_outer", "group_avg_lineage",
    "nested_agg_lineage", "pure_agg_lineage", "distinct_lineage", "window_rows_lineage", "window_groups_lineage", "single_row_lineage", "union_lineage", "intersect_lineage_right",
    "except_all_lineage", "poly_unfactored", "poly_factored", "sketch_64", "sketch_large", "layer_stats", "q2_lineage_sublink", "q3_lineage_lineitem", "q13_lineage_orders", "q21_lineage_sublink",
    "exists_over_window_lineage", "exists_uncorrelated_lineage", "exists_uncorrelated_attached", "exists_over_pure_agg_lineage", "intersect_all_lineage", "stored_single_row", "stored_all_rows",
    "stored_graph", "lineage_view", "lineage_csv", "generated_series", "chain_lineage", "chain_group_lineage", "column_stats", "sketch_bits", "sketch_equality",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    cols = sorted(found.columns)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    assert bag(found) == Counter(tuple(r[names.index(c)] for c in cols) for r in answer.fetchall())


@pytest.mark.parametrize("name", ["q3", "q13", "q15", "q18", "q20"])
def test_replay(spark, name):
    assert differences(tpch.PLANS[name](micro.Tables(spark, SF))) == 0


def test_single_row_is_a_part_of_all_rows(spark):
    captured = capture(micro.topk(micro.Tables(spark, SF)))
    every = backtrace(captured, "o", ["c_custkey"])
    one = backtrace(captured, "o", ["c_custkey"], offset=2)
    key = one.first()["out_c_custkey"]
    assert bag(one) == bag(every.where(F.col("out_c_custkey") == key))


@pytest.mark.parametrize("partitions", [0, 3])
def test_save_and_load(spark, tmp_path, partitions):
    plan = micro.nested_agg(micro.Tables(spark, SF))
    own = capture(plan)
    stored = save(own, str(tmp_path / "capture"), partitions)
    again = load(spark, str(tmp_path / "capture"))
    for c in (stored, again):
        assert bag(c.result) == bag(own.result)
        assert bag(backtrace(c, "o", ["orders"])) == bag(backtrace(own, "o", ["orders"]))
    assert [x["kind"] for x in json.loads(graph_json(again))["layers"]] == ["aggregate", "aggregate"]
    assert statistics.stored_bytes(spark, str(tmp_path / "capture")) > 0


def test_cached(spark):
    own = cached(capture(micro.having(micro.Tables(spark, SF))))
    assert bag(lineage(own, "o")) == bag(backtrace(own, "o", ["o_custkey"]).select("o_o_orderkey").distinct())
    release(own)


def test_null_group_keys_and_missing_sides(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 7), (4, 7), (5, 8)], "id long, k long")
    other = spark.createDataFrame([(10, 7), (11, None)], "oid long, ok long")
    grouped = scan("t", rows, ["id"]).group(["k"], n="count(1)")
    found = backtrace(capture(grouped), "t")
    assert bag(found, ["out_k", "t_id"]) == Counter([(None, 1), (None, 2), (7, 3), (7, 4), (8, 5)])
    # the null group must not be mistaken for a missing side
    joined = scan("o", other, ["oid"]).join(grouped, "ok = k", "left")
    assert bag(backtrace(capture(joined), "t", ["oid"]), ["out_oid", "t_id"]) == Counter([(10, 3), (10, 4)])
    assert bag(backtrace(capture(joined), "o", ["oid"]), ["out_oid", "o_oid"]) == Counter([(10, 10), (11, 11)])
    nothing = scan("t", rows, ["id"]).not_in("k", scan("o", other, ["oid"]), "ok")
    assert capture(nothing).result.count() == 0
    some = scan("t", rows, ["id"]).not_in("k", scan("o", other.where("ok = 7"), ["oid"]), "ok")
    assert bag(capture(some).result) == Counter([(5, 8)])


def test_every_traced_row_matters(spark):
    rows = spark.createDataFrame([(i, i % 3, i + 1) for i in range(12)], "id long, k long, v long")
    plan = scan("t", rows, ["id"]).filter("v > 2").group(["k"], total="sum(v)")
    before = bag(capture(plan).result)
    for r in lineage(capture(plan), "t").collect():
        less = scan("t", rows.where(F.col("id") != r["t_id"]), ["id"]).filter("v > 2").group(["k"], total="sum(v)")
        assert bag(capture(less).result) != before


def test_empty_input(spark):
    t = spark.createDataFrame([], "id long, k long")
    plan = scan("t", t, ["id"]).group((), n="count(1)")
    assert capture(plan).result.first()["n"] == 0 and lineage(capture(plan), "t").count() == 0
    assert replay(scan("t", t, ["id"]).distinct()).count() == 0


def test_window_without_partition_and_frame_without_current_row(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(3000)], "id long, v double")
    plan = scan("t", rows, ["id"]).window((), ["v"], ("rows", -1, -1), before="max(v)")
    found = bag(backtrace(capture(plan), "t", ["id"]), ["out_id", "t_id"])
    assert found == Counter([(i, i) for i in range(3000)] + [(i, i - 1) for i in range(1, 3000)])


def test_factored_expands_to_unfactored(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2)], "o string, x long")
    b = spark.createDataFrame([("g", 3), ("g", 4)], "o string, y long")
    assert polynomials.factored([(a, "x"), (b, "y")], ["o"]).first()["polynomial"] == "(1 ⊕ 2) ⊗ (3 ⊕ 4)"
    assert polynomials.unfactored(a.join(b, "o"), ["o"], ["x", "y"]).first()["polynomial"] == "(1 ⊗ 3) ⊕ (1 ⊗ 4) ⊕ (2 ⊗ 3) ⊕ (2 ⊗ 4)"
    assert polynomials.counting(a.join(b, "o"), ["o"]).first()["ways"] == 4


def test_sketches(spark):
    rows = spark.range(1000).withColumnRenamed("id", "x")
    few, many = [float(i) for i in range(100, 1000, 100)], [float(i) for i in range(1, 1000)]
    bits = sketches.sketch64(rows.where("x in (5, 250, 999)"), "x", few).first()["sketch"]
    assert bits == 1 + (1 << 2) + (1 << 9)
    assert sketches.skip(rows, "x", few, bits).count() == 300
    part = rows.where("x % 7 = 0")
    assert {r["range"] for r in sketches.ranges_touched(part, "x", many).collect()} == set(range(0, 1000, 7))
    assert sketches.same(sketches.sketch(part, "x", many), sketches.sketch(part.orderBy(F.desc("x")), "x", many))
    assert not sketches.same(sketches.sketch(part, "x", many), sketches.sketch(rows, "x", many))
    assert len(sketches.equal_depth(rows, "x", 8)) == 7


def test_sources(spark, tmp_path):
    z = tables.zipf(spark, 2000, 20, 1.0, seed=3)
    facts = z.agg(F.count("*"), F.countDistinct("id"), F.min("z"), F.max("z"), F.min("val"), F.max("val")).first()
    assert tuple(facts)[:2] == (2000, 2000) and facts[2] == 1 and facts[3] <= 20 and facts[4] >= 1 and facts[5] <= 100
    assert z.where("z = 1").count() > z.where("z = 10").count()
    assert tables.series(spark, 5, 2).columns == ["column_1", "column_2"]
    found = lineage(capture(micro.distinct(micro.Tables(spark, SF))), "s")
    tables.write_csv(found, str(tmp_path / "csv"))
    assert bag(tables.read_csv(spark, str(tmp_path / "csv"), "s_s_suppkey long")) == bag(found)
    assert bag(tables.materialise(found, "kept_lineage")) == bag(found)
    one, two = tables.chain(spark, [3, 9])
    joined = scan("a", one, ["idx_0"]).join(scan("b", two, ["idx_1"]), "idx_0 = up_1").group(["idx_0"], n="count(1)")
    assert backtrace(capture(joined), "b").count() == 9


def test_plan_and_statistics(spark):
    captured = capture(micro.nested_agg(micro.Tables(spark, SF)))
    assert "Aggregate" in statistics.plan_text(captured.result)
    ids = [x.id for x in layers_of(captured.sources)]
    assert len(ids) == 2 and statistics.column_statistics(captured, ids[0]).count() > 0
    assert "PushedFilters" in statistics.plan_text(capture(micro.urgent(micro.Tables(spark, SF))).result, "executed")


SQL = {
    "exists": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "nested": "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND l_quantity > (SELECT 0.9 * sum(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = lineitem.l_partkey AND l2.l_suppkey = lineitem.l_suppkey)) ORDER BY s_name",
    "cte_twice": "WITH r AS (SELECT l_suppkey AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_name, total FROM supplier, r WHERE s_suppkey = k AND total = (SELECT max(total) FROM r)",
    "self_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey ORDER BY x DESC, y LIMIT 5",
    "windows": "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY CAST(value AS INT)) AS r, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM events",
    "sets": "SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region",
    "case": "SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'u' ELSE 'n' END AS k, count(*) FILTER (WHERE o_totalprice > 1000) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY CASE WHEN o_orderpriority LIKE '1%' THEN 'u' ELSE 'n' END HAVING count(*) > 3",
    "or": "SELECT o_orderkey FROM orders WHERE o_totalprice > 195000 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
    "not_in": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AND year(DATE '2020-01-01') = 2020",
}


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    for n in tables.TABLES:
        c.register(n, tables.read(spark, SF, n), tables.KEYS[n])
    return c


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, catalog, name):
    plan = catalog.plan(SQL[name])
    own = spark.sql(SQL[name])
    found = capture(plan).result
    assert found.columns == own.columns and bag(found) == bag(own)
    assert differences(plan) == 0


def test_sql_lineage_is_that_of_the_plan(spark, catalog):
    captured = capture(catalog.plan(SQL["self_join"]))
    assert catalog.plan(SQL["self_join"]).accesses() == ["nation", "nation_2"]
    one = backtrace(captured, "nation_2", ["x", "y"], offset=0)
    assert bag(one, ["nation_2_n_nationkey"]) == Counter([(r["n_nationkey"],) for r in spark.sql("SELECT n_nationkey FROM nation WHERE n_name = (SELECT first(y) FROM (" + SQL["self_join"].replace("LIMIT 5", "LIMIT 1") + "))").collect()])
    with pytest.raises(Unsupported):
        catalog.plan("SELECT explode(array(1, 2)) AS x FROM nation")


def test_attached_scalar_lineage_of_all_output_rows(spark, duck):
    name = "uncorr_scalar_lineage_attached_all"
    found = catalogue.queries()[name](spark, SF)
    assert bag(found, ["out_c_custkey", "c2_c_custkey"]) == Counter(duck.execute(ORACLES[name]).fetchall())
    result = capture(micro.uncorr_scalar(micro.Tables(spark, SF))).result
    assert bag(found.select("out_c_custkey").distinct()) == bag(result, ["c_custkey"]) and result.count() > 1


def test_attached_scalar_lineage_is_spread_over_tasks(spark, tmp_path):
    """Whatever files the table has, outputs x inner rows are made by all tasks; equal ids and ids without a value stay a bag."""
    one_file = spark.createDataFrame([(i if i % 7 else None, i % 10) for i in range(400)] + [(1, 1), (1, 9)], "k int, v int").coalesce(1)
    one_file.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = scan("o", t, ["k"]).scalar(scan("i", t, ["k"], "i_").filter("i_v > 3"), (), mean="avg(i_v)").filter("v > mean")
    found = backtrace(capture(plan), "i", ["k"], factored=False)
    rows = [tuple(r) for r in t.collect()]
    inner = [k for k, v in rows if v > 3]
    mean = sum(v for _, v in rows if v > 3) / len(inner)
    assert bag(found, ["out_k", "i_k"]) == Counter((o, i) for o, v in rows if v > mean for i in inner)
    busy = found.groupBy(F.spark_partition_id()).count().count()
    assert t.rdd.getNumPartitions() == 1 and busy == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert backtrace(capture(plan.filter("k < 0")), "i", ["k"], factored=False).count() == 0


def test_attached_scalar_lineage_is_bounded_in_a_task(spark):
    """No generated loop holds an array once for every output row (a broadcast join does), and no array grows with repeated ids."""
    t = spark.createDataFrame([(i if i % 7 else None, i % 10) for i in range(300)] + [(5, 9)] * 1_000, "k int, v int")
    plan = scan("o", t, ["k"]).scalar(scan("i", t, ["k"], "i_").filter("i_v > 3"), (), mean="avg(i_v)").filter("v > mean AND k % 50 = 5")
    found = backtrace(capture(plan), "i", ["k"], factored=False)
    made = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in made and "Coalesce " not in made
    rows = [tuple(r) for r in t.collect()]
    inner = Counter(k for k, v in rows if v > 3)
    outer = Counter(k for k, v in rows if k is not None and k % 50 == 5 and v > 8)
    counted = found.groupBy("out_k", "i_k").count().collect()
    assert {(r["out_k"], r["i_k"]): r["count"] for r in counted} == {(o, i): n * m for o, n in outer.items() for i, m in inner.items()} and outer[5] > 900
    arrays = [r["n"] for r in _in_arrays(t.select("k"), 2).select(F.size("_ids").alias("n")).collect()]
    assert sum(arrays) == len(rows) and max(arrays) == ARRAY


SQL_TEXTS = [
    "SELECT k FROM (SELECT k, v, sum(k) OVER (PARTITION BY g) s FROM t) x WHERE EXISTS (SELECT 1 FROM u WHERE u.w > x.v)",
    "SELECT k FROM (SELECT k, v, sum(k) OVER () s FROM t) x WHERE EXISTS (SELECT 1 FROM u WHERE u.w > x.v)",
    "SELECT m FROM (SELECT max(v) m FROM t) x WHERE EXISTS (SELECT 1 FROM u WHERE u.w > x.m)",
    "SELECT k FROM t WHERE EXISTS (SELECT 1 FROM u WHERE w > 3)",
    "SELECT k FROM t WHERE EXISTS (SELECT 1 FROM u WHERE w > 300)",
    "SELECT k FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE w > 300) AND k < 3",
    "SELECT k FROM t WHERE s LIKE 'x!_y' ESCAPE '!'",
    "SELECT k, row_number() OVER (ORDER BY v NULLS LAST, k) r FROM t",
    "SELECT k, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) r FROM t",
    "SELECT k, sum(k) OVER (ORDER BY v DESC NULLS FIRST, k ROWS 1 PRECEDING) r FROM t",
    "SELECT k, first_value(v) IGNORE NULLS OVER (PARTITION BY g ORDER BY k DESC) f, lag(v) IGNORE NULLS OVER (ORDER BY k) l FROM t",
    "SELECT k, last(s, true) OVER (PARTITION BY g ORDER BY k) f, nth_value(v, 2) IGNORE NULLS OVER (ORDER BY k) n FROM t",
    "SELECT g, first(v, true) f FROM (SELECT * FROM t WHERE k IN (3, 5)) GROUP BY g",
    "SELECT k, TRY_CAST(s AS INT) c, CAST(v AS STRING) d FROM t",
    "SELECT k FROM t ORDER BY v ASC NULLS LAST, k DESC LIMIT 3",
    "SELECT k FROM t ORDER BY k OFFSET 2",
    "SELECT k, v FROM t ORDER BY v DESC NULLS FIRST, k LIMIT 2 OFFSET 1",
    "SELECT count(*) n, sum(v) FILTER (WHERE k > 1) f, count(DISTINCT g) d FROM t",
    "SELECT upper(s) a, coalesce(v, -1) b, CASE WHEN v > 1 THEN 'p' ELSE 'q' END d, v IN (1, 5) e, s LIKE 'x%' f FROM t",
    "SELECT s RLIKE '^x' a, concat_ws('-', s, g) b, round(v / 3, 2) c, v % 2 m, -v n, NOT (v > 1) o FROM t",
    "SELECT k, date_add(DATE '2020-01-01', k) d, extract(year FROM DATE '2020-01-01') y FROM t",
    "SELECT k, ntile(2) OVER (ORDER BY k) n, percent_rank() OVER (ORDER BY v NULLS LAST) p, lead(v, 1, 0) OVER (ORDER BY k) l FROM t",
    "SELECT t.k, u.w FROM t LEFT JOIN u ON t.g = u.h AND u.w > t.k",
    "SELECT k FROM t WHERE k NOT IN (SELECT w FROM u WHERE w IS NOT NULL)",
    "SELECT g, max(v) - min(v) d FROM t GROUP BY g HAVING count(*) > 1",
]


@pytest.fixture(scope="module")
def small(spark):
    t = spark.createDataFrame([(1, "a", 1, "x_y"), (2, "a", 1, "x%y"), (3, "b", 5, None), (4, "b", None, "7"), (5, None, 3, "q")], "k int, g string, v int, s string")
    u = spark.createDataFrame([(2, "a"), (6, "b"), (4, None)], "w int, h string")
    return Catalog(spark).register("t", t, ["k"]).register("u", u, ["w"])


@pytest.mark.parametrize("text", SQL_TEXTS)
def test_sql_means_what_spark_means(spark, small, text):
    assert sorted(map(str, map(tuple, capture(small.plan(text)).result.collect()))) == sorted(map(str, map(tuple, spark.sql(text).collect())))


@pytest.mark.parametrize("text", SQL_TEXTS[:3])
def test_witnesses_of_conditions_over_windows_and_aggregates(spark, small, text):
    """Every output row has all witnesses of its own condition, also where outer rows have no ids of their own."""
    v = {1: 1, 2: 1, 3: 5, 4: None, 5: 3} if text.startswith("SELECT k") else {5: 5}
    want = sorted((k, w) for k, low in v.items() for w in (2, 6, 4) if low is not None and w > low)
    assert sorted(map(tuple, backtrace(capture(small.plan(text)), "u").collect())) == want


@pytest.mark.parametrize("text", ["SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY v) p FROM t", "SELECT k, sum(v) OVER (ORDER BY CAST(v AS DOUBLE) RANGE BETWEEN 0.5 PRECEDING AND CURRENT ROW) r FROM t", "SELECT k FROM t WHERE k > 3 OR EXISTS (SELECT 1 FROM u WHERE w > 3)"])
def test_sql_that_is_refused(small, text):
    with pytest.raises(Unsupported):
        small.plan(text)


def test_a_stored_layer_is_pruned_to_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 50) for i in range(1000)] + [(5000, None)], "k int, g int")
    from sparktrail.plans.nodes import scan

    saved = save(capture(scan("t", rows, ["k"]).group(["g"], n="count(1)")), str(tmp_path / "capture"), partitions=8)
    for g in (7, None):
        found = backtrace(saved, "t", ["g"], where="g <=> 7" if g else "g IS NULL")
        assert sorted(r["t_k"] for r in found.collect()) == ([i for i in range(1000) if i % 50 == 7] if g else [5000])
        assert len(found.inputFiles()) and "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().executedPlan().toString()
