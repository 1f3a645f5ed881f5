"""Queries over stored, viewed and exported lineage, generated tables, sketches and statistics, and the rarer EXISTS and set rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketches, statistics
from ..operators import backtrace, capture, lineage, save
from ..operators.backtrace import as_view
from ..operators.layers import graph_json
from ..sources import tables as src
from . import nodes as N
from .micro import Entry, Tables, topk, traced


def _nations(t):
    return t("nation", "n").join(t("region", "r"), "n_regionkey = r_regionkey").group(["r_regionkey"], n="count(1)")


def _by_customer(t):
    return t("orders", "o").group(["o_custkey"], n="count(1)")


def _exists_over_window(t):
    return t("supplier", "s").window(["s_nationkey"], total="sum(s_acctbal)").exists(t("nation", "n"), residual="n_nationkey * 300 > s_acctbal")


def _exists_uncorrelated(t):
    return t("region", "r").exists(t("nation", "n").filter("n_nationkey > 20"))


def _exists_over_pure_agg(t):
    return t("supplier", "s").group([], m="max(s_suppkey)").exists(t("nation", "n"), residual="n_nationkey * 10 < m")


def _intersect_all(t):
    return N.SetOp(t("customer", "c").project(k="c_nationkey"), t("supplier", "s").project(k="s_nationkey"), "intersect", True)


def _chain(spark: SparkSession) -> N.Plan:
    one, two, three = src.chain(spark, [10, 100, 1000])
    joined = N.scan("a", one, ["idx_0"]).join(N.scan("b", two, ["idx_1"]), "up_1 = idx_0")
    return joined.join(N.scan("c", three, ["idx_2"]), "up_2 = idx_1")


def stored_single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output row traced in a stored capture: one folder of its layer is opened."""
    saved = save(capture(_by_customer(Tables(spark, sf_dir))), src.workspace(spark, "capture"), partitions=16)
    return backtrace(saved, "o", ["o_custkey"], where="o_custkey = 7")


def stored_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All output rows traced in a stored capture."""
    return backtrace(save(capture(_by_customer(Tables(spark, sf_dir))), src.workspace(spark, "capture"), partitions=16), "o", ["o_custkey"])


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of a dependency graph, as its JSON tells them."""
    graph = json.loads(graph_json(capture(_nations(Tables(spark, sf_dir)))))
    return spark.createDataFrame([(x["kind"], len(x["ptr"]), len(x["sources"])) for x in graph["layers"]], "kind string, pointers long, sources long")


def lineage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage relation as a view that SQL reads."""
    as_view(capture(_nations(Tables(spark, sf_dir))), "n", "sparktrail_nations")
    return src.run_sql(spark, "SELECT out_r_regionkey AS r_regionkey, count(*) AS n, sum(n_n_nationkey) AS total FROM sparktrail_nations GROUP BY out_r_regionkey")


def lineage_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage written as CSV and read again."""
    path = src.workspace(spark, "csv")
    src.write_csv(backtrace(capture(_nations(Tables(spark, sf_dir))), "n", ["r_regionkey"]), path)
    return src.read_csv(spark, path, "out_r_regionkey int, n_n_nationkey int")


def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage exported as CSV and saved as a table."""
    path = src.workspace(spark, "csv")
    src.write_csv(backtrace(capture(_by_customer(Tables(spark, sf_dir))), "o", ["o_custkey"]), path)
    return src.csv_to_table(spark, path, "out_o_custkey long, o_o_orderkey long", "sparktrail_lineage")


def generated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.series(spark, 1000, 3)


def generated_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by Zipf's law (random, so there is no SQL for them)."""
    return src.zipf(spark, 10_000, 100, 1.0)


def chain_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrace(capture(_chain(spark)), "a", ["idx_2"])


def chain_group_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrace(capture(_chain(spark).group(["idx_0"], n="count(1)")), "c", ["idx_0"])


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest value of each column of a layer."""
    captured = capture(_by_customer(Tables(spark, sf_dir)))
    found = statistics.column_statistics(captured, captured.sources[0].layer.id)
    return found.select(F.when(F.col("column").startswith("_ptr"), "pointer").otherwise("id").alias("part"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def _orders(spark: SparkSession, sf_dir: str):
    t = Tables(spark, sf_dir)
    return lineage(capture(topk(t)), "o"), sketches.equal_width(t.df("orders"), "o_orderkey", 4000)


def sketch_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranges a large sketch has."""
    found, bounds = _orders(spark, sf_dir)
    return sketches.sketch(found, "o_o_orderkey", bounds).agg(F.sum(F.expr("bitmap_count(bits)")).cast("long").alias("n"))


def sketch_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of a lineage equals that of its stored copy, and not that of half of it."""
    found, bounds = _orders(spark, sf_dir)
    whole = sketches.sketch(found, "o_o_orderkey", bounds)
    half = sketches.sketch(found.orderBy("o_o_orderkey").limit(1), "o_o_orderkey", bounds)
    return spark.createDataFrame([(sketches.same(whole, sketches.sketch(found.repartition(3), "o_o_orderkey", bounds)), sketches.same(whole, half))], "same boolean, other boolean")


def entries(sketch_large_sql: str) -> dict[str, Entry]:
    orders = "SELECT o_custkey AS out_o_custkey, o_orderkey AS o_o_orderkey FROM orders"
    nations = "FROM nation JOIN region ON n_regionkey = r_regionkey"
    return {
        "exists_over_window_lineage": Entry(traced(_exists_over_window, "n", ["s_suppkey"]), "SELECT s_suppkey AS out_s_suppkey, n_nationkey AS n_n_nationkey FROM supplier JOIN nation ON n_nationkey * 300 > s_acctbal"),
        "exists_uncorrelated_lineage": Entry(traced(_exists_uncorrelated, "n"), "SELECT n_nationkey AS n_n_nationkey FROM nation WHERE n_nationkey > 20"),
        "exists_uncorrelated_attached": Entry(traced(_exists_uncorrelated, "n", ["r_regionkey"], factored=False), "SELECT r_regionkey AS out_r_regionkey, n_nationkey AS n_n_nationkey FROM region, nation WHERE n_nationkey > 20"),
        "exists_over_pure_agg_lineage": Entry(traced(_exists_over_pure_agg, "n", ["m"]), "SELECT m AS out_m, n_nationkey AS n_n_nationkey FROM (SELECT max(s_suppkey) AS m FROM supplier) JOIN nation ON n_nationkey * 10 < m"),
        "intersect_all_lineage": Entry(traced(_intersect_all, "c", ["k"]), "WITH o AS (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) SELECT k AS out_k, c_custkey AS c_c_custkey FROM o JOIN customer ON c_nationkey = k"),
        "stored_single_row": Entry(stored_single_row, f"{orders} WHERE o_custkey = 7"),
        "stored_all_rows": Entry(stored_all_rows, orders),
        "stored_graph": Entry(stored_graph, "SELECT 'aggregate' AS kind, CAST(1 AS BIGINT) AS pointers, CAST(2 AS BIGINT) AS sources"),
        "lineage_view": Entry(lineage_view, f"SELECT r_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total {nations} GROUP BY r_regionkey"),
        "lineage_csv": Entry(lineage_csv, f"SELECT r_regionkey AS out_r_regionkey, n_nationkey AS n_n_nationkey {nations}"),
        "lineage_table": Entry(lineage_table, orders),
        "generated_series": Entry(generated_series, "SELECT i % 97 + i AS column_1, i % 97 + i AS column_2, i % 97 + i AS column_3 FROM range(1000) AS t(i)"),
        "generated_zipf": Entry(generated_zipf, None),
        "chain_lineage": Entry(chain_lineage, "SELECT i AS out_idx_2, i % 100 % 10 AS a_idx_0 FROM range(1000) AS t(i)"),
        "chain_group_lineage": Entry(chain_group_lineage, "SELECT i % 100 % 10 AS out_idx_0, i AS c_idx_2 FROM range(1000) AS t(i)"),
        "column_stats": Entry(column_stats, "SELECT 'pointer' AS part, CAST(min(o_custkey) AS BIGINT) AS low, CAST(max(o_custkey) AS BIGINT) AS high FROM orders UNION ALL SELECT 'id', CAST(min(o_orderkey) AS BIGINT), CAST(max(o_orderkey) AS BIGINT) FROM orders"),
        "sketch_bits": Entry(sketch_bits, f"SELECT count(*) AS n FROM ({sketch_large_sql})"),
        "sketch_equality": Entry(sketch_equality, "SELECT true AS same, false AS other"),
    }
