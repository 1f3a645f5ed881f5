"""One small query per provenance rule: the plan, what is traced, and the DuckDB text that joins back to the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polynomials, sketches, statistics
from ..operators import backtrace, capture, lineage, replay
from ..sources.tables import KEYS, read
from .nodes import Plan, scan


class Tables:
    """Accesses of the tables of one folder: ``t("orders", "o")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, access: str, prefix: str = "", keys=None) -> Plan:
        return scan(access, read(self.spark, self.sf_dir, name), keys or KEYS[name], prefix)

    def df(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Entry:
    run: object
    sql: str | None


def traced(plan, access: str, outputs=(), **options) -> object:
    """A query: the lineage bag of ``access`` with the given output columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return backtrace(capture(plan(Tables(spark, sf_dir))), access, list(outputs), **options)

    return run


def replayed(plan) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return replay(plan(Tables(spark, sf_dir)))

    return run


def L(alias: str = "", access: str = "l") -> str:
    """The identifying columns of lineitem in a select list."""
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{dot}{k} AS {access}_{k}" for k in KEYS["lineitem"])


# --- plans ---------------------------------------------------------------------


def urgent(t):
    return t("orders", "o").filter("o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus <> 'P'").project("o_orderkey", half="o_totalprice / 2")


def join2(t):
    return t("nation", "n").join(t("region", "r"), "n_regionkey = r_regionkey").filter("r_name LIKE 'A%' AND r_name NOT LIKE '%CA'")


def join3(t):
    return t("customer", "c").join(t("nation", "n"), "c_nationkey = n_nationkey").join(t("region", "r"), "n_regionkey = r_regionkey").filter("r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")


def join4(t):
    return t("orders", "o").join(t("customer", "c"), "o_custkey = c_custkey").join(t("nation", "n"), "c_nationkey = n_nationkey").join(t("region", "r"), "n_regionkey = r_regionkey").filter("r_name = 'EUROPE' AND o_orderstatus = 'P'")


def selfjoin(t):
    return t("nation", "n1", "a_").join(t("nation", "n2", "b_"), "a_n_regionkey = b_n_regionkey AND a_n_nationkey < b_n_nationkey")


def theta(t):
    return t("nation", "n").join(t("region", "r"), "n_regionkey < r_regionkey")


def left_outer(t):
    return t("orders", "o").join(t("lineitem", "l").filter("l_quantity > 45"), "o_orderkey = l_orderkey", "left")


def full_outer(t):
    return t("customer", "c").filter("c_acctbal > 3000").join(t("supplier", "s").filter("s_acctbal > 1000"), "c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'", "full")


def right_outer(t):
    return t("supplier", "s").filter("s_acctbal > 5000").join(t("nation", "n"), "s_nationkey = n_nationkey", "right")


def exists(t):
    return t("orders", "o").filter("o_orderpriority = '2-HIGH'").exists(t("lineitem", "l"), [("o_orderkey", "l_orderkey")], "l_shipdate > o_orderdate + INTERVAL 110 DAY")


def anti(t):
    return t("customer", "c").not_exists(t("orders", "o").filter("o_totalprice > 150000"), [("c_custkey", "o_custkey")])


def not_in(t):
    return t("nation", "n").not_in("n_nationkey", t("supplier", "s").filter("s_acctbal < 0"), "s_nationkey")


def in_(t):
    big = t("lineitem", "l").group(["l_orderkey"], having="sum_qty > 250", sum_qty="sum(l_quantity)")
    return t("orders", "o").is_in("o_orderkey", big, "l_orderkey")


def nested_in(t):
    nations = t("nation", "n").is_in("n_regionkey", t("region", "r").filter("r_name IN ('ASIA', 'EUROPE')"), "r_regionkey")
    return t("supplier", "s").filter("s_acctbal > 2000").is_in("s_nationkey", nations, "n_nationkey")


def corr_scalar(t):
    inner = t("lineitem", "l2", "i_")
    return t("lineitem", "l").scalar(inner, [("l_partkey", "i_l_partkey")], small="0.3 * avg(i_l_quantity)").filter("l_quantity < small AND l_returnflag = 'R'")


def uncorr_scalar(t):
    return t("customer", "c").scalar(t("customer", "c2", "i_").filter("i_c_acctbal > 0"), (), mean="avg(i_c_acctbal)").filter("c_acctbal > mean AND c_mktsegment = 'MACHINERY'")


def nested_scalar(t):
    sums = t("orders", "o2", "i_").group(["i_o_custkey"], total="sum(i_o_totalprice)")
    return t("orders", "o").group(["o_custkey"], total_o="sum(o_totalprice)").scalar(sums, (), top="max(total)").filter("total_o >= 0.8 * top")


def having_scalar(t):
    sums = t("supplier", "s").group(["s_nationkey"], total="sum(s_acctbal)")
    return sums.scalar(t("supplier", "s2", "i_"), (), cut="sum(i_s_acctbal) * 0.05").filter("total > cut")


def sublink_or(t):
    marked = t("orders", "o").mark("shipped", t("lineitem", "l").filter("l_quantity = 50"), [("o_orderkey", "l_orderkey")])
    return marked.filter("shipped OR o_totalprice > 195000")


def view(t, k):
    return t("lineitem", f"l{k}", f"v{k}_").group([f"v{k}_l_suppkey"], **{f"revenue{k}": f"round(sum(v{k}_l_extendedprice), 2)"})


def view_twice(t):
    return view(t, 1).scalar(view(t, 2), (), top="max(revenue2)").filter("revenue1 >= 0.98 * top")


def grouped(agg: str, t):
    return t("lineitem", "l").filter("l_linestatus = 'O' AND l_quantity > 48").group(["l_returnflag"], value=agg)


def nested_agg(t):
    per = t("customer", "c").join(t("orders", "o").filter("o_orderpriority <> '1-URGENT'"), "c_custkey = o_custkey", "left").group(["c_custkey"], orders="count(o_orderkey)")
    return per.group(["orders"], customers="count(1)").filter("customers < 60")


def pure_agg(t):
    return t("lineitem", "l").filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 4").group((), revenue="round(sum(l_extendedprice * l_discount), 2)")


def having(t):
    return t("orders", "o").group(["o_custkey"], having="n >= 18", n="count(1)")


def distinct(t):
    return t("supplier", "s").filter("s_acctbal > 4000").project(nation="s_nationkey").distinct()


def window(frame, order, t, partition=("user_id",)):
    return t("events", "e").filter("event_type = 'purchase'").window(partition, order, frame, total="sum(value)")


def topk(t):
    return t("customer", "c").join(t("orders", "o"), "c_custkey = o_custkey").group(["c_custkey"], total="round(sum(o_totalprice), 2)").sort("total desc", "c_custkey").limit(10)


def union_all(t):
    a = t("customer", "c").filter("c_acctbal > 9000").project(nation="c_nationkey", kind="'c'")
    b = t("supplier", "s").filter("s_acctbal > 5000").project(nation="s_nationkey", kind="'s'")
    return a.union_all(b)


def union(t):
    a = t("customer", "c").filter("c_acctbal > 9000").project(nation="c_nationkey")
    return a.union(t("supplier", "s").filter("s_acctbal > 5000").project(nation="s_nationkey"))


def intersect(t):
    return t("customer", "c").filter("c_acctbal > 9000").project(nation="c_nationkey").intersect(t("supplier", "s").filter("s_acctbal > 5000").project(nation="s_nationkey"))


def except_(t):
    return t("customer", "c").filter("c_acctbal > 5000").project(nation="c_nationkey").except_(t("supplier", "s").filter("s_acctbal > 5000").project(nation="s_nationkey"))


def except_all(t):
    return t("customer", "c").filter("c_acctbal > 9000").project(nation="c_nationkey").except_(t("supplier", "s").project(nation="s_nationkey"), all=True)


# --- queries ---------------------------------------------------------------------

_HAVING_SQL = "SELECT o_custkey AS out_o_custkey, o_orderkey AS o_o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 18)"
_TOPK = "SELECT c_custkey, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY total DESC, c_custkey"
_UNION = "(SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"
_FRAME = "SELECT a.event_id AS out_event_id, b.event_id AS e_event_id FROM ({rows}) a JOIN ({rows}) b ON a.user_id = b.user_id AND {test}"
_ROWS = "SELECT *, {place} AS k FROM events WHERE event_type = 'purchase'"


def _frame(place: str, test: str) -> str:
    return _FRAME.format(rows=_ROWS.format(place=place), test=test)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}

    def add(name, run, sql):
        out[name] = Entry(run, sql)

    add("scan_lineage", traced(lambda t: t("nation", "n"), "n", ["n_name"]), "SELECT n_name AS out_n_name, n_nationkey AS n_n_nationkey FROM nation")
    # the views that the driver registers hide row numbers, so this text names the file of the scale it compares at
    add("scan_rowid", scan_rowid, "SELECT l_orderkey AS out_l_orderkey, l_linenumber AS out_l_linenumber, file_row_number AS l_row FROM read_parquet('/root/testdata/sf0.01/lineitem.parquet', file_row_number = true) WHERE l_quantity = 50 AND l_returnflag = 'R'")
    add("filter_lineage", traced(urgent, "o", ["o_orderkey"]), "SELECT o_orderkey AS out_o_orderkey, o_orderkey AS o_o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus <> 'P'")
    add("join2_lineage", traced(join2, "r", ["n_nationkey"]), "SELECT n_nationkey AS out_n_nationkey, r_regionkey AS r_r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' AND r_name NOT LIKE '%CA'")
    add("join3_lineage", traced(join3, "n", ["c_custkey"]), "SELECT c_custkey AS out_c_custkey, n_nationkey AS n_n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")
    add("join4_lineage", traced(join4, "c", ["o_orderkey"]), "SELECT o_orderkey AS out_o_orderkey, c_custkey AS c_c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND o_orderstatus = 'P'")
    pairs = "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
    add("selfjoin_lineage_first", traced(selfjoin, "n1", ["a_n_name", "b_n_name"]), f"SELECT a.n_name AS out_a_n_name, b.n_name AS out_b_n_name, a.n_nationkey AS n1_n_nationkey {pairs}")
    add("selfjoin_lineage_second", traced(selfjoin, "n2", ["a_n_name", "b_n_name"]), f"SELECT a.n_name AS out_a_n_name, b.n_name AS out_b_n_name, b.n_nationkey AS n2_n_nationkey {pairs}")
    add("theta_join_lineage", traced(theta, "r", ["n_nationkey"]), "SELECT n_nationkey AS out_n_nationkey, r_regionkey AS r_r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
    add("left_outer_lineage", traced(left_outer, "l", ["o_orderkey"]), f"SELECT o_orderkey AS out_o_orderkey, {L()} FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
    add("right_outer_lineage", traced(right_outer, "s", ["n_nationkey"]), "SELECT n_nationkey AS out_n_nationkey, s_suppkey AS s_s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
    add("full_outer_lineage", traced(full_outer, "s", ["c_custkey"]), "SELECT c_custkey AS out_c_custkey, s_suppkey AS s_s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 1000) ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'")
    witness = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 110 DAY WHERE o_orderpriority = '2-HIGH'"
    add("exists_lineage_inner", traced(exists, "l", ["o_orderkey"]), f"SELECT o_orderkey AS out_o_orderkey, {L()} {witness}")
    add("exists_lineage_outer", traced(exists, "o", ["o_orderkey"]), f"SELECT DISTINCT o_orderkey AS out_o_orderkey, o_orderkey AS o_o_orderkey {witness}")
    add("anti_lineage", traced(anti, "c", ["c_custkey"]), "SELECT c_custkey AS out_c_custkey, c_custkey AS c_c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
    add("not_in_lineage", traced(not_in, "n", ["n_name"]), "SELECT n_name AS out_n_name, n_nationkey AS n_n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
    add("in_lineage", traced(in_, "l", ["o_orderkey"]), f"SELECT o_orderkey AS out_o_orderkey, {L()} FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)")
    nested = "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 2000 AND r_name IN ('ASIA', 'EUROPE')"
    add("nested_in_lineage_middle", traced(nested_in, "n", ["s_suppkey"]), f"SELECT s_suppkey AS out_s_suppkey, n_nationkey AS n_n_nationkey {nested}")
    add("nested_in_lineage_inner", traced(nested_in, "r", ["s_suppkey"]), f"SELECT s_suppkey AS out_s_suppkey, r_regionkey AS r_r_regionkey {nested}")
    small = "FROM lineitem o JOIN (SELECT l_partkey AS k, 0.3 * avg(l_quantity) AS small FROM lineitem GROUP BY l_partkey) ON o.l_partkey = k"
    add("corr_scalar_lineage", traced(corr_scalar, "l2", ["l_orderkey", "l_linenumber"]), f"SELECT o.l_orderkey AS out_l_orderkey, o.l_linenumber AS out_l_linenumber, {L('i', 'l2')} {small} JOIN lineitem i ON i.l_partkey = o.l_partkey WHERE o.l_quantity < small AND o.l_returnflag = 'R'")
    cut = "(SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)"
    rich = f"FROM customer o WHERE o.c_acctbal > {cut} AND o.c_mktsegment = 'MACHINERY'"
    add("uncorr_scalar_lineage", traced(uncorr_scalar, "c2"), f"SELECT c_custkey AS c2_c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 {rich})")
    add("uncorr_scalar_lineage_attached_all", traced(uncorr_scalar, "c2", ["c_custkey"], factored=False), f"SELECT o.c_custkey AS out_c_custkey, i.c_custkey AS c2_c_custkey FROM (SELECT * {rich}) o JOIN customer i ON i.c_acctbal > 0")
    add("nested_scalar_lineage", traced(nested_scalar, "o2"), "SELECT o_orderkey AS o2_o_orderkey FROM orders")
    add("nested_scalar_lineage_outer", traced(nested_scalar, "o", ["o_custkey"]), "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o.o_custkey AS out_o_custkey, o_orderkey AS o_o_orderkey FROM orders o JOIN s ON o.o_custkey = s.o_custkey WHERE t >= 0.8 * (SELECT max(t) FROM s)")
    add("having_scalar_lineage", traced(having_scalar, "s", ["s_nationkey"]), "SELECT s_nationkey AS out_s_nationkey, s_suppkey AS s_s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING sum(s_acctbal) > (SELECT sum(s_acctbal) * 0.05 FROM supplier))")
    add("sublink_or_lineage", traced(sublink_or, "l", ["o_orderkey"]), f"SELECT o_orderkey AS out_o_orderkey, {L()} FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50")
    views = "WITH v AS (SELECT l_suppkey AS k, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_suppkey)"
    add("view_twice_lineage_outer", traced(view_twice, "l1", ["v1_l_suppkey"]), f"{views} SELECT k AS out_v1_l_suppkey, {L('', 'l1')} FROM lineitem JOIN v ON l_suppkey = k WHERE revenue >= 0.98 * (SELECT max(revenue) FROM v)")
    add("view_twice_lineage_inner", traced(view_twice, "l2"), f"SELECT {L('', 'l2')} FROM lineitem")
    for name, agg in {"sum": "sum(l_quantity)", "avg": "avg(l_tax)", "count": "count(1)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)"}.items():
        add(f"group_{name}_lineage", traced(partial(grouped, agg), "l", ["l_returnflag"]), f"SELECT l_returnflag AS out_l_returnflag, {L()} FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48")
    add("count_distinct_lineage", traced(partial(grouped, "count(DISTINCT l_suppkey)"), "l", ["l_returnflag", "value"]), f"SELECT l_returnflag AS out_l_returnflag, value AS out_value, {L()} FROM (SELECT *, l_returnflag AS k FROM lineitem) JOIN (SELECT l_returnflag AS k2, count(DISTINCT l_suppkey) AS value FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48 GROUP BY 1) ON k = k2 WHERE l_linestatus = 'O' AND l_quantity > 48")
    per = "WITH p AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON c_custkey = o_custkey GROUP BY c_custkey), q AS (SELECT n FROM p GROUP BY n HAVING count(*) < 60)"
    add("nested_agg_lineage", traced(nested_agg, "o", ["orders"]), f"{per} SELECT p.n AS out_orders, o_orderkey AS o_o_orderkey FROM q JOIN p ON q.n = p.n LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON p.c_custkey = o_custkey")
    add("nested_agg_lineage_customer", traced(nested_agg, "c", ["orders"]), f"{per} SELECT p.n AS out_orders, p.c_custkey AS c_c_custkey FROM q JOIN p ON q.n = p.n LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON p.c_custkey = o_custkey")
    add("pure_agg_lineage", traced(pure_agg, "l"), f"SELECT {L()} FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 4")
    add("having_lineage", traced(having, "o", ["o_custkey"]), _HAVING_SQL)
    add("distinct_lineage", traced(distinct, "s", ["nation"]), "SELECT s_nationkey AS out_nation, s_suppkey AS s_s_suppkey FROM supplier WHERE s_acctbal > 4000")
    by_time = ["ts", "event_id"]
    numbered = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    add("window_partition_lineage", traced(partial(window, None, ()), "e", ["event_id"]), _frame("0", "true"))
    add("window_rows_lineage", traced(partial(window, ("rows", -2, 1), by_time), "e", ["event_id"]), _frame(numbered, "b.k BETWEEN a.k - 2 AND a.k + 1"))
    add("window_growing_lineage", traced(partial(window, ("rows", None, 0), by_time), "e", ["event_id"]), _frame(numbered, "b.k <= a.k"))
    add("window_groups_lineage", traced(partial(window, ("groups", -1, 0), ["CAST(value / 10 AS INT)"]), "e", ["event_id"]), _frame("dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(trunc(value / 10) AS INT))", "b.k BETWEEN a.k - 1 AND a.k"))
    add("window_range_lineage", traced(partial(window, ("range", -20, 5), ["CAST(value AS INT)"]), "e", ["event_id"]), _frame("CAST(trunc(value) AS INT)", "b.k BETWEEN a.k - 20 AND a.k + 5"))
    add("topk_lineage", traced(topk, "o", ["c_custkey"]), f"SELECT o_custkey AS out_c_custkey, o_orderkey AS o_o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({_TOPK} LIMIT 10))")
    add("single_row_lineage", traced(topk, "o", ["c_custkey"], offset=3), f"SELECT o_custkey AS out_c_custkey, o_orderkey AS o_o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({_TOPK} LIMIT 1 OFFSET 3))")
    add("single_key_lineage", traced(having, "o", ["o_custkey"], where="n >= 22"), f"{_HAVING_SQL} AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 22)")
    add("union_all_lineage_left", traced(union_all, "c", ["nation", "kind"]), "SELECT c_nationkey AS out_nation, 'c' AS out_kind, c_custkey AS c_c_custkey FROM customer WHERE c_acctbal > 9000")
    add("union_all_lineage_right", traced(union_all, "s", ["nation", "kind"]), "SELECT s_nationkey AS out_nation, 's' AS out_kind, s_suppkey AS s_s_suppkey FROM supplier WHERE s_acctbal > 5000")
    add("union_lineage", traced(union, "s", ["nation"]), f"SELECT nation AS out_nation, s_suppkey AS s_s_suppkey FROM {_UNION} JOIN supplier ON s_nationkey = nation WHERE s_acctbal > 5000")
    both = "(SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"
    add("intersect_lineage_left", traced(intersect, "c", ["nation"]), f"SELECT nation AS out_nation, c_custkey AS c_c_custkey FROM {both} JOIN customer ON c_nationkey = nation WHERE c_acctbal > 9000")
    add("intersect_lineage_right", traced(intersect, "s", ["nation"]), f"SELECT nation AS out_nation, s_suppkey AS s_s_suppkey FROM {both} JOIN supplier ON s_nationkey = nation WHERE s_acctbal > 5000")
    add("except_lineage", traced(except_, "c", ["nation"]), "SELECT nation AS out_nation, c_custkey AS c_c_custkey FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) JOIN customer ON c_nationkey = nation WHERE c_acctbal > 5000")
    add("except_all_lineage", traced(except_all, "c", ["nation"]), "SELECT nation AS out_nation, c_custkey AS c_c_custkey FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 EXCEPT ALL SELECT s_nationkey FROM supplier) JOIN customer ON c_nationkey = nation WHERE c_acctbal > 9000")
    add("poly_join", poly_join, "SELECT c_custkey AS out_c_custkey, concat_ws(' ⊗ ', c_custkey, n_nationkey, r_regionkey) AS polynomial FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")
    terms = "SELECT r_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 1000"
    add("poly_unfactored", poly_unfactored, f"SELECT r_regionkey AS out_r_regionkey, string_agg('(' || concat_ws(' ⊗ ', r_regionkey, n_nationkey, s_suppkey) || ')', ' ⊕ ' ORDER BY r_regionkey, n_nationkey, s_suppkey) AS polynomial FROM ({terms}) GROUP BY 1")
    add("poly_factored", poly_factored, "WITH a AS (SELECT DISTINCT n_regionkey AS g, n_nationkey AS i FROM nation), b AS (SELECT DISTINCT n_regionkey AS g, s_suppkey AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT x.g AS out_region, x.p || ' ⊗ ' || y.p AS polynomial FROM (SELECT g, '(' || string_agg(CAST(i AS VARCHAR), ' ⊕ ' ORDER BY i) || ')' AS p FROM a GROUP BY g) x JOIN (SELECT g, '(' || string_agg(CAST(i AS VARCHAR), ' ⊕ ' ORDER BY i) || ')' AS p FROM b GROUP BY g) y ON x.g = y.g")
    add("poly_counting", poly_counting, "SELECT r_regionkey AS out_r_regionkey, count(*) AS ways FROM (" + terms + ") GROUP BY 1")
    add("poly_which", poly_which, f"SELECT r_regionkey AS out_r_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ids FROM (SELECT DISTINCT r_regionkey, n_nationkey FROM ({terms})) GROUP BY 1")
    add("poly_formula", poly_formula, f"SELECT r_regionkey AS out_r_regionkey, 'δ(' || string_agg('(' || concat_ws(' ⊗ ', r_regionkey, n_nationkey, s_suppkey) || ')', ' ⊕ ' ORDER BY r_regionkey, n_nationkey, s_suppkey) || ')' AS polynomial FROM ({terms}) GROUP BY 1")
    width = "(SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)"
    at = "(SELECT count(*) FROM range(1, {n}) t(i) WHERE lo + (hi - lo) * i / {n} <= o_orderkey)"
    top = f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({_TOPK} LIMIT 10))"
    add("sketch_64", sketch_64, f"SELECT CAST(bit_or(CAST(1 AS UBIGINT) << CAST({at.format(n=63)} AS INTEGER)) AS BIGINT) AS sketch FROM ({top}), {width}")
    add("sketch_large", sketch_large, f"SELECT DISTINCT CAST({at.format(n=4000)} AS BIGINT) AS range FROM ({top}), {width}")
    add("layer_stats", layer_stats, "WITH a AS (SELECT c_custkey AS g, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON c_custkey = o_custkey GROUP BY 1), p AS (SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON c_custkey = o_custkey GROUP BY 1), b AS (SELECT orders AS g, count(*) AS n FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, min(n) AS min_group, max(n) AS max_group FROM a UNION ALL SELECT CAST(sum(n) AS BIGINT), count(*), min(n), max(n) FROM b")
    for name, plan, sql in (
        ("exists", exists, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 110 DAY)"),
        ("having", having, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 18"),
        ("topk", topk, f"{_TOPK} LIMIT 10"),
        ("union", union, f"SELECT nation FROM {_UNION}"),
    ):
        run = (lambda p: lambda spark, sf_dir: replay(p(Tables(spark, sf_dir))))(plan)
        out[f"{name}_replay"] = Entry((lambda r: lambda spark, sf_dir: r(spark, sf_dir).select("o_orderkey", "o_custkey"))(run) if name == "exists" else run, sql)
    return out


def scan_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key, identified by their place in their file."""
    plan = scan("l", read(spark, sf_dir, "lineitem")).filter("l_quantity = 50 AND l_returnflag = 'R'")
    found = backtrace(capture(plan), "l", ["l_orderkey", "l_linenumber"])
    return found.select("out_l_orderkey", "out_l_linenumber", "l_row")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    plan = t("supplier", "s").filter("s_acctbal > 1000").join(t("nation", "n"), "s_nationkey = n_nationkey").join(t("region", "r"), "n_regionkey = r_regionkey").group(["r_regionkey"], n="count(1)")
    captured = capture(plan)
    # one layer holds the ids of all three accesses side by side: that is the relation of the terms
    layer = captured.sources[0].layer
    ids = [s for s in layer.sources]
    return layer.df.select(F.col(layer.ptr[0]).alias("out_r_regionkey"), *[F.col(c).alias(f"{s.access}_{k}") for s in ids for k, c in zip(s.keys, s.cols, strict=True)])


_IDS = ["r_r_regionkey", "n_n_nationkey", "s_s_suppkey"]


def poly_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = capture(join3(Tables(spark, sf_dir)))
    rows = captured.df.select(F.col("c_custkey").alias("out_c_custkey"), *[F.col(c) for s in captured.sources for c in s.cols])
    return polynomials.join_polynomial(rows, ["out_c_custkey"], [c for s in captured.sources for c in s.cols])


def poly_unfactored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polynomials.unfactored(_terms(spark, sf_dir), ["out_r_regionkey"], _IDS)


def poly_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polynomials.formula(_terms(spark, sf_dir), ["out_r_regionkey"], _IDS)


def poly_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polynomials.counting(_terms(spark, sf_dir), ["out_r_regionkey"])


def poly_which(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polynomials.which(_terms(spark, sf_dir), ["out_r_regionkey"], "n_n_nationkey")


def poly_factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that nations and suppliers share: each input is made distinct first, so each factor is summed alone."""
    t = Tables(spark, sf_dir)
    nations = t("nation", "n").project(region="n_regionkey").distinct()
    suppliers = t("supplier", "s").join(t("nation", "n2", "i_"), "s_nationkey = i_n_nationkey").project(other="i_n_regionkey").distinct()
    captured = capture(nations.join(suppliers, "region = other"))
    return polynomials.factored([(backtrace(captured, a, ["region"]), f"{a}_{k}") for a, k in (("n", "n_nationkey"), ("s", "s_suppkey"))], ["out_region"])


def _top_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    return lineage(capture(topk(t)), "o"), t.df("orders")


def sketch_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, orders = _top_orders(spark, sf_dir)
    return sketches.sketch64(found, "o_o_orderkey", sketches.equal_width(orders, "o_orderkey", 63))


def sketch_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, orders = _top_orders(spark, sf_dir)
    return sketches.ranges_touched(found, "o_o_orderkey", sketches.equal_width(orders, "o_orderkey", 4000))


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = capture(nested_agg(Tables(spark, sf_dir)))
    return statistics.layer_statistics(captured).select("n_rows", "n_groups", "min_group", "max_group")
