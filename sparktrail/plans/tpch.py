"""The 22 decision-support queries, adapted to the tables at hand: plan, traced accesses, DuckDB text of lineage and result."""

from __future__ import annotations

from .micro import Entry, L, Tables, replayed, traced

REV = "l_extendedprice * (1 - l_discount)"


def q1(t):
    return t("lineitem", "l").filter("l_shipdate <= DATE '1998-09-02'").group(
        ["l_returnflag", "l_linestatus"], sum_qty="sum(l_quantity)", sum_price=f"round(sum({REV}), 2)", avg_disc="round(avg(l_discount), 6)", n="count(1)"
    ).sort("l_returnflag", "l_linestatus")


def q2(t):
    small = t("part", "p").filter("p_size = 15 AND p_type = 'PROMO'").join(t("lineitem", "l"), "p_partkey = l_partkey").join(t("supplier", "s"), "l_suppkey = s_suppkey")
    cheapest = small.scalar(t("lineitem", "l2", "i_"), [("p_partkey", "i_l_partkey")], cheapest="min(i_l_extendedprice)")
    return cheapest.filter("l_extendedprice = cheapest").project("s_name", "p_partkey", "l_orderkey").sort("s_name", "p_partkey", "l_orderkey").limit(100)


def q3(t):
    joined = t("customer", "c").filter("c_mktsegment = 'BUILDING'").join(t("orders", "o").filter("o_orderdate < DATE '1998-03-15'"), "c_custkey = o_custkey")
    joined = joined.join(t("lineitem", "l").filter("l_shipdate > DATE '1998-03-15'"), "o_orderkey = l_orderkey")
    return joined.group(["l_orderkey", "o_custkey"], revenue=f"round(sum({REV}), 2)").sort("revenue desc", "l_orderkey").limit(10)


def q4(t):
    orders = t("orders", "o").filter("o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'")
    return orders.exists(t("lineitem", "l").filter("l_returnflag = 'R'"), [("o_orderkey", "l_orderkey")]).group(["o_orderpriority"], n="count(1)").sort("o_orderpriority")


def q5(t):
    joined = t("customer", "c").join(t("orders", "o").filter("o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"), "c_custkey = o_custkey")
    joined = joined.join(t("lineitem", "l"), "o_orderkey = l_orderkey").join(t("supplier", "s"), "l_suppkey = s_suppkey AND c_nationkey = s_nationkey")
    joined = joined.join(t("nation", "n"), "s_nationkey = n_nationkey").join(t("region", "r").filter("r_name = 'ASIA'"), "n_regionkey = r_regionkey")
    return joined.group(["n_name"], revenue=f"round(sum({REV}), 2)").sort("revenue desc", "n_name")


def q6(t):
    return t("lineitem", "l").filter("l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").group((), revenue="round(sum(l_extendedprice * l_discount), 2)")


def q7(t):
    joined = t("supplier", "s").join(t("lineitem", "l"), "s_suppkey = l_suppkey").join(t("orders", "o"), "o_orderkey = l_orderkey").join(t("customer", "c"), "c_custkey = o_custkey")
    joined = joined.join(t("nation", "n1", "a_"), "s_nationkey = a_n_nationkey").join(t("nation", "n2", "b_"), "c_nationkey = b_n_nationkey")
    pair = "((a_n_name = 'NATION_1' AND b_n_name = 'NATION_2') OR (a_n_name = 'NATION_2' AND b_n_name = 'NATION_1'))"
    return joined.filter(pair).group({"supp_nation": "a_n_name", "cust_nation": "b_n_name", "l_year": "year(l_shipdate)"}, revenue=f"round(sum({REV}), 2)").sort("supp_nation", "cust_nation", "l_year")


def q8(t):
    joined = t("part", "p").filter("p_type = 'ECONOMY'").join(t("lineitem", "l"), "p_partkey = l_partkey").join(t("supplier", "s"), "s_suppkey = l_suppkey").join(t("orders", "o").filter("o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"), "l_orderkey = o_orderkey")
    joined = joined.join(t("customer", "c"), "o_custkey = c_custkey").join(t("nation", "n1", "a_"), "c_nationkey = a_n_nationkey").join(t("region", "r").filter("r_name = 'AMERICA'"), "a_n_regionkey = r_regionkey").join(t("nation", "n2", "b_"), "s_nationkey = b_n_nationkey")
    return joined.group({"o_year": "year(o_orderdate)"}, share=f"round(sum(CASE WHEN b_n_name = 'NATION_3' THEN {REV} ELSE 0 END) / sum({REV}), 6)").sort("o_year")


def q9(t):
    joined = t("part", "p").filter("p_name LIKE '%anvil%'").join(t("lineitem", "l"), "p_partkey = l_partkey").join(t("supplier", "s"), "s_suppkey = l_suppkey").join(t("orders", "o"), "o_orderkey = l_orderkey").join(t("nation", "n"), "s_nationkey = n_nationkey")
    derived = joined.project(nation="n_name", o_year="year(o_orderdate)", amount=f"{REV} - 0.1 * l_quantity")
    return derived.group(["nation", "o_year"], profit="round(sum(amount), 2)").sort("nation", "o_year desc")


def q10(t):
    joined = t("customer", "c").join(t("orders", "o").filter("o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'"), "c_custkey = o_custkey").join(t("lineitem", "l").filter("l_returnflag = 'R'"), "l_orderkey = o_orderkey").join(t("nation", "n"), "c_nationkey = n_nationkey")
    return joined.group(["c_custkey", "c_name", "c_acctbal", "n_name"], revenue=f"round(sum({REV}), 2)").sort("revenue desc", "c_custkey").limit(20)


def _stock(t, k, prefix=""):
    return t("lineitem", f"l{k}", prefix).join(t("supplier", f"s{k}", prefix), f"{prefix}l_suppkey = {prefix}s_suppkey").join(t("nation", f"n{k}", prefix).filter(f"{prefix}n_name IN ('NATION_3', 'NATION_4')"), f"{prefix}s_nationkey = {prefix}n_nationkey")


def q11(t):
    per = _stock(t, 1).group(["l_partkey"], value="round(sum(l_extendedprice), 2)")
    return per.scalar(_stock(t, 2, "i_"), (), cut="round(sum(i_l_extendedprice), 2) * 0.0015").filter("value > cut").project("l_partkey", "value").sort("value desc", "l_partkey")


def q12(t):
    joined = t("orders", "o").join(t("lineitem", "l").filter("l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'"), "o_orderkey = l_orderkey")
    high = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
    return joined.group(["l_returnflag"], high=f"sum(CASE WHEN {high} THEN 1 ELSE 0 END)", low=f"sum(CASE WHEN {high} THEN 0 ELSE 1 END)").sort("l_returnflag")


def q13(t):
    per = t("customer", "c").join(t("orders", "o").filter("o_orderpriority LIKE '%URGENT'"), "c_custkey = o_custkey", "left").group(["c_custkey"], c_count="count(o_orderkey)")
    return per.group(["c_count"], custdist="count(1)").sort("custdist desc", "c_count desc")


def q14(t):
    joined = t("lineitem", "l").filter("l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'").join(t("part", "p"), "l_partkey = p_partkey")
    return joined.group((), promo=f"round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN {REV} ELSE 0 END) / sum({REV}), 6)")


def _revenue(t, k):
    return t("lineitem", f"l{k}", f"v{k}_").filter(f"v{k}_l_shipdate >= DATE '1996-01-01' AND v{k}_l_shipdate < DATE '1996-04-01'").group({f"supplier{k}": f"v{k}_l_suppkey"}, **{f"total{k}": f"round(sum(v{k}_l_extendedprice * (1 - v{k}_l_discount)), 2)"})


def q15(t):
    joined = t("supplier", "s").join(_revenue(t, 1), "s_suppkey = supplier1")
    return joined.scalar(_revenue(t, 2), (), top="max(total2)").filter("total1 = top").project("s_suppkey", "s_name", "total1").sort("s_suppkey")


def q16(t):
    joined = t("lineitem", "l").join(t("part", "p").filter("p_brand <> 'Brand#5' AND p_type NOT LIKE 'MED%' AND p_size IN (9, 19, 45)"), "l_partkey = p_partkey")
    kept = joined.not_in("l_suppkey", t("supplier", "s").filter("s_acctbal < 0"), "s_suppkey")
    return kept.group(["p_brand", "p_type", "p_size"], supplier_cnt="count(DISTINCT l_suppkey)").sort("supplier_cnt desc", "p_brand", "p_type", "p_size")


def q17(t):
    joined = t("lineitem", "l").join(t("part", "p").filter("p_brand = 'Brand#3' AND p_size < 20"), "p_partkey = l_partkey")
    kept = joined.scalar(t("lineitem", "l2", "i_"), [("p_partkey", "i_l_partkey")], small="0.4 * avg(i_l_quantity)").filter("l_quantity < small")
    return kept.group((), yearly="round(sum(l_extendedprice) / 7.0, 2)")


def q18(t):
    big = t("lineitem", "l2", "i_").group(["i_l_orderkey"], having="q > 250", q="sum(i_l_quantity)")
    joined = t("customer", "c").join(t("orders", "o").is_in("o_orderkey", big, "i_l_orderkey"), "c_custkey = o_custkey").join(t("lineitem", "l"), "o_orderkey = l_orderkey")
    return joined.group(["c_custkey", "o_orderkey", "o_totalprice"], q="sum(l_quantity)").sort("o_totalprice desc", "o_orderkey").limit(100)


def q19(t):
    joined = t("lineitem", "l").join(t("part", "p"), "p_partkey = l_partkey")
    test = " OR ".join(f"(p_brand = 'Brand#{b}' AND p_size BETWEEN 1 AND {s} AND l_quantity BETWEEN {q} AND {q + 10})" for b, s, q in ((1, 15, 1), (2, 25, 10), (3, 35, 20)))
    return joined.filter(test).group((), revenue=f"round(sum({REV}), 2)")


def q20(t):
    parts = t("part", "p").filter("p_name LIKE 'blue%'")
    usual = t("lineitem", "l").filter("l_quantity > 30").is_in("l_partkey", parts, "p_partkey")
    much = usual.scalar(t("lineitem", "l2", "i_").filter("i_l_shipdate >= DATE '1996-01-01'"), [("l_partkey", "i_l_partkey"), ("l_suppkey", "i_l_suppkey")], half="0.9 * sum(i_l_quantity)").filter("l_quantity > half")
    return t("supplier", "s").is_in("s_suppkey", much, "l_suppkey").join(t("nation", "n").filter("n_regionkey = 1"), "s_nationkey = n_nationkey").project("s_suppkey", "s_name").sort("s_suppkey")


def q21(t):
    late = t("supplier", "s").join(t("lineitem", "l").filter("l_returnflag = 'R'"), "s_suppkey = l_suppkey").join(t("orders", "o").filter("o_orderstatus = 'F'"), "o_orderkey = l_orderkey").join(t("nation", "n").filter("n_regionkey = 2"), "s_nationkey = n_nationkey")
    others = late.exists(t("lineitem", "l2", "i_"), [("l_orderkey", "i_l_orderkey")], "i_l_suppkey <> l_suppkey")
    alone = others.not_exists(t("lineitem", "l3", "j_").filter("j_l_returnflag = 'R'"), [("l_orderkey", "j_l_orderkey")], "j_l_suppkey <> l_suppkey")
    return alone.group(["s_name"], numwait="count(1)").sort("numwait desc", "s_name").limit(100)


def q22(t):
    kept = t("customer", "c").filter("c_nationkey IN (1, 3, 5, 7, 9, 11, 13)").scalar(t("customer", "c2", "i_").filter("i_c_acctbal > 0"), (), mean="avg(i_c_acctbal)").filter("c_acctbal > mean")
    kept = kept.not_exists(t("orders", "o").filter("o_totalprice > 180000"), [("c_custkey", "o_custkey")])
    return kept.group(["c_nationkey"], numcust="count(1)", total="round(sum(c_acctbal), 2)").sort("c_nationkey")


# --- the same in DuckDB: result, and lineage by joining back -------------------------

_Q3 = "FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'"
_Q3R = f"SELECT l_orderkey, o_custkey, round(sum({REV}), 2) AS revenue {_Q3} GROUP BY 1, 2 ORDER BY revenue DESC, l_orderkey LIMIT 10"
_Q2 = "FROM part JOIN lineitem l ON p_partkey = l.l_partkey JOIN supplier ON l.l_suppkey = s_suppkey WHERE p_size = 15 AND p_type = 'PROMO' AND l.l_extendedprice = (SELECT min(x.l_extendedprice) FROM lineitem x WHERE x.l_partkey = p_partkey)"
_Q2R = f"SELECT s_name, p_partkey, l.l_orderkey {_Q2} ORDER BY s_name, p_partkey, l.l_orderkey LIMIT 100"
_Q4 = "FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
_Q5 = "FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"
_Q6 = "FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
_Q7 = "FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1'))"
_Q8 = "FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
_Q9 = "FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%anvil%'"
_Q10 = "FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'"
_Q10R = f"SELECT c_custkey, c_name, c_acctbal, n_name, round(sum({REV}), 2) AS revenue {_Q10} GROUP BY 1, 2, 3, 4 ORDER BY revenue DESC, c_custkey LIMIT 20"
_Q11 = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_4')"
_Q11R = f"SELECT l_partkey, round(sum(l_extendedprice), 2) AS value {_Q11} GROUP BY 1 HAVING round(sum(l_extendedprice), 2) > (SELECT round(sum(l_extendedprice), 2) * 0.0015 {_Q11})"
_Q12 = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'"
_Q13 = "WITH p AS (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority LIKE '%URGENT') ON c_custkey = o_custkey GROUP BY 1)"
_Q14 = "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'"
_Q15V = f"WITH v AS (SELECT l_suppkey AS k, round(sum({REV}), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY 1)"
_Q16 = "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MED%' AND p_size IN (9, 19, 45) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"
_Q17 = "FROM lineitem l JOIN part ON p_partkey = l.l_partkey JOIN (SELECT l_partkey AS k, 0.4 * avg(l_quantity) AS small FROM lineitem GROUP BY 1) ON k = p_partkey WHERE p_brand = 'Brand#3' AND p_size < 20 AND l.l_quantity < small"
_Q18IN = "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250)"
_Q18R = f"SELECT c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN {_Q18IN} GROUP BY 1, 2, 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"
_Q19 = "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_brand = 'Brand#2' AND p_size BETWEEN 1 AND 25 AND l_quantity BETWEEN 10 AND 20) OR (p_brand = 'Brand#3' AND p_size BETWEEN 1 AND 35 AND l_quantity BETWEEN 20 AND 30)"
_Q20M = "WITH h AS (SELECT l_partkey AS hp, l_suppkey AS hs, 0.9 * sum(l_quantity) AS half FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY 1, 2), m AS (SELECT l.* FROM lineitem l JOIN h ON l_partkey = hp AND l_suppkey = hs WHERE l_quantity > 30 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND l_quantity > half), out AS (SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (SELECT l_suppkey FROM m))"
_Q21 = "FROM supplier JOIN lineitem l ON s_suppkey = l.l_suppkey JOIN orders ON o_orderkey = l.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE l.l_returnflag = 'R' AND o_orderstatus = 'F' AND n_regionkey = 2 AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = l.l_orderkey AND y.l_returnflag = 'R' AND y.l_suppkey <> l.l_suppkey)"
_Q21R = f"SELECT s_name, count(*) AS numwait {_Q21} GROUP BY 1 ORDER BY numwait DESC, s_name LIMIT 100"
_Q22 = "FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)"

#: query -> (plan, {suffix: (access, output columns, DuckDB text)}, DuckDB text of the result)
_SPECS = {
    "q1": (q1, {"lineitem": ("l", ["l_returnflag", "l_linestatus"], f"SELECT l_returnflag AS out_l_returnflag, l_linestatus AS out_l_linestatus, {L()} FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'")}, f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum({REV}), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2"),
    "q2": (q2, {
        "supplier": ("s", ["p_partkey", "l_orderkey"], f"SELECT p_partkey AS out_p_partkey, l_orderkey AS out_l_orderkey, s_suppkey AS s_s_suppkey FROM (SELECT s_name, p_partkey, l.l_orderkey, s_suppkey {_Q2} ORDER BY s_name, p_partkey, l.l_orderkey LIMIT 100)"),
        "sublink": ("l2", ["p_partkey", "l_orderkey"], f"SELECT p_partkey AS out_p_partkey, o.l_orderkey AS out_l_orderkey, {L('i', 'l2')} FROM ({_Q2R}) o JOIN lineitem i ON i.l_partkey = p_partkey"),
    }, _Q2R),
    "q3": (q3, {
        "lineitem": ("l", ["l_orderkey"], f"SELECT l.l_orderkey AS out_l_orderkey, {L('l')} FROM lineitem l JOIN ({_Q3R}) q ON l.l_orderkey = q.l_orderkey WHERE l_shipdate > DATE '1998-03-15'"),
        "customer": ("c", ["l_orderkey"], f"SELECT l.l_orderkey AS out_l_orderkey, q.o_custkey AS c_c_custkey FROM lineitem l JOIN ({_Q3R}) q ON l.l_orderkey = q.l_orderkey WHERE l_shipdate > DATE '1998-03-15'"),
    }, _Q3R),
    "q4": (q4, {
        "orders": ("o", ["o_orderpriority"], f"SELECT o_orderpriority AS out_o_orderpriority, o_orderkey AS o_o_orderkey {_Q4}"),
        "lineitem": ("l", ["o_orderpriority"], f"SELECT o_orderpriority AS out_o_orderpriority, {L()} FROM (SELECT * {_Q4}) JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"),
    }, f"SELECT o_orderpriority, count(*) AS n {_Q4} GROUP BY 1"),
    "q5": (q5, {"lineitem": ("l", ["n_name"], f"SELECT n_name AS out_n_name, {L()} {_Q5}"), "region": ("r", ["n_name"], f"SELECT n_name AS out_n_name, r_regionkey AS r_r_regionkey {_Q5}")}, f"SELECT n_name, round(sum({REV}), 2) AS revenue {_Q5} GROUP BY 1"),
    "q6": (q6, {"lineitem": ("l", [], f"SELECT {L()} {_Q6}")}, f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue {_Q6}"),
    "q7": (q7, {"nation1": ("n1", ["supp_nation", "l_year"], f"SELECT a.n_name AS out_supp_nation, CAST(year(l_shipdate) AS INTEGER) AS out_l_year, a.n_nationkey AS n1_n_nationkey {_Q7}"), "lineitem": ("l", ["supp_nation"], f"SELECT a.n_name AS out_supp_nation, {L()} {_Q7}")}, f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum({REV}), 2) AS revenue {_Q7} GROUP BY 1, 2, 3"),
    "q8": (q8, {"lineitem": ("l", ["o_year"], f"SELECT CAST(year(o_orderdate) AS INTEGER) AS out_o_year, {L()} {_Q8}"), "nation2": ("n2", ["o_year"], f"SELECT CAST(year(o_orderdate) AS INTEGER) AS out_o_year, b.n_nationkey AS n2_n_nationkey {_Q8}")}, f"SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(CASE WHEN b.n_name = 'NATION_3' THEN {REV} ELSE 0 END) / sum({REV}), 6) AS share {_Q8} GROUP BY 1"),
    "q9": (q9, {"part": ("p", ["nation", "o_year"], f"SELECT n_name AS out_nation, CAST(year(o_orderdate) AS INTEGER) AS out_o_year, p_partkey AS p_p_partkey {_Q9}")}, f"SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum({REV} - 0.1 * l_quantity), 2) AS profit {_Q9} GROUP BY 1, 2"),
    "q10": (q10, {"orders": ("o", ["c_custkey"], f"SELECT c_custkey AS out_c_custkey, o_orderkey AS o_o_orderkey {_Q10} AND c_custkey IN (SELECT c_custkey FROM ({_Q10R}))")}, _Q10R),
    "q11": (q11, {"lineitem": ("l1", ["l_partkey"], f"SELECT l_partkey AS out_l_partkey, {L('', 'l1')} {_Q11} AND l_partkey IN (SELECT l_partkey FROM ({_Q11R}))"), "sublink": ("s2", [], f"SELECT s_suppkey AS s2_s_suppkey {_Q11} AND EXISTS (SELECT 1 FROM ({_Q11R}))")}, _Q11R),
    "q12": (q12, {"orders": ("o", ["l_returnflag"], f"SELECT l_returnflag AS out_l_returnflag, o_orderkey AS o_o_orderkey {_Q12}")}, f"SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low {_Q12} GROUP BY 1"),
    "q13": (q13, {"orders": ("o", ["c_count"], f"{_Q13} SELECT c_count AS out_c_count, o_orderkey AS o_o_orderkey FROM p LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority LIKE '%URGENT') ON c_custkey = o_custkey")}, f"{_Q13} SELECT c_count, count(*) AS custdist FROM p GROUP BY 1"),
    "q14": (q14, {"part": ("p", [], f"SELECT p_partkey AS p_p_partkey {_Q14}")}, f"SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN {REV} ELSE 0 END) / sum({REV}), 6) AS promo {_Q14}"),
    "q15": (q15, {"supplier": ("s", ["s_suppkey"], f"{_Q15V} SELECT s_suppkey AS out_s_suppkey, s_suppkey AS s_s_suppkey FROM supplier JOIN v ON s_suppkey = k WHERE total = (SELECT max(total) FROM v)"), "view1": ("l1", ["s_suppkey"], f"{_Q15V} SELECT l_suppkey AS out_s_suppkey, {L('', 'l1')} FROM lineitem JOIN v ON l_suppkey = k WHERE total = (SELECT max(total) FROM v) AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'"), "view2": ("l2", [], f"SELECT {L('', 'l2')} FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'")}, f"{_Q15V} SELECT s_suppkey, s_name, total AS total1 FROM supplier JOIN v ON s_suppkey = k WHERE total = (SELECT max(total) FROM v)"),
    "q16": (q16, {"part": ("p", ["p_brand", "p_size"], f"SELECT p_brand AS out_p_brand, p_size AS out_p_size, p_partkey AS p_p_partkey {_Q16}")}, f"SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt {_Q16} GROUP BY 1, 2, 3"),
    "q17": (q17, {"lineitem": ("l", [], f"SELECT {L('l')} {_Q17}"), "sublink": ("l2", [], f"SELECT {L('i', 'l2')} {_Q17.replace(' WHERE', ' JOIN lineitem i ON i.l_partkey = p_partkey WHERE')}")}, f"SELECT round(sum(l.l_extendedprice) / 7.0, 2) AS yearly {_Q17}"),
    "q18": (q18, {"lineitem": ("l", ["o_orderkey"], f"SELECT o_orderkey AS out_o_orderkey, {L()} FROM ({_Q18R}) JOIN lineitem ON o_orderkey = l_orderkey"), "sublink": ("l2", ["o_orderkey"], f"SELECT q.o_orderkey AS out_o_orderkey, {L('i', 'l2')} FROM ({_Q18R}) q JOIN lineitem l ON q.o_orderkey = l.l_orderkey JOIN lineitem i ON q.o_orderkey = i.l_orderkey")}, _Q18R),
    "q19": (q19, {"part": ("p", [], f"SELECT p_partkey AS p_p_partkey {_Q19}")}, f"SELECT round(sum({REV}), 2) AS revenue {_Q19}"),
    "q20": (q20, {"part": ("p", ["s_suppkey"], f"{_Q20M} SELECT s_suppkey AS out_s_suppkey, m.l_partkey AS p_p_partkey FROM out JOIN m ON m.l_suppkey = s_suppkey"), "sublink": ("l2", ["s_suppkey"], f"{_Q20M} SELECT s_suppkey AS out_s_suppkey, {L('i', 'l2')} FROM out JOIN m ON m.l_suppkey = s_suppkey JOIN lineitem i ON i.l_partkey = m.l_partkey AND i.l_suppkey = m.l_suppkey WHERE i.l_shipdate >= DATE '1996-01-01'")}, f"{_Q20M} SELECT s_suppkey, s_name FROM out"),
    "q21": (q21, {"lineitem": ("l", ["s_name"], f"SELECT s_name AS out_s_name, {L('l')} {_Q21} AND s_name IN (SELECT s_name FROM ({_Q21R}))"), "sublink": ("l2", ["s_name"], f"SELECT b.s_name AS out_s_name, {L('i', 'l2')} FROM (SELECT l.*, s_name {_Q21} AND s_name IN (SELECT s_name FROM ({_Q21R}))) b JOIN lineitem i ON i.l_orderkey = b.l_orderkey AND i.l_suppkey <> b.l_suppkey")}, _Q21R),
    "q22": (q22, {"customer": ("c", ["c_nationkey"], f"SELECT c_nationkey AS out_c_nationkey, c_custkey AS c_c_custkey {_Q22}"), "sublink": ("c2", [], f"SELECT c_custkey AS c2_c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 {_Q22})")}, f"SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total {_Q22} GROUP BY 1"),
}

PLANS = {name: spec[0] for name, spec in _SPECS.items()}


def entries() -> dict[str, Entry]:
    out = {}
    for name, (plan, lineages, result) in _SPECS.items():
        for suffix, (access, outputs, sql) in lineages.items():
            out[f"{name}_lineage_{suffix}"] = Entry(traced(plan, access, outputs), sql)
        out[f"{name}_replay"] = Entry(replayed(plan), result)
    return out


__all__ = ["PLANS", "Tables", "entries"]
