"""The 22 decision-support queries over integer tables.

Each function has its SQL beside it.  Amounts are cents, rates percent, dates
days since 1970; quotients are truncated.  Top-k orders end with a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import int_div, percent
from tessera.plans.prelude import sql
from tessera.sources.generate import partsupp
from tessera.sources.tables import between_days, load, load_integers

D96, D97, D98, D99 = 9496, 9862, 10227, 10592  # the first of January of each year
RECENT = 11_300


def _t(spark: SparkSession, sf_dir: str, *names: str):
    return [partsupp(load(spark, sf_dir, "lineitem")) if n == "partsupp" else load_integers(spark, sf_dir, n, times=True) for n in names]


def _price():
    return int_div(F.col("l_extendedprice") * (100 - F.col("l_discount")), 100)


def _sum(c, name: str):
    return F.sum(c).alias(name)


PRICE = "l_extendedprice * (100 - l_discount) // 100"


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    charge = int_div(F.col("l_extendedprice") * (100 - F.col("l_discount")) * (100 + F.col("l_tax")), 10_000)
    sums = (
        li.where(between_days("l_shipdate", None, D99 + 60))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(_sum("l_quantity", "sum_qty"), _sum("l_extendedprice", "sum_base_price"), _sum(_price(), "sum_disc_price"), _sum(charge, "sum_charge"), _sum("l_discount", "sum_disc"), F.count(F.lit(1)).alias("count_order"))
    )
    return sums.select(
        "l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", int_div("sum_qty", "count_order").alias("avg_qty"),
        int_div("sum_base_price", "count_order").alias("avg_price"), int_div("sum_disc", "count_order").alias("avg_disc"), "count_order",
    ).orderBy("l_returnflag", "l_linestatus")


Q1 = sql(f"""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(l_extendedprice) AS BIGINT) AS sum_base_price,
  CAST(sum({PRICE}) AS BIGINT) AS sum_disc_price, CAST(sum(l_extendedprice * (100 - l_discount) * (100 + l_tax) // 10000) AS BIGINT) AS sum_charge,
  CAST(sum(l_quantity) // count(*) AS BIGINT) AS avg_qty, CAST(sum(l_extendedprice) // count(*) AS BIGINT) AS avg_price, CAST(sum(l_discount) // count(*) AS BIGINT) AS avg_disc, count(*) AS count_order
  FROM li WHERE l_shipdate <= {D99 + 60} GROUP BY 1, 2 ORDER BY 1, 2""", "li")  # fmt: skip


def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n, r, ps = _t(spark, sf_dir, "part", "supplier", "nation", "region", "partsupp")
    near = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r.where(F.col("r_regionkey") == 2), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = p.where((F.col("p_size") <= 15) & (F.col("p_type") == "SMALL")).select("p_partkey", "p_brand")
    offers = ps.join(wanted, F.col("ps_partkey") == F.col("p_partkey")).join(near, F.col("ps_suppkey") == F.col("s_suppkey"))
    least = offers.groupBy("p_partkey").agg(F.min("ps_supplycost").alias("least"))
    return (
        offers.join(least, "p_partkey").where("ps_supplycost = least")
        .select("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand", "s_suppkey", "ps_supplycost")
        .orderBy(F.desc("s_acctbal"), "n_name", "s_suppkey", "p_partkey").limit(100)
    )


Q2 = sql("""SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, s_suppkey, ps_supplycost FROM (
  SELECT *, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS least FROM ps JOIN p ON ps_partkey = p_partkey JOIN s ON ps_suppkey = s_suppkey
  JOIN n ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND p_size <= 15 AND p_type = 'SMALL')
  WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_suppkey, p_partkey LIMIT 100""", "ps", "p", "s", "n")


def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    buyers = c.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    open_orders = o.where(between_days("o_orderdate", None, D98 - 1)).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    revenue = li.where(between_days("l_shipdate", D98 + 1, None)).groupBy("l_orderkey").agg(_sum(_price(), "revenue"))
    return (
        revenue.join(open_orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "revenue", "o_orderdate").orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)
    )


Q3 = sql(f"""SELECT l_orderkey, CAST(sum({PRICE}) AS BIGINT) AS revenue, o_orderdate FROM c JOIN o ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < {D98} AND l_shipdate > {D98} GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""", "c", "o", "li")


def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    late = li.where("l_commitdate < l_receiptdate").select("l_orderkey")
    return o.where(between_days("o_orderdate", D97, D97 + 89)).join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


Q4 = sql(f"""SELECT o_orderpriority, count(*) AS order_count FROM o WHERE o_orderdate BETWEEN {D97} AND {D97 + 89}
  AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY 1""", "o", "li")


def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, s, n = _t(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation")
    local = n.where("n_regionkey = 1")
    orders = o.where(between_days("o_orderdate", D96, D97 - 1)).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = li.select("l_orderkey", "l_suppkey", _price().alias("price")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    same = sold.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return same.join(local, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(_sum("price", "revenue")).orderBy(F.desc("revenue"), "n_name")


Q5 = sql(f"""SELECT n_name, CAST(sum({PRICE}) AS BIGINT) AS revenue FROM c JOIN o ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey JOIN s ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN n ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderdate BETWEEN {D96} AND {D97 - 1} GROUP BY 1 ORDER BY 2 DESC, 1""", "c", "o", "li", "s", "n")


def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    kept = li.where(between_days("l_shipdate", D96, D97 - 1) & F.col("l_discount").between(5, 7) & (F.col("l_quantity") < 24))
    return kept.agg(F.sum(int_div(F.col("l_extendedprice") * F.col("l_discount"), 100)).alias("revenue"))


Q6 = sql(f"SELECT CAST(sum(l_extendedprice * l_discount // 100) AS BIGINT) AS revenue FROM li WHERE l_shipdate BETWEEN {D96} AND {D97 - 1} AND l_discount BETWEEN 5 AND 7 AND l_quantity < 24", "li")


def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, s, n = _t(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation")
    two = n.where(F.col("n_nationkey").isin(3, 7))
    sellers = s.join(two, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    buyers = c.join(two, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    sold = li.where(between_days("l_shipdate", D96, D98 - 1)).select("l_orderkey", "l_suppkey", (F.col("l_shipdate") >= D97).cast("int").alias("second_year"), _price().alias("price"))
    joined = sold.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.where("supp_nation <> cust_nation").groupBy("supp_nation", "cust_nation", "second_year").agg(_sum("price", "revenue")).orderBy("supp_nation", "cust_nation", "second_year")


Q7 = sql(f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(l_shipdate >= {D97} AS INTEGER) AS second_year, CAST(sum({PRICE}) AS BIGINT) AS revenue
  FROM li JOIN s ON l_suppkey = s_suppkey JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN n a ON s_nationkey = a.n_nationkey JOIN n b ON c_nationkey = b.n_nationkey
  WHERE a.n_nationkey IN (3, 7) AND b.n_nationkey IN (3, 7) AND a.n_nationkey <> b.n_nationkey AND l_shipdate BETWEEN {D96} AND {D98 - 1} GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""", "li", "s", "o", "c", "n")


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, s, n, p = _t(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "part")
    parts = p.where("p_type = 'ECONOMY'").select("p_partkey")
    buyers = c.join(n.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    orders = o.where(between_days("o_orderdate", D96, D98 - 1)).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", (F.col("o_orderdate") >= D97).cast("int").alias("second_year"))
    sold = li.select("l_orderkey", "l_partkey", "l_suppkey", _price().alias("price")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    joined = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    mine = F.when(F.col("s_nationkey") == 4, F.col("price")).otherwise(0)
    return joined.groupBy("second_year").agg(percent(F.sum(mine), F.sum("price")).alias("mkt_share")).orderBy("second_year")


Q8 = sql(f"""SELECT CAST(o_orderdate >= {D97} AS INTEGER) AS second_year, CAST(sum(CASE WHEN s_nationkey = 4 THEN {PRICE} ELSE 0 END) * 100 // sum({PRICE}) AS BIGINT) AS mkt_share
  FROM li JOIN p ON l_partkey = p_partkey JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey JOIN s ON l_suppkey = s_suppkey
  WHERE p_type = 'ECONOMY' AND n_regionkey = 1 AND o_orderdate BETWEEN {D96} AND {D98 - 1} GROUP BY 1 ORDER BY 1""", "li", "p", "o", "c", "n", "s")


def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s, n, p, ps = _t(spark, sf_dir, "orders", "lineitem", "supplier", "nation", "part", "partsupp")
    parts = p.where("p_word = 5").select("p_partkey")
    sold = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", _price().alias("price")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    costed = sold.join(ps, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")))
    placed = costed.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    amount = F.col("price") - F.col("ps_supplycost") * F.col("l_quantity")
    return placed.groupBy("n_name", "o_orderdate").agg(_sum(amount, "sum_profit")).orderBy("n_name", F.desc("o_orderdate"))


Q9 = sql(f"""SELECT n_name, o_orderdate, CAST(sum({PRICE} - ps_supplycost * l_quantity) AS BIGINT) AS sum_profit FROM li JOIN p ON l_partkey = p_partkey
  JOIN ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN o ON l_orderkey = o_orderkey JOIN s ON l_suppkey = s_suppkey JOIN n ON s_nationkey = n_nationkey
  WHERE p_word = 5 GROUP BY 1, 2 ORDER BY 1, 2 DESC""", "li", "p", "ps", "o", "s", "n")


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = _t(spark, sf_dir, "customer", "orders", "lineitem", "nation")
    back = li.where("l_returnflag = 'R'").select("l_orderkey", _price().alias("price"))
    orders = o.where(between_days("o_orderdate", D97, D97 + 89)).select("o_orderkey", "o_custkey")
    lost = back.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(_sum("price", "revenue"))
    named = lost.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey")


Q10 = sql(f"""SELECT c_custkey, c_name, CAST(sum({PRICE}) AS BIGINT) AS revenue, c_acctbal, n_name FROM c JOIN o ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey JOIN n ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R' AND o_orderdate BETWEEN {D97} AND {D97 + 89} GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey""", "c", "o", "li", "n")


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ps = _t(spark, sf_dir, "supplier", "partsupp")
    mine = ps.join(s.where("s_nationkey = 7"), F.col("ps_suppkey") == F.col("s_suppkey"), "left_semi").select("ps_partkey", (F.col("ps_supplycost") * F.col("ps_availqty")).alias("value"))
    total = mine.agg(int_div(F.sum("value"), 500).alias("floor"))  # one row
    return mine.groupBy("ps_partkey").agg(_sum("value", "value")).crossJoin(F.broadcast(total)).where("value > floor").select("ps_partkey", "value").orderBy(F.desc("value"), "ps_partkey")


Q11 = sql("""SELECT ps_partkey, CAST(sum(ps_supplycost * ps_availqty) AS BIGINT) AS value FROM ps JOIN s ON ps_suppkey = s_suppkey WHERE s_nationkey = 7 GROUP BY 1
  HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) // 500 FROM ps JOIN s ON ps_suppkey = s_suppkey WHERE s_nationkey = 7) ORDER BY 2 DESC, 1""", "ps", "s")


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    kept = li.where(F.col("l_shipmode").isin(2, 5) & F.col("l_receiptdate").between(D97, D98 - 1) & (F.col("l_commitdate") < F.col("l_receiptdate")) & (F.col("l_shipdate") < F.col("l_commitdate"))).select("l_orderkey", "l_shipmode")
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("long")
    return kept.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_shipmode").agg(_sum(high, "high_line_count"), _sum(1 - high, "low_line_count")).orderBy("l_shipmode")


Q12 = sql(f"""SELECT l_shipmode, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count FROM li JOIN o ON l_orderkey = o_orderkey
  WHERE l_shipmode IN (2, 5) AND l_receiptdate BETWEEN {D97} AND {D98 - 1} AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate GROUP BY 1 ORDER BY 1""", "li", "o")


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    counts = o.where("o_comment <> 0 AND o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    per = c.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("c_count"))
    return per.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


Q13 = sql("""SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM c LEFT JOIN o ON c_custkey = o_custkey AND o_comment <> 0 AND o_orderpriority <> '5-LOW' GROUP BY 1)
  GROUP BY 1 ORDER BY 2 DESC, 1 DESC""", "c", "o")


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    sold = li.where(between_days("l_shipdate", D97, D97 + 29)).select("l_partkey", _price().alias("price")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return sold.agg(percent(F.sum(F.when(F.col("p_type") == "PROMO", F.col("price")).otherwise(0)), F.sum("price")).alias("promo_revenue"))


Q14 = sql(f"SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN {PRICE} ELSE 0 END) * 100 // sum({PRICE}) AS BIGINT) AS promo_revenue FROM li JOIN p ON l_partkey = p_partkey WHERE l_shipdate BETWEEN {D97} AND {D97 + 29}", "li", "p")


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = _t(spark, sf_dir, "lineitem", "supplier")
    revenue = li.where(between_days("l_shipdate", D97, D97 + 89)).groupBy("l_suppkey").agg(_sum(_price(), "total_revenue"))
    best = revenue.agg(F.max("total_revenue").alias("most"))  # one row
    top = revenue.crossJoin(F.broadcast(best)).where("total_revenue = most")
    return top.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


Q15 = sql(f"""SELECT s_suppkey, s_name, total_revenue FROM (SELECT l_suppkey, CAST(sum({PRICE}) AS BIGINT) AS total_revenue, max(CAST(sum({PRICE}) AS BIGINT)) OVER () AS most
  FROM li WHERE l_shipdate BETWEEN {D97} AND {D97 + 89} GROUP BY 1) JOIN s ON l_suppkey = s_suppkey WHERE total_revenue = most ORDER BY 1""", "li", "s")


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, ps = _t(spark, sf_dir, "part", "supplier", "partsupp")
    parts = p.where((F.col("p_type") != "PROMO") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49)).select("p_partkey", "p_brand", "p_type", "p_size")
    clean = ps.select("ps_partkey", "ps_suppkey").join(s.where("s_comment = 3"), F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti")
    return clean.join(parts, F.col("ps_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


Q16 = sql("""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN p ON ps_partkey = p_partkey WHERE p_type <> 'PROMO' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM s WHERE s_comment = 3) GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3""", "ps", "p", "s")


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    parts = p.where("p_container <= 8").select("p_partkey")
    sold = li.select("l_partkey", "l_quantity", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    limits = sold.groupBy("l_partkey").agg(int_div(int_div(F.sum("l_quantity"), 2), F.count(F.lit(1))).alias("limit"))
    return sold.join(limits, "l_partkey").where("l_quantity < limit").agg(int_div(F.sum("l_extendedprice"), 7).alias("avg_yearly"))


Q17 = sql("""SELECT CAST(sum(l_extendedprice) // 7 AS BIGINT) AS avg_yearly FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_partkey) // 2 // count(*) OVER (PARTITION BY l_partkey) AS lim
  FROM li JOIN p ON l_partkey = p_partkey WHERE p_container <= 8) WHERE l_quantity < lim""", "li", "p")


def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    large = li.groupBy("l_orderkey").agg(_sum("l_quantity", "sum_qty")).where("sum_qty > 230")
    joined = large.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")


Q18 = sql("""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum_qty FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS sum_qty FROM li GROUP BY 1 HAVING sum(l_quantity) > 230)
  JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey""", "li", "o", "c")


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    box = F.col("p_container").bitwiseAND(3)
    one = lambda b, k, low, size: (F.col("brand") == b) & (box == k) & F.col("l_quantity").between(low, low + 10) & F.col("p_size").between(1, size)
    parts = p.withColumn("brand", F.col("p_partkey") % 25)
    kept = li.where(F.col("l_shipmode").isin(0, 1) & (F.col("l_shipinstruct") == 2))
    return kept.join(parts, F.col("l_partkey") == F.col("p_partkey")).where(one(12, 0, 1, 25) | one(23, 1, 10, 30) | one(9, 2, 20, 45)).agg(_sum(_price(), "revenue"))


Q19 = sql(f"""SELECT CAST(sum({PRICE}) AS BIGINT) AS revenue FROM li JOIN p ON l_partkey = p_partkey WHERE l_shipmode IN (0, 1) AND l_shipinstruct = 2 AND (
  (p_partkey % 25 = 12 AND p_container & 3 = 0 AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25) OR (p_partkey % 25 = 23 AND p_container & 3 = 1 AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
  OR (p_partkey % 25 = 9 AND p_container & 3 = 2 AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45))""", "li", "p")


def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s, ps = _t(spark, sf_dir, "lineitem", "part", "supplier", "partsupp")
    sold = li.where(between_days("l_shipdate", D97, D98 - 1)).groupBy("l_partkey", "l_suppkey").agg(_sum("l_quantity", "sold"))
    stock = ps.join(p.where("p_word = 5"), F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    spare = stock.join(sold, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).where("2 * ps_availqty > sold")
    return s.where("s_nationkey = 3").join(spare, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")


Q20 = sql(f"""SELECT s_suppkey, s_name FROM s WHERE s_nationkey = 3 AND s_suppkey IN (SELECT ps_suppkey FROM ps JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS sold FROM li
  WHERE l_shipdate BETWEEN {D97} AND {D98 - 1} GROUP BY 1, 2) ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
  WHERE 2 * ps_availqty > sold AND ps_partkey IN (SELECT p_partkey FROM p WHERE p_word = 5)) ORDER BY s_name, s_suppkey""", "s", "ps", "li", "p")


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s = _t(spark, sf_dir, "orders", "lineitem", "supplier")
    per = li.groupBy("l_orderkey", "l_suppkey").agg(F.bit_or((F.col("l_receiptdate") > F.col("l_commitdate")).cast("int")).alias("late"), _sum((F.col("l_receiptdate") > F.col("l_commitdate")).cast("long"), "late_lines"))
    orders = per.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("late").alias("late_suppliers"), F.max(F.when(F.col("late") == 1, F.struct("l_suppkey", "late_lines"))).alias("who"))
    blamed = orders.where("suppliers > 1 AND late_suppliers = 1").join(o.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    named = blamed.join(s.where("s_nationkey = 7"), F.col("who.l_suppkey") == F.col("s_suppkey"))
    return named.groupBy("s_name").agg(F.sum("who.late_lines").alias("numwait")).orderBy(F.desc("numwait"), "s_name")


Q21 = sql("""SELECT s_name, count(*) AS numwait FROM li l1 JOIN s ON l1.l_suppkey = s_suppkey JOIN o ON l1.l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND s_nationkey = 7 AND l1.l_receiptdate > l1.l_commitdate
  AND EXISTS (SELECT 1 FROM li l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM li l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate) GROUP BY 1 ORDER BY 2 DESC, 1""", "li", "s", "o")


def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    some = c.where(F.col("c_cntrycode").isin(13, 31, 23, 29, 30, 18, 17))
    mean = some.where("c_acctbal > 0").agg(int_div(F.sum("c_acctbal"), F.count(F.lit(1))).alias("mean"))  # one row
    rich = some.crossJoin(F.broadcast(mean)).where("c_acctbal > mean")
    idle = rich.join(o.where(between_days("o_orderdate", RECENT, None)), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_cntrycode").agg(F.count(F.lit(1)).alias("numcust"), _sum("c_acctbal", "totacctbal")).orderBy("c_cntrycode")


Q22 = sql(f"""SELECT c_cntrycode, count(*) AS numcust, CAST(sum(c_acctbal) AS BIGINT) AS totacctbal FROM c WHERE c_cntrycode IN (13, 31, 23, 29, 30, 18, 17)
  AND c_acctbal > (SELECT sum(c_acctbal) // count(*) FROM c WHERE c_acctbal > 0 AND c_cntrycode IN (13, 31, 23, 29, 30, 18, 17))
  AND NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND o_orderdate >= {RECENT}) GROUP BY 1 ORDER BY 1""", "c", "o")

QUERIES = {f"tpch_q{i}": globals()[f"q{i}"] for i in range(1, 23)}
ORACLE_SQL = {f"tpch_q{i}": globals()[f"Q{i}"] for i in range(1, 23)}
