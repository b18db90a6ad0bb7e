"""Generators of test tables, distributed and reproducible: every value is a hash of its row number and column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def between(low: int, high: int, salt: str, key: Column | str = "id") -> Column:
    """An integer from ``low`` to ``high``, both included."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.lit(salt), k), F.lit(high - low + 1)) + low


def _rows(n: float, least: int = 1) -> int:
    return max(least, int(n))


def partsupp(lineitem: DataFrame) -> DataFrame:
    """The part-supplier pairs of ``lineitem`` with a cost and a quantity derived from the keys."""
    pairs = lineitem.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return pairs.select(
        "ps_partkey", "ps_suppkey", ((F.col("ps_partkey") * 31 + F.col("ps_suppkey") * 17) % 1000 + 1).alias("ps_supplycost"), ((F.col("ps_partkey") * 7 + F.col("ps_suppkey") * 13) % 9999 + 1).alias("ps_availqty")
    )


def generate_tpch(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    """Eight tables of integers at a scale factor, with the benchmark's ranges."""
    n_c, n_o, n_p, n_s = (_rows(x * sf) for x in (150_000, 1_500_000, 200_000, 10_000))
    r = lambda low, high, salt, name: between(low, high, salt).alias(name)
    customer = spark.range(n_c).select(F.col("id").alias("c_custkey"), r(0, 24, "cn", "c_nationkey"), r(-99_999, 999_999, "ca", "c_acctbal"), r(1, 5, "cm", "c_mktsegment"), r(0, 15, "cc", "c_comment"), r(10, 34, "cp", "c_cntrycode"))
    orders = spark.range(n_o).select(F.col("id").alias("o_orderkey"), r(0, n_c - 1, "oc", "o_custkey"), r(1, 5, "op", "o_orderpriority"), r(0, 2400, "od", "o_orderdate"), r(100, 50_000_000, "ot", "o_totalprice"), r(0, 2, "os", "o_orderstatus"), r(0, 15, "om", "o_comment"))
    lines = spark.range(n_o).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(0).cast("long"), between(0, 6, "ln"))).alias("l_linenumber")).withColumn("id", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    ship = between(0, 2400, "od", "l_orderkey") + between(1, 121, "ls")
    lineitem = lines.select(
        "l_orderkey", "l_linenumber", r(0, n_p - 1, "lp", "l_partkey"), r(0, n_s - 1, "lu", "l_suppkey"), r(1, 50, "lq", "l_quantity"), r(100, 10_000_000, "le", "l_extendedprice"), r(0, 9, "ld", "l_discount"),
        r(0, 7, "lt", "l_tax"), r(0, 2, "lr", "l_returnflag"), r(0, 1, "lz", "l_linestatus"), ship.alias("l_shipdate"), (ship + between(-30, 29, "lc")).alias("l_commitdate"), (ship + between(1, 30, "lx")).alias("l_receiptdate"),
        r(0, 6, "lm", "l_shipmode"), r(0, 3, "li", "l_shipinstruct"),
    )
    part = spark.range(n_p).select(F.col("id").alias("p_partkey"), r(1, 25, "pb", "p_brand"), r(1, 40, "pc", "p_container"), r(1, 10, "pt", "p_type"), r(1, 50, "ps", "p_size"), r(0, 20, "pn", "p_name"))
    supplier = spark.range(n_s).select(F.col("id").alias("s_suppkey"), r(0, 24, "sn", "s_nationkey"), r(-99_999, 999_999, "sa", "s_acctbal"), r(0, 15, "sc", "s_comment"))
    pairs = spark.range(n_p).select(F.col("id").alias("ps_partkey"), F.explode(F.sequence(F.lit(0), F.lit(min(3, n_s - 1)))).alias("k"))
    each = pairs.withColumn("id", F.col("ps_partkey") * 4 + F.col("k"))
    supply = each.select("ps_partkey", ((F.col("ps_partkey") + F.col("k") * F.lit(max(1, n_s // 4))) % n_s).alias("ps_suppkey"), r(1, 1000, "pq", "ps_supplycost"), r(1, 9999, "pv", "ps_availqty"))
    nation = spark.range(25).select(F.col("id").alias("n_nationkey"), F.col("id").alias("n_name"), (F.col("id") % 5).alias("n_regionkey"))
    region = spark.range(5).select(F.col("id").alias("r_regionkey"), F.col("id").alias("r_name"))
    return {"customer": customer, "orders": orders, "lineitem": lineitem, "part": part, "supplier": supplier, "partsupp": supply, "nation": nation, "region": region}


def generate_one_to_one(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """lineitem, orders and part of exactly ``rows`` rows each, key k of one belonging to key k of the others.

    Prices follow the benchmark's rule for retail prices; a line is received two
    days after it ships, and lines late in the year are neither returned nor billed.
    """
    r = lambda low, high, salt, name: between(low, high, salt).alias(name)
    key = F.col("id")
    quantity, ship = between(1, 50, "1q"), between(0, 364, "1s")
    retail = 90_000 + F.call_function("div", key, F.lit(10)) % 20_001 + 100 * (key % 1000)
    lineitem = spark.range(rows).select(
        key.alias("l_orderkey"), key.alias("l_partkey"), quantity.alias("l_quantity"), (retail * quantity).alias("l_extendedprice"), r(4, 6, "1d", "l_discount"), r(0, 7, "1t", "l_tax"),
        ship.alias("l_shipdate"), (ship + 1).alias("l_commitdate"), (ship + 2).alias("l_receiptdate"), F.when(ship + 2 > 168, 0).otherwise(between(1, 2, "1r")).alias("l_returnflag"),
        F.when(ship > 168, 0).otherwise(1).cast("long").alias("l_linestatus"), r(0, 2, "1m", "l_shipmode"),
    )
    orders = spark.range(rows).select(key.alias("o_orderkey"), r(1, 4, "1p", "o_orderpriority"))
    part = spark.range(rows).select(key.alias("p_partkey"), r(1, 6, "1y", "p_type"))
    return {"lineitem": lineitem, "orders": orders, "part": part}


def generate_other(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    """The tables of the medical, password, taxi and credit queries."""
    r = lambda low, high, salt, name: between(low, high, salt).alias(name)
    n = lambda rows: spark.range(_rows(rows * sf))
    people = _rows(500_000 * sf)
    return {
        "diagnosis": n(3_000_000).select(r(0, people - 1, "dp", "pid"), r(0, 9999, "dt", "time"), r(0, 9, "dd", "diag")),
        "medication": n(2_000_000).select(r(0, people - 1, "mp", "pid"), r(0, 9999, "mt", "time"), r(0, 9, "mm", "med")),
        "password": n(5_000_000).select(r(0, people - 1, "wi", "id"), r(0, 999, "ww", "pwd")),
        "taxi": n(5_000_000).select(r(0, 9, "tc", "company"), r(1, 1000, "tf", "fare"), r(0, 3, "tt", "type")),
        "credit": n(5_000_000).select(r(0, people - 1, "cu", "uid"), r(0, 2, "cg", "agency"), r(2015, 2024, "cy", "year"), r(300, 850, "cs", "cs")),
        "r": n(2_000_000).select(r(0, people - 1, "ri", "id"), r(0, 99, "ra", "ak")),
        "s": n(2_000_000).select(r(0, people - 1, "si", "id")),
        "cohort": cohort(spark, people),
        **coinsurance(spark, sf),
    }


def cohort(spark: SparkSession, people: int) -> DataFrame:
    """About a tenth of the people."""
    return spark.range(people).where(between(0, 9, "co") == 0).select(F.col("id").alias("pid"))


def coinsurance(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    """t1 (person, coinsurance, state), t2 (person, disease, cost), t3 (disease, class)."""
    r = lambda low, high, salt, name: between(low, high, salt).alias(name)
    n = lambda rows: spark.range(_rows(rows * sf))
    people = _rows(500_000 * sf)
    return {
        "t1": n(2_000_000).select(r(0, people - 1, "1p", "person"), r(0, 100, "1c", "coinsurance"), r(0, 49, "1s", "state")),
        "t2": n(1_000_000).select(r(0, people - 1, "2p", "person"), r(0, 999, "2d", "disease"), r(1, 10_000, "2c", "cost")),
        "t3": n(1_000_000).select(r(0, 999, "3d", "disease"), r(0, 9, "3c", "class_")),
    }
