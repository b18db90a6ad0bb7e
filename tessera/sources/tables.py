"""The supplied tables as DataFrames, and as the integer tables that the queries compute on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import money_cents

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(column: str):
    """A timestamp as days since 1970-01-01."""
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


#: The columns that hold the stored times of days, with ``times``.
TIMES = {"l_shipdate": "l_shiptime", "o_orderdate": "o_ordertime"}


def between_days(day: str, first: int | None, last: int | None) -> Column:
    """A day of ``load_integers(..., times=True)`` from ``first`` to ``last``, both included; None: open.

    The condition on the computed day can't reach a Parquet scan; the same one on
    the stored time does, and lets it leave out row groups.
    """
    time, start = F.col(TIMES[day]), F.lit("1970-01-01").cast("date")
    found = F.lit(True)
    if first is not None:
        found = found & (F.col(day) >= first) & (time >= F.date_add(start, first).cast("timestamp_ntz"))
    if last is not None:
        found = found & (F.col(day) <= last) & (time < F.date_add(start, last + 1).cast("timestamp_ntz"))
    return found


def load_integers(spark: SparkSession, sf_dir: str, name: str, times: bool = False) -> DataFrame:
    """A table with amounts in cents, rates in percent and dates as days, and the columns that are derived from keys.

    The supplied tables lack some columns of the benchmark's schema.  Those are
    derived by fixed integer arithmetic, the same in the SQL that the queries are
    compared with.  ``times`` keeps the stored times of ``TIMES`` beside their days.
    """
    df = load(spark, sf_dir, name)
    stored = lambda day: [F.col(day).cast("timestamp_ntz").alias(TIMES[day])] if times else []
    if name == "lineitem":
        ship = days("l_shipdate")
        number = F.col("l_linenumber").cast("long")
        return df.select(
            "l_orderkey", "l_partkey", "l_suppkey", number.alias("l_linenumber"), F.col("l_quantity").cast("long").alias("l_quantity"),
            money_cents("l_extendedprice").alias("l_extendedprice"), F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"),
            F.round(F.col("l_tax") * 100).cast("long").alias("l_tax"), "l_returnflag", "l_linestatus", ship.alias("l_shipdate"),
            (ship + (F.col("l_orderkey") * 3 + number) % 60 - 30).alias("l_commitdate"), (ship + (F.col("l_orderkey") + number * 7) % 29 + 1).alias("l_receiptdate"),
            ((F.col("l_orderkey") + number) % 7).alias("l_shipmode"), ((F.col("l_partkey") + number) % 4).alias("l_shipinstruct"), *stored("l_shipdate"),
        )
    if name == "orders":
        return df.select("o_orderkey", "o_custkey", "o_orderstatus", money_cents("o_totalprice").alias("o_totalprice"), days("o_orderdate").alias("o_orderdate"), "o_orderpriority", (F.col("o_orderkey") % 16).alias("o_comment"), *stored("o_orderdate"))
    if name == "customer":
        return df.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), money_cents("c_acctbal").alias("c_acctbal"), "c_mktsegment", (F.col("c_custkey") % 90 + 10).alias("c_cntrycode"))
    if name == "supplier":
        return df.select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), money_cents("s_acctbal").alias("s_acctbal"), (F.col("s_suppkey") % 16).alias("s_comment"))
    if name == "part":
        return df.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), money_cents("p_retailprice").alias("p_retailprice"), (F.col("p_partkey") % 40 + 1).alias("p_container"), (F.col("p_partkey") % 21).alias("p_word"))
    if name == "nation":
        return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    if name == "region":
        return df.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    if name == "events":
        return df.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), money_cents("value").alias("value"))
    return df
