"""Medical, credit, password, taxi and market queries, and queries of two parties' partial results.

The tables they need are derived from ``events`` and ``lineitem``: a user is a
patient, the kind of an event a diagnosis or a medication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import int_div
from tessera.plans.prelude import sql
from tessera.plans.tpch import D97, PRICE, _price, _sum
from tessera.sources.tables import load_integers

DAY = 86_400_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_integers(spark, sf_dir, "events")


def aspirin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with a diagnosis no later than a medication: the first of one against the last of the other."""
    ev = _events(spark, sf_dir)
    first = ev.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("diagnosed"))
    last = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("treated"))
    return first.join(last, "user_id").where("diagnosed <= treated").agg(F.count(F.lit(1)).alias("patients"))


ASPIRIN = sql("""SELECT count(DISTINCT d.user_id) AS patients FROM ev d JOIN ev m ON d.user_id = m.user_id WHERE d.event_type = 'error' AND m.event_type = 'purchase' AND d.ts <= m.ts""", "ev")


def comorbidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent diagnoses (parts bought) of a cohort (buyers of one segment)."""
    li, o, c = (load_integers(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    cohort = o.join(c.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    rows = li.select("l_orderkey", (F.col("l_partkey") % 1000).alias("diag")).join(cohort, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.groupBy("diag").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "diag").limit(10)


COMORBIDITY = sql("""SELECT l_partkey % 1000 AS diag, count(*) AS cnt FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM o JOIN c ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY')
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "li", "o", "c")


def credit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose scores of one kind lie far apart."""
    ev = _events(spark, sf_dir).where("event_type = 'view'")
    spread = ev.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return spread.where("high - low > 9000").select("user_id", (F.col("high") - F.col("low")).alias("spread"))


CREDIT = sql("SELECT user_id, max(value) - min(value) AS spread FROM ev WHERE event_type = 'view' GROUP BY 1 HAVING max(value) - min(value) > 9000", "ev")


def custom_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A many-to-many join of three tables, each aggregated before it is joined: coinsurance of costs by class."""
    li, o = (load_integers(spark, sf_dir, t) for t in ("lineitem", "orders"))
    people = o.groupBy("o_custkey").agg(_sum(F.col("o_comment") + 1, "coinsurance"))
    costs = li.select("l_orderkey", (F.col("l_partkey") % 50).alias("disease"), "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_pair = costs.groupBy("o_custkey", "disease").agg(_sum("l_quantity", "cost"))
    paid = by_pair.join(people, "o_custkey").groupBy("disease").agg(_sum(F.col("cost") * F.col("coinsurance"), "paid"))
    classes = load_integers(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("disease"), F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("times"))
    return paid.join(classes, "disease").groupBy("class").agg(int_div(F.sum(F.col("paid") * F.col("times")), 100).alias("total"))


CUSTOM = sql("""SELECT p_type AS class, CAST(sum(CAST(l_quantity AS BIGINT) * (a.o_comment + 1)) // 100 AS BIGINT) AS total FROM li JOIN o b ON l_orderkey = b.o_orderkey JOIN o a ON a.o_custkey = b.o_custkey
  JOIN p ON p_partkey % 50 = l_partkey % 50 GROUP BY 1""", "li", "o", "p")


def distinct_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with one diagnosis and one medication."""
    ev = _events(spark, sf_dir)
    a = ev.where("event_type = 'error' AND value > 5000").select("user_id")
    b = ev.where("event_type = 'signup'").select("user_id").distinct()
    return b.join(a, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("patients"))


DISTINCT = sql("SELECT count(DISTINCT a.user_id) AS patients FROM ev a JOIN ev b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND a.value > 5000 AND b.event_type = 'signup'", "ev")


def market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Herfindahl-Hirschman index of suppliers' revenues, in units of a dollar."""
    li = load_integers(spark, sf_dir, "lineitem")
    revenue = li.groupBy("l_suppkey").agg(int_div(_sum(_price(), "r"), 10_000).alias("rev"))
    d = lambda c: c.cast("decimal(38,0)")
    sums = revenue.agg(F.sum(d(F.col("rev") * F.col("rev"))).alias("squares"), F.sum("rev").alias("total"))
    return sums.select((d(F.col("squares")) * 10_000 / (d(F.col("total")) * d(F.col("total")))).cast("long").alias("hhi"))


MARKET = sql(f"""SELECT CAST(sum(CAST(rev AS HUGEINT) * rev) * 10000 // (CAST(sum(rev) AS HUGEINT) * CAST(sum(rev) AS HUGEINT)) AS BIGINT) AS hhi
  FROM (SELECT CAST(sum({PRICE}) // 10000 AS BIGINT) AS rev FROM li GROUP BY l_suppkey)""", "li")


def pwd_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the passwords (amounts) that they use more than once."""
    rows = _events(spark, sf_dir).select("user_id", (F.col("value") % 100).alias("pwd"))
    return rows.groupBy("user_id", "pwd").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


PWD = sql("SELECT user_id, value % 100 AS pwd, count(*) AS times FROM ev GROUP BY 1, 2 HAVING count(*) > 1", "ev")


def rcdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with two visits in a row that lie two to eight days apart."""
    ev = _events(spark, sf_dir).where("event_type = 'error'")
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.select("user_id", gap.alias("gap")).where(F.col("gap").between(2 * DAY, 8 * DAY)).select("user_id").distinct()


RCDIFF = sql(f"""SELECT DISTINCT user_id FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM ev WHERE event_type = 'error')
  WHERE gap BETWEEN {2 * DAY} AND {8 * DAY}""", "ev")


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a many-to-many join by a column of one side, counted without making them."""
    ev = _events(spark, sf_dir)
    n = ev.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    m = ev.where("event_type = 'view'").groupBy("user_id", (F.col("value") % 10).alias("ak")).agg(F.count(F.lit(1)).alias("m"))
    return m.join(n, "user_id").groupBy("ak").agg(_sum(F.col("n") * F.col("m"), "cnt"))


PAIRS = sql("SELECT b.value % 10 AS ak, count(*) AS cnt FROM ev a JOIN ev b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1", "ev")


# -- two parties: each computes on its own rows, only small results meet ------------


def _parties(li: DataFrame) -> list[DataFrame]:
    return [li.where("l_suppkey % 2 = 0"), li.where("l_suppkey % 2 = 1")]


def two_party_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of each party by group, added."""
    parts = [p.where(F.col("l_shipdate") <= D97).groupBy("l_returnflag", "l_linestatus").agg(_sum("l_quantity", "q"), F.count(F.lit(1)).alias("n")) for p in _parties(load_integers(spark, sf_dir, "lineitem"))]
    return parts[0].unionByName(parts[1]).groupBy("l_returnflag", "l_linestatus").agg(_sum("q", "sum_qty"), _sum("n", "count_order"))


TWO_Q1 = sql(f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS count_order FROM li WHERE l_shipdate <= {D97} GROUP BY 1, 2", "li")


def two_party_q1_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One party has the quantities, the other the group of each order; they meet on a unique compound key."""
    li = load_integers(spark, sf_dir, "lineitem")
    amounts = li.groupBy("l_orderkey", "l_linenumber").agg(_sum("l_quantity", "q"))
    groups = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    return amounts.join(groups, ["l_orderkey", "l_linenumber"]).groupBy("flag").agg(_sum("q", "sum_qty"))


TWO_Q1_KEYED = sql("SELECT flag, CAST(sum(q) AS BIGINT) AS sum_qty FROM (SELECT sum(l_quantity) AS q, max(l_returnflag) AS flag FROM li GROUP BY l_orderkey, l_linenumber) GROUP BY 1", "li")


def two_party_q1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums as columns, each row multiplied by whether it is in the group."""
    li = load_integers(spark, sf_dir, "lineitem")
    part = lambda p: p.agg(*[_sum(F.col("l_quantity") * (F.col("l_returnflag") == f).cast("long"), f"sum_{f.lower()}") for f in "ANR"])
    a, b = map(part, _parties(li))
    return a.unionByName(b).agg(*[_sum(c, c) for c in a.columns])


TWO_Q1_MASKED = sql("SELECT " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END) AS BIGINT) AS sum_{f.lower()}" for f in "ANR") + " FROM li", "li")


def two_party_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sums, added."""
    parts = [p.where("l_quantity < 24").agg(_sum(_price(), "r")) for p in _parties(load_integers(spark, sf_dir, "lineitem"))]
    return parts[0].unionByName(parts[1]).agg(_sum("r", "revenue"))


TWO_Q6 = sql(f"SELECT CAST(sum({PRICE}) AS BIGINT) AS revenue FROM li WHERE l_quantity < 24", "li")


def _q12(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = (load_integers(spark, sf_dir, t) for t in ("orders", "lineitem"))
    return o.select("o_orderkey", (F.col("o_orderpriority") <= "2-HIGH").cast("int").alias("high")), li.where("l_shipmode IN (2, 5)").select("l_orderkey", "l_shipmode")


def two_party_q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One party's orders joined with the other's lines."""
    o, li = _q12(spark, sf_dir)
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_shipmode", "high").agg(F.count(F.lit(1)).alias("line_count"))


def two_party_q12_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines counted by order before the join."""
    o, li = _q12(spark, sf_dir)
    counted = li.groupBy("l_orderkey", "l_shipmode").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_shipmode", "high").agg(_sum("n", "line_count"))


TWO_Q12 = sql("SELECT l_shipmode, CAST(o_orderpriority <= '2-HIGH' AS INTEGER) AS high, CAST(count(*) AS BIGINT) AS line_count FROM li JOIN o ON l_orderkey = o_orderkey WHERE l_shipmode IN (2, 5) GROUP BY 1, 2", "li", "o")


def two_party_q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One party's lines joined with the other's parts."""
    li, p = (load_integers(spark, sf_dir, t) for t in ("lineitem", "part"))
    return li.select("l_partkey", _price().alias("price")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(_sum("price", "revenue"))


def two_party_q14_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines summed by part before the join."""
    li, p = (load_integers(spark, sf_dir, t) for t in ("lineitem", "part"))
    return li.groupBy("l_partkey").agg(_sum(_price(), "price")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(_sum("price", "revenue"))


TWO_Q14 = sql(f"SELECT p_type, CAST(sum({PRICE}) AS BIGINT) AS revenue FROM li JOIN p ON l_partkey = p_partkey GROUP BY 1", "li", "p")

QUERIES = {
    "aspirin": aspirin, "comorbidity": comorbidity, "credit_score": credit_score, "custom_agg": custom_agg, "distinct_patients": distinct_patients, "market_share": market_share,
    "pwd_reuse": pwd_reuse, "rcdiff": rcdiff, "pair_counts": pair_counts, "two_party_q1": two_party_q1, "two_party_q1_keyed": two_party_q1_keyed, "two_party_q1_masked": two_party_q1_masked,
    "two_party_q6": two_party_q6, "two_party_q12": two_party_q12, "two_party_q12_merge": two_party_q12_merge, "two_party_q14": two_party_q14, "two_party_q14_merge": two_party_q14_merge,
}
ORACLE_SQL = {
    "aspirin": ASPIRIN, "comorbidity": COMORBIDITY, "credit_score": CREDIT, "custom_agg": CUSTOM, "distinct_patients": DISTINCT, "market_share": MARKET, "pwd_reuse": PWD, "rcdiff": RCDIFF, "pair_counts": PAIRS,
    "two_party_q1": TWO_Q1, "two_party_q1_keyed": TWO_Q1_KEYED, "two_party_q1_masked": TWO_Q1_MASKED, "two_party_q6": TWO_Q6, "two_party_q12": TWO_Q12, "two_party_q12_merge": TWO_Q12, "two_party_q14": TWO_Q14, "two_party_q14_merge": TWO_Q14,
}
