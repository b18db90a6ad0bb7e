"""One query for each operator of the table API, on the supplied tables."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as fn
from tessera.operators.table import Table
from tessera.plans.prelude import sql
from tessera.sources.csv import read_csv, write_csv
from tessera.sources.generate import generate_one_to_one, generate_tpch
from tessera.sources.tables import load, load_integers
from tessera.storage import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def _query(name: str, text: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir)
        ORACLE_SQL[name] = text
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(load_integers(spark, sf_dir, name), name=name)


@_query("table_filter_select", sql("SELECT o_orderkey, o_totalprice, o_totalprice // 100 AS dollars FROM o WHERE o_orderstatus = 'P' AND o_totalprice >= 10000000", "o"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").filter(F.col("o_totalprice") >= 10_000_000)
    return t.with_columns(dollars=fn.int_div("o_totalprice", 100)).select("o_orderkey", "o_totalprice", "dollars").df


@_query("table_revalidate", sql("SELECT (SELECT count(*) FROM o WHERE o_orderstatus = 'F') AS kept, count(*) AS n FROM o", "o"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey").with_columns(twice=2 * F.col("o_custkey")).drop("o_custkey")
    one = t.aggregate([], {"kept": ("count", None)})
    return one.scalar_join(t.revalidate().aggregate([], {"n": ("count", None)}), ("kept",)).df


@_query("table_mask", sql("SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN n_regionkey ELSE -1 END AS r FROM (SELECT CASE WHEN n_regionkey < 2 THEN n_nationkey ELSE -1 END AS n_nationkey, n_regionkey FROM n)", "n"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "nation").filter(F.col("n_regionkey") < 2).drop("n_name").rename("n_nationkey", "k")
    return t.mask(-1).rename("n_regionkey", "r").df


@_query("table_shape", sql("SELECT s_suppkey AS k, s_nationkey, 0 AS zero, s_nationkey AS again FROM s", "s"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier").drop("s_name", "s_acctbal", "s_comment").add_columns("zero").copy_column("s_nationkey", "again")
    return t.rename("s_suppkey", "k").zero("zero").df


@_query("table_head", sql("SELECT c_custkey, c_acctbal FROM c ORDER BY c_acctbal DESC, c_custkey LIMIT 25", "c"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").head(25, [("c_acctbal", "desc"), "c_custkey"]).df


@_query("table_tail", sql("SELECT c_custkey, c_acctbal FROM c ORDER BY c_acctbal, c_custkey DESC LIMIT 25", "c"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").tail(25, [("c_acctbal", "desc"), "c_custkey"]).df


@_query("table_sort", sql("SELECT n_regionkey, n_nationkey FROM n ORDER BY n_regionkey DESC, n_nationkey", "n"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").sort([("n_regionkey", "desc"), "n_nationkey"]).df


@_query("table_slice", sql("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM o) WHERE i >= 10 AND i < 5000 AND (i - 10) % 7 = 0", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").row_slice(["o_totalprice", "o_orderkey"], 10, 5000, 7).select("o_orderkey").df


@_query("table_resize", sql("SELECT 32 AS n, CAST(count(*) AS BIGINT) AS valid FROM n", "n"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "nation").drop("n_name").pad_power_of_two()
    whole = t.revalidate().aggregate([], {"n": ("count", None)})
    return whole.scalar_join(t.aggregate([], {"valid": ("count", None)}), ("n",)).df.select(F.col("n").cast("int"), "valid")


@_query("table_shuffle", sql("SELECT s_suppkey FROM s", "s"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").finalize(seed=3).select("s_suppkey").df


@_query("table_repeat", sql("SELECT r_regionkey, k FROM r, (VALUES (1), (2), (3)) v(k)", "r"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "region").select("r_regionkey").repeat(3)
    return t.window_aggregate(["r_regionkey"], {"k": ("count", None)}, ["r_regionkey"]).df.select("r_regionkey", F.col("k").cast("int"))


@_query("aggregate_all", sql("""SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS s, count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi, bit_or(l_linenumber) AS bits,
  CAST(sum(l_quantity) // count(*) AS BIGINT) AS mean, count(DISTINCT l_partkey) AS parts, CAST(sum(l_quantity * l_quantity) AS BIGINT) AS squares FROM li GROUP BY 1""", "li"))
def _(spark, sf_dir):
    spec = {"s": ("sum", "l_quantity"), "n": ("count", None), "lo": ("min", "l_shipdate"), "hi": ("max", "l_shipdate"), "bits": ("bit_or", "l_linenumber"), "mean": ("avg_int", "l_quantity"), "parts": ("count_distinct", "l_partkey"), "squares": ("sum_squares", "l_quantity")}
    return _table(spark, sf_dir, "lineitem").aggregate(["l_suppkey"], spec).df


@_query("aggregate_global", sql("SELECT CAST(sum(o_totalprice) AS BIGINT) AS s, count(*) AS n FROM o", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").aggregate([], {"s": ("sum", "o_totalprice"), "n": ("count", None)}).df


@_query("aggregate_having", sql("SELECT o_custkey, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 15", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").aggregate(["o_custkey"], {"n": ("count", None)}).filter(F.col("n") >= 15).df


@_query("aggregate_conditional", sql("SELECT l_shipmode, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS back FROM li GROUP BY 1", "li"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").with_columns(flagged=fn.multiplex(F.col("l_returnflag") == "R", 0, "l_quantity"))
    return t.aggregate(["l_shipmode"], {"back": ("sum", "flagged")}).df


@_query("window_prefix_by_key", sql("SELECT event_id, CAST(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").window_aggregate(["user_id"], {"s": ("sum", "value"), "m": ("max", "value")}, ["ts", "event_id"]).select("event_id", "s", "m").df


@_query("window_suffix_by_key", sql("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").window_aggregate(["user_id"], {"m": ("min", "value")}, ["ts", "event_id"], "suffix").select("event_id", "m").df


@_query("window_group_broadcast", sql("SELECT event_id, min(value) OVER (PARTITION BY user_id) AS least FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").group_broadcast(["user_id"], {"least": ("min", "value")}).select("event_id", "least").df


@_query("window_first_value", sql("SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").first_value(["user_id"], "value", ["ts", "event_id"], "f").select("event_id", "f").df


@_query("window_shift", sql("SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM ev", "ev"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "events").shift("ts", 1, ["ts", "event_id"], ["user_id"], "before")
    return t.with_columns(gap=F.col("ts") - F.col("before")).select("event_id", "gap").df


@_query("window_mark_distinct", sql("SELECT event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS first FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").mark_distinct(["event_type"], "first", ["ts", "event_id"], ["user_id"]).select("event_id", "first").df


@_query("prefix_sum", sql("SELECT o_orderkey, CAST(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM o", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").prefix_sum("o_totalprice", "o_orderkey", "upto").select("o_orderkey", "upto").df


@_query("suffix_sum", sql("SELECT o_orderkey, CAST(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS onward FROM o", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").prefix_sum("o_totalprice", "o_orderdate", "onward", reverse=True, tie=["o_orderkey"]).select("o_orderkey", "onward").df


@_query("tumbling_window", sql(f"SELECT ts // {6 * HOUR} AS w, event_type, count(*) AS n FROM ev GROUP BY 1, 2", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").tumbling_window("ts", 6 * HOUR, "w").aggregate(["w", "event_type"], {"n": ("count", None)}).df


@_query("gap_session_window", sql(f"""SELECT event_id, max(CASE WHEN start THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > {8 * HOUR}, true) AS start FROM ev)""", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").gap_session_window(["user_id"], "ts", "session", 8 * HOUR).select("event_id", "session").df


@_query("threshold_session_window", sql("""SELECT event_id, max(CASE WHEN start THEN ts ELSE -1 END) OVER (PARTITION BY user_id, over5 ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, over5 AND NOT coalesce(lag(over5) OVER (PARTITION BY user_id ORDER BY ts), false) AS start FROM (SELECT *, value > 5000 AS over5 FROM ev)) QUALIFY over5""", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").threshold_session_window(["user_id"], "value", "ts", "session", 5000).select("event_id", "session").df


@_query("gap_session_global", sql(f"""SELECT event_id, coalesce(max(CASE WHEN start THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), -1) AS session FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts, user_id, event_id) > {HOUR} // 6, true) AS start FROM ev)""", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").gap_session_window(["user_id"], "ts", "session", HOUR // 6, mode="global").select("event_id", "session").df


@_query("threshold_session_global", sql("""SELECT event_id, max(CASE WHEN start THEN ts ELSE -1 END) OVER (PARTITION BY user_id, over5 ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, over5 AND NOT coalesce(lag(over5) OVER (ORDER BY ts, user_id), true) AS start FROM (SELECT *, value > 5000 AS over5 FROM ev)) QUALIFY over5 AND session > 0""", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").threshold_session_window(["user_id"], "value", "ts", "session", 5000, mode="global").select("event_id", "session").df


@_query("mark_distinct_global", sql("SELECT event_id, CASE WHEN event_type = lag(event_type) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS first FROM ev", "ev"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").mark_distinct(["event_type"], "first", ["ts", "event_id"]).select("event_id", "first").df


@_query("csv_round_trip", sql("SELECT o_orderkey, o_custkey, o_totalprice, 0 AS missing FROM o", "o"))
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/orders-{uuid4().hex}.csv"
    write_csv(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return read_csv(spark, path, ["o_orderkey", "o_custkey", "o_totalprice", "missing"]).with_columns(missing=F.col("missing").cast("int")).df


@_query("generated_tables", """SELECT * FROM (VALUES ('customer', 1500, 1500), ('orders', 15000, 15000), ('part', 2000, 2000), ('supplier', 100, 100), ('partsupp', 8000, 2000), ('nation', 25, 25), ('region', 5, 5)) v(name, n_rows, n_keys)""")
def _(spark, sf_dir):
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "partsupp": "ps_partkey", "nation": "n_nationkey", "region": "r_regionkey"}
    made = generate_tpch(spark, 0.01)
    counts = [made[t].agg(F.lit(t).alias("name"), F.count(F.lit(1)).cast("int").alias("n_rows"), F.count_distinct(k).cast("int").alias("n_keys")) for t, k in keys.items()]
    return reduce(DataFrame.unionByName, counts)


@_query("generated_one_to_one", "SELECT CAST(500 AS BIGINT) AS n, CAST(sum(90000 + (k // 10) % 20001 + 100 * (k % 1000)) AS BIGINT) AS prices FROM range(500) t(k)")
def _(spark, sf_dir):
    made = generate_one_to_one(spark, 500)
    li = Table(made["lineitem"]).with_columns(price=fn.int_div("l_extendedprice", F.col("l_quantity")))
    both = Table(made["orders"]).rename("o_orderkey", "l_orderkey").inner_join(li, ["l_orderkey"], assert_unique=True)
    found = Table(made["part"]).rename("p_partkey", "l_partkey").inner_join(both, ["l_partkey"], assert_unique=True)
    return found.aggregate([], {"n": ("count", None), "prices": ("sum", "price")}).df


@_query("join_inner_copy", sql("SELECT o_orderkey, o_custkey, c_nationkey FROM o JOIN c ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "o", "c"))
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").rename("c_custkey", "o_custkey")
    return c.inner_join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ("c_nationkey",), assert_unique=True).df


@_query("join_inner_aggregated", sql("SELECT o_custkey, c_nationkey, CAST(sum(o_totalprice) AS BIGINT) AS s, count(*) AS n FROM o JOIN c ON o_custkey = c_custkey GROUP BY 1, 2", "o", "c"))
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").rename("c_custkey", "o_custkey")
    return c.inner_join(_table(spark, sf_dir, "orders"), ["o_custkey"], ("c_nationkey",), {"s": ("sum", "o_totalprice"), "n": ("count", None)}).df


_OUTER_R = "(SELECT o_custkey, o_orderkey, o_totalprice FROM o WHERE o_orderdate >= 11300)"


def _outer(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey", "c_nationkey", "c_acctbal").rename("c_custkey", "o_custkey")
    o = _table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= 11_300).select("o_custkey", "o_orderkey", "o_totalprice")
    return c, o


@_query("join_left_outer", sql(f"""SELECT c_custkey AS o_custkey, CASE WHEN o_orderkey IS NULL THEN c_nationkey ELSE 0 END AS c_nationkey, c_acctbal, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice
  FROM c LEFT JOIN {_OUTER_R} x ON c_custkey = x.o_custkey WHERE c_mktsegment <> 'BUILDING'""", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.left_outer_join(o, ["o_custkey"], ("c_acctbal",)).df


@_query("join_left_outer_counted", sql(f"SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, c_acctbal, CASE WHEN count(o_orderkey) = 0 THEN c_nationkey ELSE 0 END AS c_nationkey FROM c LEFT JOIN {_OUTER_R} x ON c_custkey = x.o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY c_custkey, c_acctbal, c_nationkey", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.left_outer_join(o, ["o_custkey"], ("c_acctbal",), {"n": ("count", None)}).df


@_query("join_right_outer", sql(f"SELECT x.o_custkey, o_orderkey, o_totalprice, coalesce(c_acctbal, 0) AS c_acctbal FROM {_OUTER_R} x LEFT JOIN c ON c_custkey = x.o_custkey AND c_mktsegment <> 'BUILDING'", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.right_outer_join(o, ["o_custkey"], ("c_acctbal",)).df


@_query("join_full_outer", sql(f"""SELECT c_custkey AS o_custkey, c_nationkey, c_acctbal, 0 AS o_orderkey, 0 AS o_totalprice FROM c WHERE c_mktsegment <> 'BUILDING' UNION ALL
  SELECT x.o_custkey, 0, coalesce(c_acctbal, 0), o_orderkey, o_totalprice FROM {_OUTER_R} x LEFT JOIN c ON c_custkey = x.o_custkey AND c_mktsegment <> 'BUILDING'""", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.full_outer_join(o, ["o_custkey"], ("c_acctbal",)).df


@_query("join_full_sql", sql(f"SELECT coalesce(c_custkey, x.o_custkey) AS o_custkey, c_acctbal, o_orderkey, o_totalprice FROM (SELECT * FROM c WHERE c_mktsegment <> 'BUILDING') FULL JOIN {_OUTER_R} x ON c_custkey = x.o_custkey", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.drop("c_nationkey").full_join(o, ["o_custkey"]).df


@_query("join_semi", sql(f"SELECT c_custkey FROM c WHERE c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM {_OUTER_R})", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.semi_join(o, ["o_custkey"]).select("o_custkey").rename("o_custkey", "c_custkey").df


@_query("join_anti", sql(f"SELECT c_custkey FROM c WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM {_OUTER_R})", "c", "o"))
def _(spark, sf_dir):
    c, o = _outer(spark, sf_dir)
    return c.anti_join(o, ["o_custkey"]).select("o_custkey").rename("o_custkey", "c_custkey").df


@_query("join_unique", sql("SELECT c_custkey, c_acctbal, s_suppkey + s_nationkey AS b FROM c JOIN s ON c_custkey = s_suppkey", "c", "s"))
def _(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").with_columns(c_custkey=F.col("s_suppkey"), b=F.col("s_suppkey") + F.col("s_nationkey")).select("c_custkey", "b")
    return _table(spark, sf_dir, "customer").unique_join(s, ["c_custkey"], ("c_acctbal",), assert_unique=True).df


@_query("join_compound", sql("SELECT ps_partkey, ps_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM li JOIN ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE ps_availqty > 9000 GROUP BY 1, 2", "li", "ps"))
def _(spark, sf_dir):
    from tessera.sources.generate import partsupp

    ps = Table(partsupp(load(spark, sf_dir, "lineitem"))).filter(F.col("ps_availqty") > 9000)
    li = _table(spark, sf_dir, "lineitem").rename("l_partkey", "ps_partkey").rename("l_suppkey", "ps_suppkey")
    return ps.inner_join(li, ["ps_partkey", "ps_suppkey"], aggs={"q": ("sum", "l_quantity")}).df


@_query("join_scalar", sql("SELECT o_orderkey FROM o WHERE o_totalprice > (SELECT 3 * (sum(o_totalprice) // count(*)) // 2 FROM o)", "o"))
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    mean = o.aggregate([], {"mean": ("avg_int", "o_totalprice")})
    return mean.scalar_join(o, ("mean",)).filter(F.col("o_totalprice") > fn.int_div(3 * F.col("mean"), 2)).select("o_orderkey").df


@_query("join_many_to_many", sql("SELECT CAST(count(*) AS BIGINT) AS n FROM c JOIN s ON c_nationkey = s_nationkey", "c", "s"))
def _(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer").rename("c_nationkey", "k"), _table(spark, sf_dir, "supplier").rename("s_nationkey", "k")
    return c.many_to_many_join(s, ["k"]).aggregate([], {"n": ("count", None)}).df


@_query("join_count_pairs", sql("SELECT s_nationkey AS k, count(*) AS pairs FROM c JOIN s ON c_nationkey = s_nationkey GROUP BY 1", "c", "s"))
def _(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer").rename("c_nationkey", "k"), _table(spark, sf_dir, "supplier").rename("s_nationkey", "k")
    return c.count_pairs(s, ["k"]).df


@_query("concat", sql("SELECT c_custkey AS k, c_acctbal AS bal, c_cntrycode, 0 AS tid FROM c UNION ALL SELECT s_suppkey, s_acctbal, 0, 1 FROM s", "c", "s"))
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_cntrycode").rename("c_custkey", "k").rename("c_acctbal", "bal")
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").rename("s_suppkey", "k").rename("s_acctbal", "bal")
    return c.concat(s, "tid").df


def _nations(spark, sf_dir):
    return _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 900_000).select("c_nationkey").rename("c_nationkey", "k"), _table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") < 12).select("s_nationkey").rename("s_nationkey", "k")


for _name, _word in (("union", "UNION"), ("intersect", "INTERSECT"), ("subtract", "EXCEPT")):

    @_query(f"set_{_name}", sql(f"SELECT c_nationkey AS k FROM c WHERE c_acctbal > 900000 {_word} SELECT s_nationkey FROM s WHERE s_nationkey < 12", "c", "s"))
    def _(spark, sf_dir, name=_name):
        a, b = _nations(spark, sf_dir)
        return getattr(a, name)(b).df


@_query("distinct", sql("SELECT DISTINCT o_custkey, o_orderstatus FROM o", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").distinct(["o_custkey", "o_orderstatus"]).df


@_query("scalar_bits", sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_partkey & 7 AS low, l_partkey | 8 AS up, xor(l_partkey, l_suppkey) AS x, ~l_partkey AS inv, l_partkey << 3 AS sl, l_partkey >> 2 AS sr,
  bit_count(l_partkey) % 2 AS par, -(l_partkey & 1) AS mask, 1 - (l_partkey & 1) AS nt FROM li""", "li"))
def _(spark, sf_dir):
    k = F.col("l_partkey")
    t = _table(spark, sf_dir, "lineitem")
    return t.with_columns(low=fn.keep_bits(k, 7), up=fn.set_bits(k, 8), x=k.bitwiseXOR(F.col("l_suppkey")), inv=F.bitwise_not(k), sl=fn.shift_left(k, 3), sr=fn.shift_right(k, 2), par=fn.bit_parity(k), mask=fn.bit_mask(k), nt=fn.logical_not(k)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "low", "up", "x", "inv", "sl", "sr", "par", "mask", "nt").df


@_query("scalar_division", sql("SELECT c_custkey, c_acctbal // 700 AS q, CAST(floor(c_acctbal / 700.0) AS BIGINT) AS f, c_acctbal // nullif(c_cntrycode - 50, 0) AS by_col, c_acctbal < 0 AS neg FROM c", "c"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    return t.with_columns(q=fn.int_div("c_acctbal", 700), f=fn.floor_div("c_acctbal", 700), by_col=fn.int_div("c_acctbal", F.col("c_cntrycode") - 50), neg=fn.is_negative("c_acctbal")).select("c_custkey", "q", "f", "by_col", "neg").df


@_query("scalar_fixed_point", sql("SELECT p_partkey, (p_retailprice * p_size) >> 16 AS m, (p_retailprice << 16) // (p_size + 1) AS d FROM p", "p"))
def _(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    return t.with_columns(m=fn.fixed_mul("p_retailprice", "p_size"), d=fn.fixed_div("p_retailprice", F.col("p_size") + 1)).select("p_partkey", "m", "d").df


@_query("scalar_wrap", sql("SELECT o_orderkey, ((o_totalprice + 128) % 256 + 256) % 256 - 128 AS b FROM o", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").with_columns(b=fn.wrap("o_totalprice", "byte").cast("long")).select("o_orderkey", "b").df


@_query("scalar_histogram", sql("SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 250000 THEN 1 WHEN c_acctbal < 500000 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM c GROUP BY 1", "c"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "customer").with_columns(bucket=fn.bucket_by_bounds("c_acctbal", [0, 250_000, 500_000])).aggregate(["bucket"], {"n": ("count", None)}).df


@_query("dot_product_chunks", sql("SELECT o_orderkey // 64 AS chunk, CAST(sum(o_totalprice * o_comment) AS BIGINT) AS dot FROM o GROUP BY 1", "o"))
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").dot_product("o_totalprice", "o_comment", "o_orderkey", 64).df


@_query("dot_product_arrays", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 65536) AS BIGINT) * CAST(round(CAST(x AS DOUBLE) * 65536) AS BIGINT))) AS BIGINT) AS norm FROM embeddings")
def _(spark, sf_dir):
    x = F.transform("embedding", lambda v: fn.fixed_from_double(v.cast("double")))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(F.zip_with(x, x, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v).alias("norm"))
