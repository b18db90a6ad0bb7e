"""The integer tables for SQL: the same columns as ``tessera.sources.tables.load_integers``."""

VIEWS = {
    "li": """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS l_discount, CAST(round(l_tax * 100) AS BIGINT) AS l_tax,
        l_returnflag, l_linestatus, ship AS l_shipdate, ship + (l_orderkey * 3 + l_linenumber) % 60 - 30 AS l_commitdate, ship + (l_orderkey + l_linenumber * 7) % 29 + 1 AS l_receiptdate,
        (l_orderkey + l_linenumber) % 7 AS l_shipmode, (l_partkey + l_linenumber) % 4 AS l_shipinstruct
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS ship FROM lineitem)""",
    "o": """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice,
        date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS o_orderdate, o_orderpriority, o_orderkey % 16 AS o_comment FROM orders""",
    "c": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c_acctbal, c_mktsegment, c_custkey % 90 + 10 AS c_cntrycode FROM customer",
    "s": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS s_acctbal, s_suppkey % 16 AS s_comment FROM supplier",
    "p": """SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS p_retailprice,
        p_partkey % 40 + 1 AS p_container, p_partkey % 21 AS p_word FROM part""",
    "n": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "r": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
    "ps": """SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, (l_partkey * 31 + l_suppkey * 17) % 1000 + 1 AS ps_supplycost,
        (l_partkey * 7 + l_suppkey * 13) % 9999 + 1 AS ps_availqty FROM lineitem""",
    "ev": "SELECT event_id, user_id, event_type, epoch_us(ts) AS ts, CAST(round(value * 100) AS BIGINT) AS value FROM events",
}


def sql(query: str, *views: str) -> str:
    """A query after the views that it names."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + query
