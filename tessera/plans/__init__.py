"""Complete queries, each with the SQL that gives the same rows."""

from tessera.plans import operators, other, tpch

QUERIES = tpch.QUERIES | other.QUERIES | operators.QUERIES
ORACLE_SQL = tpch.ORACLE_SQL | other.ORACLE_SQL | operators.ORACLE_SQL
