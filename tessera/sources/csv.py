"""CSV files of integers with a header."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.table import Table


class BadHeader(ValueError):
    """A file names a column that the schema lacks."""


def read_csv(spark: SparkSession, path: str, columns: list[str], rows: int | None = None, order: list[str] | None = None) -> Table:
    """The file's columns as BIGINT; columns that it lacks are 0, columns that the schema lacks raise ``BadHeader``.

    With ``rows`` the table has that many: the first ones in ``order`` (default:
    by all columns), or all and invalid rows of zeros.  The header is read first,
    one line.
    """
    header = spark.read.option("header", True).csv(path).columns
    if unknown := [c for c in header if c not in columns]:
        raise BadHeader(f"{path}: unknown columns {unknown}")
    schema = ", ".join(f"`{c}` long" for c in header)
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    table = Table(df.select(*[F.col(c) if c in header else F.lit(0).cast("long").alias(c) for c in columns]))
    return table if rows is None else table.resize(rows, order)


def write_csv(table: Table, path: str) -> None:
    """The valid rows, as a folder of CSV files with a header."""
    table.df.write.mode("error").option("header", True).csv(path)
