"""An immutable table: a DataFrame and, until rows are moved, a column that says which rows are valid.

``filter`` only narrows the validity, so an analysis can start again with
``revalidate``; projections carry it along.  Operators that move rows (joins,
sorts, aggregates, windows) apply it first as a plain filter, which the optimiser
pushes down to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate_column
from tessera.operators import joins, windows

#: Holds the validity of rows in projections, and of rows that ``resize`` adds.
HIDDEN = "__valid"
#: (aggregate name, input column or None) by output column.
Spec = Mapping[str, tuple[str, str | None]]


class Table(joins.Joins, windows.Windows):
    def __init__(self, df: DataFrame, valid: Column | None = None, name: str = ""):
        self._base, self._valid, self.name = df, valid, name

    # -- making and opening ---------------------------------------------------

    @staticmethod
    def from_columns(spark: SparkSession, columns: Mapping[str, Iterable[int]], name: str = "") -> Table:
        """A table of equally long integer columns."""
        lists = {k: list(v) for k, v in columns.items()}
        if len({len(v) for v in lists.values()}) > 1:
            raise ValueError("columns differ in length")
        schema = ", ".join(f"`{k}` long" for k in lists)
        return Table(spark.createDataFrame(list(zip(*lists.values(), strict=True)), schema), name=name)

    @staticmethod
    def zeros(spark: SparkSession, columns: list[str], rows: int, name: str = "") -> Table:
        return Table(spark.range(rows).select(*[F.lit(0).cast("long").alias(c) for c in columns]), name=name)

    @property
    def df(self) -> DataFrame:
        """The valid rows."""
        return (self._base if self._valid is None else self._base.where(self._valid)).drop(HIDDEN)

    @property
    def valid(self) -> Column:
        return F.lit(True) if self._valid is None else self._valid

    @property
    def columns(self) -> list[str]:
        return [c for c in self._base.columns if c != HIDDEN]

    @property
    def schema(self):
        return self._base.drop(HIDDEN).schema

    def count(self) -> int:
        return self.df.count()

    def open(self, remove_invalid: bool = True) -> tuple[list[list], list[str]]:
        """(columns, names), names in alphabetical order.  Brings the whole result to the driver."""
        names = sorted(self.columns)
        rows = (self.df if remove_invalid else self._base).select(*names).collect()
        return [[r[i] for r in rows] for i in range(len(names))], names

    @staticmethod
    def column_of(opened: tuple[list[list], list[str]], name: str) -> list:
        return opened[0][opened[1].index(name)]

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def _new(self, df: DataFrame, valid: Column | None = None) -> Table:
        return Table(df, valid, self.name)

    # -- validity -------------------------------------------------------------

    def filter(self, condition: Column) -> Table:
        """Rows where the condition is true stay valid; where it is null they don't."""
        kept = F.coalesce(condition, F.lit(False))
        return self._new(self._base, kept if self._valid is None else self._valid & kept)

    def revalidate(self) -> Table:
        """All rows valid again, whatever was filtered since rows were last moved."""
        return self._new(self._base.drop(HIDDEN))

    def mask(self, value: int = 2**63 - 1) -> Table:
        """Invalid rows stay, with ``value`` in every column."""
        if self._valid is None:
            return self
        return self._new(self._base.select(*[F.when(self._valid, F.col(c)).otherwise(F.lit(value).cast(t)).alias(c) for c, t in self._base.dtypes if c != HIDDEN]))

    def finalize(self, shuffle: bool = True, seed: int = 0) -> Table:
        """Only valid rows, in random order."""
        out = self._new(self.df)
        return out.shuffle(seed) if shuffle else out

    # -- shaping --------------------------------------------------------------

    def _project(self, change) -> Table:
        """``change`` applied to all rows, invalid ones too, with their validity in a hidden column."""
        if self._valid is None:
            return self._new(change(self._base))
        return self._new(change(self._base.withColumn(HIDDEN, self._valid)), F.col(HIDDEN))

    def select(self, *names: str) -> Table:
        return self._project(lambda df: df.select(*names, *([HIDDEN] if self._valid is not None else [])))

    def with_columns(self, **exprs: Column) -> Table:
        return self._project(lambda df: df.withColumns(exprs))

    def add_columns(self, *names: str) -> Table:
        """New columns of zeros."""
        if clash := set(names) & set(self.columns):
            raise ValueError(f"columns exist: {sorted(clash)}")
        return self.with_columns(**{c: F.lit(0).cast("long") for c in names})

    def drop(self, *names: str) -> Table:
        return self._project(lambda df: df.drop(*names))

    def rename(self, old: str, new: str) -> Table:
        if old not in self.columns or new in self.columns:
            raise ValueError(f"cannot rename {old} to {new}")
        return self._project(lambda df: df.withColumnRenamed(old, new))

    def zero(self, *names: str) -> Table:
        return self.with_columns(**{c: F.lit(0).cast(dict(self._base.dtypes)[c]) for c in names})

    def copy_column(self, source: str, target: str) -> Table:
        return self.with_columns(**{target: F.col(source)})

    # -- order ----------------------------------------------------------------

    @staticmethod
    def _pairs(spec: Iterable[tuple[str, str] | str]) -> list[tuple[str, str]]:
        """(column, ``asc`` or ``desc``) of each part of an order."""
        pairs = [(s, "asc") if isinstance(s, str) else s for s in spec]
        return [(c, "desc" if d.lower().startswith("d") else "asc") for c, d in pairs]

    @classmethod
    def _order(cls, spec: Iterable[tuple[str, str] | str], reverse: bool = False) -> list[Column]:
        """Sort columns; nulls come first in ascending and last in descending order, so that the reverse is exact."""
        return [F.desc(c) if (d == "desc") != reverse else F.asc(c) for c, d in cls._pairs(spec)]

    def sort(self, spec: Iterable[tuple[str, str] | str]) -> Table:
        """Sorted by (column, direction) pairs.  Rows that tie come in no fixed order: name a last key that differs."""
        return self._new(self.df.orderBy(*self._order(spec)))

    def head(self, n: int, order: Iterable[tuple[str, str] | str]) -> Table:
        """The first ``n`` rows in an order; a top-k, without a full sort."""
        return self._new(self.df.orderBy(*self._order(order)).limit(n))

    def tail(self, n: int, order: Iterable[tuple[str, str] | str]) -> Table:
        """The last ``n`` rows in an order."""
        return self.head(n, [(c, "asc" if d == "desc" else "desc") for c, d in self._pairs(order)])

    def resize(self, n: int, order: Iterable[tuple[str, str] | str] | None = None) -> Table:
        """``n`` rows: the first ones, or all and as many rows of zeros as are missing, which are invalid."""
        have = self.count()
        if n <= have:
            return self.head(n, order or sorted(self.columns))
        spark = self._base.sparkSession
        rows = self.df.withColumn(HIDDEN, F.lit(True))
        pad = spark.range(n - have).select(*[F.lit(0).cast(t).alias(c) for c, t in self._base.dtypes if c != HIDDEN], F.lit(False).alias(HIDDEN))
        return self._new(rows.unionByName(pad), F.col(HIDDEN))

    def pad_power_of_two(self) -> Table:
        return self.resize(1 << self.count().bit_length())

    def shuffle(self, seed: int = 0) -> Table:
        return self._new(self.df.orderBy(F.rand(seed)))

    def row_slice(self, order: Iterable[tuple[str, str] | str], start: int = 0, stop: int | None = None, step: int = 1) -> Table:
        """Every ``step``-th row from ``start`` on and before ``stop``, by place in an order.

        Places come from ranks within ranges of the order, not from one global window.
        """
        placed = windows.with_position(self.df, self._order(order), "__place")
        place = F.col("__place")
        keep = (place >= start) & ((place - start) % step == 0)
        return self._new(placed.where(keep if stop is None else keep & (place < stop)).drop("__place"))

    def repeat(self, times: int) -> Table:
        """Each row ``times`` times."""
        return self._new(self.df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__k") if times > 0 else self.df.limit(0))

    # -- aggregation ------------------------------------------------------------

    def aggregate(self, keys: list[str], spec: Spec) -> Table:
        """One row for each key, with out = (aggregate, column).

        Without keys one row, also for an empty table.  The sums are partial
        before the shuffle, so a frequent key is no burden.
        """
        columns = [aggregate_column(fn, c).alias(out) for out, (fn, c) in spec.items()]
        return self._new(self.df.groupBy(*keys).agg(*columns) if keys else self.df.agg(*columns))

    def distinct(self, keys: list[str]) -> Table:
        """One row for each key; which one is open."""
        return self._new(self.df.dropDuplicates(keys))

    def concat(self, other: Table, id_column: str | None = None) -> Table:
        """All rows of both, by column name; a column that one side lacks is 0 there."""
        a, b = self.df, other.df
        if id_column:
            a, b = a.withColumn(id_column, F.lit(0)), b.withColumn(id_column, F.lit(1))
        missing = (set(a.columns) ^ set(b.columns))
        return self._new(a.unionByName(b, allowMissingColumns=True).fillna(0, subset=sorted(missing)) if missing else a.unionByName(b))

    def union(self, other: Table) -> Table:
        return self._new(self.concat(other).df.distinct())

    def intersect(self, other: Table) -> Table:
        return self._new(self.df.intersect(other.df.select(*self.columns)))

    def subtract(self, other: Table) -> Table:
        return self._new(self.df.subtract(other.df.select(*self.columns)))

    def dot_product(self, a: str, b: str, index: str, size: int, out: str = "dot") -> Table:
        """Sum of a * b over each run of ``size`` indexes: columns ``chunk`` and ``out``."""
        chunk = F.call_function("div", F.col(index).cast("long"), F.lit(size).cast("long"))
        return self._new(self.df.groupBy(chunk.alias("chunk")).agg(F.sum(F.col(a) * F.col(b)).alias(out)))
