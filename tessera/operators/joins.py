"""Joins of a side with unique keys (left) and a side that refers to it (right).

The left side contributes only the columns named in ``copy``, zeros stand for
missing numbers (missing strings and dates stay null), and ``aggs`` fuses a group-by of the right side: it is
aggregated by key before the join, so the join sees one row for each key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate_column


class DuplicateKeys(ValueError):
    """The left side of a join holds a key more than once."""


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise DuplicateKeys(f"keys {keys} are not unique")


def _zeros(df: DataFrame, columns: list[str], fill: int | None) -> DataFrame:
    return df if fill is None or not columns else df.fillna(fill, subset=columns)


class Joins:
    """Mixed into ``Table``."""

    def _sides(self, right, keys: list[str], aggs: Mapping | None, check: bool) -> tuple[DataFrame, DataFrame]:
        left, r = self.df, right.df
        if check:
            assert_unique(left, keys)
        if aggs:
            r = r.groupBy(*keys).agg(*[aggregate_column(fn, c).alias(out) for out, (fn, c) in aggs.items()])
        return left, r

    def inner_join(self, right, keys: list[str], copy: tuple[str, ...] = (), aggs: Mapping | None = None, assert_unique: bool = False):
        """The right rows with a match; with ``aggs`` one row for each key that has a match."""
        left, r = self._sides(right, keys, aggs, assert_unique)
        return self._new(r.join(left.select(*keys, *copy), keys) if copy else r.join(left.select(*keys), keys, "left_semi"))

    def right_outer_join(self, right, keys: list[str], copy: tuple[str, ...] = (), aggs: Mapping | None = None, null_fill: int | None = 0, assert_unique: bool = False):
        """All right rows (with ``aggs`` one for each key); copied columns are ``null_fill`` without a match."""
        left, r = self._sides(right, keys, aggs, assert_unique)
        return self._new(_zeros(r.join(left.select(*keys, *copy), keys, "left"), list(copy), null_fill))

    def left_outer_join(self, right, keys: list[str], copy: tuple[str, ...] = (), aggs: Mapping | None = None, null_fill: int | None = 0, assert_unique: bool = False):
        """The right rows with a match, and the left rows without.

        Left columns are in the result.  Those that are not copied hold
        ``null_fill`` in matched rows; right columns hold it in unmatched rows.
        """
        left, r = self._sides(right, keys, aggs, assert_unique)
        own = [c for c in left.columns if c not in keys]
        if clash := set(own) & set(r.columns):
            raise ValueError(f"both sides have {sorted(clash)}; rename one")
        joined = left.join(r.withColumn("__matched", F.lit(True)), keys, "left")
        plain = [c for c in own if c not in copy]
        kept = joined.withColumns({c: F.when(F.col("__matched").isNull(), F.col(c)) for c in plain}).drop("__matched")
        return self._new(_zeros(kept, [c for c in kept.columns if c not in keys], null_fill))

    def full_outer_join(self, right, keys: list[str], copy: tuple[str, ...] = (), aggs: Mapping | None = None, null_fill: int | None = 0, assert_unique: bool = False):
        """All left rows and all right rows, matched or not; copied columns flow into matched right rows.  See ``full_join``."""
        left, _ = self._sides(right, keys, None, assert_unique)
        r = self.right_outer_join(right, keys, copy, aggs, null_fill).df
        both = left.unionByName(r, allowMissingColumns=True)
        return self._new(_zeros(both, [c for c in both.columns if c not in keys], null_fill))

    def full_join(self, right, keys: list[str], null_fill: int | None = None):
        """FULL JOIN as in SQL."""
        out = self.df.join(right.df, keys, "full")
        return self._new(_zeros(out, [c for c in out.columns if c not in keys], null_fill))

    def semi_join(self, right, keys: list[str]):
        """The left rows whose key the right side has."""
        return self._new(self.df.join(right.df.select(*keys), keys, "left_semi"))

    def anti_join(self, right, keys: list[str]):
        """The left rows whose key the right side lacks."""
        return self._new(self.df.join(right.df.select(*keys), keys, "left_anti"))

    def unique_join(self, right, keys: list[str], copy: tuple[str, ...] = (), assert_unique: bool = False):
        """The right rows whose key the left side has, both sides with unique keys: an intersection."""
        if assert_unique:
            from tessera.operators.joins import assert_unique as check

            check(right.df, keys)
        return self.inner_join(right, keys, copy, assert_unique=assert_unique)

    def scalar_join(self, right, copy: tuple[str, ...]):
        """Columns of this table, which has one row, beside every row of ``right``.

        The row is limited to one before it is broadcast.
        """
        return self._new(right.df.crossJoin(F.broadcast(self.df.select(*copy).limit(1))))

    def many_to_many_join(self, right, keys: list[str]):
        """All pairs with the same key, as in SQL."""
        return self._new(self.df.join(right.df, keys))

    def count_pairs(self, right, keys: list[str], out: str = "pairs", group: list[str] | None = None):
        """How many pairs with the same key there are by ``group`` (columns of the right side): counted before the join, never expanded."""
        counts = self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        by = group or keys
        mine = right.df.groupBy(*dict.fromkeys([*keys, *by])).agg(F.count(F.lit(1)).alias("__m"))
        return self._new(mine.join(counts, keys).groupBy(*by).agg(F.sum(F.col("__n") * F.col("__m")).alias(out)))
