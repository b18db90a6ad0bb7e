"""Windows over an order: running sums, first values, tumbling and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate_column
from tessera.functions.scalar import floor_div
from tessera.storage import checkpointed



def with_ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in the ranges of an order of all rows: ``__part``, the number of a row's range, and ``__rank``, its place there from 0 on.

    There are as many ranges as shuffle partitions (``spark.sql.shuffle.partitions``).
    Bounds are sampled, so they may fall otherwise when a task runs again or
    another branch of a plan asks for other columns; hence the ranged rows are
    written once, and all that uses them reads the same numbers.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return checkpointed(dealt).withColumns({"__part": F.shiftright("__at", 33), "__rank": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def with_position(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with each row's place, from 0 on, in an order of all rows.

    Places within a range are added to the number of rows in the ranges before
    it, a table with a row for each range.
    """
    ranked = with_ranks(df, order)
    sizes = ranked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranked.join(F.broadcast(before), "__part").withColumn(out, F.col("__rank") + F.col("__before")).drop("__part", "__rank", "__before")


def with_previous(df: DataFrame, order: list[Column], columns: list[str], out: str) -> DataFrame:
    """``df`` with the ``columns`` of the row before in an order of all rows as a struct, null in the first row.

    Within a range that is the row before; the first row of a range gets the last
    one of the range before, from a table with a row for each range.
    """
    ranked = with_ranks(df, order)
    held = F.struct(*columns)
    last = ranked.groupBy("__part").agg(F.max_by(held, "__rank").alias("__held"))
    edge = last.select("__part", F.lag("__held").over(Window.orderBy("__part")).alias("__edge"))
    inner = F.lag(held).over(Window.partitionBy("__part").orderBy("__rank"))
    return ranked.join(F.broadcast(edge), "__part").withColumn(out, F.when(F.col("__rank") == 0, F.col("__edge")).otherwise(inner)).drop("__part", "__rank", "__edge")


def joined_by_group(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` beside the row of ``groups`` with the same keys, null keys included."""
    right = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(right, same).drop(*[f"__{k}" for k in keys])


class Windows:
    """Mixed into ``Table``."""

    def window_aggregate(self, keys: list[str], spec, order: list, direction: str = "prefix"):
        """Every row with aggregates of its group: of the rows up to it (``prefix``), from it on (``suffix``), or of all (``all``).

        A suffix is the prefix of the reversed order, which is summed in one go;
        ``copy`` is the first row of the frame, for a suffix the row itself.
        Whole groups are aggregated before they are shuffled and joined back, so a
        frequent key is no burden there; running aggregates walk a key in one task.
        """
        if direction == "all":
            return self.group_broadcast(keys, spec)
        w = Window.partitionBy(*keys).orderBy(*self._order(order, reverse=direction == "suffix")).rowsBetween(Window.unboundedPreceding, 0)
        own = lambda fn, c: F.col(c) if direction == "suffix" and fn == "copy" else aggregate_column(fn, c).over(w)
        return self._new(self.df.withColumns({out: own(fn, c) for out, (fn, c) in spec.items()}))

    def group_broadcast(self, keys: list[str], spec):
        """Every row with the aggregates of its whole group."""
        df = self.df
        groups = df.groupBy(*keys).agg(*[aggregate_column(fn, c).alias(out) for out, (fn, c) in spec.items()])
        return self._new(joined_by_group(df.drop(*[c for c in spec if c not in keys]), groups, keys))

    def first_value(self, keys: list[str], column: str, order: list, out: str | None = None):
        """Every row with its group's first value in an order.

        Where all directions are the same, the value is an aggregate that is joined
        back, else a window walks each group.
        """
        df, out = self.df, out or column
        ways = {d for _, d in self._pairs(order)}
        if len(ways) == 1:
            at = F.struct(*[c for c, _ in self._pairs(order)])
            groups = df.groupBy(*keys).agg((F.min_by if ways == {"asc"} else F.max_by)(column, at).alias("__first"))
            return self._new(joined_by_group(df, groups, keys).withColumn(out, F.col("__first")).drop("__first"))
        w = Window.partitionBy(*keys).orderBy(*self._order(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self._new(df.withColumn(out, F.first(column).over(w)))

    def mark_distinct(self, keys: list[str], out: str, order: list, within: list[str] = ()):
        """1 in rows whose keys differ from the row before in an order, else 0: the first of each run.

        ``within`` names keys that runs may not cross; without any the order is
        over the whole table, in ranges.
        """
        if within:
            w = Window.partitionBy(*within).orderBy(*self._order(order))
            held = self.df.withColumn("__before", F.lag(F.struct(*keys)).over(w))
        else:
            held = with_previous(self.df, self._order(order), list(keys), "__before")
        same = F.col("__before").isNotNull()
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("__before")[k])
        return self._new(held.withColumn(out, (~same).cast("int")).drop("__before"))

    def shift(self, column: str, by: int, order: list, within: list[str], out: str):
        """Each row with the value ``by`` rows before (negative: after) in its group."""
        return self._new(self.df.withColumn(out, F.lag(column, by).over(Window.partitionBy(*within).orderBy(*self._order(order)))))

    def prefix_sum(self, column: str, order: str, out: str | None = None, partition_by: list[str] | None = None, reverse: bool = False, tie: list[str] = ()):
        """Running sum in the order of a numeric column, ties by ``tie``; ``reverse``: the sum of the row and all after it.

        Without ``partition_by`` the order is cut into ranges.  Each range is
        summed on its own and the totals of the ranges before it are added, so no
        task has to walk the whole table.
        """
        out = out or column
        spec = self._order([order, *tie], reverse)
        up_to = (Window.unboundedPreceding, 0)
        if partition_by:
            return self._new(self.df.withColumn(out, F.sum(column).over(Window.partitionBy(*partition_by).orderBy(*spec).rowsBetween(*up_to))))
        dealt = with_ranks(self.df, spec)
        inner = dealt.withColumn("__sum", F.sum(column).over(Window.partitionBy("__part").orderBy("__rank").rowsBetween(*up_to)))
        totals = dealt.groupBy("__part").agg(F.sum(column).alias("__total"))  # a row for each range
        before = F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select("__part", F.coalesce(before, F.lit(0)).alias("__carried"))
        total = F.coalesce("__sum", F.lit(0)) + F.col("__carried")
        known = F.col("__sum").isNotNull() | (F.col("__carried") != 0)
        return self._new(inner.join(F.broadcast(carried), "__part").withColumn(out, F.when(known, total)).drop("__part", "__rank", "__sum", "__carried"))

    # -- windows over time --------------------------------------------------------

    def tumbling_window(self, time: str, size: int, out: str):
        """The number of the window of ``size`` that a time lies in."""
        return self.with_columns(**{out: floor_div(time, size)})

    def gap_session_window(self, keys: list[str], time: str, out: str, gap: int, mode: str = "per_key"):
        """The first time of each row's session; a session ends where more than ``gap`` passes.

        ``per_key``: each key's rows by themselves.  ``global``: a gap is sought in
        the order of all rows, which is cut into ranges, and rows before their key's
        first session start get -1.
        """
        by_key = Window.partitionBy(*keys).orderBy(time)
        if mode == "per_key":
            held, before = self.df, F.lag(time).over(by_key)
        else:
            held = with_previous(self.df, self._order([time, *keys]), [time], "__before")
            before = F.col("__before")[time]
        start = before.isNull() | (F.col(time) - before > gap)
        marked = held.withColumn("__start", F.when(start, F.col(time)).otherwise(F.lit(-1) if mode == "global" else F.lit(None)))
        running = F.max("__start").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
        return self._new(marked.withColumn(out, running).drop("__start", "__before"))

    def threshold_session_window(self, keys: list[str], value: str, time: str, out: str, threshold: int, keep_only_sessions: bool = True, mode: str = "per_key"):
        """The first time of each run of rows whose value is over ``threshold``; -1 in other rows.

        ``per_key``: runs within each key.  ``global``: a run starts only where the
        row before, of all rows, is not over; a run without such a start gets -1.
        """
        over = F.coalesce(F.col(value) > threshold, F.lit(False))
        held = self.df.withColumn("__over", over)
        by_key = Window.partitionBy(*keys).orderBy(time)
        if mode == "per_key":
            start = F.col("__over") & ~F.coalesce(F.lag("__over").over(by_key), F.lit(False))
        else:
            held = with_previous(held, self._order([time, *keys]), ["__over"], "__before")
            start = F.col("__over") & ~F.coalesce(F.col("__before")["__over"], F.lit(True))
        marked = held.withColumn("__start", F.when(start, F.col(time)).otherwise(F.lit(-1)))
        running = F.max("__start").over(Window.partitionBy(*keys, "__over").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
        found = marked.withColumn(out, F.when(F.col("__over"), running).otherwise(F.lit(-1))).drop("__start", "__over", "__before")
        return self._new(found.where(F.col(out) > 0) if keep_only_sessions else found)
