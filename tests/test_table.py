import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import AGGREGATES, register_aggregate
from tessera.operators import DuplicateKeys, Table


def rows(t, *columns):
    return sorted(tuple(r) for r in t.df.select(*columns).collect())


def col(t, name):
    return sorted(r[0] for r in t.df.select(name).collect())


@pytest.fixture(scope="module")
def make(spark):
    return lambda **c: Table.from_columns(spark, c)


# -- joins ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def users(make):
    left = make(UID=[1, 2, 3, -5, 10], Zip=[12345, 67890, 11111, 98989, 22222], Age=[18, 22, 82, -10, 0], Amount2=[1111, 2222, 3333, 1040, 7777])
    right = make(
        UID=[1, 2, 3, 3, 2, 3, 3, 3, 3, 10, 3, 3, 3, 3, 4, 4, 4, 4, 4, -5, 10],
        Amount=[100, -30, 80, 9, 10, 18, 4, 5, 5, 7, 19, 8, 1, 2, 5, 6, 3, 3, 1, 8, 9],
        To=[2, 8, 7, 1, 8, 3, 1, 0, 3, 4, 8, 1, 0, 1, 9, 0, 3, 9, 7, 8, 3],
    )
    return left, right


def test_simple_inner_join(make):
    left, right = make(UID=[1, 2], Zipcode=[12345, 67890]), make(UID=[2, 2], Amount=[40, -60])
    out = left.inner_join(right, ["UID"], ("Zipcode",))
    assert rows(out, "UID", "Zipcode", "Amount") == [(2, 67890, -60), (2, 67890, 40)]
    assert sorted(out.columns) == ["Amount", "UID", "Zipcode"]


def test_inner_join_copies(users):
    left, right = users
    out = left.inner_join(right, ["UID"], ("Zip", "Age"))
    zips = [r[0] for r in out.df.select("Zip").collect()]
    assert {z: zips.count(z) for z in zips} == {98989: 1, 12345: 1, 67890: 2, 11111: 10, 22222: 2}
    assert "Amount2" not in out.columns and 4 not in col(out, "UID")


def test_inner_join_with_aggregates(users):
    left, right = users
    out = left.inner_join(right, ["UID"], (), {"n": ("count", None), "s": ("sum", "Amount")})
    assert rows(out, "UID", "s") == [(-5, 8), (1, 100), (2, -20), (3, 151), (10, 16)]
    assert {1, 2, 10} <= set(col(out, "n"))


def test_compound_keys(make):
    left = make(K1=[1, 1, 2, 3, 4], K2=[1, 2, 4, 6, 7])
    right = make(K1=[1, 1, 1, 3, 4, 4, 1, 1, 4, 5], K2=[2, 1, 1, 6, 7, 7, 1, 2, 7, 8])
    out = left.inner_join(right, ["K1", "K2"], aggs={"n": ("count", None)})
    assert [r[2] for r in rows(out, "K1", "K2", "n")] == [3, 2, 1, 3]


def test_filtered_rows_do_not_join(make):
    left = make(K=[1, 2, 3, 4], D2=[100, 200, 300, 400], v=[1, 0, 1, 0]).filter(F.col("v") == 1)
    right = make(K=[1, 1, 1, 1, 2, 3, 3, 3, 3, 5, 5], Data=[10, 20, 30, 32, 35, 40, 50, 60, 65, 70, 80], w=[1, 1, 0, 1, 1, 1, 0, 0, 1, 1, 0]).filter(F.col("w") == 1)
    assert col(left.inner_join(right, ["K"], ("D2",)), "Data") == [10, 20, 32, 40, 65]


@pytest.fixture(scope="module")
def outer(make):
    t1 = make(K=[111, 222, 222, 333, 444, 444, 999], D=[100, 200, 201, 300, 400, 402, 900], A=[-1, -2, -2, -3, -4, -7, -5])
    t2 = make(K=[222, 999, 666, 333], D2=[1, 2, 3, 4])
    return t1, t2


def test_left_outer_join(outer):
    t1, t2 = outer
    out = t2.left_outer_join(t1, ["K"])
    assert rows(out, "K", "D2", "D", "A") == [(222, 0, 200, -2), (222, 0, 201, -2), (333, 0, 300, -3), (666, 3, 0, 0), (999, 0, 900, -5)]
    counted = t2.left_outer_join(t1, ["K"], aggs={"n": ("count", None)})
    assert rows(counted, "K", "n") == [(222, 2), (333, 1), (666, 0), (999, 1)]


def test_right_and_full_outer_joins(outer):
    t1, t2 = outer
    assert [r[1] for r in rows(t2.right_outer_join(t1, ["K"], ("D2",)), "D", "D2")] == [0, 1, 1, 4, 0, 0, 2]
    full = t2.full_outer_join(t1, ["K"], ("D2",))
    assert full.count() == 11 and col(full, "D2") == [0, 0, 0, 1, 1, 1, 2, 2, 3, 4, 4]
    assert t2.full_join(t1, ["K"]).count() == 8


def test_semi_and_anti_joins(outer):
    t1, t2 = outer
    semi, anti = t1.semi_join(t2, ["K"]), t1.anti_join(t2, ["K"])
    assert (col(semi, "D"), sorted(col(semi, "A"))) == ([200, 201, 300, 900], [-5, -3, -2, -2])
    assert (col(anti, "D"), sorted(col(anti, "A"))) == ([100, 400, 402], [-7, -4, -1])
    assert rows(semi.concat(anti), "K", "D", "A") == rows(t1, "K", "D", "A")


def test_unique_joins(make):
    a = make(K=[1, 2, 4, 6, 7, 9, 10, 11, 13, 15], A=list(range(10)), Z=list(range(10)))
    b = make(K=[2, 3, 4, 5, 6, 9, 12, 14], B=[111, 222, 333, 444, 555, 888, 777, 999])
    out = a.unique_join(b, ["K"], assert_unique=True)
    assert rows(out, "K", "B") == [(2, 111), (4, 333), (6, 555), (9, 888)] and sorted(out.columns) == ["B", "K"]
    with pytest.raises(DuplicateKeys):
        make(K=[1, 1]).unique_join(b, ["K"], assert_unique=True)
    with pytest.raises(DuplicateKeys):
        make(K=[1, 1]).inner_join(b, ["K"], assert_unique=True)


def test_clashing_columns_are_refused(make):
    with pytest.raises(ValueError):
        make(K=[1], A=[1]).left_outer_join(make(K=[1], A=[2]), ["K"])


# -- aggregates, distinct, windows ------------------------------------------------


@pytest.fixture(scope="module")
def small(make):
    return make(SEL=[1, 1, 1, 1, 0, 0, 0, 0], DATA=list(range(1, 9)))


def test_aggregates(small):
    out = small.aggregate(["SEL"], {"s": ("sum", "DATA"), "n": ("count", "DATA"), "lo": ("min", "DATA"), "hi": ("max", "DATA")})
    assert rows(out, "s", "n", "lo", "hi") == [(10, 4, 1, 4), (26, 4, 5, 8)]
    assert small.filter(F.col("DATA") > 99).aggregate([], {"n": ("count", None)}).df.first()[0] == 0


def test_aggregates_of_ones_own(small):
    register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    try:
        assert col(small.aggregate(["SEL"], {"x": ("spread", "DATA")}), "x") == [3, 3]
        with pytest.raises(ValueError):
            register_aggregate("spread", F.sum)
    finally:
        del AGGREGATES["spread"]
    with pytest.raises(KeyError):
        small.aggregate([], {"x": ("nonsense", "DATA")})


def test_tumbling_windows(small):
    ids = col(small.tumbling_window("DATA", 2, "w"), "w")
    assert ids == [0, 1, 1, 2, 2, 3, 3, 4]


def test_tumbling_windows_of_negative_times(make):
    assert col(make(t=[-3, -2, -1, 0]).tumbling_window("t", 2, "w"), "w") == [-2, -1, -1, 0]


def test_gap_sessions(small):
    per_key = small.gap_session_window(["SEL"], "DATA", "s", 2)
    assert [r[1] for r in rows(per_key, "DATA", "s")] == [1, 1, 1, 1, 5, 5, 5, 5]
    whole = small.gap_session_window(["SEL"], "DATA", "s", 2, mode="global")
    assert [r[1] for r in rows(whole, "DATA", "s")] == [1, 1, 1, 1, -1, -1, -1, -1]


def test_gaps_are_strict(make):
    out = make(k=[1, 1, 1], t=[0, 5, 11]).gap_session_window(["k"], "t", "s", 5)
    assert [r[1] for r in rows(out, "t", "s")] == [0, 0, 11]


@pytest.mark.parametrize(
    ("mode", "values", "want"),
    [
        ("global", [1, 5, 6, 1, 7, 8, 1, 9], [-1, 2, 2, -1, 5, 5, -1, 8]),
        ("global", [5, 5, 1, 1, 7, 8, 1, 9], [-1, -1, -1, -1, 5, 5, -1, 8]),
        ("per_key", [5, 5, 1, 1, 7, 8, 1, 9], [1, 1, -1, -1, 5, 5, -1, 8]),
    ],
)
def test_threshold_sessions(make, mode, values, want):
    t = make(k=[1] * 8, f=values, t=list(range(1, 9)))
    out = t.threshold_session_window(["k"], "f", "t", "s", 3, keep_only_sessions=False, mode=mode)
    assert [r[1] for r in rows(out, "t", "s")] == want
    assert t.threshold_session_window(["k"], "f", "t", "s", 3, mode=mode).count() == sum(x > 0 for x in want)


def test_threshold_sessions_over_two_keys(small):
    out = small.threshold_session_window(["SEL"], "DATA", "DATA", "s", 3, keep_only_sessions=False, mode="global")
    assert [r[1] for r in rows(out, "DATA", "s")] == [-1, -1, -1, 4, -1, -1, -1, -1]


def test_mark_distinct(make):
    t = make(i=list(range(7)), K1=[0, 0, 0, 1, 1, 1, 2], K2=[0, 0, 1, 1, 1, 0, 2])
    mark = lambda keys: [r[1] for r in rows(t.mark_distinct(keys, "m", ["i"]), "i", "m")]
    assert mark(["K1"]) == [1, 0, 0, 1, 0, 0, 1]
    assert mark(["K2"]) == [1, 0, 1, 0, 0, 1, 1]
    assert mark(["K1", "K2"]) == [1, 0, 1, 1, 0, 1, 1]


@pytest.mark.parametrize("reverse", [False, True])
def test_sums_over_ranges(make, reverse):
    rnd = random.Random(1)
    v = [rnd.randint(-99, 99) for _ in range(256)]
    t = make(i=list(range(256)), v=v)
    want = [sum(v[k:]) if reverse else sum(v[: k + 1]) for k in range(256)]
    assert [r[1] for r in rows(t.prefix_sum("v", "i", "s", reverse=reverse), "i", "s")] == want
    per = [r[1] for r in rows(t.prefix_sum("v", "i", "s", ["v"], reverse), "i", "s")]
    assert per == [sum(x for k, x in enumerate(v) if x == v[i] and (k >= i if reverse else k <= i)) for i in range(256)]


def test_suffixes_are_prefixes_of_the_reverse(make):
    rnd = random.Random(4)
    g, v = [rnd.randint(0, 3) for _ in range(300)], [rnd.randint(-99, 99) for _ in range(300)]
    out = make(g=g, i=list(range(300)), v=v).window_aggregate(["g"], {"s": ("sum", "v"), "m": ("max", "v"), "c": ("copy", "v")}, ["i"], "suffix")
    rest = lambda k: [x for x, y in zip(v[k:], g[k:], strict=True) if y == g[k]]
    assert [r[1:] for r in rows(out, "i", "s", "m", "c")] == [(sum(rest(k)), max(rest(k)), v[k]) for k in range(300)]


def test_suffix_sums_are_not_quadratic(spark):
    """400,000 rows in one group: as many squared would take hours."""
    t = Table(spark.range(400_000).select(F.lit(0).alias("g"), "id", F.lit(1).alias("v")))
    out = t.window_aggregate(["g"], {"s": ("sum", "v")}, ["id"], "suffix").df
    assert out.where("s <> 400000 - id").count() == 0
    assert t.prefix_sum("v", "id", "s", reverse=True).df.where("s <> 400000 - id").count() == 0


def test_groups_with_null_keys(spark):
    t = Table(spark.createDataFrame([(None, 1, 5), (None, 2, 6), (1, 3, None), (1, 4, 8)], "k long, i long, v long"))
    key = lambda t, *c: sorted((tuple(r) for r in t.df.select(*c).collect()), key=str)
    assert key(t.group_broadcast(["k"], {"s": ("sum", "v")}), "i", "s") == [(1, 11), (2, 11), (3, 8), (4, 8)]
    assert key(t.first_value(["k"], "v", [("i", "desc")], "f"), "i", "f") == [(1, 6), (2, 6), (3, 8), (4, 8)]
    assert key(t.first_value(["k"], "v", ["v"], "f"), "i", "f") == [(1, 5), (2, 5), (3, None), (4, None)]
    assert key(t.first_value(["k"], "v", ["v", ("i", "desc")], "f"), "i", "f") == [(1, 5), (2, 5), (3, None), (4, None)]


def test_running_max_is_sorted(make):
    rnd = random.Random(2)
    t = make(g=[0] * 256, i=list(range(256)), v=[rnd.randint(-999, 999) for _ in range(256)])
    out = [r[1] for r in rows(t.window_aggregate(["g"], {"m": ("max", "v")}, ["i"]), "i", "m")]
    assert out == sorted(out)


def test_row_slices(make):
    t = make(v=[5, 3, 9, 1, 7, 2])
    assert col(t.row_slice(["v"], 1, 5, 2), "v") == [2, 5]
    assert t.repeat(3).count() == 18 and t.repeat(0).count() == 0


def test_places_among_many_uneven_rows(spark):
    """A million rows over many ranges, those of small ids much wider."""
    wide = F.when(F.col("id") < 50_000, F.repeat(F.lit("x"), 200)).otherwise(F.lit(""))
    t = Table(spark.range(1_000_000, numPartitions=16).select(((F.col("id") * 7919) % 1_000_000).alias("id")).withColumn("wide", wide))
    whole = t.row_slice(["id"])
    assert whole.count() == 1_000_000 and whole.df.agg(F.sum("id")).first()[0] == 1_000_000 * 999_999 // 2
    some = t.row_slice([("id", "desc")], 10, 900_000, 7).df
    assert some.where("(999999 - id - 10) % 7 <> 0 or id > 999989 or id <= 99999").count() == 0
    assert some.count() == len(range(10, 900_000, 7))


def test_marks_over_ranges_of_the_whole_order(spark):
    t = Table(spark.range(50_000, numPartitions=8).select("id", F.expr("id div 3").alias("k")))
    out = t.mark_distinct(["k"], "m", ["id"]).df
    assert out.where("m <> int(id % 3 = 0)").count() == 0 and out.count() == 50_000


# -- shaping ------------------------------------------------------------------------


def test_shaping(spark):
    t = Table.zeros(spark, ["c1", "c2", "c3", "c4", "c5", "c6"], 10_000)
    assert len(t.columns) == 6 and len(t.drop("c6").columns) == 5 and t.select("c1").columns == ["c1"]
    a = t.select("c1").add_columns("A").with_columns(A=F.lit(99))
    assert a.aggregate([], {"s": ("sum", "A")}).df.first()[0] == 990_000
    with pytest.raises(ValueError):
        a.add_columns("A")
    with pytest.raises(ValueError):
        a.rename("nope", "x")
    assert t.head(8000, ["c1"]).tail(3000, ["c1"]).resize(2000).pad_power_of_two().revalidate().count() == 2048


def test_validity(make):
    t = make(a=[1, 2, 3, 4], b=[1, 1, 0, 0]).filter(F.col("a") > 1).filter(F.col("b") == 0)
    assert t.count() == 2 and t.revalidate().count() == 4
    assert col(t.mask(-1).revalidate(), "a") == [-1, -1, 3, 4]
    assert t.open() == ([[3, 4], [0, 0]], ["a", "b"]) or sorted(t.open()[0][0]) == [3, 4]
    assert len(t.open(remove_invalid=False)[0][0]) == 4
    assert sorted(Table.column_of(t.open(), "a")) == [3, 4]
    assert sorted(r.a for r in t.finalize(seed=1).df.collect()) == [3, 4]
    assert make(a=[1, 2]).filter(F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t.select("a", "b"),
        lambda t: t.drop("c"),
        lambda t: t.rename("c", "d"),
        lambda t: t.with_columns(y=F.col("a") * 2),
        lambda t: t.with_columns(a=F.col("a") * 1),
        lambda t: t.add_columns("z"),
        lambda t: t.zero("c"),
        lambda t: t.copy_column("a", "e"),
        lambda t: t.tumbling_window("a", 2, "w"),
        lambda t: t.select("b", "a").rename("b", "x").with_columns(b=F.col("x")).drop("x"),
    ],
)
def test_validity_outlives_projections(make, change):
    t = change(make(a=[1, 2, 3, 4], b=[1, 1, 0, 0], c=[7, 7, 7, 7]).filter(F.col("a") > 2))
    assert col(t, "a") == [3, 4] and col(t.revalidate(), "a") == [1, 2, 3, 4]
    assert col(t.mask(-1), "a") == [-1, -1, 3, 4]
    assert col(t.filter(F.col("b") == 0).filter(F.col("a") < 4), "a") == [3]
    assert "__valid" not in t.columns and "__valid" not in t.df.columns and "__valid" not in t.revalidate().df.columns
    assert len(t.open(remove_invalid=False)[0][0]) == 4


def test_sets_and_sort(make):
    a, b = make(k=[1, 2, 2, 3]), make(k=[2, 4])
    assert (col(a.union(b), "k"), col(a.intersect(b), "k"), col(a.subtract(b), "k")) == ([1, 2, 3, 4], [2], [1, 3])
    t = make(x=[1, 2, 1, 2], y=[3, 4, 5, 6])
    assert [tuple(r) for r in t.sort([("x", "desc"), "y"]).df.collect()] == [(2, 4), (2, 6), (1, 3), (1, 5)]
    assert rows(make(k=[1]).concat(make(j=[2]), "t"), "j", "k", "t") == [(0, 1, 0), (2, 0, 1)]
    with pytest.raises(ValueError):
        make(a=[1], b=[1, 2])


def test_dot_products(make):
    t = make(i=list(range(8)), x=list(range(8)), y=[2] * 8)
    assert rows(t.dot_product("x", "y", "i", 4), "chunk", "dot") == [(0, 12), (1, 44)]
