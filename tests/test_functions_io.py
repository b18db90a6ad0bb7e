import random
from datetime import date, datetime, timedelta
from time import sleep

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import Table
from tessera.sources import BadHeader, generate_other, generate_tpch, load, read_csv, write_csv
from tessera.streaming import gap_sessions, threshold_sessions, tumbling


def test_divisions(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(-(10**12), 10**12), rnd.choice([-7, -1, 1, 3, 10**6])) for _ in range(200)] + [(5, 0), (-7, 2), (2**63 - 1, 2)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", fn.int_div("a", "b").alias("q"), fn.floor_div("a", "b").alias("f"))
    for r in df.collect():
        if r.b == 0:
            assert r.q is None and r.f is None
        else:
            assert r.f == r.a // r.b and r.q == abs(r.a) // abs(r.b) * (1 if (r.a < 0) == (r.b < 0) else -1)


def test_bits_and_wrap(spark):
    values = [-(2**62), -129, -128, -5, -1, 0, 1, 127, 128, 255, 300, 2**33 + 5]
    for r in spark.createDataFrame([(v,) for v in values], "a long").select(
        "a", fn.shift_right("a", 1).alias("sr"), fn.shift_right_logical("a", 1).alias("sl"), fn.bit_parity("a").alias("p"), fn.bit_mask("a").alias("m"), fn.low_bit("a").alias("lb"),
        fn.wrap("a", "byte").alias("w8"), fn.wrap("a").alias("w32"), fn.bucket_by_bounds("a", [0, 128]).alias("b"), fn.is_negative("a").alias("n"), fn.multiplex(F.col("a") > 0, 7, 8).alias("x"),
    ).collect():
        bits = r.a % 2**64
        assert (r.sr, r.sl, r.p) == (r.a >> 1, bits >> 1, bin(bits).count("1") % 2)
        assert (r.m, r.lb) == (-(r.a & 1), r.a & 1)
        assert (r.w8, r.w32) == ((r.a + 128) % 256 - 128, (r.a + 2**31) % 2**32 - 2**31)
        assert (r.b, r.n, r.x) == ((r.a >= 0) + (r.a >= 128), r.a < 0, 8 if r.a > 0 else 7)  # 7 where the selector is false


def test_fixed_point(spark):
    rnd = random.Random(2)
    pairs = [(rnd.uniform(-50, 50), rnd.uniform(0.1, 50)) for _ in range(100)]
    a, b = fn.fixed_from_double("a"), fn.fixed_from_double("b")
    df = spark.createDataFrame(pairs, "a double, b double")
    for r in df.select("a", "b", fn.fixed_to_double(fn.fixed_mul(a, b)).alias("m"), fn.fixed_to_double(fn.fixed_div(a, b)).alias("d"), fn.fixed_to_double(fn.fixed_sqrt(b)).alias("s")).collect():
        assert abs(r.m - r.a * r.b) < 100 / 65536 and abs(r.d - r.a / r.b) < 0.1 and abs(r.s - r.b**0.5) < 3 / 65536


def test_csv_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    people = [(i, rnd.randint(1, 5), rnd.randint(18, 80)) for i in range(25)]
    path = tmp_path / "people.csv"
    path.write_text("EMPLOYEE_ID,REGION,AGE\n" + "".join(f"{a},{b},{c}\n" for a, b, c in people))
    t = read_csv(spark, str(path), ["EMPLOYEE_ID", "REGION", "AGE", "BONUS"], rows=32)
    assert t.count() == 25 and t.revalidate().count() == 32
    assert t.open()[1] == ["AGE", "BONUS", "EMPLOYEE_ID", "REGION"] and set(Table.column_of(t.open(), "BONUS")) == {0}
    assert read_csv(spark, str(path), ["EMPLOYEE_ID", "REGION", "AGE"], rows=10).count() == 10
    with pytest.raises(BadHeader):
        read_csv(spark, str(path), ["EMPLOYEE_ID", "AGE"])
    write_csv(t, str(tmp_path / "out"))
    again = read_csv(spark, str(tmp_path / "out"), ["EMPLOYEE_ID", "REGION", "AGE", "BONUS"])
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, t.df.collect()))


def test_generators_hold_their_keys(spark):
    t = generate_tpch(spark, 0.001)
    assert {k: v.count() for k, v in t.items() if k != "lineitem"} == {"customer": 150, "orders": 1500, "part": 200, "supplier": 10, "partsupp": 800, "nation": 25, "region": 5}
    assert t["partsupp"].distinct().count() == t["partsupp"].dropDuplicates(["ps_partkey", "ps_suppkey"]).count() == 800
    assert t["lineitem"].dropDuplicates(["l_orderkey", "l_linenumber"]).count() == t["lineitem"].count() > 1500
    assert t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == 0
    other = generate_other(spark, 0.001)
    assert other["credit"].count() == 5000 and 0 < other["cohort"].count() < 500
    with pytest.raises(ValueError):
        load(spark, "/nowhere", "nothing")


def run(spark, df, folder, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/check-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_give_the_batch_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    minutes = [0, 2, 4, 30, 31, 90, 91, 200]
    rows = [(1, start + timedelta(minutes=m), m) for m in minutes] + [(2, start + timedelta(minutes=5), 5), (9, start + timedelta(days=2), 0)]
    pd.DataFrame(rows, columns=["k", "ts", "v"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "a.parquet")
    stream = spark.readStream.schema("k long, ts timestamp, v long").parquet(str(tmp_path))
    spec = {"n": ("count", None)}
    got = run(spark, tumbling(stream, "ts", "10 minutes", ["k"], spec, "1 minute"), tmp_path, "tumbled").where("k < 9")
    assert sorted(r.n for r in got.collect()) == sorted([3, 2, 2, 1, 1])
    got = run(spark, gap_sessions(stream, "ts", "10 minutes", ["k"], spec, "1 minute"), tmp_path, "sessions").where("k = 1")
    assert sorted(r.n for r in got.collect()) == [1, 2, 2, 3]


@pytest.mark.parametrize("kind", ["long", "timestamp", "date"])
def test_threshold_sessions_of_a_stream(spark, tmp_path, kind):
    values = [1, 5, 6, 1, 7, 8, 1, 9]
    time = {"long": int, "timestamp": lambda t: datetime(2026, 1, 1, 0, 0, t, 500), "date": lambda t: date(2026, 1, t)}[kind]
    for part in (0, 1):
        rows = [(1, time(t + 1), v) for t, v in enumerate(values)][4 * part : 4 * part + 4]
        spark.createDataFrame(rows, f"k long, t {kind}, f long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(f"k long, t {kind}, f long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = threshold_sessions(stream, "k", "f", "t", 3).writeStream.format("memory").queryName(f"thresholds_{kind}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = [(2, 2), (3, 2), (5, 5), (6, 5), (8, 8)]
    assert sorted((r.t, r.session) for r in spark.table(f"thresholds_{kind}").collect()) == [(time(a), time(b)) for a, b in want]
