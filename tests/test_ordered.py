"""Distributed ordering against plain windows, with a third of the rows on one key and many copies."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.operators import ordered, windows
from claimlens.operators.ordered import ascending


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(3)
    rows = []
    for i in range(1500):
        if i % 3 == 0:
            rows.append((i, "hot", 5, Decimal("1.10")))
        else:
            key = draw.choice(["a", "b", "c", None])
            rows.append((i, key, draw.choice([None, *range(40)]), Decimal(draw.randrange(1000)) / 100))
    return ordered.stored(spark.createDataFrame(rows, "i bigint, k string, o int, v decimal(18,2)"))


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("ranges", [None, 1, 2, 7])
def test_running_sum(skewed, ranges):
    order = ascending("o", "i")
    window = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running_sum(skewed, {"v": "s", "o": "t"}, order, ["k"], ranges)
    rows = ordered.running_sum_of_rows(skewed, {"v": "s", "o": "t"}, ["o", "i"], ["k"], ranges)
    assert collected(rows.select("i", "s", "t")) == collected(got.select("i", "s", "t"))
    want = skewed.withColumns({"s": F.sum("v").over(window), "t": F.sum("o").over(window)})
    assert collected(got.select("i", "s", "t")) == collected(want.select("i", "s", "t"))


@pytest.mark.parametrize("ranges", [None, 1, 2, 7])
def test_next_in_group(skewed, ranges):
    window = Window.partitionBy("k").orderBy(*ascending("o", "i"))
    got = ordered.next_in_group(skewed, {"i": "ni", "v": "nv"}, ["k"], ["o", "i"], ranges)
    want = skewed.withColumns({"ni": F.lead("i").over(window), "nv": F.lead("v").over(window)})
    assert collected(got.select("i", "ni", "nv")) == collected(want.select("i", "ni", "nv"))


@pytest.mark.parametrize("ranges", [None, 2, 7])
def test_rank_in_group(skewed, ranges):
    window = Window.partitionBy("k").orderBy(F.col("o").desc_nulls_first())
    got = ordered.rank_in_group(skewed, "o", "r", ["k"], ranges).select("i", "r")
    assert collected(got) == collected(skewed.withColumn("r", F.rank().over(window).cast("bigint")).select("i", "r"))


@pytest.mark.parametrize("rows", [0, 1, 7, 10, 1003])
@pytest.mark.parametrize("ranges", [1, 4])
def test_tiles(spark, rows, ranges):
    df = spark.range(rows).select((F.col("id") % 3).alias("v"), F.col("id").alias("i"))
    limits = ordered.tile_limits(df, ["v", "i"], 10, ranges)
    got = ordered.with_tile(df, ["v", "i"], 10, "t", limits)
    want = df.withColumn("t", F.ntile(10).over(Window.orderBy("v", "i")))
    assert collected(got) == collected(want)


def test_tiles_with_missing_and_typed_keys(spark):
    df = spark.range(57).select(
        F.when(F.col("id") % 5 != 0, (F.col("id") / 7).cast("decimal(10,3)")).alias("d"),
        (F.lit("2024-03-10 02:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"),
        F.struct((F.col("id") * 3 % 11).alias("file"), F.col("id").alias("row")).alias("p"),
    )
    got = ordered.with_tile(df, ["d", "t", "p"], 4, "q", ordered.tile_limits(df, ["d", "t", "p"], 4, 3))
    want = df.withColumn("q", F.ntile(4).over(Window.orderBy(*ascending("d", "t", "p"))))
    assert collected(got) == collected(want)


@pytest.mark.parametrize("ranges", [None, 3])
def test_quantiles(spark, ranges):
    draw = random.Random(11)
    data = [(draw.choice("xy"), draw.choice([0.0] * 4 + [draw.gauss(0, 9)]), draw.choice([None, 1.0, float("nan"), 2.5])) for _ in range(3001)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    got = {(r["g"], r["column"]): r for r in ordered.exact_quantiles(df, ["a", "b"], [0.75, 0.5, 0.0, 1.0], ["g"], ranges).collect()}
    for group in "xy":
        for i, name in ((1, "a"), (2, "b")):
            values = sorted(r[i] for r in data if r[0] == group and r[i] is not None and r[i] == r[i])
            at = (len(values) - 1) * 0.75
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            found = got[group, name]
            assert found["n"] == len(values)
            assert found["quantiles"] == [
                pytest.approx(low + (high - low) * (at - int(at))),
                pytest.approx(statistics.median(values)),
                values[0],
                values[-1],
            ]


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_of_many_rows(spark, parts):
    """Far more rows than are counted singly, a third of them equal, in sorted splits."""
    n = 300_000
    value = F.when(F.col("id") % 3 == 0, 70_000).otherwise(F.col("id") * 48_271 % 99_991 if parts == 1 else F.col("id"))
    df = spark.range(0, n, 1, parts).select(value.cast("double").alias("v"))
    values = sorted(r.v for r in df.collect())
    probabilities = [0.25, 0.5, 0.9]
    found = ordered.exact_quantiles(df, ["v"], probabilities).first()
    assert found.n == n
    for p, q in zip(probabilities, found.quantiles):
        at = (n - 1) * p
        low, high = values[int(at)], values[int(at) + 1]
        assert q == pytest.approx(low + (high - low) * (at - int(at)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert ordered.exact_quantiles(df, ["a"], [0.5]).collect() == []
    assert ordered.exact_medians(df, ["a"]) == {"a": None}


def test_first_rows_and_sample(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert sorted(r.v for r in ordered.first_rows(df, ["v"], 137, ranges=5).collect()) == list(range(137))
    assert ordered.first_rows(df, ["v"], 5000, ranges=5).count() == 1000
    one = {r.v for r in ordered.fixed_sample(df.repartition(1), 50, ["v"]).collect()}
    many = {r.v for r in ordered.fixed_sample(df.repartition(9), 50, ["v"]).collect()}
    assert len(one) == 50 and one == many
    assert ordered.fixed_sample(df, 5000, ["v"]).count() == 1000


def test_lookup_by_shuffle_and_by_broadcast_agree(spark, skewed):
    lookup = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    near = collected(ordered.attach_lookup(skewed, lookup, ["k"]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert collected(ordered.attach_lookup(skewed, lookup, ["k"])) == near
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_wide_rows_are_computed_once_and_move_once(spark, skewed):
    """Every input row is made once, and the running sum deals the rows once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(i):
        made.add(1)
        return i

    rows = skewed.repartition(3).withColumn("i", counted("i"))
    summed = ordered.running_sum_of_rows(rows, {"v": "s"}, ["o", "i"], ["k"], 4)
    assert summed.count() == 1500 and made.value == 1500
    plan = summed._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # One for the rows; the others belong to the carry, which has a row per range.
    scans = plan.count("FileScan parquet")
    assert scans == 2 and len([x for x in wide if "k#" in x]) >= 1


def test_rolling_mean_excludes_the_far_end(spark):
    days = {0: 1.0, 1: 5.0, 29: 2.0, 30: 4.0, 61: 8.0, 1000: 3.0}
    points = spark.createDataFrame(list(days.items()), "d int, v double").withColumn(
        "t", F.lit("2019-12-30 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("d"))
    )
    got = {r.d: r.m for r in windows.rolling_mean(points, "t", "v", "m").collect()}
    for day in days:
        inside = [v for d, v in days.items() if day - 30 < d <= day]
        assert got[day] == pytest.approx(sum(inside) / len(inside))


def test_rolling_mean_of_many_times(spark):
    """200,000 distinct seconds within two windows: the work must not grow with the points in a window."""
    points = spark.range(200_000).select(
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 20)).alias("t"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 1000) / 7.0).alias("v"),
    )
    got = windows.rolling_mean(points, "t", "v", "m")
    assert got.count() == 200_000
    last = got.orderBy(F.col("t").desc()).first()
    inside = [k % 1000 / 7.0 for k in range(200_000 - 129_600, 200_000) if k % 7]
    assert last.m == pytest.approx(sum(inside) / len(inside), rel=1e-12)


def test_hot_key_and_copies_spread_over_ranges(spark):
    """A third of the rows on one key, all of them copies: no range holds more than its share."""
    copies = F.col("id") % 3 == 0
    rows = ordered.stored(
        spark.range(30_000).select(
            F.when(copies, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))).alias("k"),
            F.when(copies, 1).otherwise(F.col("id")).alias("o"),
            F.struct(F.lit(0).cast("bigint").alias("file"), F.col("id").alias("row")).alias("p"),
        )
    )
    ranged = ordered.ordered_ranges(rows, ascending("k", "o", "p"), 12)
    sizes = [n for _, n in ordered._range_sizes(ranged)]
    assert len(sizes) == 12 and max(sizes) < 2 * 30_000 / 12
    tagged = ordered.tagged_ranges(rows, ["k", "o", "p"], 12)
    sizes = [n for _, n in ordered._range_sizes(tagged)]
    assert len(sizes) == 12 and max(sizes) < 2 * 30_000 / 12
    counted = ordered.running_sum_of_rows(rows.withColumn("one", F.lit(1)), {"one": "n"}, ["o", "p"], ["k"], 12)
    assert counted.filter("k = 'hot'").agg(F.max("n"), F.countDistinct("n")).first() == (10_000, 10_000)
