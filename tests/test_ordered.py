"""Chunked windows against plain windows, with one hot series holding most rows."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattgrid.operators import series as W
from wattgrid.operators.alerts import sustained
from wattgrid.operators.joins import change_since
from wattgrid.operators.ordered import CHUNK, HALO, chunk_window, chunked, fill_gaps, over_rows, position_in_order, running_sum
from wattgrid.operators import quantiles as K
from wattgrid.operators.quantiles import exact_percentiles
from wattgrid.operators.stats import ks_statistic

def by_node():
    return Window.partitionBy("node").orderBy("t", "id")


@pytest.fixture(scope="module")
def hot(spark):
    """600 samples; node 'a' has two thirds of them and bursts inside one minute."""
    draw = random.Random(7)
    rows = []
    for i in range(600):
        node = "a" if i % 3 else draw.choice("bcd")
        second = draw.randrange(0, 40) if i % 5 == 0 else draw.randrange(0, 90_000)
        rows.append((i, node, second, draw.choice([None, 1, 2, 3, 5]), draw.random() > 0.4))
    df = spark.createDataFrame(rows, "id int, node string, second long, v int, ok boolean")
    return df.withColumn("t", F.timestamp_seconds("second")).drop("second").persist()


def same(left, right):
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(left) == key(right)


@pytest.mark.parametrize("rows", [1, 7, 40, 10_000])
def test_lookback(hot, rows):
    build = lambda w: {"back": F.lag("v", 5).over(w), "mean": F.avg("v").over(w.rowsBetween(-5, 0))}
    same(over_rows(hot, ["node"], "t", ["id"], 5, build, rows_per_chunk=rows), hot.withColumns(build(by_node())))


@pytest.mark.parametrize("rows", [1, 13, 10_000])
def test_running_sum_and_fill(hot, rows):
    total = F.sum("v").over(by_node().rowsBetween(Window.unboundedPreceding, 0))
    got = running_sum(hot, "v", "total", ["node"], "t", ["id"], rows_per_chunk=rows)
    same(got, hot.withColumn("total", total))
    ahead = F.first("v", True).over(by_node().rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("v", True).over(by_node().rowsBetween(Window.unboundedPreceding, 0))
    same(fill_gaps(hot, ["v"], ["node"], "t", ["id"], rows_per_chunk=rows), hot.withColumn("v", F.coalesce(behind, ahead)))


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("x", 1, 4)], "node string, at long, v int")
    out = running_sum(df, "v", "s", ["node"], "at", rows_per_chunk=1, grain=1)
    assert sorted((str(r.node), r.s) for r in out.collect()) == [("None", 2), ("None", 5), ("x", 4)]


@pytest.mark.parametrize("rows", [3, 10_000])
def test_sustained_runs(hot, rows):
    got = {(r.node, r.since, r.until, r.fired_at) for r in
           sustained(hot, ["node"], "t", "ok", 600, ["id"], rows_per_chunk=rows).collect()}
    want = set()
    ordered = sorted(hot.collect(), key=lambda r: (r.node, r.t, r.id))
    for node, part in itertools.groupby(ordered, key=lambda r: r.node):
        for ok, run in itertools.groupby(part, key=lambda r: r.ok):
            run = list(run)
            met = [r.t for r in run if (r.t - run[0].t).total_seconds() >= 600]
            if ok and met:
                want.add((node, run[0].t, run[-1].t, met[0]))
    assert got == want and want


@pytest.mark.parametrize("rows", [5, 10_000])
def test_change_since(hot, rows):
    known = hot.filter("v is not null")
    out = change_since(known, "v", ["node"], "t", ["id"], 300, 900, rows_per_chunk=rows)
    data = known.collect()
    for r in out.collect():
        target = r.t.timestamp() - 300
        old = [x for x in data if x.node == r.node and x.t.timestamp() <= target]
        old = max(old, key=lambda x: (x.t, x.id)) if old else None
        want = old.v if old and target - old.t.timestamp() < 900 else None
        assert r.v_before == want


@pytest.mark.parametrize("rows", [4, 10_000])
def test_rate_with_resets(spark, rows):
    values = [0, 10, 30, 5, 25, 25, 40]
    df = spark.createDataFrame([("n", i, i * 60, v) for i, v in enumerate(values)], "node string, id int, s long, c long")
    df = df.withColumn("t", F.timestamp_seconds("s"))
    out = W.rate(df, "c", ["node"], "t", ["id"], window_seconds=180, step_seconds=60, rows_per_chunk=rows)
    got = {r.at_epoch: (r.samples, r.rate) for r in out.collect()}
    # Steps hold one sample each; windows see three: rises 10, 20, 5 (reset), 20, 0, 15.
    assert got[60] == (2, 10 / 60) and got[120] == (3, 30 / 120) and got[180] == (3, 25 / 120)
    assert got[240] == (3, 25 / 120) and got[360] == (3, 15 / 120)


def test_thermal_filter_matches_a_loop(hot):
    samples = hot.select("id", "node", "t", (F.coalesce("v", F.lit(0)) * 60.0).alias("p"))
    out = W.thermal_filter(samples, "p", ["node"], "t", ["id"], dt=10.0, rows_per_chunk=16)
    got = {r.id: r.model_temp for r in out.collect()}
    temps = {}
    for r in sorted(samples.collect(), key=lambda r: (r.node, r.t, r.id)):
        before = temps.get(r.node, 25.0)
        temps[r.node] = max(22.0, before + (0.8 * r.p - (before - 22) * 50) / 1000 * 10)
        assert got[r.id] == pytest.approx(temps[r.node])
    assert len(got) == 600
    with pytest.raises(ValueError):
        W.thermal_filter(samples, "p", ["node"], "t", dt=60.0)


@pytest.mark.parametrize("rows", [1_000_000, 5])
def test_percentiles(hot, spark, rows):
    df = hot.withColumn("x", F.when(F.col("id") % 3 == 0, F.lit(4.0)).otherwise(F.pow(F.col("id") * 1.0, 3)))
    asked = {"p15": 0.15, "p50": 0.5, "p99": 0.99}
    want = df.groupBy("node").agg(F.percentile("x", list(asked.values())).alias("p")).collect()
    got = {r.node: [r.p15, r.p50, r.p99] for r in exact_percentiles(df, "x", asked, ["node"], rows).collect()}
    for r in want:
        assert got[r.node] == pytest.approx(list(r.p))
    every = exact_percentiles(df, "x", asked, bracket_rows=rows).first()
    assert list(every) == pytest.approx(list(df.agg(F.percentile("x", list(asked.values()))).first()[0]))
    assert exact_percentiles(df.filter("id < 0"), "x", asked, bracket_rows=rows).first().p50 is None


def test_positions_and_ks(hot):
    numbered = position_in_order(hot.select("id", "v").fillna(0), ["v", "id"], sums={"run": "v"}).orderBy("position").collect()
    assert [r.position for r in numbered] == list(range(1, 601))
    assert [r.run for r in numbered] == list(itertools.accumulate(r.v for r in numbered))
    known = hot.filter("v is not null")
    for r in ks_statistic(known, "v", F.col("ok"), ["node"]).collect():
        a = [x.v for x in known.collect() if x.node == r.node and x.ok]
        b = [x.v for x in known.collect() if x.node == r.node and not x.ok]
        share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        assert r.ks_statistic == pytest.approx(max(abs(share(a, v) - share(b, v)) for v in {*a, *b}))
        assert 0 <= r.ks_pvalue <= 1


def test_column_percentiles(hot):
    df = hot.select(F.col("id").cast("double").alias("a"), F.col("v").alias("b"), F.lit(None).cast("int").alias("c"))
    found = K.column_percentiles(df, ["a", "b", "c"], {"lo": 0.15, "hi": 0.85})
    want = df.agg(*[F.percentile(c, [0.15, 0.85]).alias(c) for c in "ab"]).first()
    assert list(found["a"]) == pytest.approx(want["a"]) and list(found["b"]) == pytest.approx(want["b"])
    assert found["c"].lo is None


def test_backward_fill_is_linear(spark):
    rows = spark.range(120_000).select(F.lit("n").alias("node"), F.timestamp_seconds(F.col("id") * 60).alias("t"), "id",
                                       F.when(F.col("id") % 50_000 == 49_999, F.col("id")).alias("v"))
    filled = fill_gaps(rows, ["v"], ["node"], "t")
    # Forward first: only what lies before the first value is filled from behind.
    assert filled.where("v is null or v <> case when id < 49999 then 49999 when id < 99999 then 49999 else 99999 end").count() == 0


@pytest.mark.parametrize("rows", [1, 7, 40, 10_000])
@pytest.mark.parametrize("grain", [60, 3600])
def test_lookback_by_time(hot, rows, grain):
    at = hot.withColumn("at", F.unix_seconds("t"))
    frame = lambda w: F.sum("v").over(w.rangeBetween(-900, 0))
    cut = chunked(at, ["node"], "at", lookback=900, rows_per_chunk=rows, grain=grain)
    got = cut.withColumn("sum", frame(chunk_window(["node"], "at"))).filter(~F.col(HALO)).drop(CHUNK, HALO)
    same(got, at.withColumn("sum", frame(Window.partitionBy("node").orderBy("at"))))


def test_a_crowded_slice_is_cut(spark):
    """One series with all its rows in one hour lies in many chunks; rows of one instant stay together."""
    df = spark.range(20_000).select(F.lit("a").alias("node"), "id", F.timestamp_micros(F.col("id") * 170_000).alias("t"))
    sizes = [r["count"] for r in chunked(df, ["node"], "t", rows_per_chunk=500).groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 600
    instant = df.withColumn("t", F.timestamp_seconds(F.lit(5)))
    got = running_sum(instant, "id", "sum", ["node"], "t", ["id"], rows_per_chunk=500).agg(F.max("sum")).first()[0]
    assert got == 20_000 * 19_999 // 2


@pytest.mark.parametrize("rows", [3, 50])
def test_rate_in_small_chunks(hot, rows):
    counter = hot.withColumn("c", F.col("id") % 97)
    at = dict(keys=["node"], time="t", ties=["id"], window_seconds=3600, step_seconds=600)
    same(W.rate(counter, "c", **at, rows_per_chunk=rows, grain=1200), W.rate(counter, "c", **at, rows_per_chunk=10**6))


def test_values_are_not_shuffled_by_a_few_names(spark):
    """Distances and bins meet their groups' totals by broadcast, as these are written and known to be small."""
    from wattgrid.operators.stats import histogram

    df = spark.range(5000).select((F.col("id") % 2).cast("string").alias("name"), (F.col("id") * 37 % 501).cast("double").alias("v"), (F.col("id") % 3 > 0).alias("a"))
    for out in (ks_statistic(df, "v", F.col("a"), ["name"]), histogram(df, "v", 30, ["name"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rows_in_order_are_shuffled_once(hot):
    numbered = position_in_order(hot.select("id", "v"), [F.desc("v"), "id"])
    assert [r.id for r in numbered.orderBy("position").collect()] == [r.id for r in hot.orderBy(F.desc("v"), "id").collect()]
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "PARTITIONED" not in plan.upper().replace("REPARTITIONED", "")
