"""Text, JSON and table inputs and outputs on small literal files."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattgrid.functions import parse as Q
from wattgrid.operators import scans as S
from wattgrid.sources import documents as D
from wattgrid.sources import logs as G
from wattgrid.sources import store as O
from wattgrid.sources.traces import clean_trace, read_swf

SWF = "; comment\n\n 1 100 5 60 4 -1 2048 1 60 1 1 7 1 1 1 -1 -1 0\n2 x 5 0 4 -1 2048 1 60 1 1 7 1 1 1 -1 -1 0\n3 1 2 3\n"


def test_jdbc_slices():
    parts = O.time_predicates(datetime(2024, 1, 1), datetime(2024, 1, 3), 2)
    assert parts == ["time >= '2024-01-01 00:00:00' AND time < '2024-01-02 00:00:00'",
                     "time >= '2024-01-02 00:00:00' AND time < '2024-01-03 00:00:00.000001'"]


@pytest.mark.parametrize("zipped", [False, True])
def test_swf(spark, tmp_path, zipped):
    path = tmp_path / ("t.swf.gz" if zipped else "t.swf")
    path.write_bytes(gzip.compress(SWF.encode()) if zipped else SWF.encode())
    rows = {r.job_id: r for r in read_swf(spark, str(path)).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].run_time == 60 and rows["2"].submit_time is None
    clean = clean_trace(read_swf(spark, str(path)), "x", utilisation=F.lit(0.5)).collect()
    assert len(clean) == 1 and clean[0].estimated_power_w == 400 and clean[0].memory_gb == 2
    assert (clean[0].end_time - clean[0].start_time).total_seconds() == 60


def test_benchmark_files(spark, tmp_path):
    doc = {"benchmark_info": {"start_time": "2024-01-01T00:00:00", "workload_type": "mixed", "duration_actual": 3600},
           "performance_metrics": {"total_cpu_operations": 10},
           "system_metrics": {"avg_cpu_percent": 20, "disk_read_rate_mbps": 4},
           "metrics_history": [{"timestamp": "2024-01-01T00:00:01", "cpu_percent": 5, "disk_read_bytes": 1048576}, {"error": "lost"}]}
    (tmp_path / "job 1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "job2.json").write_text(json.dumps({"other": 1}))
    docs = D.read_benchmarks(spark, str(tmp_path))
    job = D.benchmark_jobs(docs).collect()
    assert len(job) == 1 and job[0].job_id == "job 1" and job[0].estimated_energy_wh == 50 + 40 + 2
    sample = D.benchmark_samples(docs).collect()
    assert len(sample) == 1 and sample[0].disk_read_mbps == 1 and sample[0].memory_percent == 0


def test_accounting_defaults(spark):
    texts = [json.dumps({"job_id": "1", "name": "Compute-x", "state": {"current": "RUNNING"}, "time": {"elapsed": "01:00:10"},
                         "average": {"cpu": "00:01:30", "rss": "2G"}}), "{}", "not json"]
    rows = D.accounting_jobs(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert rows[0].runtime_seconds == 3610 and rows[0].cpu_usage_percent == 1.5 and rows[0].memory_usage_bytes == 2 * 1024 ** 3
    assert rows[0].job_type == "cpu_intensive" and rows[0].energy_estimate_joules == pytest.approx((20 + 0.45) * 3610)
    assert rows[1].cpus_allocated == 1 and rows[1].job_state == "" and rows[1].runtime_seconds == 0
    inventory = spark.createDataFrame([(4, 100), (8, 50)], "cpus int, real_memory int")
    assert tuple(D.cluster_totals(inventory).first()) == (2, 12, 150)


def test_energy_log(spark, tmp_path):
    (tmp_path / "job_7_energy.log").write_text("# head\n\n2024-01-01,50,40,60,100,extra\n2024-01-01,50,40,bad,200\n")
    samples = G.read_energy_log(spark, str(tmp_path)).withColumn("s", F.lit(1800))
    row = G.log_energy(samples, "s", []).first()
    assert (row.avg_power, row.peak_power, row.avg_temp, row.energy_wh) == (150, 200, 30, 75)


def test_multiline_log(spark, tmp_path):
    text = ["tail of an older file"]
    for i in range(40):
        text += [f"[2024-01-01T00:00:{i % 60:02d}.000] [INFO] record {i}"] + [f"  line {k}" for k in range(i % 4)] + ["[not a start]"] * (i % 2)
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    for size in ("200b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = G.read_multiline_log(spark, str(tmp_path)).collect()
        assert len(rows) == 41
        by_message = {r.message.split("\n")[0]: r for r in rows}
        assert by_message["record 7"].message.split("\n")[1:] == ["  line 0", "  line 1", "  line 2", "[not a start]"]
        assert by_message["record 7"].time == datetime(2024, 1, 1, 0, 0, 7) and by_message["record 7"].level == "INFO"
        assert by_message["tail of an older file"].time is None


def test_json_log_and_messages(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"timestamp": "2024-01-01 00:00:05", "message": "Energy: 1.50 Wh, Job: 9, Node: n1"}\n')
    df = G.read_json_log(spark, str(tmp_path), "timestamp string, message string")
    row = G.route_errors(G.energy_messages(G.enrich(df, "energy"))).first()
    assert row.energy_value == 1.5 and row.job_id == "9" and row.route == "normal" and row.log_type == "energy"
    errors = spark.createDataFrame([("a traceBack here",), ("Thermal event: hot, Temperature: 91.2°C, Sensor: c0",)], "message string")
    got = G.route_errors(G.thermal_messages(errors)).collect()
    assert got[0].route == "error" and got[1].temperature == 91.2 and got[1].sensor_name == "c0"
    wrapped = spark.createDataFrame([("k", '{"a": 1}')], "tag string, log string")
    assert G.unwrap_json(wrapped, "a int").collect() == [("k", 1)]


def test_parsers(spark):
    df = spark.createDataFrame([("01:02:03", "1.5G"), ("02:03", "10KB"), ("9", "77"), ("a:b", "zz"), (None, None), ("1:2:3:4", "")], "t string, m string")
    rows = df.select(Q.clock_seconds("t").alias("s"), Q.memory_bytes("m").alias("b"), Q.cpu_minutes("t").alias("c")).collect()
    assert [r.s for r in rows][:5] == [3723, 123, 9, 0, 0]
    assert [r.b for r in rows] == [int(1.5 * 1024 ** 3), 10240, 77, 0, 0, 0]
    assert rows[0].c == pytest.approx((2 * 60 + 3) / 60) and rows[2].c == 0


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_write_dataset(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    O.write_dataset(df, str(tmp_path / kind), kind)
    reader = spark.read.schema("x int, y string")
    back = reader.csv(str(tmp_path / kind), header=True) if kind == "csv" else reader.format(kind).load(str(tmp_path / kind))
    assert sorted(back.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        O.write_dataset(df, str(tmp_path / "bad"), "xml")


def test_results_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.5)], "time timestamp, v double")
    O.write_results({"energy": df}, df.groupBy().count(), str(tmp_path))
    assert O.read_csv(spark, str(tmp_path / "energy_csv"), "time timestamp, v double", O.TIME_FORMAT).collect() == df.collect()


def test_refresh_replaces_only_its_hours(spark, tmp_path, tables):
    jobs = tables.job_metrics.limit(50)
    jobs = jobs.withColumn("time", F.lit("2024-01-01 09:30:00").cast("timestamp_ntz"))
    path = str(tmp_path / "hourly")
    later = jobs.withColumn("time", F.lit("2024-01-01 10:30:00").cast("timestamp_ntz"))
    O.refresh_hourly_summary(jobs.unionByName(later), path, "2024-01-01 12:00:00", 3, 1)
    O.refresh_hourly_summary(later.limit(10), path, "2024-01-01 12:00:00", 2, 1)
    counts = {r.hour: r.n for r in spark.read.parquet(path).groupBy("hour").agg(F.sum("job_count").alias("n")).collect()}
    assert counts == {"2024-01-01-09": 50, "2024-01-01-10": 10}


def test_append_prunes_by_date(spark, tmp_path, tables):
    path = str(tmp_path / "jobs")
    O.append_rows(O.start_records(tables.job_metrics), path)
    table = spark.read.parquet(path)
    assert table.filter("job_state <> 'STARTING' or estimated_energy_wh <> 0").isEmpty()
    kept = S.time_range(table, "1998-01-01 00:00:00", "1998-01-31 00:00:00")
    assert "PartitionFilters: [isnotnull(date" in kept._jdf.queryExecution().toString()


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, d double, s string")
    assert S.numeric_columns(df) == ["i", "d"] and S.available(df, ["d", "zz"]) == ["d"]
    series = spark.createDataFrame([("go_x", {"job": "a"}), ("cpu", {"job": "a", "k": "v"})], "metric string, labels map<string,string>")
    assert S.relabel(S.drop_series(series), job="b").collect()[0].labels == {"job": "b", "k": "v"}
