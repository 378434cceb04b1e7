"""Registered queries beside their SQL on the smallest data; all of them with WATTGRID_ALL=1."""

import os
from pathlib import Path

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
USUAL = ["a1_job_metrics_hourly", "a4_prediction_accuracy", "a24_ks_statistic", "a42_validation_score", "j1_j2_combined_dataset",
         "j4_align_by_hour", "j7_power_change_5m", "j12_samples_during_runs", "w3_w4_w5_rolling_features", "w7_counter_rate", "w11_alerts",
         "w13_queue_length", "w9_busy_percent", "f49_scaled_rate", "a12_load_statistics", "a30_node_specs", "a39_value_histograms", "f34_polynomials",
         "f37_f38_thermal_messages", "a41_compare_recorded", "t5_top_recorded", "s24_saved_model", "m2_normal_equations", "m19_a20_cluster_members", "c4_iqr_filter", "s18_upsert", "f35_row_statistics", "r2_hourly_load", "r5_held_alerts"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("WATTGRID_ALL") else USUAL)
def test_matches_sql(spark, duck, name):
    note, good = check.compare(spark, duck, name, queries()[name], oracle_sql()[name], SF)
    assert good, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_are_registered_once_and_checked():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables as folders of three files."""
    folder = tmp_path_factory.mktemp("parts")
    for path in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(path)).repartition(3).write.parquet(f"{folder}/{path.name}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith(("r", "s22")) and n[1].isdigit()))
def test_streams_read_folders(spark, duck, parts, name):
    note, good = check.compare(spark, duck, name, queries()[name], oracle_sql()[name], parts)
    assert good, note
