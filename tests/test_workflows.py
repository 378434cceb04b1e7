from pyspark.sql import functions as F

from wattgrid.operators.joins import node_thermals
from wattgrid.plans.workflows import ModellingSettings, analyse, model_and_validate, write_report


def test_analysis_writes_all_sections(tables, tmp_path):
    jobs = tables.job_metrics.drop("time")
    sections = analyse(jobs, thermals=node_thermals(tables.node_metrics))
    write_report(sections, str(tmp_path))
    read = lambda name: tables.spark.read.json(str(tmp_path / name))
    assert read("data_summary").first().total_jobs == jobs.count()
    assert read("clusters").count() == 5 and read("model_scores").count() == 2
    assert read("energy_correlations").filter("rank = 1").count() == 1


def test_modelling_validates_its_models(tables):
    out = model_and_validate(tables.job_metrics, ModellingSettings(models=["linear_regression", "decision_tree"]))
    assert {r.component for r in out["validation"].collect()} == {"energy", "thermal"}
    assert 0 < out["overall_score"].first().overall_score <= 1
    assert out["energy_scores"].agg(F.max("r2")).first()[0] > 0.8 and out["overfit"].count() == 1
