"""The two end-to-end runs: analysis of a cluster's data, and modelling with validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.advice import validation_advice
from wattgrid.functions.features import combined_efficiency
from wattgrid.operators import cleaning as C
from wattgrid.operators import joins as J
from wattgrid.operators import learning as M
from wattgrid.operators import stats as A
from wattgrid.operators.scans import available, numeric_columns
from wattgrid.session import checkpointed
from wattgrid.sources.store import write_dataset


def analyse(jobs: DataFrame, usage: DataFrame | None = None, thermals: DataFrame | None = None, *, key: str = "job_id",
            target: str = "estimated_energy_wh", clusters: int = 5) -> dict[str, DataFrame]:
    """Combine the sources once, then correlate, model, cluster and look for anomalies.

    The combined table is written once and every section reads it.
    """
    joined = J.combine_jobs(jobs, usage, thermals, key)
    combined, _ = combined_efficiency(joined)
    combined = checkpointed(combined.fillna(0))
    numeric = [c for c in numeric_columns(combined) if c != key]
    trained = M.train_models(combined, target, [key], ["linear_regression", "random_forest"], most_rows=M.SEARCH_ROWS)
    grouped = [c for c in [*M.CLUSTERED, "cpu_usage", "memory_usage"] if c in combined.columns]
    spark = combined.sparkSession
    return {
        "data_summary": combined.agg(F.count(F.lit(1)).alias("total_jobs"), F.avg(target).alias("avg_energy"),
                                     F.avg("duration_seconds").alias("avg_duration")),
        "job_types": combined.groupBy("job_type").count(),
        "energy_patterns": A.spread(combined, target, (), {"median": 0.5}),
        "correlations": A.correlations(combined, numeric),
        "energy_correlations": A.correlation_ranking(combined, target, [c for c in numeric if c != target]),
        "model_scores": trained.scores,
        "feature_importance": M.importances(spark, trained.models["random_forest"], trained.names),
        "clusters": M.cluster_summary(M.cluster(combined, grouped, clusters), grouped),
        "anomalies": C.above_fence(combined, target),
    }


@dataclass(frozen=True)
class ModellingSettings:
    keys: Sequence[str] = ("job_id",)
    order: str = "time"
    series: Sequence[str] = ("node_id",)
    label: str = "estimated_energy_wh"
    models: Sequence[str] = ("linear_regression", "ridge", "random_forest", "gradient_boosting")
    trees: int = 100
    remove_outliers: bool = True


def model_and_validate(jobs: DataFrame, settings: ModellingSettings = ModellingSettings()) -> dict[str, DataFrame]:
    """Clean, train energy and temperature models, validate their predictions, advise."""
    usable = C.usable_jobs(jobs)
    columns = [c for c in available(usable, M.NUMERIC) if c != settings.label]
    clean = C.preprocess(usable, settings.series, settings.order, settings.keys, outliers=settings.remove_outliers,
                         columns=[*columns, settings.label])
    clean = checkpointed(clean)
    options = dict(chosen=settings.models, trees=settings.trees)
    energy = M.train_models(clean, settings.label, settings.keys, **options)
    heat = M.train_temperature(clean, settings.keys, **options)

    def held(run: M.Trained, name: str) -> DataFrame:
        scored = run.models[run.best("r2")].transform(run.test)
        return scored.select(F.lit(name).alias("component"), F.col(run.label).alias("real"), F.col("prediction").alias("simulated"))

    pairs = checkpointed(held(energy, "energy").unionByName(held(heat, "thermal")))
    metrics = checkpointed(A.validation_metrics(pairs, "real", "simulated", ["component"]))
    best = energy.models[energy.best("r2")]
    return {
        "data_profile": A.data_profile(jobs), "energy_scores": energy.scores, "thermal_scores": heat.scores,
        "validation": metrics, "overall_score": A.validation_score(metrics), "advice": validation_advice(metrics),
        "overfit": M.overfit_check(best, energy.train, energy.test, settings.label),
    }


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON in its own folder."""
    for name, df in sections.items():
        write_dataset(df, f"{path}/{name}", "json")
