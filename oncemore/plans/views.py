"""The statistics as temporary views, for use from SQL."""

from pyspark.sql import DataFrame

from oncemore.plans import snapshots as snap
from oncemore.plans import stats

# Names of the views over the metrics.
METRIC_VIEWS = {
    "v_latency_stats": stats.latency_stats,
    "v_duplicate_stats": stats.duplicate_stats,
    "v_comparison": stats.comparison,
    "v_experiment_stats": stats.experiment_stats,
    "v_throughput_per_second": stats.throughput_per_second,
    "v_latency_percentiles": stats.latency_percentiles,
}


def create_views(metrics: DataFrame, snapshots: DataFrame | None = None) -> None:
    """Register ``metrics`` and the statistics over it, and, if given,
    ``stats_snapshots`` and ``v_snapshot_history``."""
    metrics.createOrReplaceTempView("metrics")
    for name, view in METRIC_VIEWS.items():
        view(metrics).createOrReplaceTempView(name)
    if snapshots is not None:
        snapshots.createOrReplaceTempView("stats_snapshots")
        snap.snapshot_history(snapshots).createOrReplaceTempView("v_snapshot_history")
