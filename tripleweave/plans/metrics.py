"""What a query really reads, from the metrics of its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rows_scanned(df: DataFrame) -> int:
    """Run ``df`` and add up the rows its file scans have decoded."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return _scanned(execution.executedPlan())


def _scanned(plan) -> int:
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _scanned(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _scanned(plan.plan())
    if kind.startswith("Reused"):
        return 0
    if kind == "FileSourceScanExec":
        return plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    return sum(_scanned(children.apply(i)) for i in range(children.size()))
