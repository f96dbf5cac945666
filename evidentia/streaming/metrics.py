"""Windowed operational metrics of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evidentia.operators.dialogue import metrics_by_window


def metrics_stream(metrics: DataFrame, width: str = "1 hour", delay: str = "10 minutes",
                   dimensions: list[str] = ["status"]) -> DataFrame:
    """``metrics_by_window`` with a watermark. In append mode a window comes out once, when the watermark has
    passed its end; rows later than that are counted by ``late_rows``."""
    return metrics_by_window(metrics.withWatermark("ts", delay), width, dimensions)


def late_rows(query) -> int:
    """Rows of a run that came after their window was final, from its progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
