"""Assignment of a stream of points to fixed centroids: stateless, so it needs no watermark and runs in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators.assign import assign


def assign_stream(points: DataFrame, centers: DataFrame, metric: str = "euclidean", with_distance: bool = False) -> DataFrame:
    """points: a streaming DataFrame of (batch_id, point_id, features). The JVM engine joins each micro-batch with the broadcast row."""
    return assign(points, centers, metric, "sql", with_distance)
