"""Exact, batched k-means over Spark DataFrames."""

from tessella.operators.assign import assign
from tessella.operators.centroids import first_k, seeded
from tessella.operators.estimator import KMeans
from tessella.operators.lloyd import Run, kmeans
from tessella.operators.update import finalize, merge_sums, partial_sums, update
from tessella.sources.points import as_points, blocks, read_points, write_labels
from tessella.streaming.assign import assign_stream

__all__ = ["KMeans", "Run", "as_points", "assign", "assign_stream", "blocks", "finalize", "first_k", "kmeans", "merge_sums", "partial_sums", "read_points", "seeded", "update", "write_labels"]
