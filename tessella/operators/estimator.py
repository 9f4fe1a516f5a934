"""Estimator of Euclidean k-means: train / fit / predict / fit_predict over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .assign import assign
from .lloyd import Run, kmeans


@dataclass
class KMeans:
    """d: length of the points (checked); k; niter and tol stop a run; seed draws the start; engine: 'arrow', 'sql', or 'auto' (arrow
    where pyarrow is installed). return_updated: always return centroids after the last update."""

    d: int
    k: int
    niter: int = 25
    tol: float = 1e-8
    seed: int = 0
    engine: str = "auto"
    verbose: bool = False
    return_updated: bool = False
    run: Run | None = field(default=None, init=False, repr=False)
    batches: set[int] = field(default_factory=set, init=False, repr=False)

    def _engine(self) -> str:
        if self.engine != "auto":
            return self.engine
        try:
            import pyarrow  # noqa: F401
        except ImportError:
            return "sql"
        return "arrow"

    def train(self, points: DataFrame, init: DataFrame | None = None) -> None:
        """Fits centroids to points (batch_id, point_id, features)."""
        first = points.select(F.size("features").alias("d")).first()
        if first is not None and first.d != self.d:
            raise ValueError(f"points have {first.d} components, not {self.d}")
        run = kmeans(points, self.k, "euclidean", self.niter, self.tol, init, self.seed, self._engine(), self.return_updated, self.verbose)
        self.batches = {r.batch_id for r in run.centers.select("batch_id").distinct().collect()}
        self.run = run

    def fit(self, points: DataFrame, init: DataFrame | None = None) -> KMeans:
        self.train(points, init)
        return self

    @property
    def centers(self) -> DataFrame:
        if self.run is None:
            raise RuntimeError("the model isn't trained")
        return self.run.centers

    def predict(self, points: DataFrame) -> DataFrame:
        """Labels by the trained centroids, Euclidean; the points must have the batches that the model was trained on."""
        centers = self.centers
        found = {r.batch_id for r in points.select("batch_id").distinct().collect()}
        if found != self.batches:
            raise ValueError("the batches aren't those of the training")
        return assign(points, centers, "euclidean", self._engine())

    def fit_predict(self, points: DataFrame, init: DataFrame | None = None) -> DataFrame:
        """Labels from the training, which lag the final centroids by one update unless the run converged."""
        self.train(points, init)
        return self.run.labels
