"""Points and their results as DataFrames and files.

Points are rows of (batch_id, point_id, features ARRAY<DOUBLE>). Row identity is the id, never a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.functions.vectors import doubles


def as_points(df: DataFrame, point_id: str, features: str | list[str], batch_id: str | None = None, compute_type: str = "double") -> DataFrame:
    """Points of any table: features is an array column or a list of numeric columns; without batch_id all rows are batch 0.

    compute_type 'float' rounds the components to single precision first. Null and non-finite components and null ids raise when the
    rows are read. An array of another length than its centroids' raises in the assignment.
    """
    if compute_type not in ("double", "float"):
        raise ValueError("compute_type is 'double' or 'float'")
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
            raise ValueError(f"{features} is no array of numbers")
        v: Column = F.col(features)
    else:
        v = F.array(*[F.col(c).cast("double") for c in features])
    if compute_type == "float":
        v = F.transform(v, lambda x: x.cast("float"))
    v = doubles(v)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checked = F.when(ok, v).otherwise(F.raise_error(F.lit("a point has null or non-finite components")).cast("array<double>"))
    batch = F.lit(0).cast("long") if batch_id is None else F.col(batch_id).cast("long")
    return df.select(batch.alias("batch_id"), F.col(point_id).cast("long").alias("point_id"), checked.alias("features"))


def read_points(spark: SparkSession, path: str, point_id: str, features: str | list[str], batch_id: str | None = None, partitions: int | None = None, compute_type: str = "double") -> DataFrame:
    """Parquet to points; only the named columns are read. `partitions` deals the rows anew (few large files have few partitions)."""
    points = as_points(spark.read.parquet(path), point_id, features, batch_id, compute_type)
    return points.repartition(partitions) if partitions else points


def blocks(points: DataFrame, partitions: int) -> DataFrame:
    """Contiguous ranges of ids, one partition each; results don't depend on them."""
    return points.repartitionByRange(partitions, "batch_id", "point_id")


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labels keyed by id, as Parquet."""
    labels.write.mode(mode).parquet(path)


def unbatched(df: DataFrame) -> DataFrame:
    """Results of points that had no batch."""
    return df.drop("batch_id")
