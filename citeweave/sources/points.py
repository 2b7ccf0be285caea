"""The point table: vectors, hashes and payloads keyed by ``point_id``, as Parquet
snapshots. A change writes a new snapshot; readers follow a version table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def create_if_absent(spark: SparkSession, path: str) -> DataFrame:
    """The point table at ``path``; written empty, partitioned by source type, when missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], schemas.POINT).write.partitionBy("source_type").parquet(path)
    return spark.read.schema(schemas.POINT).parquet(path)


def check_vector_size(points: DataFrame, size: int) -> DataFrame:
    """Fail a job that meets a vector of another size."""
    bad = F.col("dense").isNotNull() & (F.size("dense") != size)
    return points.withColumn("dense", F.when(bad, F.raise_error(F.lit(f"dense vector is not of size {size}")).cast("array<float>")).otherwise(F.col("dense")))


def stored_hashes(points: DataFrame) -> DataFrame:
    """The columns a sync compares; the scan reads nothing else."""
    return points.select("point_id", "source_type", "content_hash", "payload_hash")


def point_ids(points: DataFrame, source_type: str) -> DataFrame:
    return points.filter(F.col("source_type") == source_type).select("point_id")


def upsert(points: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored points with the changed ones replaced or added whole."""
    return points.join(changed.select("point_id"), "point_id", "left_anti").unionByName(changed.select(points.columns))


def overwrite_payloads(points: DataFrame, payloads: DataFrame) -> DataFrame:
    """Replace payload and payload hash by id; vectors stay."""
    new = payloads.select("point_id", F.col("payload").alias("_payload"), F.col("payload_hash").alias("_hash"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    return points.join(new, "point_id", "left").select(*[
        F.when(hit, F.col({"payload": "_payload", "payload_hash": "_hash"}[c])).otherwise(F.col(c)).alias(c)
        if c in ("payload", "payload_hash") else F.col(c) for c in points.columns
    ])


def delete(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("point_id"), "point_id", "left_anti")


def count(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points_count"))
