"""Sinks: stage tables, keyed upserts and public view tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, root: str, stage: str, study_run: tuple[str, ...] = ("study_id", "run_id")) -> str:
    """One parquet table per stage below the folder of a job, partitioned by study and run."""
    path = f"{root}/{stage}"
    df.write.mode("overwrite").partitionBy(*study_run).parquet(path)
    return path


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished stage table is present (its commit marker was written)."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_keyed(df: DataFrame, path: str, key: str = "post_id") -> str:
    """A keyed label table in key order (range-partitioned, so files are sorted and disjoint)."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return path


def write_views(views: dict[str, DataFrame], root: str) -> dict[str, str]:
    for name, df in views.items():
        df.write.mode("overwrite").json(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in views}
