"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fleetvitals.plans.lineage import shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage.

    A lost executor costs nothing then: what it had computed is on the shared store.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


@contextmanager
def shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing is to be computed from it any more. Other DataFrames are left alone."""
    path = df.__dict__.pop("stored_at", None)
    if path is not None:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def show_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed for them."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, environment.get("PYTHONPATH", "")) if p)
