"""Cutting a plan where many results share one expensive input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it names none, a folder in the warehouse, but only if all executors
    see it: on one machine, or if the warehouse is no local path. Else an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not one_machine and warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. Lost executors re-read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
