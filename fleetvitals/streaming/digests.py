"""Statement digests kept over time, as a server keeps its counters.

New slow-log files are a stream of files: the stream's own offsets remember
which ones were read. Each batch is rolled up by digest and merged with the
totals so far; nothing expires, and a file is never read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.operators import workload
from fleetvitals.sources import parse

NODE_KEYS = ["cluster_id", "node_ip"]
VERSION = "batch"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """(batch, path) of every complete version of the totals, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    named = [s.getPath() for s in files.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(f"{VERSION}=")]
    done = [p for p in named if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((int(p.getName().split("=")[1]), p) for p in done)


def digest_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """The roll-up of all files so far; none before the first run."""
    versions = _folders(spark, path)
    return spark.read.parquet(versions[-1][1].toString()) if versions else None


def roll_up_new_logs(
    spark: SparkSession, logs: str, totals: str, state: str, files_per_batch: int = 1000, keys: list[str] = NODE_KEYS
) -> DataFrame | None:
    """Takes all slow-log files that have arrived under logs since the last run into the totals, and returns these.

    Files count as they were when first seen, so a log that a server still
    writes to belongs here once it is rotated. state: the stream's checkpoint.
    Each batch writes a version of the totals from the one before; a batch that
    runs again after a failure writes the same version again, and a reader sees
    complete versions only. The work of a run follows the new files and the
    number of digests, not the files of the past.
    """
    texts = spark.readStream.format("text").schema("value string").options(**parse.SLOW_LOG_OPTIONS)
    arrived = texts.option("maxFilesPerTrigger", files_per_batch).load(logs)
    entries = parse.slow_log_file_records(arrived, ["time", "query_s", "rows_sent", "rows_examined", "db", "sql"])
    files = ["file_path", "file_name"]

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # By file first: what a path says about its node is read per digest of a file and not per statement.
        by_file = workload.digest_statements(workload.logged_statements(batch), files)
        # The day of the snapshot is no part of the keys: counters go on from day to day.
        rolled = workload.merge_digests(by_file.select(*parse.keys_of_path("1970-01-01"), *[c for c in by_file.columns if c != "file_path"]), keys)
        before = [(n, p) for n, p in _folders(session, totals) if n < number]
        if before:
            rolled = workload.merge_digests(session.read.parquet(before[-1][1].toString()).unionByName(rolled), keys)
        rolled.write.mode("overwrite").parquet(f"{totals}/{VERSION}={number}")
        for _, old in before[:-1]:  # the last one stays until the next batch, for readers that hold it
            old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    query = entries.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return digest_totals(spark, totals)
