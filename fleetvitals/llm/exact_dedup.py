"""Exact deduplication of dumps as a stateful stream.

A collector that runs again, or a dump that is uploaded twice, brings the same
content under another name. The stream's state keeps, per digest and without
expiry, the stable identifier of the dump that stays, its content locator and
how many dumps have the digest. The state is Spark's RocksDB store: it lives on
local disk, and its change log in the stream's checkpoint folder, from which a
lost executor's share is rebuilt.

A digest only nominates copies. Where the state holds a digest more than once,
the dumps behind it are compared over their full bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.storage import new_path, stored

# The store that spills to disk; a task closes its part when it has committed, since one run takes all that has
# arrived: open parts would each keep some megabytes of local disk, however little they hold.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(content: Column) -> Column:
    """Lowercase hex SHA-256 over the UTF-8 bytes; null content counts as empty."""
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """Per digest: the largest identifier, its locator, and the number of arrivals so far.

    arrivals: (digest, dump_id, locator), streaming or not. On a stream this is
    keyed state without a watermark, so nothing expires.
    """
    return arrivals.groupBy("digest").agg(
        F.max("dump_id").alias("keep_id"),
        F.max_by("locator", F.struct("dump_id", "locator")).alias("keep_locator"),
        F.count(F.lit(1)).alias("n"),
    )


def run_stream(arrivals: DataFrame, state_path: str, changes_path: str) -> None:
    """Takes all that has arrived into the state at state_path and appends the changed keys to changes_path.

    Called again on a grown folder it goes on from the state; a batch that ran
    twice after a failure overwrites its own part of the changes.
    """
    spark = arrivals.sparkSession

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{changes_path}/batch_id={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            keyed_state(arrivals)
            .writeStream.outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def deduplicate(
    dumps: DataFrame,
    dump_id: str = "dump_id",
    content: str = "content",
    digest=sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Per row: dump_id, keep_id, group_size, kept, text_sha256.

    Dumps are copies when their contents are identical bytes; null content
    counts as empty. Of copies the largest dump_id stays. A row without an id
    is a member of its group but stays only where no copy has an id. Rows that
    share the id that stays are all marked kept. An empty table gives none.

    digest: nominates copies; whatever it is, contents are compared in full.
    """
    spark = dumps.sparkSession
    # The digest's function sees the content only, so other columns of any name do not matter.
    texts = dumps.select(
        F.col(dump_id).cast("long").alias("dump_id"), F.coalesce(F.col(content), F.lit("")).alias("content")
    ).withColumn("digest", digest(F.col("content")))
    arrived = new_path(spark, "arrivals")
    texts.select(
        "digest",
        "dump_id",
        F.concat_ws("#", F.lit(content), F.col("dump_id").cast("string")).alias("locator"),
        sha256(F.col("content")).alias("text_sha256"),
    ).write.parquet(arrived)
    landed = spark.read.schema("digest string, dump_id long, locator string, text_sha256 string").parquet(arrived)
    stream = (
        spark.readStream.schema("digest string, dump_id long, locator string")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(arrived)
    )
    changes = new_path(spark, "changes")
    run_stream(stream, new_path(spark, "state"), changes)
    state = (
        spark.read.schema("digest string, keep_id long, keep_locator string, n long, batch_id long")
        .parquet(changes)
        .groupBy("digest")
        .agg(F.max_by(F.struct("keep_id", "n"), "batch_id").alias("last"))
        .select("digest", "last.*")
    )
    hits = state.where("n > 1").select("digest")
    # Full bytes: grouping by the content itself, after map-side combining, so a hot group is one row per task.
    compared = stored(
        texts.join(hits, "digest", "left_semi")
        .groupBy("digest", "content")
        .agg(F.max("dump_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .select("digest", "keep_id", "n", F.xxhash64("content").alias("of"), sha256(F.col("content")).alias("text_sha256")),
        "compared",
    )
    groups = state.where("n = 1").select("digest", "keep_id", "n", F.lit(None).cast("string").alias("text_sha256")).unionByName(
        compared.drop("of")
    )
    clash = compared.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if clash.isEmpty():
        grouped = landed.drop("locator").join(groups.drop("text_sha256"), "digest", "left")
    else:
        # Different contents under one digest: tell them apart by SHA-256 as well.
        of = F.coalesce(groups["text_sha256"], landed["text_sha256"])
        grouped = landed.drop("locator").join(
            groups, (landed["digest"] == groups["digest"]) & (landed["text_sha256"] == of), "left"
        ).drop(groups["digest"]).drop(groups["text_sha256"])
    return grouped.select(
        F.col("dump_id").alias(dump_id),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("dump_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
