"""Structured sources and result sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS

FORMATS = ("parquet", "orc", "csv", "tsv", "json")
TEXT_FORMATS = ("csv", "tsv", "json")
CORRUPT = "_corrupt_record"

# Columns of the server's own tables that are called differently by version, under the name used here.
SERVER_COLUMNS = {
    "lock_wait_rows": {
        "waiting_trx_id": ("requesting_trx_id", "requesting_engine_transaction_id"),
        "blocking_trx_id": ("blocking_trx_id", "blocking_engine_transaction_id"),
    },
    "lock_rows": {
        "trx_id": ("lock_trx_id", "engine_transaction_id"),
        "table_schema": ("object_schema",),
        "table_name": ("lock_table", "object_name"),
        "lock_mode": ("lock_mode",),
        "lock_type": ("lock_type",),
    },
    "trx": {"trx_id": ("trx_id",), "thread_id": ("trx_mysql_thread_id",), "query": ("trx_query",), "state": ("trx_state",)},
    "variables": {"name": ("variable_name",), "value": ("variable_value",)},
}


def conform_to_server(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """A server's own table under one set of column names, whatever its version calls them; null where it has none.

    Names are compared without case, as servers differ in that too. A column
    that already has the name used here counts as it is.
    """
    have = {c.lower(): c for c in df.columns}

    def pick(name: str, options: tuple[str, ...]):
        found = next((have[o] for o in (name, *options) if o in have), None)
        return (F.lit(None).cast("string") if found is None else F.col(f"`{found}`")).alias(name)

    return df.select(*keys, *[pick(name, options) for name, options in SERVER_COLUMNS[table].items()])


def read_base_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """A landed base table. Text formats need a schema, so nothing is inferred by an extra pass.

    A malformed record of a text format has nulls where it could not be read;
    read_with_quarantine tells it apart.
    """
    return _reader(spark, fmt, schema).load(path)


def _reader(spark: SparkSession, fmt: str, schema: str | None):
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt not in TEXT_FORMATS:
        return spark.read.format(fmt)
    if schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.schema(schema).format("json" if fmt == "json" else "csv")
    return reader if fmt == "json" else reader.options(header=True, sep="\t" if fmt == "tsv" else ",", multiLine=False)


def read_with_quarantine(spark: SparkSession, path: str, fmt: str, schema: str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a text format: a record with a value of another type, or of another width, goes to the quarantine.

    The quarantine keeps the record as it stands and the file that it stands
    in. A record is a line, so files of any size split; all of its columns are
    parsed, whichever are read later. header: lines that only repeat the
    schema's names are no records.
    """
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"{fmt} has no malformed records: its files carry their types")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if fmt != "json":
        options["sep"] = "\t" if fmt == "tsv" else ","
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value").filter(F.trim("value") != "")
    parse = F.from_json if fmt == "json" else F.from_csv
    parsed = lines.withColumn("r", parse("value", f"{schema}, {CORRUPT} string", options))
    columns = [f.name for f in parsed.schema["r"].dataType if f.name != CORRUPT]
    if header:
        parsed = parsed.filter(F.col("value") != options["sep"].join(columns))
    sound = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    rows = parsed.filter(sound).select(*[F.col(f"r.`{c}`").alias(c) for c in columns])
    return rows, parsed.filter(~sound).select("file_path", F.col("value").alias("record"))


def read_base_tables(spark: SparkSession, path: str, names: list[str], fmt: str = "parquet", schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    schemas = schemas or {}
    return {n: read_base_table(spark, os.path.join(path, n), fmt, schemas.get(n)) for n in names}


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A base table straight from a server, read in parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def write_mart(df: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """One result table, partitioned by snapshot. Only the snapshots that are written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_marts(marts: dict[str, DataFrame], path: str) -> None:
    for name, df in marts.items():
        write_mart(df, os.path.join(path, name))


def write_documents(parts: DataFrame, path: str) -> None:
    """Document parts as JSON lines, one directory per snapshot. Only the snapshots that are written are replaced."""
    lines = parts.select("snapshot_date", F.to_json(F.struct(*[c for c in parts.columns if c != "snapshot_date"])).alias("value"))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").text(path)


def write_cluster_documents(lines: DataFrame, path: str, keys: list[str] = CLUSTER_KEYS) -> None:
    """One JSON file per cluster and snapshot from operators.documents.document_lines, in a folder named by both.

    The lines of a cluster come sorted from one task, which writes them as they
    pass. Only the clusters and snapshots that are written are replaced.
    """
    lines.select(*keys, "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)
